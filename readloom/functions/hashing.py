"""Hashes of the sampling operators, as columns and on the driver.

Spark's arithmetic raises on overflow in ANSI mode, so 32-bit hashes live in BIGINT and are
masked after each step, and 64-bit products are built from 16-bit limbs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32, MASK64 = 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF
BUCKETS = 1 << 24


def signed64(x: int) -> int:
    x &= MASK64
    return x - (1 << 64) if x >> 63 else x


def _and(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit(signed64(bits)).cast("bigint"))


# --- 32 bits -----------------------------------------------------------------------------


def x31(text: Column) -> Column:
    """X31 string hash over signed bytes, as an unsigned 32-bit number in a BIGINT; '' is 0."""
    zero = F.lit(0).cast("bigint")
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.hex(F.substring(text.cast("binary"), i, F.lit(1))), 16, 10).cast("bigint"))
    any_text = F.aggregate(octets, zero, lambda h, c: _and(h * 31 + F.when(c > 127, c - 256).otherwise(c), MASK32))
    # Names are ASCII as a rule: a byte is then a character.
    ascii_text = F.aggregate(F.split(text, ""), zero, lambda h, c: _and(h * 31 + F.ascii(c), MASK32))
    return F.when(F.octet_length(text) == 0, zero).when(F.octet_length(text) == F.length(text), ascii_text).otherwise(any_text)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def wang(key: Column) -> Column:
    """Wang's 32-bit integer mix of an unsigned number in a BIGINT."""

    def negated(k: Column, bits: int) -> Column:
        return F.lit(MASK32) - _and(F.shiftleft(k, bits), MASK32)

    steps = (
        lambda k: _and(k + negated(k, 15), MASK32),
        lambda k: k.bitwiseXOR(F.shiftright(k, 10)),
        lambda k: _and(k + F.shiftleft(k, 3), MASK32),
        lambda k: k.bitwiseXOR(F.shiftright(k, 6)),
        lambda k: _and(k + negated(k, 11), MASK32),
        lambda k: k.bitwiseXOR(F.shiftright(k, 16)),
    )
    for step in steps:
        key = bind(key, step)
    return key


def name_bucket(name: Column, scrambled: int = 0) -> Column:
    """The 24-bit sampling bucket of a read name."""
    return _and(wang(x31(name).bitwiseXOR(F.lit(scrambled & MASK32).cast("bigint"))), BUCKETS - 1)


def x31_py(text: str) -> int:
    h = 0
    for b in text.encode():
        h = (h * 31 + (b - 256 if b > 127 else b)) & MASK32
    return h


def wang_py(k: int) -> int:
    k = (k + (~(k << 15) & MASK32)) & MASK32
    k ^= k >> 10
    k = (k + (k << 3)) & MASK32
    k ^= k >> 6
    k = (k + (~(k << 11) & MASK32)) & MASK32
    return k ^ (k >> 16)


def fraction_cutoff(fraction: float) -> int:
    """Buckets under this number are kept."""
    scaled = fraction * BUCKETS
    return min(BUCKETS, int(scaled) + (scaled > int(scaled)))


def scrambled_seed(seed: int) -> int:
    """First output of the C library's additive-feedback generator for a seed; 0 stays 0."""
    if seed == 0:
        return 0
    state = [seed if seed < 2**31 else seed - 2**32]
    for _ in range(30):
        high, low = int(state[-1] / 127773), 0
        low = state[-1] - high * 127773
        word = 16807 * low - 2836 * high
        state.append(word + 2147483647 if word < 0 else word)
    state = [x & MASK32 for x in state]
    state += state[:3]  # r[31..33] repeat r[0..2]
    for i in range(34, 345):
        state.append((state[i - 31] + state[i - 3]) & MASK32)
    return state[344] >> 1


def fnv1a(text: bytes) -> int:
    """FNV-1a of 32 bits."""
    h = 2166136261
    for b in text:
        h = ((h ^ b) * 16777619) & MASK32
    return h


# --- 64 bits -----------------------------------------------------------------------------


def multiply64(x: Column, factor: int) -> Column:
    """x * factor modulo 2**64 on two's complement BIGINTs.

    With x = h * 2**32 + l and factor = g * 2**32 + f the result is l * f + (l * g + h * f) * 2**32; halves of
    the factor of 16 bits keep each product under 2**48.
    """
    parts = [factor >> 16 * i & 0xFFFF for i in range(4)]

    def product(v: Column) -> Column:
        low, high = v.bitwiseAND(MASK32), F.shiftrightunsigned(v, 32)
        upper = low * parts[2] + high * parts[0] + F.shiftleft((low * parts[3] + high * parts[1]).bitwiseAND(0xFFFF), 16)
        bottom, middle = low * parts[0], low * parts[1]
        rest = F.shiftright(bottom, 16) + middle
        upper = (upper + F.shiftright(rest, 16)).bitwiseAND(MASK32)
        return F.shiftleft(upper, 32).bitwiseOR(F.shiftleft(rest.bitwiseAND(0xFFFF), 16)).bitwiseOR(bottom.bitwiseAND(0xFFFF))

    return bind(x, product)


#: Multipliers and increment of the SplitMix64 generator.
MIX_A, MIX_B, GOLDEN = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def mix64(x: Column) -> Column:
    """The SplitMix64 finaliser."""
    x = multiply64(bind(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 30))), MIX_A)
    x = multiply64(bind(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 27))), MIX_B)
    return bind(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 31)))


def mix64_py(x: int) -> int:
    x &= MASK64
    x = ((x ^ (x >> 30)) * MIX_A) & MASK64
    x = ((x ^ (x >> 27)) * MIX_B) & MASK64
    return x ^ (x >> 31)


class SplitMix:
    """SplitMix64 stream."""

    def __init__(self, seed: int):
        self.state = seed & MASK64

    def next(self) -> int:
        self.state = (self.state + GOLDEN) & MASK64
        return mix64_py(self.state)
