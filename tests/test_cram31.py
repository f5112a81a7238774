import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.sources import cram_codecs31 as C
from readloom.sources.cram_codecs import COMPRESS

FLAGS = [0, C.ORDER1, C.X32, C.X32 | C.ORDER1, C.PACK, C.RLE, C.PACK | C.RLE | C.ORDER1, C.STRIPE, C.STRIPE | C.RLE, C.CAT, C.PACK | C.CAT]


def samples():
    rng = random.Random(4)
    yield b""
    yield b"a"
    yield bytes([255]) * 300
    yield bytes(range(256)) * 3
    yield bytes(rng.choices(b"ACGT", weights=[9, 1, 3, 2], k=3001))
    yield b"".join(bytes([rng.choice(b"!5?I")]) * rng.randint(1, 40) for _ in range(90))
    yield bytes(rng.randbytes(2000))
    yield bytes([0, 1]) * 700 + bytes(40)


@pytest.mark.parametrize("flags", FLAGS)
def test_nx16_round_trip(flags):
    for data in samples():
        assert C.nx16_decode(C.nx16_encode(data, flags)) == data


@pytest.mark.parametrize("flags", [0, C.ORDER1, C.RLE, C.RLE | C.ORDER1, C.PACK, C.PACK | C.ORDER1, C.STRIPE | C.ORDER1, C.EXTERNAL, C.CAT])
def test_arithmetic_round_trip(flags):
    for data in samples():
        assert C.arithmetic_decode(C.arithmetic_encode(data, flags)) == data


def large_samples():
    rng = random.Random(9)
    yield bytes(rng.choices(b"0123456789/_mcs", weights=range(1, 16), k=70_001))
    yield bytes(rng.choices(range(256), weights=[1 + i % 40 for i in range(256)], k=50_000))
    yield bytes(rng.choices(range(40), k=9_000)) + bytes(20_000)
    yield bytes(rng.choices(b"ACGT", k=33_333))
    yield bytes([30] * 5000 + [255] * 99) * 7
    yield bytes(range(17)) * 500
    yield b"x" * 40_000
    yield rng.randbytes(30_000)
    yield b"ab" * 40


@pytest.mark.parametrize("stream_bytes", [100, 2048, 40_000])
def test_many_streams(monkeypatch, stream_bytes):
    """Streams decoded at once, and one by one as another reader does it."""
    for data in large_samples():
        coded = C.nx16_many(data, stream_bytes)
        assert len(coded) <= len(data) + 5 and C.nx16_decode(coded) == data
        with monkeypatch.context() as m:
            m.setattr(C, "_dealt_at_once", lambda c, n: None)
            assert C.nx16_decode(coded) == data
    data = bytes(random.Random(2).choices(b"ACGTN", weights=[9, 1, 3, 2, 1], k=9_000))
    assert C._dealt_at_once(C.Cursor(C.nx16_encode(data, C.STRIPE | C.X32, 7)[3:]), len(data)) == data  # tables of their own
    assert C._dealt_at_once(C.Cursor(C.nx16_encode(data, C.STRIPE | C.ORDER1, 7)[3:]), len(data)) is None


def test_large_blocks_take_no_step_of_python_for_each_byte():
    import time

    C.register()
    data = bytes(random.Random(5).choices(b"0123456789/_mcs.:;,+", k=400_000))
    began = time.process_time()
    assert C.nx16_decode(COMPRESS[C.NX16](data)) == data
    assert time.process_time() - began < 0.4


@settings(max_examples=120, deadline=None)
@given(st.binary(max_size=400), st.sampled_from(FLAGS))
def test_round_trips_of_any_data(data, flags):
    assert C.nx16_decode(C.nx16_encode(data, flags)) == data
    assert C.arithmetic_decode(C.arithmetic_encode(data, flags & ~(C.X32 | C.CAT))) == data


def test_fixed_streams():
    """Streams put together by hand from the format's description."""
    assert C.uint7(300) == b"\x82\x2c" and C.read7(C.Cursor(b"\x82\x2c")) == 300
    assert C.nx16_decode(bytes([C.CAT]) + b"\x03abc") == b"abc"
    assert C.nx16_decode(bytes([C.CAT | C.NO_SIZE]) + b"abc", 3) == b"abc"
    assert C.nx16_decode(bytes([C.CAT | C.PACK]) + b"\x0a" + b"\x02AB\x02" + bytes([0b10110001, 0b01])) == b"BAAABBABBA"
    assert C.nx16_decode(bytes([C.CAT | C.RLE]) + b"\x06" + bytes([3 << 1 | 1]) + b"\x03" + b"\x01b\x03" + b"abc") == b"abbbbc"
    assert C.nx16_decode(bytes([C.STRIPE]) + b"\x05" + b"\x02\x05\x04" + b"\x20\x03ace" + b"\x20\x02bd") == b"abcde"
    # One symbol of the full frequency leaves the states as they are.
    assert C.nx16_decode(b"\x00\x07" + b"Z\x00" + b"\xa0\x00" + (1 << 15).to_bytes(4, "little") * 4) == b"ZZZZZZZ"


def test_size():
    rng = random.Random(1)
    data = bytes(rng.choices(b"ACGT", weights=[90, 4, 3, 3], k=20_000))
    bound = 20_000 * 0.62 / 8  # bits of its entropy
    assert len(C.nx16_encode(data)) < 1.05 * bound + 60 and len(C.arithmetic_encode(data)) < 1.06 * bound + 60
