"""Predicates on the flag column."""

from __future__ import annotations

from pyspark.sql import Column

from readloom import schema as S


def has(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(bits) != 0


def is_mapped(flag: Column) -> Column:
    return ~has(flag, S.UNMAPPED)


def is_reverse(flag: Column) -> Column:
    return has(flag, S.REVERSE)


def is_primary(flag: Column) -> Column:
    return ~has(flag, S.SECONDARY | S.SUPPLEMENTARY)


def is_secondary(flag: Column) -> Column:
    return has(flag, S.SECONDARY)


def is_supplementary(flag: Column) -> Column:
    return has(flag, S.SUPPLEMENTARY)
