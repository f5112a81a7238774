"""Base sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 4-bit alphabet in code order, and the complements of its letters.
ALPHABET = "=ACMGRSVTWYHKDBN"
LETTERS, COMPLEMENTS = "ACGTMRWSYKVHDBNacgtmrwsykvhdbn=", "TGCAKYWSRMBDHVNtgcakywsrmbdhvn="


def reverse_complement(seq: Column) -> Column:
    """Reverse complement with IUPAC codes and case; '=' stays, U pairs with A, any other character gives N."""
    known = F.regexp_replace(F.translate(F.reverse(seq), "Uu", "Tt"), f"[^{LETTERS}]", "N")
    return F.translate(known, LETTERS, COMPLEMENTS)


def reverse_complement_py(seq: str) -> str:
    table = dict(zip(LETTERS + "Uu", COMPLEMENTS + "Aa", strict=True))
    return "".join(table.get(c, "N") for c in reversed(seq))


def base_at(seq: Column, index: Column) -> Column:
    """The base at a 0-based index."""
    return F.substring(seq, index + 1, F.lit(1))


def reference_md5(seq: Column) -> Column:
    """MD5 of a reference's upper-case sequence without white space."""
    return F.md5(F.upper(F.regexp_replace(seq, r"\s", "")))


def positions_of(seq: Column, letters: str) -> Column:
    """array of the 0-based positions of the given letters."""
    found = F.filter(F.sequence(F.lit(1), F.greatest(F.length(seq), F.lit(1))), lambda i: F.substring(seq, i, F.lit(1)).isin(*letters))
    return F.transform(found, lambda i: i - 1)
