"""Qualities as SAM text and back, without an expression for each character."""

from __future__ import annotations

import pyarrow as pa

from readloom.functions import sam_text
from readloom.sources import sam


def test_qualities_as_text_and_back(spark):
    quals = [bytes(range(94)), b"\0", b"", None, b"\0\0\x5d", bytes([30] * 200)]
    frame = spark.createDataFrame([(i, q) for i, q in enumerate(quals)], "i int, qual binary")
    column = sam_text.phred_text(frame["qual"])
    texts = [r[0] for r in sorted(frame.select(column.alias("t"), "i").collect(), key=lambda r: r["i"])]
    assert texts == ["".join(chr(b + 33) for b in q) if q else "*" for q in quals]
    assert "lambdafunction" not in str(column._jc) and "transform" not in str(column._jc)
    found = pa.array(["I!~", None, "", "!"])
    assert sam._qualities(found).to_pylist() == [b"\x28\0\x5d", None, b"", b"\0"]
    assert sam._qualities(found.slice(2)).to_pylist() == [b"", b"\0"] and sam._qualities(pa.array([], pa.string())).to_pylist() == []
