"""Arrow columns as Python values and back, and that the record paths convert lists a column at a time."""

from __future__ import annotations

import time

import pyarrow as pa
import pytest

from readloom.sources.bam import ARROW
from readloom.sources.columns import array_of, rows_of_batch, values_of
from readloom.sources.records import tag

TAGS = [
    {"zm": tag("i", i=5), "ip": tag("B", et="C", ai=[1, 2, 250]), "sn": tag("B", et="f", af=[1.5, -2.25])},
    None,
    {},
    {"xx": tag("Z", s="hé"), "e0": tag("B", et="S", ai=[]), "none": None},
    {"zm": tag("i", i=-(2**40)), "rq": tag("f", f=0.5)},
]
CIGARS = [[{"op": "M", "len": 3}, {"op": "S", "len": 9}], [], None, [{"op": "=", "len": 0}], []]


@pytest.mark.parametrize("name, values", [("tags", TAGS), ("cigar", CIGARS), ("qual", [b"", None, b"\0\xff", b"a", b""]), ("qname", ["a", None, "", "a", "b"]), ("rec_no", [1, None, 2**60, 0, -1])])
def test_columns_there_and_back(name, values):
    kind = ARROW.field(name).type
    plain = [None if v is None else list(v.items()) for v in values] if name == "tags" else values
    column = array_of(values, kind)
    column.validate(full=True)
    assert column.equals(pa.array(plain, kind)) and values_of(column) == values
    for a, b in ((0, 0), (1, 3), (2, 5), (4, 5)):
        assert values_of(column.slice(a, b - a)) == values[a:b]
    assert array_of([], kind).equals(pa.array([], kind)) and values_of(array_of([None], kind)) == [None]


def test_a_key_twice_is_an_error():
    column = pa.array([[("a", None), ("a", None)]], ARROW.field("tags").type)
    with pytest.raises(KeyError):
        values_of(column)


def test_rows_convert_list_elements_in_bulk():
    """Reading rows of long tracks may make no object for each element."""
    batch = pa.RecordBatch.from_arrays([array_of([{"ip": tag("B", et="C", ai=list(range(250)))}] * 4000, ARROW.field("tags").type)], names=["tags"])
    began = time.process_time()
    rows = rows_of_batch(batch)
    took = time.process_time() - began
    began = time.process_time()
    assert rows == batch.to_pylist(maps_as_pydicts="strict")
    assert took < (time.process_time() - began) / 3
