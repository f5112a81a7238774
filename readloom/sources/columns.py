"""Arrow columns as Python values and back, with the elements of lists converted at once for a whole column."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate, chain, pairwise

import pyarrow as pa

_T = pa.types


def values_of(column: pa.Array, repeated: bool = False) -> list:
    """As column.to_pylist(maps_as_pydicts="strict"); repeated: its texts are few and occur often."""
    kind, n = column.type, len(column)
    if column.null_count == n:
        return [None] * n
    if _T.is_map(kind) or _T.is_list(kind):
        ends = column.offsets.to_numpy().tolist()
        first = ends[0]

        def inner(child: pa.Array) -> list:
            return values_of(child.slice(first, ends[-1] - first), True)

        spans = pairwise([e - first for e in ends])
        if _T.is_map(kind):
            keys, items = inner(column.keys), inner(column.items)
            out = [dict(zip(keys[a:b], items[a:b], strict=True)) for a, b in spans]
            if sum(map(len, out)) != len(keys):
                raise KeyError("a map holds a key twice")
        else:
            flat = inner(column.values)
            out = [flat[a:b] for a, b in spans]
    elif _T.is_struct(kind):
        names = [f.name for f in kind]
        out = [dict(zip(names, v, strict=True)) for v in zip(*(values_of(c, True) for c in column.flatten()), strict=True)]
    elif _T.is_integer(kind) or _T.is_float32(kind) or _T.is_float64(kind):
        out = (column.fill_null(0) if column.null_count else column).to_numpy(zero_copy_only=False).tolist()
    elif repeated and _T.is_string(kind):
        coded = column.dictionary_encode()
        texts = [*coded.dictionary.to_pylist(), None]
        return [texts[i] for i in coded.indices.fill_null(len(texts) - 1).to_numpy(zero_copy_only=False).tolist()]
    else:
        return column.to_pylist()
    if column.null_count:
        valid = column.is_valid().to_numpy(zero_copy_only=False).tolist()
        out = [v if there else None for v, there in zip(out, valid, strict=True)]
    return out


def rows_of_batch(batch: pa.RecordBatch) -> list[dict]:
    names = batch.schema.names
    return [dict(zip(names, v, strict=True)) for v in zip(*map(values_of, batch.columns), strict=True)] if names else [{}] * batch.num_rows


def array_of(values: list, kind: pa.DataType) -> pa.Array:
    """As pa.array(values, kind); maps are given as dicts, and fields that a struct's dict lacks are null."""
    nested = _T.is_map(kind) or _T.is_list(kind)
    if not (nested or _T.is_struct(kind)):
        return pa.array(values, kind)
    missing = [v is None for v in values]
    mask = pa.array(missing) if any(missing) else None
    if not nested:
        fields = [array_of([None if v is None else v.get(f.name) for v in values], f.type) for f in kind]
        return pa.StructArray.from_arrays(fields, fields=list(kind), mask=mask)
    given: Iterable = [v for v in values if v is not None] if mask is not None else values
    ends = pa.array(accumulate((0 if v is None else len(v) for v in values), initial=0), pa.int32())
    if _T.is_map(kind):
        keys = array_of(list(chain.from_iterable(given)), kind.key_type)
        items = array_of([x for v in given for x in v.values()], kind.item_type)
        return pa.MapArray.from_arrays(ends, keys, items, kind, mask=mask)
    return pa.ListArray.from_arrays(ends, array_of(list(chain.from_iterable(given)), kind.value_type), kind, mask=mask)
