"""Clipping records to a query or reference window, with their per-base tags.

A clip cuts whole and partial operations off both ends of the CIGAR, then takes the same window
[offset, offset + length) of the sequence, the qualities and each per-base tag. Tags are clipped by a
strategy registered for their key; a strategy returns the new value, or None where the tag's value
contradicts the record, and the tag is then removed.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom import schema as S
from readloom.functions.cigar import QUERY_OPS, REFERENCE_OPS
from readloom.functions.sequence import reverse_complement_py

Ops = list[tuple[str, int]]


# --- CIGAR ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Clip:
    """What is left of an alignment: its operations, the window of the sequence, its position."""

    cigar: Ops
    offset: int
    length: int
    pos: int


def cut_front(cigar: Ops, count: int, counted: str) -> tuple[Ops, dict[str, int]]:
    """cigar without its first count positions of the counted operations, and what was cut of query and reference.

    Operations that aren't counted go as long as there is something left to cut.
    """
    cut = {"query": 0, "reference": 0, "left": count}
    at = 0
    while at < len(cigar) and cut["left"] > 0:
        op, n = cigar[at]
        taken = min(n, cut["left"]) if op in counted else n
        if op in counted:
            cut["left"] -= taken
        cut["query"] += taken if op in QUERY_OPS else 0
        cut["reference"] += taken if op in REFERENCE_OPS else 0
        if taken < n:
            return [(op, n - taken), *cigar[at + 1 :]], cut
        at += 1
    return cigar[at:], cut


def cut_back(cigar: Ops, count: int, counted: str) -> tuple[Ops, dict[str, int]]:
    left, cut = cut_front(cigar[::-1], count, counted)
    return left[::-1], cut


def clip_cigar_to_query(cigar: Ops, start: int, end: int, query_start: int, query_end: int, pos: int, reverse: bool) -> Clip:
    """Keeps the query window [start, end) of a record that covers [query_start, query_end).

    On the reverse strand the window is mirrored. Bases that no operation holds (an unaligned record) are cut as well.
    """
    front, back = max(0, start - query_start), max(0, query_end - end)
    if reverse:
        front, back = back, front
    left, cut = cut_front(cigar, front, QUERY_OPS)
    left, _ = cut_back(left, back, QUERY_OPS)
    return Clip(left, cut["query"] + cut["left"], end - start, pos + cut["reference"])


def clip_cigar_to_reference(cigar: Ops, start: int, end: int, pos: int, reverse: bool, excise: bool = False) -> Clip:
    """Keeps the reference window [start, end); with excise an insertion that then stands at either end goes too.

    On the reverse strand the window of the sequence is mirrored.
    """
    span = sum(n for op, n in cigar if op in REFERENCE_OPS)
    total = sum(n for op, n in cigar if op in QUERY_OPS)
    left, front = cut_front(cigar, max(0, start - pos), REFERENCE_OPS)
    left, back = cut_back(left, max(0, pos + span - end), REFERENCE_OPS)
    gone = [front["query"], back["query"]]
    if excise:
        for side in (0, -1):
            if left and left[side][0] == "I":
                gone[side] += left.pop(side)[1]
    if reverse:
        gone.reverse()
    return Clip(left, gone[0], max(0, total - sum(gone)), max(pos, start))


# --- base modifications --------------------------------------------------------------------

_MODIFICATION = re.compile(r"(..(?:[0-9]+|[A-Za-z]*)[?.]?)((?:,?-?[0-9]+)*)", re.S)


def parse_modifications(text: str) -> list[tuple[str, list[int]]]:
    """(prefix, skips) of each part of an MM tag; parts of under three characters are left out."""
    out = []
    for part in text.split(";"):
        if len(part) >= 3 and (m := _MODIFICATION.match(part)):
            out.append((m[1], [int(x) for x in re.findall(r"-?[0-9]+", m[2])]))
    return out


def format_modifications(parts: list[tuple[str, list[int]]]) -> str:
    return "".join(",".join([prefix, *map(str, skips)]) + ";" for prefix, skips in parts)


def modification_codes(prefix: str) -> int:
    """Modifications that share one list of sites: one for a numeric code, else one a letter."""
    code = prefix[2:].rstrip("?.")
    return 1 if code[:1].isdecimal() else len(code)


def clip_sites(prefix: str, skips: list[int], seq: str, offset: int, length: int, reverse: bool) -> tuple[int, list[int]]:
    """Number of sites before the window, and the skips of those in it.

    Sites count bases in the original orientation: a reverse record counts the complement from its end.
    """
    base, window = prefix[0], seq[offset : offset + length]
    before = seq[offset + length :] if reverse else seq[:offset]
    if base == "N":
        skipped, inside = len(before), len(window)
    else:
        base = reverse_complement_py(base) if reverse else base
        skipped, inside = before.count(base), window.count(base)
    ordinals = list(itertools.accumulate(s + 1 for s in skips))
    first, last = bisect_left(ordinals, skipped + 1), bisect_right(ordinals, skipped + inside)
    kept = skips[first:last]
    if kept:
        kept[0] = ordinals[first] - skipped - 1
    return first, kept


# --- tag strategies ------------------------------------------------------------------------


@dataclass(frozen=True)
class Context:
    """The record as it was before the clip."""

    seq: str
    reverse: bool
    pulses: str
    modifications: str


Strategy = Callable[[dict, int, int, Context], dict | None]


def _window(value: dict, offset: int, length: int) -> dict | None:
    """Elements [offset, offset + length); a shorter value is no per-base track and stays."""
    for name in ("s", "ai", "af"):
        track = value[name]
        if track is not None and value["t"] in "ZHB":
            return value if offset + length > len(track) else {**value, name: track[offset : offset + length]}
    return None


def clip_track(value: dict, offset: int, length: int, record: Context) -> dict | None:
    return _window(value, offset, length)


def clip_mirrored_track(value: dict, offset: int, length: int, record: Context) -> dict | None:
    """Tracks of the other strand run against the sequence."""
    if offset + length > len(record.seq):
        return None
    return _window(value, len(record.seq) - offset - length, length)


def clip_pulses(value: dict, offset: int, length: int, record: Context) -> dict | None:
    """Tracks with an element for each pulse: the window from its first to its last called base (upper case)."""
    if not length:
        return _window(value, 0, 0)
    called = [i for i, c in enumerate(record.pulses) if "A" <= c <= "Z"]
    if offset + length > len(called):
        return None
    first, last = called[offset], called[offset + length - 1]
    return _window(value, first, last - first + 1)


def clip_modifications(value: dict, offset: int, length: int, record: Context) -> dict | None:
    """MM (text) and ML (numbers, of each part all its sites' values)."""
    if not record.seq:
        return None
    if value["t"] == "Z":
        parts = parse_modifications(value["s"])
        return {**value, "s": format_modifications([(p, clip_sites(p, s, record.seq, offset, length, record.reverse)[1]) for p, s in parts])}
    if value["t"] != "B" or not record.modifications or value["ai"] is None:
        return None
    parts = parse_modifications(record.modifications)
    if len(value["ai"]) < sum(len(s) * modification_codes(p) for p, s in parts):
        return None
    kept, at = [], 0
    for prefix, skips in parts:
        first, inside = clip_sites(prefix, skips, record.seq, offset, length, record.reverse)
        each = modification_codes(prefix)
        kept += value["ai"][at + first * each : at + (first + len(inside)) * each]
        at += len(skips) * each
    return {**value, "ai": kept}


def clip_runs(value: dict, offset: int, length: int, record: Context) -> dict | None:
    """Pairs (run length, coverage) of bytes whose runs cover the sequence."""
    flat = value["ai"]
    if value["t"] != "B" or value["et"] not in ("C", "c"):
        return None
    if not length:
        return {**value, "et": value["et"], "ai": []}
    if len(flat) % 2 or sum(flat[::2]) != len(record.seq) or offset + length > len(record.seq):
        return None
    out, at = [], 0
    for run, coverage in zip(flat[::2], flat[1::2], strict=True):
        inside = min(at + run, offset + length) - max(at, offset)
        if inside > 0:
            out += [inside, coverage]
        at += run
    return {**value, "et": "C", "ai": out}


#: Strategy of each per-base tag. More can be registered.
STRATEGIES: dict[str, Strategy] = {
    **dict.fromkeys("dq iq mq sq dt st ip pw fi fp sm sx".split(), clip_track),
    **dict.fromkeys("ri rp".split(), clip_mirrored_track),
    **dict.fromkeys("pc pt pq pv pg pa pm ps pi pd px pe sf".split(), clip_pulses),
    **dict.fromkeys("MM ML".split(), clip_modifications),
    "sa": clip_runs,
}


def clip_tags(tags: dict[str, dict], offset: int, length: int, seq: str, reverse: bool, strategies: dict[str, Strategy] | None = None) -> dict[str, dict]:
    def text(key: str) -> str:
        return (tags.get(key) or {}).get("s") or ""

    record, out = Context(seq, reverse, text("pc"), text("MM")), {}
    for key, value in tags.items():
        strategy = (STRATEGIES if strategies is None else strategies).get(key)
        value = strategy(value, offset, length, record) if strategy else value
        if value is not None:
            out[key] = value
    if "MN" in out:  # the length that MM and ML refer to
        out["MN"] = int_value(length)
    return out


def int_value(x: int) -> dict:
    return {"t": "i", "i": x, "f": None, "s": None, "et": None, "ai": None, "af": None}


def query_bounds(row: dict) -> tuple[int, int]:
    """qs and qe, by default the whole sequence."""
    tags = row["tags"] or {}

    def number(key: str, default: int) -> int:
        value = tags.get(key)
        if value is None:
            return default
        if value["t"] == "A":
            return ord(value["s"])
        if value["t"] != "i":
            raise ValueError(f"tag {key} is no number")
        return value["i"]

    return number("qs", 0), number("qe", len(row["seq"] or ""))


def clip_record(row: dict, kind: str, start: int, end: int, excise: bool = False, strategies: dict[str, Strategy] | None = None) -> dict:
    """The row clipped to a 'query' or 'reference' window; an unmapped record has no reference window and stays."""
    if kind == "reference" and row["flag"] & S.UNMAPPED:
        return row
    seq, reverse = row["seq"] or "", bool(row["flag"] & S.REVERSE)
    cigar = [(o["op"], o["len"]) for o in row["cigar"] or ()]
    query_start, query_end = query_bounds(row)
    if kind == "query":
        clip = clip_cigar_to_query(cigar, start, end, query_start, query_end, row["pos"], reverse)
    elif kind == "reference":
        clip = clip_cigar_to_reference(cigar, start, end, row["pos"], reverse, excise)
    else:
        raise ValueError(f"unknown window: {kind}")
    window = slice(clip.offset, clip.offset + clip.length)
    tags = clip_tags(row["tags"] or {}, clip.offset, clip.length, seq, reverse, strategies)
    if "qs" in tags:
        bounds = (start, end) if kind == "query" else (query_start + clip.offset, query_start + clip.offset + clip.length)
        tags |= {"qs": int_value(bounds[0]), "qe": int_value(bounds[1])}
    return row | {
        "cigar": [{"op": op, "len": n} for op, n in clip.cigar],
        "pos": clip.pos,
        "seq": seq[window],
        "qual": row["qual"][window] if row["qual"] else row["qual"],
        "tags": tags,
    }


# --- DataFrames ----------------------------------------------------------------------------


def map_records(reads: DataFrame, change: Callable[[dict], dict]) -> DataFrame:
    """reads with each record changed by a Python function on its row, in Arrow batches.

    The columns of the reads schema come back as that schema has them; other columns are handed to the
    function with the row and stay as they are.
    """
    from readloom.sources.bam import ARROW
    from readloom.sources.columns import array_of, rows_of_batch

    columns, schema = reads.columns, reads.schema
    typed = {f.name: f.type for f in ARROW}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed = [change(r) for r in rows_of_batch(batch)]
            arrays = []
            for i, name in enumerate(columns):
                if name in typed:
                    arrays.append(array_of([r[name] for r in changed], typed[name]))
                else:
                    arrays.append(batch.column(i))
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return reads.mapInArrow(run, schema)


def clip(reads: DataFrame, kind: str, start: str = "clip_start", end: str = "clip_end", excise: bool = False, strategies: dict[str, Strategy] | None = None, only: list[str] | None = None) -> DataFrame:
    """Each read clipped to its own window, given in two of its columns; reads with a null there stay.

    only: tags that are wanted; tags is then a struct of these (null: the read has none), which is much faster than a map.
    With strategies of one's own records are handed to Python, otherwise all is done in columns.
    """
    from readloom.operators import clip_columns

    if kind not in ("query", "reference"):
        raise ValueError(f"unknown window: {kind}")
    if (keys := keys_by_strategy(strategies)) is not None:
        return clip_columns.clip(reads, kind, F.col(start), F.col(end), excise, keys, only)
    table = dict(STRATEGIES if strategies is None else strategies)  # workers import a table of their own

    def change(row: dict) -> dict:
        if row[start] is None or row[end] is None:
            return row
        return clip_record(row, kind, row[start], row[end], excise, table)

    clipped = map_records(reads, change)
    if only is None:
        return clipped
    return clipped.withColumn("tags", F.struct(*(F.col("tags")[key].alias(key) for key in only)))


def keys_by_strategy(strategies: dict[str, Strategy] | None = None) -> dict[str, list[str]] | None:
    """The tags that each strategy of this module is for, by its name; None if there are others, or tags that every clip sets."""
    known = (clip_track, clip_mirrored_track, clip_pulses, clip_modifications, clip_runs)
    keys: dict[str, list[str]] = {}
    for key, strategy in (STRATEGIES if strategies is None else strategies).items():
        if strategy not in known or key in ("MN", "qs", "qe"):
            return None
        keys.setdefault(strategy.__name__, []).append(key)
    return keys


def place(reads: DataFrame, ref_id: int, pos: int, reverse: bool, cigar: str, mapq: int) -> DataFrame:
    """Each read mapped to a place: flags set, sequence and qualities turned where the strand changes."""
    from readloom.functions.cigar import parse_cigar
    from readloom.functions.flags import is_reverse
    from readloom.functions.sequence import reverse_complement

    turns = is_reverse(F.col("flag")) != F.lit(reverse)
    flag = F.col("flag").bitwiseAND(~(S.UNMAPPED | S.REVERSE) & 0xFFFF).bitwiseOR(S.REVERSE if reverse else 0)
    return reads.withColumns(
        {
            "seq": F.when(turns, reverse_complement(F.col("seq"))).otherwise(F.col("seq")),
            "qual": F.when(turns, F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex("qual"), F.lit(".."), F.lit(0))), ""))).otherwise(F.col("qual")),
            "flag": flag,
            "ref_id": F.lit(ref_id),
            "pos": F.lit(pos),
            "cigar": parse_cigar(F.lit(cigar)),
            "mapq": F.lit(mapq).cast("smallint"),
        }
    )


def set_mate(reads: DataFrame, next_ref_id: int, next_pos: int, tlen: int) -> DataFrame:
    return reads.withColumns({"next_ref_id": F.lit(next_ref_id), "next_pos": F.lit(next_pos), "tlen": F.lit(tlen)})
