import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readloom.functions.sequence import reverse_complement, reverse_complement_py
from readloom.operators import clip as C
from readloom.operators import lossless as L
from readloom.sources import sam
from readloom.sources.records import tag
from tests.samples import write_sam


def ops(text):
    import re

    return [(op, int(n)) for n, op in re.findall("([0-9]+)([MIDNSHP=X])", text)]


def text(cigar):
    return "".join(f"{n}{op}" for op, n in cigar)


@pytest.mark.parametrize(
    ("cigar", "window", "reverse", "left", "offset", "pos"),
    [
        ("10=", (2, 8), False, "6=", 2, 102),
        ("10=", (0, 10), False, "10=", 0, 100),
        ("5=2D5=", (5, 10), False, "2D5=", 5, 105),
        ("5=2D5=", (6, 10), False, "4=", 6, 108),
        ("2S8=", (3, 10), False, "7=", 3, 101),
        ("3=1I6=", (0, 9), True, "2=1I6=", 1, 101),
        ("10=", (3, 10), True, "7=", 0, 100),
        ("", (3, 8), False, "", 3, 100),
    ],
)
def test_clip_to_query(cigar, window, reverse, left, offset, pos):
    got = C.clip_cigar_to_query(ops(cigar), *window, 0, 10, 100, reverse)
    assert (text(got.cigar), got.offset, got.length, got.pos) == (left, offset, window[1] - window[0], pos)


@pytest.mark.parametrize(
    ("cigar", "window", "reverse", "excise", "left", "offset", "length", "pos"),
    [
        ("10=", (102, 107), False, False, "5=", 2, 5, 102),
        ("10=", (0, 500), False, False, "10=", 0, 10, 100),
        ("5=2D5=", (106, 110), False, False, "1D3=", 5, 3, 106),
        ("4=2I4=", (104, 108), False, False, "2I4=", 4, 6, 104),
        ("4=2I4=", (104, 108), False, True, "4=", 6, 4, 104),
        ("4=2I4=", (100, 104), True, True, "4=", 6, 4, 100),
    ],
)
def test_clip_to_reference(cigar, window, reverse, excise, left, offset, length, pos):
    got = C.clip_cigar_to_reference(ops(cigar), *window, 100, reverse, excise)
    assert (text(got.cigar), got.offset, got.length, got.pos) == (left, offset, length, pos)


def test_tag_strategies():
    record = C.Context("ACGTACGTAC", False, "AcCgGTACGTaAC", "C+m?,0,1;N+x,3;")
    track = tag("B", et="C", ai=list(range(10)))
    assert C.clip_track(track, 2, 5, record)["ai"] == [2, 3, 4, 5, 6]
    assert C.clip_mirrored_track(track, 2, 5, record)["ai"] == [3, 4, 5, 6, 7]
    assert C.clip_track(tag("B", et="C", ai=[]), 2, 5, record)["ai"] == []
    assert C.clip_mirrored_track(track, 8, 5, record) is None
    pulses = tag("Z", s="abcdefghijklm")
    assert C.clip_pulses(pulses, 1, 3, record)["s"] == "cdef"
    assert C.clip_pulses(pulses, 8, 9, record) is None and C.clip_pulses(pulses, 0, 0, record)["s"] == ""
    assert C.clip_runs(tag("B", et="C", ai=[4, 7, 6, 9]), 3, 4, record)["ai"] == [1, 7, 3, 9]
    assert C.clip_runs(tag("B", et="C", ai=[4, 7, 5, 9]), 3, 4, record) is None
    assert C.clip_modifications(tag("Z", s=record.modifications), 1, 6, record)["s"] == "C+m?,0;N+x,2;"
    assert C.clip_modifications(tag("B", et="C", ai=[1, 2, 3]), 1, 6, record)["ai"] == [1, 3]
    assert C.clip_modifications(tag("B", et="C", ai=[1]), 1, 6, record) is None
    assert C.parse_modifications("C+mh?,1,2;C+76792,3;;x;T-a;") == [("C+mh?", [1, 2]), ("C+76792", [3]), ("T-a", [])]
    assert [C.modification_codes(p) for p in ("C+mh?", "C+76792.", "T-a")] == [2, 1, 1]


def slow_sites(prefix, skips, seq, offset, length, reverse):
    """Sites by walking the original read."""
    original = reverse_complement_py(seq) if reverse else seq
    places, seen, todo = [], 0, list(skips)
    for i, c in enumerate(original):
        if prefix[0] in ("N", c) and todo:
            if seen == todo[0]:
                places.append(i)
                todo.pop(0)
                seen = 0
            else:
                seen += 1
    lo, hi = (len(seq) - offset - length, len(seq) - offset) if reverse else (offset, offset + length)
    inside = [p for p in places if lo <= p < hi]
    out, at = [], lo
    for p in inside:
        out.append(sum(prefix[0] in ("N", c) for c in original[at:p]))
        at = p + 1
    return sum(p < lo for p in places), out


@settings(max_examples=200, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=40), st.lists(st.integers(0, 3), max_size=6), st.sampled_from("ACGTN"), st.booleans(), st.data())
def test_sites_against_a_walk(seq, skips, base, reverse, data):
    total = len(seq) if base == "N" else (reverse_complement_py(seq) if reverse else seq).count(base)
    while sum(skips) + len(skips) > total:
        skips.pop()
    left = data.draw(st.integers(0, len(seq)))
    right = data.draw(st.integers(left, len(seq)))
    got = C.clip_sites(base + "+m", list(skips), seq, left, right - left, reverse)
    assert got == slow_sites(base + "+m", skips, seq, left, right - left, reverse)


def record(rng, n=40):
    seq = "".join(rng.choice("ACGT") for _ in range(n))
    number = lambda et: tag("B", et=et, ai=[rng.randrange(200) for _ in range(n)])
    sites = [rng.randrange(2) for _ in range(seq.count("C") // 3)]
    runs, left = [], n
    while left:
        k = rng.randint(1, min(left, 9))
        runs += [k, rng.randrange(30)]
        left -= k
    tags = {"ip": number("C"), "rp": number("S"), "sm": number("i"), "sa": tag("B", et="S", ai=runs), "MN": tag("i", i=n), "zm": tag("i", i=3)}
    tags["MM"] = tag("Z", s="".join([f"C+m?{''.join(f',{x}' for x in sites)};"]))
    tags["ML"] = tag("B", et="C", ai=[rng.randrange(256) for _ in sites])
    return {"qname": "m/3/ccs", "flag": 4, "pos": -1, "cigar": [], "seq": seq, "qual": bytes(rng.randrange(60) for _ in range(n)), "tags": tags}


@pytest.mark.parametrize("seed", range(30))
def test_restore_undoes_chained_clips(seed):
    rng = random.Random(seed)
    row = record(rng)
    out = row | {"tags": row["tags"] | {"bc": tag("B", et="S", ai=[3, 4]), "bq": tag("i", i=99), "RG": tag("Z", s="abcd1234/3--4"), "cx": tag("i", i=12)}}
    for _ in range(rng.randint(1, 3)):
        n = len(out["seq"])
        left = rng.randint(0, n // 3)
        out = L.clip_lossless(out, left, rng.randint(left + 1, n))
    back = L.restore(out)
    assert back == row | {"tags": row["tags"] | {"RG": tag("Z", s="abcd1234")}}


def test_lossless_refuses_what_it_cannot_keep():
    row = record(random.Random(1))
    assert L.clip_lossless(row, 0, 40) == row and L.clip_lossless(row, 5, 5) == row
    with pytest.raises(ValueError):
        L.clip_lossless(row | {"tags": row["tags"] | {"pc": tag("Z", s="A")}}, 1, 5)
    with pytest.raises(ValueError):
        L.clip_lossless(row | {"tags": row["tags"] | {"sa": tag("B", et="C", ai=[1, 1])}}, 1, 5)


@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.text(max_size=40), lambda x: st.lists(x, max_size=20) | st.dictionaries(st.text(max_size=5), x, max_size=20)))
def test_msgpack_round_trip(value):
    assert L.unpack(L.pack(value)) == value


def test_clip_of_a_frame(spark, tmp_path):
    reads = sam.read_sam(spark, write_sam(tmp_path / "a.sam")).withColumns({"clip_start": F.when(F.length("seq") >= 10, 2), "clip_end": F.lit(8)})
    got = {(r["qname"], r["flag"]): r for r in C.clip(reads, "query").collect()}
    assert got["m/1/0_10", 0]["seq"] == "GTACGT" and got["m/1/0_10", 0]["pos"] == 12 and got["m/1/0_10", 0]["tags"]["zm"]["i"] == 1
    assert got["m/5/0_4", 4]["seq"] == "ACGT"
    back = L.restore_reads(L.clip_reads(reads))
    fields = ["qname", "flag", "seq", "qual"]
    assert sorted(map(str, back.select(fields).collect())) == sorted(map(str, reads.select(fields).collect()))
    placed = C.place(reads.where("flag = 4"), 1, 7, True, "4M", 20).first()
    assert (placed["flag"], placed["seq"], placed["ref_id"], placed["cigar"][0]["len"]) == (16, "ACGT", 1, 4)
    turned = reads.where("flag = 4").select(reverse_complement(F.lit("ACGTNRuX=a")).alias("x")).first()["x"]
    assert turned == reverse_complement_py("ACGTNRuX=a") == "t=NaYNACGT"
