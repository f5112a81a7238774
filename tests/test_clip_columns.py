"""The clips in columns against those of single records, and that they hand no record to Python."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom import schema as S
from readloom.operators import clip as C
from readloom.operators import lossless as L
from readloom.sources.records import tag

SCHEMA = T.StructType([*S.READS.fields, T.StructField("clip_start", T.IntegerType()), T.StructField("clip_end", T.IntegerType())])
MODIFICATIONS = ["C+m?,0,1;", "C+mh?,1,0,2;N+x,3,0;", "C+76792.,0;;x;T-a;", "", "G-m,1,,2;A+a,0,2,1", "C+m,2,-"]


def numbers(rng, n, most=300):
    return tag("B", et=rng.choice("CSi"), ai=[rng.randrange(-40, most) for _ in range(n)])


def runs(rng, n):
    out, left = [], n
    while left:
        k = rng.randint(0, min(left, 9))
        out += [k, rng.randrange(30)]
        left -= k
    return out


def record(rng, no, modified=True):
    cigar = [{"op": rng.choice("MIDNSHP=X"), "len": rng.randint(0, 9)} for _ in range(rng.choice([0, 1, 4, 9]))]
    n = rng.choice([0, 1, 30, sum(o["len"] for o in cigar if o["op"] in "MIS=X")])
    seq = "".join(rng.choice("ACGTN") for _ in range(n))
    pulses = "".join(c + "".join(rng.choice("acgt") for _ in range(rng.choice([0, 0, 1, 3]))) for c in (seq if rng.random() < 0.8 else seq[1:]))
    some = {
        **{k: numbers(rng, n if rng.random() < 0.9 else n // 2) for k in ("ip", "ri", "pw", "rp", "xx")},
        "sm": tag("B", et="f", af=[x / 2 for x in range(n)]),
        "dq": tag("Z", s="".join(rng.choice("01é") for _ in range(n))),
        "st": tag("A", s="x"),
        "pc": tag("Z", s=pulses),
        "pd": numbers(rng, len(pulses)),
        "sa": tag("B", et=rng.choice("CCCS"), ai=runs(rng, n) + [1] * rng.choice([0, 0, 0, 1])),
        "MN": tag("i", i=n),
        "qs": rng.choice([tag("i", i=0), tag("i", i=2), tag("A", s="\3")]),
        "qe": tag("i", i=n + rng.choice([0, 2])),
        "bc": tag("B", et="S", ai=[rng.randrange(70000) for _ in range(rng.choice([2, 2, 1]))]),
        "bq": tag("i", i=rng.choice([0, 99, 200, 70000, -5, -200])),
        "RG": tag("Z", s="abcd1234/3--4"),
        "cx": tag("i", i=rng.choice([4, 12, 13])),
        "no": None,
    }
    if modified:
        ml = tag("B", et="C", ai=[rng.randrange(256) for _ in range(rng.choice([0, 2, 4, 9, 20]))])
        some |= {"MM": tag("Z", s=rng.choice(MODIFICATIONS)), "ML": rng.choice([ml, ml, tag("Z", s="C+m,0;")])}
    tags = {k: v for k, v in some.items() if rng.random() < 0.7}
    quals = bytes(rng.randrange(223) for _ in range(n)) if rng.random() < 0.7 else rng.choice([None, b""])
    start = rng.choice([0, 0, 1, 5, n])
    end = start + rng.choice([0, 1, max(0, n - start), max(0, n - start - 2)])
    places = (None, None) if rng.random() < 0.1 else (start, end)
    row = dict.fromkeys(SCHEMA.names) | {"rec_no": no, "qname": rng.choice(["m/1/ccs", "m/1/ccs/rev", "m/1/0_9"]), "flag": rng.choice([0, 0, 4, 16, 20]), "pos": rng.choice([-1, 7])}
    return row | {"cigar": rng.choice([cigar, cigar, cigar, None]), "seq": seq or rng.choice(["", None]), "qual": quals, "tags": tags if rng.random() < 0.95 else None, "clip_start": places[0], "clip_end": places[1]}


def plain(row):
    if hasattr(row, "asDict"):
        row = row.asDict(recursive=True)
    return row | {"qual": None if row["qual"] is None else bytes(row["qual"])}


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in SCHEMA.names) for r in rows], SCHEMA)


def same(reads, expected):
    assert reads.schema.simpleString() == SCHEMA.simpleString()
    got = {r["rec_no"]: plain(r) for r in reads.collect()}
    assert len(got) == len(expected)
    for row in expected:
        assert got[row["rec_no"]] == row


@pytest.mark.parametrize("kind, excise", [("query", False), ("reference", False), ("reference", True)])
def test_clip(spark, kind, excise):
    rng = random.Random(kind + str(excise))
    rows = [record(rng, i) for i in range(600)]
    if kind == "reference":
        rows = [r if r["clip_start"] is None else r | {"clip_start": r["pos"] + r["clip_start"], "clip_end": r["pos"] + r["clip_end"]} for r in rows]
    expected = [r if r["clip_start"] is None else C.clip_record(r, kind, r["clip_start"], r["clip_end"], excise) for r in rows]
    same(C.clip(frame(spark, rows), kind, excise=excise), expected)


def test_clip_of_wanted_tags(spark):
    rng, only = random.Random(5), ["ip", "ri", "sm", "dq", "pc", "pd", "sa", "MN", "qs", "qe", "MM", "bc", "no", "absent"]
    rows = [record(rng, i) for i in range(300)]
    expected = {r["rec_no"]: r if r["clip_start"] is None else C.clip_record(r, "query", r["clip_start"], r["clip_end"]) for r in rows}
    for r in C.clip(frame(spark, rows), "query", only=only).collect():
        row = expected[r["rec_no"]]
        assert plain(r) == row | {"tags": {k: (row["tags"] or {}).get(k) for k in only}}


def test_clip_of_long_modifications(spark):
    rng = random.Random(3)
    seq = "".join(rng.choice("ACGT") for _ in range(30000))
    sites = [rng.randrange(2) for _ in range(3000)]
    tags = {"MM": tag("Z", s="C+m," + ",".join(map(str, sites)) + ";"), "ML": tag("B", et="C", ai=[rng.randrange(256) for _ in sites])}
    rows = [record(rng, i) | {"flag": flag, "seq": seq, "cigar": [{"op": "M", "len": 1}, {"op": "I", "len": 2}] * 10000, "tags": tags, "qual": None, "clip_start": 1000, "clip_end": 20000} for i, flag in enumerate((0, 16))]
    same(C.clip(frame(spark, rows), "query"), [C.clip_record(r, "query", 1000, 20000) for r in rows])


def test_a_number_that_is_none_is_an_error(spark):
    rows = [record(random.Random(1), 0) | {"tags": {"qs": tag("Z", s="3")}, "clip_start": 0, "clip_end": 1}]
    with pytest.raises(Exception, match="tag qs is no number"):
        C.clip(frame(spark, rows), "query").collect()


def test_own_strategies_are_used(spark, monkeypatch):
    rows = [record(random.Random(1), 0) | {"tags": {"xx": tag("i", i=3)}, "clip_start": 0, "clip_end": 1}]
    own = {"xx": lambda value, offset, length, record: None}
    assert C.clip(frame(spark, rows), "query", strategies=own).first()["tags"] == {}
    monkeypatch.setitem(C.STRATEGIES, "xx", own["xx"])
    assert C.clip(frame(spark, rows), "query").first()["tags"] == {}


def test_clip_hands_nothing_to_python(spark):
    plan = C.clip(frame(spark, []), "query")._jdf.queryExecution().optimizedPlan().toString()
    assert "ython" not in plan and "InArrow" not in plan
