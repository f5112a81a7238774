import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import hypergeometric_shards as H
from readloom.llm import poisson_mix, warc
from tests.llm.cases import documents, empty


# --- sharding ------------------------------------------------------------------------------


def test_matrix_has_exact_margins_and_the_right_law():
    sizes = H.capacities(103, 5)
    assert sizes.tolist() == [21, 21, 21, 20, 20]
    counts = [50, 0, 3, 50]
    total = np.zeros((4, 5))
    for seed in range(600):
        matrix = H.communication_matrix(counts, sizes, seed)
        assert matrix.sum(axis=1).tolist() == counts and matrix.sum(axis=0).tolist() == sizes.tolist()
        total += matrix
    expected = np.outer(counts, sizes) / 103
    assert np.abs(total / 600 - expected).max() < 0.4
    # The variance of one entry is hypergeometric: n K/N (1-K/N) (N-n)/(N-1).
    entries = np.array([H.communication_matrix(counts, sizes, s)[0, 0] for s in range(2000)])
    want = 50 * (21 / 103) * (82 / 103) * (53 / 102)
    assert abs(entries.var() - want) < 0.15 * want


def test_large_totals_are_drawn_without_replacement():
    rng = np.random.Generator(np.random.Philox(key=1))
    left = np.full(4, 2 * 10**9, dtype=np.int64)
    got = H._in_steps(rng, left, 100_000)
    assert got.sum() == 100_000 and np.abs(got - 25_000).max() < 1000


def check_shards(docs, rows, shards):
    ids = Counter(str(r["doc_id"]) for r in docs)
    assert Counter(str(r["doc_id"]) for r in rows) == ids
    counts = Counter(r["shard"] for r in rows)
    n = len(docs)
    assert sorted(counts.values()) == sorted(c for c in H.capacities(n, shards).tolist() if c)
    for k, c in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(c))
    assert all(r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < shards for r in rows)


@pytest.mark.parametrize(("block", "bound"), [(7, 200_000), (250_000, 200_000), (250_000, 0)])
def test_shards_are_exact_uniform_and_repeatable(spark, monkeypatch, block, bound):
    import readloom.llm.common as common

    monkeypatch.setattr(H, "BLOCK_ROWS", block)
    monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 9).alias("text")).repartition(5)
    rows = H.shard_rows(docs).collect()
    check_shards(docs.collect(), rows, 24)
    for r in rows[:50]:
        text = f"text {r['doc_id'] % 9}".encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 8, zlib.crc32(text))
    assert sorted(map(str, H.shard_rows(docs).collect())) == sorted(map(str, rows))
    slots = np.array(sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows))
    assert abs(np.corrcoef(slots[:, 0], slots[:, 1])[0, 1]) < 0.12 and abs(np.corrcoef(slots[:, 0], slots[:, 2])[0, 1]) < 0.12
    assert sorted(map(str, H.shard_rows(docs, seed=5).collect())) != sorted(map(str, rows))


def test_shards_of_edge_cases(spark):
    docs = documents(spark)
    check_shards(docs.collect(), H.shard_rows(docs).collect(), 24)
    assert H.shard_rows(empty(spark)).count() == 0
    check_shards(docs.collect(), H.shard_rows(docs, shards=3).collect(), 3)


def test_documents_arrive_whole_in_their_shards(spark):
    docs = documents(spark).withColumn("slot", F.lit("replaced"))
    got = H.shard_documents(docs, shards=3)
    assert got.columns == [c for c in docs.columns if c != "slot"] + ["law", "shard", "slot", "grown_shard"]
    check_shards(docs.collect(), got.collect(), 3)
    assert sorted(map(str, got.select(*documents(spark).columns).collect())) == sorted(map(str, documents(spark).collect()))
    placed = {(r["shard"], r["slot"]): (r["doc_id"], zlib.crc32((r["text"] or "").encode())) for r in got.collect()}
    assert placed == {(r["shard"], r["slot"]): (r["doc_id"], r["text_crc32"]) for r in H.shard_rows(docs, shards=3).collect()}
    assert H.shard_documents(empty(spark)).count() == 0


# --- mixing --------------------------------------------------------------------------------


def copies_of(doc_id, text, rate, seed=poisson_mix.SEED):
    name = f"{doc_id}:{hashlib.md5(text.encode()).hexdigest()}"
    pieces = max(1, math.ceil(rate / poisson_mix.RATE_STEP))
    step, out = rate / pieces, 0
    for i in range(1, pieces + 1):
        u = int(hashlib.md5(f"{seed}:{name}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p, c = 0, math.exp(-step), math.exp(-step)
        while c <= u:
            k += 1
            p *= step / k
            c += p
        out += k
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_copies_against_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(poisson_mix, "BROADCAST_ROWS", 0)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "big").when(F.col("id") < 6, "tiny").otherwise("mid").alias("source"), F.lit("t").alias("text"))
    weights = spark.createDataFrame([("big", 1.0), ("tiny", 2.0), ("mid", 1.0), ("none", 9.0)], "source string, weight double")
    n = Counter(r["source"] for r in docs.collect())
    w = {"big": 1.0, "tiny": 2.0, "mid": 1.0}
    for given in (weights, None):
        share = w if given is not None else {s: math.sqrt(c) for s, c in n.items()}
        rates = {s: 600 * share[s] / sum(share.values()) / c for s, c in n.items()}
        got = Counter(r["doc_id"] for r in poisson_mix.mix_sources(docs, given).collect())
        want = {r["doc_id"]: copies_of(r["doc_id"], "t", rates[r["source"]]) for r in docs.collect()}
        assert got == Counter({k: v for k, v in want.items() if v})


def test_mix_reaches_target_shares_and_shuffles(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, "a").otherwise("b").alias("source"), F.lit(None).cast("string").alias("text"))
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    rows = poisson_mix.mix_sources(docs, weights, budget=10_000).collect()
    share = Counter(r["source"] for r in rows)
    assert abs(share["a"] - 5000) < 300 and abs(share["b"] - 5000) < 300
    b = Counter(r["doc_id"] for r in rows if r["source"] == "b")
    counts = np.array([b.get(i, 0) for i in range(0, 20_000, 10)])
    assert abs(counts.var() / counts.mean() - 1) < 0.15  # Poisson: variance equals mean
    order = np.array([r["doc_id"] for r in rows])
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.05


def test_null_and_repeated_ids_are_drawn_by_text(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 2 > 0, 5).cast("bigint").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    mixed = poisson_mix.mix_sources(docs)
    counts = np.array(list(Counter(r["text"] for r in mixed.collect()).values()))
    assert abs(counts.sum() - 4000) < 250 and abs(len(counts) / 4000 - (1 - math.exp(-1))) < 0.03
    assert mixed.select("mix_key").distinct().count() == mixed.count()


def test_mix_edge_cases(spark):
    docs = documents(spark)
    mixed = poisson_mix.mix_sources(docs)
    assert set(docs.columns) <= set(mixed.columns) and dict(mixed.dtypes)["mix_key"] == "bigint"
    assert poisson_mix.mix_sources(empty(spark)).count() == 0
    plan = mixed._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


# --- WARC ----------------------------------------------------------------------------------


def fake(payload):
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: {len(payload)}\r\n\r\n{payload}\r\n\r\n"


def pages(spark):
    long_ = "<p>" + "é" * 200 + "</p>"
    rows = [
        (1, "http://a/", long_),
        (5, "http://a/\r\nX: y", long_),
        (3, None, long_),
        (4, "u", None),
        (6, "u", ""),
        (7, "u", "short"),
        (8, "u", "short"),
        (9, "u", "WARC/1.1\r\n"),
        (10, "u", "x" + fake("<p>nested</p>") * 3 + "tail"),
        (11, "u", fake("inside")),
        (12, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.1\r\n"),
        (13, "u", "line\r\n\r\n\r\n"),
        (None, "u", "null id"),
        (1, "twice", long_),
        (14, "u", "z" * 300_000),
        (15, "u", "x" + fake("<p>nested</p>") * 3 + "tail"),
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"kind": F.lit("k"), "digest": F.lit(1), "value": F.lit("v")})


@pytest.mark.parametrize("read", ["read_warc", "read_pages"])
def test_scans_may_split_differently(spark, tmp_path, monkeypatch, read):
    """Executors that come or go change the splits between the scans of one read."""
    rows = [(i, "u", ("x" * 40 + fake(f"inner {i % 4}")) * 3 if i % 3 == 0 else f"page {i} " * 30) for i in range(60)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    warc.write_warc(table.coalesce(1), f"{tmp_path}/w")
    scans, real = [], warc.candidates

    def candidates(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", ["1k", "128m", "700", "5k"][len(scans) % 4])
        scans.append(1)
        return warc.materialize(real(*args))

    monkeypatch.setattr(warc, "candidates", candidates)
    try:
        got = getattr(warc, read)(spark, f"{tmp_path}/w").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(scans) >= 2 and sorted(r["page_id"] for r in got) == list(range(60))
    if read == "read_pages":
        assert {r["page_id"]: r["html"] for r in got} == {i: html for i, _, html in rows}
    else:
        assert {r["page_id"]: r["payload_digest"] for r in got} == {i: hashlib.sha256(html.encode()).hexdigest() for i, _, html in rows}


@pytest.mark.parametrize("split", ["128m", "2k"])
def test_warc_round_trip(spark, tmp_path, split):
    table = pages(spark)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = warc.round_trip(table.repartition(3), path=f"{tmp_path}/w").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    groups = {}
    for r in table.collect():
        groups.setdefault(r["html"] or "", []).append(r["page_id"])
    want = []
    for r in table.collect():
        html = (r["html"] or "").encode()
        first = min(i for i in groups[r["html"] or ""] if i is not None) if any(i is not None for i in groups[r["html"] or ""]) else None
        revisit = len(html) >= 100 and len(groups[r["html"] or ""]) > 1 and r["page_id"] != first
        want.append((str(r["page_id"]), len(html), hashlib.sha256(html).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    got = [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_pages_are_read_back(spark, tmp_path):
    warc.write_warc(pages(spark).repartition(3), f"{tmp_path}/w")
    got = warc.read_pages(spark, f"{tmp_path}/w").collect()
    want = [(r["page_id"], (r["url"] or "").replace("\r", "%0D").replace("\n", "%0A"), r["html"] or "") for r in pages(spark).collect()]
    assert sorted(((r["page_id"], r["url"], r["html"]) for r in got), key=str) == sorted(want, key=str)
    assert {r["page_id"] for r in got if r["record_type"] == "revisit"} == {3, 5, 15}


def test_warc_files_hold_standard_records(spark, tmp_path):
    warc.write_warc(pages(spark).coalesce(1), f"{tmp_path}/w")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    at, n, ids = 0, 0, []
    while at < len(data):
        assert data[at:].startswith(b"WARC/1.1\r\n")
        head = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(b": ", 1) for line in data[at:head].split(b"\r\n")[1:])
        assert {b"WARC-Type", b"WARC-Record-ID", b"WARC-Date", b"Content-Length"} <= fields.keys()
        assert re.fullmatch(rb"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields[b"WARC-Date"])
        ids.append(fields[b"WARC-Record-ID"])
        at = head + 4 + int(fields[b"Content-Length"])
        assert data[at : at + 4] == b"\r\n\r\n"
        at, n = at + 4, n + 1
    assert n == pages(spark).count() == len(set(ids))


def test_chain_ends_at_damage(spark, tmp_path):
    warc.write_warc(pages(spark).where("page_id in (6, 7, 8)").coalesce(1), f"{tmp_path}/w")
    path = next((tmp_path / "w").glob("part-*"))
    data = path.read_bytes()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut/a.warc").write_bytes(data[:-30])
    (tmp_path / "cut/b.warc").write_bytes(b"garbage" + data)
    (tmp_path / "cut/c.warc").write_bytes(data)
    assert warc.read_warc(spark, f"{tmp_path}/cut").count() == 2 + 0 + 3


def test_empty_archive(spark, tmp_path):
    assert warc.round_trip(pages(spark).limit(0), path=f"{tmp_path}/w").count() == 0


def test_pointer_jumping_against_a_walk():
    rng = np.random.default_rng(0)
    for _ in range(200):
        offsets = np.unique(rng.integers(0, 60, size=rng.integers(0, 25)))
        jumps = np.array([rng.choice([o + rng.integers(1, 9), *offsets[offsets > o][:2]]) for o in offsets], dtype=np.int64)
        want, at = set(), 0
        while at in offsets:
            want.add(at)
            at = int(jumps[list(offsets).index(at)])
        assert set(offsets[warc.reachable(offsets, jumps)].tolist()) == want
