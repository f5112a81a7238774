import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import cuckoo_dedup as C
from readloom.llm import simhash as S
from tests.llm.cases import TEXTS, documents, empty


def digest(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_cuckoo_index_inserts_deletes_and_resizes():
    index = C.CuckooIndex(buckets=2)
    for i in range(3000):
        assert index.get(digest(i)) is None
        index.put(digest(i), [i])
    assert index.resizes > 3 and len(index) == 3000
    assert all(index.get(digest(i)) == [i] for i in range(3000))
    assert all(index.get(digest(i)) is None for i in range(3000, 9000))
    for i in range(0, 3000, 2):
        assert index.delete(digest(i)) and not index.delete(digest(i))
    assert [index.get(digest(i)) for i in range(6)] == [None, [1], None, [3], None, [5]]
    assert len(index) == 1500


def test_false_hits_are_told_apart_by_the_stored_keys():
    index = C.CuckooIndex(buckets=2)
    first = digest(1)
    twin = first[:10] + digest(2)[10:]  # same fingerprint and buckets
    index.put(first, "a")
    assert twin in index.filter and index.get(twin) is None
    index.put(twin, "b")
    assert index.get(first) == "a" and index.get(twin) == "b"
    assert index.delete(first) and index.get(twin) == "b"


def brute_groups(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    return groups


def test_exact_dedup_against_brute_force(spark):
    docs = documents(spark)
    groups = brute_groups(docs.collect())
    got = C.exact_dedup(docs).collect()
    assert len(got) == docs.count()
    by_sha = {}
    for r in got:
        by_sha.setdefault(r["text_sha256"], []).append(r)
    assert by_sha.keys() == {hashlib.sha256(t.encode()).hexdigest() for t in groups}
    for text, ids in groups.items():
        rows = by_sha[hashlib.sha256(text.encode()).hexdigest()]
        keep = max((i for i in ids if i is not None), default=None)
        assert {r["keep_id"] for r in rows} == {keep} and {r["group_size"] for r in rows} == {len(ids)}
        assert [r["doc_id"] for r in rows if r["kept"]] == [keep]
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(map(str, ids))


def test_exact_dedup_large_group_and_small_local_index(spark, monkeypatch):
    monkeypatch.setattr(C, "LOCAL_KEYS", 50)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 700)).alias("text"))
    got = {r["text_sha256"]: (r["keep_id"], r["group_size"]) for r in C.exact_dedup(docs).where("kept").collect()}
    groups = brute_groups(docs.collect())
    assert got == {hashlib.sha256(t.encode()).hexdigest(): (max(i), len(i)) for t, i in groups.items()}


def test_retired_rows_leave_the_index(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "c")], "doc_id bigint, text string")
    got = C.exact_dedup(docs, retired=spark.createDataFrame([(2,), (3,), (5,)], "doc_id bigint"))
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()) == [(1, 1, 1, True), (4, 4, 1, True)]


@pytest.mark.parametrize("bound", [0, 200_000])
def test_drop_copies_keeps_one_row_of_each_text(spark, monkeypatch, bound):
    import readloom.llm.common as common

    monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
    docs = documents(spark)
    got = C.drop_copies(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    groups = brute_groups(docs.collect())
    assert sorted(r["text"] or "" for r in rows) == sorted(groups)
    for r in rows:
        assert r["doc_id"] == max((i for i in groups[r["text"] or ""] if i is not None), default=None)


def test_empty_tables(spark):
    assert C.exact_dedup(empty(spark)).count() == 0 and C.drop_copies(empty(spark)).count() == 0
    assert S.near_dedup(empty(spark)).count() == 0 and S.drop_near_copies(empty(spark)).count() == 0


def slow_fingerprint(text):
    import re

    import xxhash

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_fingerprints_against_brute_force():
    for text in TEXTS:
        assert S.fingerprint(text) == slow_fingerprint(text)


def clustered(rng, n):
    base = rng.integers(0, 2**64, size=n, dtype=np.uint64)
    near = base[: n // 4].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, size=len(near)).astype(np.uint64)
    chain = [base[0]]
    for k in range(12):
        chain.append(chain[-1] ^ np.uint64(0b1111 << 4 * k))
    return np.unique(np.concatenate([base, near, np.array(chain, dtype=np.uint64)]))


@pytest.mark.parametrize("radius", [1, 3, 4, 7])
def test_bit_sliced_links_against_brute_force(radius):
    fps = clustered(np.random.default_rng(radius), 700)
    order = list(range(64))
    random.Random(radius).shuffle(order)
    got = {(i, int(j)) for i, js in S.links(fps, order, radius) for j in js}
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(apart <= radius, 1)), strict=True)}


def slow_words(text):
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingle_set(text, width=5):
    words = slow_words(text)
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} or ({" ".join(words)} if words else set())


def slow_lanes(text, width):
    """The fingerprint as four numbers, by plain integers."""
    import xxhash

    mask, counts, found = 2**64 - 1, [0] * 256, shingle_set(text, width)
    for shingle in found:
        for lane in range(4):
            x = (xxhash.xxh64_intdigest(shingle.encode(), 42) + (lane + 1) * 0x9E3779B97F4A7C15) & mask
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
            x ^= x >> 31
            for b in range(64):
                counts[64 * lane + b] += x >> b & 1
    return [sum(1 << b for b in range(64) if counts[64 * lane + b] * 2 > len(found)) for lane in range(4)]


def test_similar_fingerprints_against_brute_force():
    long = " ".join(f"w{i % 777}" for i in range(3000))
    for text in [t for t in TEXTS if len(t or "") < 5000] + [long]:
        fp, key = S.similar_fingerprint(text)
        assert fp.tolist() == slow_lanes(text, 5) and key.tolist() == slow_lanes(text, 2)


def similar_components(texts):
    """The least position of each text's component, all pairs compared."""
    fps = np.array([S.similar_fingerprint(t)[0] for t in texts])
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :]).sum(axis=2)
    return join_links(len(texts), zip(*np.nonzero(np.triu(apart <= S.SIMILAR_RADIUS, 1)), strict=True))


def edited(rng, n, words=150):
    """n unrelated texts, and for each one a copy with a word in fifty or fewer replaced."""
    base = [[f"{rng.getrandbits(20):x}" for _ in range(words)] for _ in range(n)]
    copies = []
    for text in base:
        copy = list(text)
        for at in rng.sample(range(words), rng.randint(1, words // 50)):
            copy[at] = f"{rng.getrandbits(20):x}"
        copies.append(copy)
    return [" ".join(t) for t in base], [" ".join(t) for t in copies]


@pytest.mark.parametrize(("block", "bucket"), [(4096, 2048), (4096, 16), (16, 16)])
def test_similar_texts_are_found(spark, monkeypatch, block, bucket):
    """Copies with a Jaccard similarity of 0.8 or more lose one row in nine of ten cases, unrelated texts never."""
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "SIMILAR_BUCKET", bucket)
    base, copies = edited(random.Random(3), 300)
    docs = spark.createDataFrame(list(enumerate(base + copies)), "doc_id bigint, text string").repartition(5)
    kept = {r["doc_id"] for r in S.drop_near_copies(docs).collect()}
    assert set(range(300)) <= kept
    near = [i for i in range(300) if len(a := shingle_set(base[i])) and len(a & (b := shingle_set(copies[i]))) >= 0.8 * len(a | b)]
    assert len(near) > 200
    assert sum(300 + i not in kept for i in near) >= 0.9 * len(near)
    if bucket > 600:  # one bucket: all pairs are compared
        assert kept == set(similar_components(base + copies))


def test_dense_groups_of_similar_texts(spark, monkeypatch):
    """A bucket far over BLOCK whose rows all are near copies of each other keeps one of them."""
    monkeypatch.setattr(S, "BLOCK", 64)
    rng = random.Random(4)
    text = [f"{rng.getrandbits(30):x}" for _ in range(400)]
    rows = [(i, " ".join([*text[: i % 400], f"new{i}", *text[i % 400 + 1 :]])) for i in range(700)]
    assert [r["doc_id"] for r in S.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()] == [0]


def test_bit_sliced_links_of_long_fingerprints_against_brute_force():
    rng = np.random.default_rng(9)
    fps = rng.integers(0, 2**64, size=(300, 4), dtype=np.uint64)
    near = fps[:200].copy()
    for _ in range(50):
        near[np.arange(200), rng.integers(0, 4, 200)] ^= np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
    fps = np.concatenate([fps, near])
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :]).sum(axis=2)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(apart <= 46, 1)), strict=True)}
    assert 50 < len(want) < 200
    assert {(i, int(j)) for i, js in S.links(fps, list(range(256)), 46) for j in js} == want


def test_tables_meet_similar_keys():
    """Keys that differ in KEY_FLIPS of the bits meet in a table, whatever the number of rows."""
    rng = np.random.default_rng(2)
    for rows in (0, 10, 10**5, 10**7, 10**10):
        tables = S.table_bits(rows)
        flips = rng.random((2000, 256)) < S.KEY_FLIPS
        missed = np.all([flips[:, t].any(axis=1) for t in tables], axis=0).mean() if tables[0] else 0
        assert missed < 2 * S.KEY_MISSES


def join_links(n, pairs):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = sorted((top(int(i)), top(int(j))))
        root[b] = a
    return [top(i) for i in range(n)]


def brute_components(fps):
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    return join_links(len(fps), zip(*np.nonzero(np.triu(apart <= 4, 1)), strict=True))


@pytest.mark.parametrize(("block", "mean"), [(4096, 1024), (16, 4), (16, 1)])
def test_components_against_brute_force(spark, monkeypatch, block, mean):
    monkeypatch.setattr(S, "BLOCK", block)
    fps = clustered(np.random.default_rng(5), 600)
    ball = np.array([int(fps[0]) ^ (1 << a) ^ (1 << b) for a in range(14) for b in range(a)], dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, ball]))
    monkeypatch.setattr(S, "table_masks", lambda rows, radius=4, f=S.table_masks: f(rows, radius, mean))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    stars = {r["node"]: r["root"] for r in S.components(S.near_edges(table)).collect()}
    signed = fps.view(np.int64).tolist()
    got, want = {}, {}
    for i, (fp, root) in enumerate(zip(signed, brute_components(fps), strict=True)):
        got.setdefault(stars.get(fp, fp), set()).add(i)
        want.setdefault(root, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_masks_cover_every_pair():
    rng = random.Random(1)
    for rows in (10, 10**7, 10**10):
        masks = S.table_masks(rows)
        for _ in range(500):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 4):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


def test_near_dedup_edge_cases(spark):
    docs = documents(spark)
    rows = docs.collect()
    got = S.near_dedup(docs).collect()
    assert len(got) == len(rows)
    fps = np.array([slow_fingerprint(r["text"]) for r in rows], dtype=np.uint64)
    roots = brute_components(fps)
    want = {}
    for i, r in enumerate(rows):
        want.setdefault(roots[i], []).append(r["doc_id"])
    expected = sorted((str(r["doc_id"]), f"{int(fps[i]):016x}", str(min((x for x in want[roots[i]] if x is not None), default=None))) for i, r in enumerate(rows))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == expected
    want = {}
    for root, r in zip(similar_components([r["text"] for r in rows]), rows, strict=True):
        want.setdefault(root, []).append(r["doc_id"])
    kept = S.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert len(ids) == len(want) and ids == sorted({str(min((x for x in ids if x is not None), default=None)) for ids in want.values()})


@pytest.mark.parametrize("bound", [200_000, 0])
def test_null_and_repeated_ids_lose_no_text(spark, monkeypatch, bound):
    import readloom.llm.common as common

    monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
    words = [f"{random.Random(i).getrandbits(64):x}" for i in range(12 * 40)]
    text = [" ".join(words[40 * i : 40 * i + 40]) for i in range(12)]
    rows = [(None, text[0]), (None, text[1]), (None, text[2]), (None, text[2].upper()), (None, text[2])]  # three components under null
    rows += [(7, text[3]), (7, text[4]), (7, text[5]), (7, text[5])]  # three under one id
    rows += [(1, text[6]), (8, text[6].upper()), (8, text[7])]  # a near copy, whose id is another text's only one
    rows += [(9, text[8]), (None, text[8].upper())]
    rows += [(3, text[9]), (3, text[9].upper()), (4, text[9])]
    rows += [(-(2**63), text[10]), (None, text[10]), (None, text[11]), (0, text[11])]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, row_ref int").repartition(4)
    assert similar_components(text) == list(range(12))
    kept = S.drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = sorted((r["text"].lower(), str(r["doc_id"])) for r in kept.collect())
    ids = [None, None, None, 7, 7, 7, 1, 8, 9, 3, -(2**63), 0]
    assert got == sorted((t, str(i)) for t, i in zip(text, ids, strict=True))


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "u bigint, v bigint")
    got = S.components(edges).collect()
    assert {r["root"] for r in got} == {0} and len(got) == n
