"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: words of the text in lower case (A-Z only), shingles of four words, XXH64
with seed 42; a bit is set if over half of the shingles' hashes have it.

near_dedup follows these. drop_near_copies, the stage of the pipeline, finds similar texts instead (see similar_edges):
its fingerprints have 256 bits, and links are found in sampled tables.

Links of near_dedup: distinct fingerprints that differ in at most four bits. The 64 bits are cut into
4 + m blocks; two linked fingerprints agree in at least m of them, so each choice of m
blocks is a table keyed by those bits, and m grows with the number of fingerprints so that
buckets stay small. Rows of a table are exchanged by key and compared bit-sliced: plane b
holds bit b of 64 fingerprints to a word, a query's bits are XORed in plane by plane, full
adders feed carry-save counters, and a block of 64 distances is abandoned once all of them
exceed the radius. A bucket over ``BLOCK`` rows is cut into parts, and each pair of parts
is a task group of its own. Each group emits a spanning forest, never its pairs.

Components: large-star and small-star rounds over the forest edges, each materialized in
the shared checkpoint folder; nothing is collected.

Defined cases: texts without words (null and empty too) have fingerprint zero and link
like any other; fewer words than a shingle has are one shingle; null ids never become a
component_id unless all its rows' ids are null; repeated rows are separate rows of the
same component; of rows that tie for a component's least id drop_near_copies keeps that of the least text
digest; texts of any length count whole; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import materialize, small_or_shuffled

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Rows of a bucket from which it is cut into parts, and rows that are compared at once.
BLOCK = 4096
#: Mean rows of a bucket from which the tables get a further block in their keys.
MEAN_BUCKET = 1024

#: Similar texts: words of a shingle, words of a shingle of the keys, 64-bit lanes of a fingerprint, and radius. Sets
#: of shingles with a Jaccard similarity of 0.8 have a cosine of 0.89, and differ in acos(0.89) / pi of the bits: 39
#: of 256 on average with a deviation of 6. 46 or fewer are nine in ten of them; unrelated texts differ in 128 (8).
SIMILAR_SHINGLE, KEY_SHINGLE, LANES, SIMILAR_RADIUS = 5, 2, 4, 46
#: Share of the key bits in which texts of that similarity differ, and share of them that all tables may miss.
KEY_FLIPS, KEY_MISSES = 0.11, 0.02
#: Mean rows of a bucket of those tables.
SIMILAR_BUCKET = 2048

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        hashes = digest(joined, SEED)
    else:
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        hashes = b"".join([digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[width - 1 :], strict=False)])
    bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
    n = len(bits)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 255):  # sums of 255 bits fit in a byte
        counts += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _shingles(words: list[bytes], width: int) -> np.ndarray:
    """The XXH64 hashes of the distinct shingles."""
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    found = {joined[a : b - 1] for a, b in zip(starts, ends[width - 1 :], strict=False)}
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(f, SEED) for f in found), dtype=np.uint64, count=len(found)))


def _lanes(hashes: np.ndarray) -> np.ndarray:
    """LANES words of 64 bits: each hash gives LANES numbers, a bit is set if over half of the numbers have it."""
    counts = np.zeros(64 * LANES, dtype=np.int64)
    steps = (np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for at in range(0, len(hashes), 255):  # sums of 255 bits fit in a byte
        x = hashes[at : at + 255, None] + steps
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)  # the finalizer of splitmix64
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def similar_fingerprint(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of a text's set of five-word shingles and that of its pairs of words, LANES words each."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(LANES, dtype=np.uint64), np.zeros(LANES, dtype=np.uint64)
    return _lanes(_shingles(words, SIMILAR_SHINGLE)), _lanes(_shingles(words, KEY_SHINGLE))


def similar_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (32 bytes), bits (array of LANES bigints, those of the keys) and sha (the text's SHA-256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [similar_fingerprint(t.as_py()) for t in batch.column(1)]
            fps = pa.array([f.tobytes() for f, _ in made], type=pa.binary())
            bits = pa.array([k.view(np.int64) for _, k in made], type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, bits, batch.column(2)], names=["doc_id", "fp", "bits", "sha"])

    columns = [F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _sha(text_col).alias("sha")]
    return docs.select(*columns).mapInArrow(run, "doc_id bigint, fp binary, bits array<bigint>, sha binary")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed bigint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def _sha(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))


def table_masks(rows: int, radius: int = RADIUS, mean_bucket: int = MEAN_BUCKET) -> list[int]:
    """The key bits of each table: every pair within radius agrees in one of them at least."""
    m = 1
    while m < 4 and rows >> (64 * m // (radius + m)) > mean_bucket:
        m += 1
    cuts = [64 * i // (radius + m) for i in range(radius + m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(cuts)]
    return [sum(c) for c in itertools.combinations(blocks, m)]


def _bits(fps: np.ndarray) -> np.ndarray:
    """Row i: the bits of fingerprint i, lane by lane; rows of zeros fill up to a multiple of 64."""
    n = len(fps)
    padded = np.zeros((-(-n // 64) * 64, fps.size // n), dtype=np.uint64)
    padded[:n] = fps.reshape(n, -1)
    return np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")


def _planes(bits: np.ndarray) -> np.ndarray:
    """Plane b, word w: bit b of fingerprints 64 w to 64 w + 63."""
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


class _Counters:
    """Bit-sliced distances: planes of weight 1, 2, 4, ... and a sticky overflow."""

    def __init__(self, shape, radius: int):
        self.radius, self.bits = radius, max(1, radius.bit_length())
        self.at = [np.zeros(shape, dtype=np.uint64) for _ in range(self.bits)]
        self.over = np.zeros(shape, dtype=np.uint64)

    def add(self, bit: np.ndarray, weight: int = 0) -> None:
        for level in range(weight, self.bits):
            kept = self.at[level]
            self.at[level] = kept ^ bit
            bit = kept & bit
        self.over |= bit

    def add3(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        """A full adder: three bits become a sum of weight 1 and a carry of weight 2."""
        ab = a ^ b
        self.add(ab ^ c)
        self.add(a & b | ab & c, 1)

    def within(self) -> np.ndarray:
        """Lanes whose distance does not exceed the radius so far."""
        above, equal = self.over.copy(), ~self.over
        for level in reversed(range(self.bits)):
            if self.radius >> level & 1:
                equal &= self.at[level]
            else:
                above |= equal & self.at[level]
                equal &= ~self.at[level]
        return ~above

    def take(self, where: np.ndarray) -> None:
        self.at = [c[where] for c in self.at]
        self.over = self.over[where]


def links(fps: np.ndarray, order: list[int], radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j > i within radius of i) for the distinct fingerprints fps, numbers or rows of lanes; order: planes in order of use.

    The first planes, in which unrelated fingerprints mostly come to exceed the radius, are added for all blocks.
    """
    n, bits = len(fps), _bits(fps)
    planes, total = _planes(bits), bits.shape[1]
    dense = min(6 * round((2 * radius + 5 * math.sqrt(radius)) / 6), total // 6 * 6)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    lanes = np.arange(64, dtype=np.uint64)
    for start in range(0, n, 256):
        chunk = bits[start : min(start + 256, n)]
        masks = np.where(chunk.T, ones, np.uint64(0))
        first = start // 64  # words before it hold earlier rows only
        counters = _Counters((len(chunk), planes.shape[1] - first), radius)
        for a, b, c in zip(order[0:dense:3], order[1:dense:3], order[2:dense:3], strict=True):
            counters.add3(*(planes[p][None, first:] ^ masks[p][:, None] for p in (a, b, c)))
        query, word = np.nonzero(counters.within())
        counters.take((query, word))
        word = word + first
        for at in range(dense, total, 3):
            if not len(query):
                break
            if at + 3 <= total:
                counters.add3(*(planes[p][word] ^ masks[p][query] for p in order[at : at + 3]))
            else:
                for p in order[at:]:
                    counters.add(planes[p][word] ^ masks[p][query])
            if at % 6 == 0:
                alive = np.nonzero(counters.within())[0]
                if len(alive) < len(query):  # blocks of which all lanes exceed the radius are abandoned
                    counters.take(alive)
                    query, word = query[alive], word[alive]
        if not len(query):
            continue
        hit = (counters.within()[:, None] >> lanes[None, :]) & np.uint64(1)
        block, lane = np.nonzero(hit)
        i, j = query[block] + start, word[block] * 64 + lane.astype(np.int64)
        later = (j > i) & (j < n)
        i, j = i[later], j[later]
        ends = np.nonzero(np.diff(i))[0] + 1
        for a, b in itertools.pairwise([0, *ends.tolist(), len(i)]):
            if b > a:
                yield int(i[a]), j[a:b]


def forest(fps: np.ndarray, order: list[int], radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint the position of the root of its component among fps."""
    root = np.arange(len(fps))
    for i, others in links(fps, order, radius):
        met = np.append(others, i)
        tops = root[met]
        while True:
            higher = root[tops]
            if (higher == tops).all():
                break
            tops = higher
        low = tops.min()
        root[tops] = low
        root[met] = low
    while True:
        higher = root[root]
        if (higher == root).all():
            return root
        root = higher


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _compare(batches: Iterator[pa.RecordBatch], orders: list[list[int]], radius: int) -> Iterator[pa.RecordBatch]:
    """Forest edges of sorted groups (tab, grp, fp and, if it isn't its own name, node); whole small groups are compared together.

    A pair of different groups that is compared by the way and found within radius is a link like any other.
    """
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def flush(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, count
        tab, group, node, fp = (np.concatenate(c) for c in zip(*held, strict=True))
        starts = np.concatenate([[0], np.nonzero(np.diff(group) | np.diff(tab))[0] + 1, [len(fp)]])
        whole = starts if final else starts[:-1]
        at = 0
        while at < len(whole) - 1:
            to = at + 1
            while to < len(whole) - 1 and whole[to + 1] - whole[at] <= BLOCK and tab[whole[to]] == tab[whole[at]]:
                to += 1
            if whole[to] - whole[at] > 1:
                names, which = np.unique(node[whole[at] : whole[to]], return_index=True)
                root = forest(fp[whole[at] : whole[to]][which], orders[int(tab[whole[at]])], radius)
                leaf = np.nonzero(root != np.arange(len(root)))[0]
                if len(leaf):
                    yield pa.RecordBatch.from_arrays([pa.array(names[leaf]), pa.array(names[root[leaf]])], schema=_EDGE)
            at = to
        left = int(whole[-1])
        held = [(tab[left:], group[left:], node[left:], fp[left:])] if left < len(fp) else []
        count = len(fp) - left

    limit = 2 * BLOCK
    for batch in batches:
        tab = batch.column("tab").to_numpy(zero_copy_only=False)
        group = batch.column("grp").to_numpy(zero_copy_only=False)
        fp = batch.column("fp")
        if pa.types.is_integer(fp.type):
            node = fp.to_numpy(zero_copy_only=False)
            held.append((tab, group, node, node.view(np.uint64)))
        else:
            lanes = np.frombuffer(b"".join(fp.to_pylist()), dtype=np.uint64).reshape(len(fp), -1)
            held.append((tab, group, batch.column("node").to_numpy(zero_copy_only=False), lanes))
        count += len(tab)
        if count > limit:
            yield from flush(False)
            limit = max(2 * BLOCK, 2 * count)
    if held:
        yield from flush(True)


def near_edges(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Forest edges (u, v) between distinct fingerprints fps.fp, enough to connect all that link."""
    masks = table_masks(fps.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("tab", "key"))
    orders = [sorted(range(64), key=lambda b, m=m: m >> b & 1) for m in masks]  # bits outside the key first
    return _edges(rows, orders, radius)


def table_bits(rows: int) -> list[list[int]]:
    """The sampled key bits of each table of similar_edges: more bits and more tables as rows grow.

    k bits make buckets of SIMILAR_BUCKET rows. Of a pair each key bit differs with KEY_FLIPS; if d of them do, it
    meets in a table with comb(all - d, k) / comb(all, k). There are as many tables as miss KEY_MISSES of such pairs
    at most, over the distribution of d. With no bits all rows are one bucket.
    """
    k, n = (rows // SIMILAR_BUCKET).bit_length(), 64 * LANES
    share = [math.comb(n, d) * KEY_FLIPS**d * (1 - KEY_FLIPS) ** (n - d) for d in range(n + 1)]
    apart = [1 - math.comb(n - d, k) / math.comb(n, k) for d in range(n + 1)]
    tables = next(t for t in itertools.count(1) if sum(s * a**t for s, a in zip(share, apart, strict=True)) <= KEY_MISSES)
    rng = np.random.default_rng(SEED)
    return [sorted(rng.choice(n, size=k, replace=False).tolist()) for _ in range(tables)]


def similar_edges(prints: DataFrame, radius: int = SIMILAR_RADIUS) -> DataFrame:
    """Forest edges (u, v) of prints.node whose prints.fp are within radius and that meet in a table of prints.bits.

    The keys are bits of the texts' pairs of words, which an edit changes less than the longer shingles; what meets is
    decided by the fingerprint of the five-word shingles, bit-sliced.
    """
    tables = table_bits(prints.count())

    def key(chosen: list[int]) -> Column:
        masks = [sum(1 << b % 64 for b in chosen if b // 64 == lane) for lane in range(LANES)]
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        return F.xxhash64(*(F.col("bits")[i].bitwiseAND(F.lit(m).cast("bigint")) for i, m in enumerate(signed)))

    rows = prints.select("node", "fp", F.posexplode(F.array(*map(key, tables))).alias("tab", "key"))
    return _edges(rows, [list(range(64 * LANES))] * len(tables), radius)


def _edges(rows: DataFrame, orders: list[list[int]], radius: int) -> DataFrame:
    """Forest edges of the rows (tab, key, fp and what else they carry) that share a table and a key."""
    carried = [c for c in rows.columns if c not in ("tab", "key")]
    sizes = rows.groupBy("tab", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    hot = materialize(sizes.select("tab", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), merge=True)
    rows = rows.join(small_or_shuffled(hot), ["tab", "key"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("own"))))
    rows = rows.withColumn("own", own).withColumn("other", other)
    # Rows of one group share this number; groups that share it by chance are merely compared together.
    group = F.xxhash64("tab", "key", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select("tab", group.alias("grp"), *carried)
    return (
        rows.repartition("tab", "grp")
        .sortWithinPartitions("tab", "grp")
        .mapInArrow(lambda batches: _compare(batches, orders, radius), "u bigint, v bigint")
        .distinct()
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for every node that has an edge."""
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), merge=True)
    before = None
    for _ in range(rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        # Large star: each node hangs its larger neighbours on the least node it knows.
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("far")).join(least, "u").select(F.col("far").alias("u"), F.col("low").alias("v")).distinct()
        # Small star: each node hangs its smaller neighbours and itself on the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
        edges = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), merge=True)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _named(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """fp, component_id, root (a node of the component) and alone (one row, without links) of each fingerprint; materialized.

    distinct: node, fp, low_id (its least id) and n (its rows) of each fingerprint, materialized; edges link nodes.
    """
    stars = components(edges)
    # Only fingerprints with a link go through their component; its least id is folded before any exchange.
    linked = stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())
    linked = materialize(linked.join(distinct.select("node", "low_id"), "node"), merge=True)
    lowest = materialize(linked.groupBy("root").agg(F.min("low_id").alias("component_id")), merge=True)
    members = linked.select("node", "root").join(small_or_shuffled(lowest), "root").select("node", "root", "component_id")
    named = distinct.join(members, "node", "left")
    # A component of null ids has a null id of its own; without a link low_id is its id.
    component_id = F.when(F.col("root").isNull(), F.col("low_id")).otherwise(F.col("component_id"))
    alone = F.col("root").isNull() & (F.col("n") == 1)
    return materialize(named.select("fp", component_id.alias("component_id"), F.coalesce("root", "node").alias("root"), alone.alias("alone")), merge=True)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least id reachable by links), one row per row of docs."""
    prints = materialize(fingerprints(docs, id_col, text_col))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low_id"), F.count("*").alias("n"))
    distinct = materialize(distinct.withColumn("node", F.col("fp")), merge=True)
    return prints.join(_named(distinct, near_edges(distinct.select("fp"), radius)), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = SIMILAR_RADIUS) -> DataFrame:
    """docs with one row of each component of similar texts (see similar_edges): that with the least id, null ids last (of rows with the same id, that
    of the least text digest; of rows equal in id and text, any one).

    The rows that go, ids and digests, are anti-joined: by broadcast up to BROADCAST_ROWS of them, so that text
    is exchanged beyond that number only. A digest belongs to one component, so no key reaches into another.
    """

    def id_of(column: str) -> dict[str, Column]:
        found = F.col(column).cast("bigint")
        return {"_id": F.coalesce(found, F.lit(0).cast("bigint")), "_null": found.isNull()}

    key = ["_sha", "_id", "_null"]
    prints = materialize(similar_fingerprints(docs, id_col, text_col))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low_id"), F.count("*").alias("n"), F.min("bits").alias("bits"))
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), merge=True)
    named = _named(distinct.drop("bits"), similar_edges(distinct.select("node", "fp", "bits"), radius))
    rows = prints.drop("bits").join(named.where("not alone"), "fp")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    rows = materialize(rows.select(F.col("sha").alias("_sha"), *(c.alias(n) for n, c in id_of("doc_id").items()), "root", stays.alias("_first")))
    # Rows under the component's id: of those one digest stays.
    first = materialize(rows.where("_first").groupBy("root", *key).agg(F.count("*").alias("n")), merge=True)
    best = materialize(first.groupBy("root").agg(F.min("_sha").alias("_best")), merge=True)
    first = materialize(first.join(small_or_shuffled(best), "root").withColumn("_stays", F.col("_sha") == F.col("_best")), merge=True)
    lost = rows.where("not _first").select(*key).unionByName(first.where("not _stays").select(*key)).distinct()
    tagged = docs.withColumns({"_sha": _sha(text_col)} | id_of(id_col))
    kept = tagged.join(small_or_shuffled(materialize(lost, merge=True)), key, "left_anti")
    twins = first.where("_stays and n > 1").select(*key)
    n = twins.count()
    if n:  # rows equal in id and text, of which one stays
        twins = small_or_shuffled(twins, n)
        kept = kept.join(twins, key, "left_anti").unionByName(kept.join(twins, key, "left_semi").dropDuplicates(key))
    return kept.drop(*key)
