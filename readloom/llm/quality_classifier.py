"""Quality classifier: ordinal regression on graded ratings.

Ratings: 2 good, 1 poor, 0 very poor. The ``labels`` table says good or poor; a poor text is
very poor if ``VERY_POOR`` or more of the quality rules vote against it. Features are
hashed: whole words, whole word shapes (``Aa``, ``A!!``, ``a***``), and tokens for
repeated words, repeated lines and vocabulary richness, each as a share of the text.
The result has the expected grade and the tail probabilities; P(grade >= 2) selects documents.

The fit reads at most ``per_class`` labelled documents of each quality value, chosen by a
hash of the id; everything else covers all documents and whole texts. The sample is joined
by broadcast (its size is the stated bound), so no text is exchanged. Its features stay in the
shared folder, and the driver gets those that one in ``RARE`` texts of the sample has or more.

Defined cases: null text is the empty text; an empty text (no words) has grade 0 and tail
0 and is rejected; without any labels each tail is 0.5 and documents with words are kept;
null labels are ignored; of repeated labels the largest values count; of repeated ids in
documents the fit reads the least text, and each row is scored; texts with equal words tie and get
equal scores, and a tail of exactly ``KEEP_AT`` is kept; texts of any length count whole, words of
any length too; an empty table gives an empty result; extra columns are ignored by score and kept by keep_good.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import ordinal, weak_supervision
from readloom.llm.common import materialize, small_batches
from readloom.llm.ordinal import CumulativeLink, bucket

#: Labelled documents of each quality value that the fit reads at most.
PER_CLASS = 2000
#: Tail probability P(grade >= 2) from which a document is kept.
KEEP_AT = 0.5
#: Quality rules that must vote against a poor text to make it very poor.
VERY_POOR = 3
#: Penalty of the fit; features of under one in RARE texts of the sample get no weight.
L1, RARE = 2e-3, 40
#: Words of no weight that each text is taken to have besides its own, so that a few words decide little.
SMOOTH = 8
#: Distinct words whose contribution a worker remembers, and their characters.
MEMO_WORDS, MEMO_CHARS = 200_000, 8_000_000


class _Shape(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return out


_SHAPES = _Shape()
_RUNS = re.compile(r"([Aa0])\1+")


def word_buckets(word: str) -> tuple[int, int]:
    """Hashed features of one word: its lower-case form and its shape."""
    return bucket("w:" + word.lower()), bucket("s:" + _RUNS.sub(r"\1", word.translate(_SHAPES)))


def richness(kinds: int, words: int) -> float:
    return math.log(kinds) / math.log(words) if words > 1 else 1.0


def layout(text: str, words: list[str]) -> list[tuple[int, float]]:
    """Hashed features of the whole text."""
    n, lines = len(words), text.split("\n")
    again = sum(map(eq, words, words[1:])) / n
    out = [
        (bucket("again"), again),
        (bucket(f"again:{int(again * 20)}"), 1.0),
        *((bucket(f"again>{k}"), 1.0) for k in (1, 2, 4, 8) if again * 20 > k),
        # Distinct words by words, as logarithms: their quotient hardly depends on the length of prose.
        (bucket(f"rich:{int(20 * richness(len(set(words)), n))}"), n / (n + SMOOTH)),
        (bucket("lines"), 1.0 - len(set(lines)) / len(lines)),
    ]
    merged: dict[int, float] = {}
    for b, v in out:
        merged[b] = merged.get(b, 0.0) + v
    return list(merged.items())


def features(text: str) -> tuple[list[int], list[float]]:
    words = text.split()
    if not words:
        return [], []
    out: dict[int, float] = {}
    for word, times in Counter(words).items():
        for b in word_buckets(word):
            out[b] = out.get(b, 0.0) + times / (len(words) + SMOOTH)
    for b, v in layout(text, words):
        out[b] = out.get(b, 0.0) + v
    return list(out), list(out.values())


def labelled(docs: DataFrame, labels: DataFrame, column: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most per_class labelled documents of each value 0 and 1 of column: doc_id, text (the least of an id's), quality, toxic."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    some = None
    for value in (0, 1):
        part = marks.where(F.col(column) == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        some = part if some is None else some.unionAll(part)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text"))


def collect_features(sample: DataFrame, extract, rare: int) -> tuple[list[dict], int]:
    """quality, toxic, bad, buckets, vals of each row of the bounded sample, in order of id, and the least number of rows of a feature.

    bad: quality rules that vote against the text. Only buckets of that least number of rows, a rare-th of them, are collected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text")
            found = [extract(t or "") for t in texts.to_pylist()]
            votes = weak_supervision.rule_votes(weak_supervision.count_batch(texts))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name).cast(pa.int64()) for name in ("doc_id", "quality", "toxic")),
                    pa.array(sum((v < 0).astype(np.int64) for v in votes.values())),
                    pa.array([f[0] for f in found], pa.list_(pa.int32())),
                    pa.array([f[1] for f in found], pa.list_(pa.float32())),
                ],
                names=["doc_id", "quality", "toxic", "bad", "buckets", "vals"],
            )

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = zip(batch.column("buckets").to_pylist(), batch.column("vals").to_pylist(), strict=True)
            pairs = [(np.array(b, dtype="<i4"), np.array(v, dtype="<f4")) for b, v in lists]
            masks = [np.isin(b, kept) for b, _ in pairs]
            thinned = [[x[i][mask].tobytes() for x, mask in zip(pairs, masks, strict=True)] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(x, pa.binary()) for x in thinned)], names=batch.schema.names)

    small_batches(sample.sparkSession)
    ddl = "doc_id bigint, quality bigint, toxic bigint, bad bigint"
    rows = materialize(sample.mapInArrow(run, f"{ddl}, buckets array<int>, vals array<float>"))
    least = max(3, rows.count() // rare)
    often = rows.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    kept = np.array(sorted(r["b"] for r in often.select("b").collect()), dtype="<i4")
    out = [r.asDict() for r in rows.mapInArrow(thin, f"{ddl}, buckets binary, vals binary").collect()]
    for r in out:
        r["buckets"], r["vals"] = np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["vals"], "<f4")
    return sorted(out, key=lambda r: r["doc_id"]), least


def rating(quality: int, bad: int) -> int:
    return 2 if quality else 0 if bad >= VERY_POOR else 1


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> CumulativeLink:
    rows, least = collect_features(labelled(docs, labels, "quality", per_class, id_col, text_col), features, RARE)
    return ordinal.fit([(r["buckets"], r["vals"]) for r in rows], [rating(r["quality"], r["bad"]) for r in rows], l1=L1, least_rows=least, levels=3)


class Scorer:
    """Tail probabilities of texts; remembers the contribution of the words it has met."""

    def __init__(self, model: CumulativeLink):
        self.model, self.memo, self.chars = model, {}, 0

    def tails(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2) of each text, rounded; zero for texts without words."""
        weight, memo = self.model.weights.get, self.memo
        scores, empty = np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        for i in range(len(texts)):
            text = texts[i].as_py() or ""
            words = text.split()
            if not words:
                empty[i] = True
                continue
            kinds = set(words)
            if len(memo) > MEMO_WORDS or self.chars > MEMO_CHARS:
                memo.clear()
                self.chars = 0
            for word in kinds.difference(memo):
                a, b = word_buckets(word)
                memo[word] = weight(a, 0.0) + weight(b, 0.0)
                self.chars += len(word)
            scores[i] = sum(map(memo.__getitem__, words)) / (len(words) + SMOOTH) + sum(weight(b, 0.0) * v for b, v in layout(text, words))
        tails = self.model.tails(scores)
        tails[empty] = 0.0
        return np.round(tails, 6)


def score(docs: DataFrame, model: CumulativeLink, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, p_poor (P(grade >= 1)), p_good (P(grade >= 2)), kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            tails = scorer.tails(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= KEEP_AT)],
                names=["doc_id", "expected_grade", "p_poor", "p_good", "kept"],
            )

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, expected_grade double, p_poor double, p_good double, kept boolean"
    )


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Fits on the labelled sample and scores every document."""
    return score(docs, train(docs, labels, per_class))


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the documents that the classifier rejects."""
    model, at = train(docs, labels, per_class, text_col=text_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(scorer.tails(batch.column(at))[:, -1] >= KEEP_AT))

    return docs.mapInArrow(run, docs.schema)
