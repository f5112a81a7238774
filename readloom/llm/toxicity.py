"""Toxicity: ordinal regression that predicts severity grades from the words of a text.

Grades: 0 clean, 1 mild, 2 severe. The ``labels`` table says only whether a document is
toxic, so a first fit with the two grades it has ranks the toxic documents, and those
scored above their median become severe; the second fit has all grades. Features are the
hashed distinct words and word stems of a text (letters only, lower case), present or absent, so a long
text is judged by what it contains, not by how much else surrounds it; the L1 penalty
leaves weights to few words. Output: expected severity, P(severity >= 1) and >= 2.

The fit reads at most ``per_class`` labelled documents of each value; scoring covers all
documents and whole texts, without an exchange. The driver gets the features that one in ``RARE``
texts of the sample has or more.

Defined cases: null and empty texts have no words and the severity of a text without known words; without labels each
tail is 0.5 and nothing is called toxic; null labels are ignored; of repeated labels the
largest values count; of repeated ids in documents the fit reads the least text, and each row is scored;
texts with the same words tie; of toxic texts that tie at the median none is severe; texts and words of any
length count whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import ordinal
from readloom.llm.ordinal import CumulativeLink, bucket
from readloom.llm.quality_classifier import collect_features, labelled

#: Labelled documents of each value of toxic that the fit reads at most.
PER_CLASS = 2000
#: P(severity >= 1) above which a document is called toxic.
TOXIC_AT = 0.5
#: Penalty by which words are selected, and that of the fits on the words left. A word in under one of RARE texts of
#: the sample is not selected.
SELECT_L1, REFIT_L1, RARE = 3e-2, 5e-4, 200
#: Distinct chunks that a worker remembers, and their characters.
MEMO_WORDS, MEMO_CHARS = 200_000, 8_000_000

_LETTERS = re.compile(r"[^\W\d_]+")


def chunk_buckets(chunk: str) -> tuple[int, ...]:
    """Hashed words of one chunk between white space, and their stems of 4 to 6 letters."""
    found = set()
    for word in _LETTERS.findall(chunk.lower()):
        found.add(bucket("t:" + word))
        found.update(bucket(f"t{n}:{word[:n]}") for n in (4, 5, 6) if len(word) > n)
    return tuple(found)


def features(text: str) -> tuple[list[int], list[float]]:
    found = sorted({b for chunk in set(text.split()) for b in chunk_buckets(chunk)})
    return found, [1.0] * len(found)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> CumulativeLink:
    rows, least = collect_features(labelled(docs, labels, "toxic", per_class, id_col, text_col), features, RARE)
    sparse = [(r["buckets"], r["vals"]) for r in rows]
    toxic = [int(bool(r["toxic"])) for r in rows]
    wide = ordinal.fit(sparse, toxic, l1=SELECT_L1, steps=150, least_rows=least)
    # The words that the strong penalty leaves are fitted again with a weak one, free of its shrinkage.
    left = np.array(sorted(wide.weights), dtype=np.int64)
    sparse = [(b[k], v[k]) for b, v in sparse for k in [np.isin(b, left)]]
    if not any(toxic):
        return ordinal.fit(sparse, toxic, levels=3)
    first = ordinal.fit(sparse, toxic, l1=REFIT_L1)
    scores = np.array([sum(first.weights.get(b, 0.0) for b in x.tolist()) for x, _ in sparse])
    middle = float(np.median(scores[np.array(toxic, dtype=bool)]))
    return ordinal.fit(sparse, [t + int(t and s > middle) for s, t in zip(scores, toxic, strict=True)], l1=REFIT_L1, levels=3)


def score(docs: DataFrame, model: CumulativeLink, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_severity, p_mild (P(severity >= 1)), p_severe (>= 2), toxic."""
    weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}  # chunks' buckets that have a weight
        chars = 0
        for batch in batches:
            scores, column = [], batch.column(1)
            for i in range(batch.num_rows):
                chunks = set((column[i].as_py() or "").split())
                for chunk in chunks.difference(memo):
                    memo[chunk] = tuple(b for b in chunk_buckets(chunk) if b in weights)
                    chars += len(chunk)
                met = set().union(*map(memo.__getitem__, chunks)) if chunks else ()
                scores.append(sum(weights[b] for b in sorted(met)))
                if len(memo) > MEMO_WORDS or chars > MEMO_CHARS:
                    memo.clear()
                    chars = 0
            tails = np.round(model.tails(np.array(scores)), 6)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, -1]), pa.array(tails[:, 0] > TOXIC_AT)],
                names=["doc_id", "expected_severity", "p_mild", "p_severe", "toxic"],
            )

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, expected_severity double, p_mild double, p_severe double, toxic boolean"
    )


def grade(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Fits on the labelled sample and scores every document."""
    return score(docs, train(docs, labels, per_class))
