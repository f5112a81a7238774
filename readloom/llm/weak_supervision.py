"""Quality rules combined by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document; most can only vote bad. Expectation-maximisation
over all documents estimates the share of good documents and, for each rule, how it votes
on good and on bad ones (its accuracies); a document's posterior probability of being
good replaces the demand that it pass every rule.

Plan: one pass over whole texts computes counts and votes in Arrow batches; the counts
are materialized; documents are counted by vote pattern (at most 3 ** rules rows, whatever
the input), EM runs on those counts, and the posterior of each pattern is joined back by
a broadcast of that bounded table. No text and no group is exchanged.

Defined cases: a null text has no words and all counts zero; ids may be null or repeated
(one result row per row); a text of any length is read whole; documents with the same votes tie and
get the same posterior, and one of exactly ``GOOD_AT`` is good; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import materialize, small_batches

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Posterior from which a document is good.
GOOD_AT = 0.5
#: Pseudo-counts of each rule's vote table, as a share of all documents.
PRIOR_SHARE = 0.3
#: A word or number of prose, with the punctuation that may stand at it.
PLAIN_WORD = r"^[\"'(\[]*[\p{L}\p{N}][\p{L}\p{M}\p{N}'’.@:/_-]*[\"')\]]*[.,;:!?]?[\"')\]]*$"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _votes(bad: np.ndarray, good: np.ndarray | bool = False) -> np.ndarray:
    return np.where(bad, -1, np.where(good, 1, 0)).astype(np.int8)


def rule_votes(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The votes of each rule, from counts of each document."""
    n = np.maximum(c["n_words"], 1)
    lines, letters = np.maximum(c["n_lines"], 1), np.maximum(c["n_letters"], 1)
    length, symbols, repeated = c["word_chars"] / n, c["n_symbols"] / n, c["n_repeat_words"] / n
    plain = c["n_plain"] / n
    again, upper, loud = c["n_again"] / n, c["n_upper"] / letters, c["n_loud"] / n
    # Distinct words by words, as logarithms: their quotient hardly depends on the length of prose.
    rich = np.where(n > 1, np.log(np.maximum(c["n_distinct"], 1)) / np.log(np.maximum(n, 2)), 1.0)
    return {
        "length": _votes(c["n_words"] < 5, c["n_words"] >= 40),
        "word_length": _votes((length < 2) | (length > 16), (length >= 3) & (length <= 10)),
        "symbols": _votes(symbols > 0.15),
        "dup_lines": _votes(c["n_dup_lines"] / lines > 0.5),
        "repeated": _votes(repeated > 0.3),
        "again": _votes(again > 0.1),
        "upper": _votes(upper > 0.4),
        "rich": _votes(rich < 0.7),
        "loud": _votes(loud > 0.15),
        "plain": _votes((plain < 0.6) & (c["n_words"] > 0)),
    }


RULES = ("length", "word_length", "symbols", "dup_lines", "repeated", "again", "upper", "rich", "loud", "plain")


def _repeated_words(ids: np.ndarray, doc: np.ndarray, docs: int, width: int = WINDOW) -> np.ndarray:
    """Words of each document in windows of width words that occur twice or more in the document."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(docs, dtype=np.int64)
    inside = doc[:n] == doc[width - 1 :]
    # A 64-bit hash finds all candidates; equal windows always share it.
    word = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    word = (word ^ (word >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    word ^= word >> np.uint64(32)
    key = doc[:n].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    for k in range(width):
        key = key * np.uint64(0xD6E8FEB86659FD93) + word[k : k + n]
    at = np.nonzero(inside)[0]
    order = at[np.argsort(key[at])]
    same = key[order][1:] == key[order][:-1]
    twin = np.zeros(len(order), dtype=bool)
    twin[1:] |= same
    twin[:-1] |= same
    found = np.sort(order[twin])
    if len(found):  # the words themselves decide
        exact = np.column_stack([doc[found], *(ids[found + k] for k in range(width))]).astype(np.int64)
        rows = np.ascontiguousarray(exact).view([("", np.int64)] * exact.shape[1]).ravel()
        _, inverse, counts = np.unique(rows, return_inverse=True, return_counts=True)
        found = found[counts[inverse] > 1]
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + width, -1)
    return np.bincount(doc[np.cumsum(edge)[:-1] > 0], minlength=docs)


def count_batch(texts: pa.Array) -> dict[str, np.ndarray]:
    """All counts of each text of a batch."""
    docs = len(texts)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")

    def pieces(split: pa.Array) -> tuple[pa.Array, np.ndarray]:
        sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        return split.flatten(), np.repeat(np.arange(docs), sizes)

    def per_doc(doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc, weights, minlength=docs).astype(np.int64)

    def count(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)

    words, doc = pieces(pc.ascii_split_whitespace(texts))
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    words, doc = words.filter(pa.array(real)), doc[real]
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    vocabulary = max(len(coded.dictionary), 1)
    plain = pc.match_substring_regex(coded.dictionary, PLAIN_WORD).to_numpy(zero_copy_only=False)
    again = np.nonzero((ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1]))[0]
    lines, line_doc = pieces(pc.split_pattern(texts, "\n"))
    real = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    lines, line_doc = lines.filter(pa.array(real)), line_doc[real]
    line_ids = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kinds = int(line_ids.max()) + 1 if len(line_ids) else 1
    n_lines = per_doc(line_doc)
    return {
        "n_words": per_doc(doc),
        "word_chars": per_doc(doc, pc.utf8_length(words).to_numpy(zero_copy_only=False)),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_dup_lines": n_lines - per_doc(np.unique(line_doc * kinds + line_ids) // kinds),
        "n_repeat_words": _repeated_words(ids, doc, docs),
        "n_lines": n_lines,
        "n_letters": count(r"\p{L}"),
        "n_upper": count(r"\p{Lu}"),
        "n_loud": count(r"!!"),
        "n_again": per_doc(doc[1:][again]) if len(again) else np.zeros(docs, np.int64),
        "n_plain": per_doc(doc[plain[ids]]) if len(ids) else np.zeros(docs, np.int64),
        "n_distinct": per_doc(np.unique(doc * vocabulary + ids) // vocabulary),
    }


def pattern_code(votes: dict[str, np.ndarray]) -> np.ndarray:
    return sum((votes[r].astype(np.int64) + 1) * 3**i for i, r in enumerate(RULES))


def pattern_votes(code: int) -> list[int]:
    return [code // 3**i % 3 - 1 for i in range(len(RULES))]


def expectation_maximisation(patterns: dict[int, int], steps: int = 100) -> tuple[dict[int, float], float, np.ndarray]:
    """Posterior of each vote pattern, share of good documents, and P(vote | good or bad) of each rule.

    patterns: documents with each pattern. The start takes documents without a bad vote for good;
    pseudo-counts keep a rule from voting with certainty.
    """
    if not patterns:
        return {}, 0.5, np.zeros((2, len(RULES), 3))
    codes = sorted(patterns)
    votes = np.array([pattern_votes(c) for c in codes]) + 1
    n = np.array([patterns[c] for c in codes], dtype=float)
    bads = (votes == 0).sum(axis=1)
    good = np.where(bads == 0, 0.95, np.where(bads == 1, 0.2, 0.02))
    shown = np.stack([votes == v for v in range(3)], axis=2)  # pattern, rule, vote
    voted = shown & (votes != 1)[:, :, None]  # who abstains says nothing
    # Before any document: bad votes are rare on good documents and common on bad ones. The pseudo-counts
    # are a share of the documents, so the estimates do not depend on the size of the input.
    prior = np.array([[0.01, 0.19, 0.8], [0.3, 0.35, 0.35]])[:, None, :] * PRIOR_SHARE * n.sum()
    for _ in range(steps):
        share = (good * n).sum() / n.sum()
        share = min(max(share, 0.01), 0.99)
        tables = []
        for y, weight in enumerate((good * n, (1 - good) * n)):
            counts = np.einsum("p,prv->rv", weight, shown) + prior[y]
            tables.append(counts / counts.sum(axis=1, keepdims=True))
        logs = np.log(np.array(tables))
        odds = np.log(share / (1 - share)) + np.einsum("prv,rv->p", voted, logs[0] - logs[1])
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        done = np.abs(new - good).max() < 1e-9
        good = new
        if done:
            break
    return dict(zip(codes, good.tolist(), strict=True)), float(share), np.array(tables)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts of the contract, and the code of the votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = count_batch(batch.column(1))
                columns = [batch.column(0), *(pa.array(c[k]) for k in COUNTS), pa.array(pattern_code(rule_votes(c)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "votes"])

    small_batches(docs.sparkSession)
    ddl = "doc_id bigint, " + ", ".join(f"{k} bigint" for k in COUNTS) + ", votes bigint"
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, counts, base_failed, p_good, kept."""
    measured = materialize(measure(docs, id_col, text_col))
    patterns = {r["votes"]: r["n"] for r in measured.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    posterior, _, _ = expectation_maximisation(patterns)
    table = docs.sparkSession.createDataFrame([(c, round(p, 6)) for c, p in posterior.items()], "votes bigint, p_good double")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (
        measured.join(F.broadcast(table), "votes")
        .withColumn("base_failed", base)
        .select("doc_id", *COUNTS, "base_failed", "p_good", (~F.col("base_failed") & (F.col("p_good") >= GOOD_AT)).alias("kept"))
    )
