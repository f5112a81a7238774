import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.llm import ordinal, quality_classifier, toxicity, trie_bpe, weak_supervision
from tests.llm.cases import TEXTS, documents, empty, labels


@pytest.fixture(scope="module")
def coder():
    return trie_bpe.Encoder(trie_bpe.tokenizer_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(trie_bpe.tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


def same(coder, library, texts):
    for text, ids in zip(texts, coder.encode_all(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_equals_the_library(coder, library):
    texts = [t or "" for t in TEXTS] + ["aaaaaaaaaaaaaaaaa", "<|startoftext|>x<|endoftext|><|endoftext|>", "\x1c\x1d a\x85b c", "don't I'LL we've 1234 !!!???", "\x00\x01﻿", "̸ ́a"]
    same(coder, library, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_bpe_equals_the_library_on_any_text(coder, library, texts):
    same(coder, library, [t.encode("utf-8", "ignore").decode() for t in texts])


def test_bpe_memo_overflow_changes_nothing(coder, library, monkeypatch):
    monkeypatch.setattr(trie_bpe, "MEMO_CHUNKS", 3)
    same(coder, library, ["some words that are many words", "and then some more of them words"])


def test_shared_prefixes_are_walked_once(coder, monkeypatch):
    vocabulary, steps = coder.vocabulary, []
    monkeypatch.setattr(vocabulary, "_steps", type("Counting", (dict,), {"get": lambda self, k: steps.append(k) or dict.get(self, k)})())
    vocabulary.encode_words({"reading", "reader", "readers", "readable"})
    # read is one path of four nodes for all words: e-r, e-r-s, a-b-l-e, i-n-g are new, the last letter of each its own node.
    assert len(steps) == len("reada") + len("bl") + 1 + len("e") + 1 + len("r") + 1 + len("in") + 1


def test_bpe_operator(spark, library):
    docs = documents(spark)
    path = trie_bpe.tokenizer_path()
    got = trie_bpe.encode_decode(docs, path).collect()
    want = sorted((str(r["doc_id"]), library.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect())
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == want
    listed = trie_bpe.encode_decode(docs, path, arrays=True).collect()
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in listed) == want
    assert trie_bpe.encode_decode(empty(spark), path).count() == 0


def test_ordinal_fit_recovers_ordered_grades():
    rng = np.random.default_rng(3)
    rows, grades = [], []
    for _ in range(900):
        x = rng.normal(size=3)
        s = 2 * x[0] - x[1] + rng.logistic() * 0.3
        rows.append(([5, 9, 70], x.tolist()))
        grades.append(int(s > -1) + int(s > 1))
    model = ordinal.fit(rows, grades, l1=1e-3)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    scores = np.array([sum(model.weights.get(b, 0) * v for b, v in zip(*r, strict=True)) for r in rows])
    tails = model.tails(scores)
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.mean((tails > 0.5).sum(axis=1) == np.array(grades)) > 0.85  # the noise leaves about 0.88
    assert abs(model.weights.get(70, 0.0)) < 0.2 * abs(model.weights[5])


def test_ordinal_fit_degenerate():
    assert ordinal.fit([], []).tails(np.zeros(1)).tolist() == [[0.5]]
    assert ordinal.fit([([1], [1.0])], [0]).tails(np.zeros(1))[0, 0] < 0.01
    assert np.round(ordinal.fit([([1], [1.0])], [1], levels=3).tails(np.zeros(1))).tolist() == [[1, 0]]
    assert ordinal.fit([([1], [1.0])], [2]).tails(np.zeros(1)).min() > 0.99


def junk_and_good(spark, n=400):
    rows, marks = [], []
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aeinorstl"), size=rng.integers(2, 8))) for _ in range(300)]
    for i in range(n):
        text = " ".join(rng.choice(words, size=rng.integers(15, 120)))
        toxic = i % 5 == 0
        if i % 4 == 1:
            text = " ".join(w.upper() + "!!" for w in text.split()) if i % 8 == 1 else " ".join(w + "$$$" for w in text.split())
        elif toxic:
            text = text.replace(" ", " moron, ", 1) + " Stupid"
        rows.append((i, text))
        marks.append((i, int(i % 4 != 1), int(toxic and i % 4 != 1)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


def test_classifiers_on_held_out_rows(spark):
    docs, marks = junk_and_good(spark)
    seen, unseen = docs.where("doc_id < 250"), docs.where("doc_id >= 250")
    truth = {r["doc_id"]: r for r in marks.collect()}
    quality = quality_classifier.score(unseen, quality_classifier.train(seen, marks)).collect()
    assert np.mean([r["kept"] == bool(truth[r["doc_id"]]["quality"]) for r in quality]) > 0.97
    assert all(0 <= r["p_good"] <= r["p_poor"] <= 1 and abs(r["expected_grade"] - r["p_poor"] - r["p_good"]) < 1e-6 for r in quality)
    severity = toxicity.score(unseen, toxicity.train(seen, marks)).collect()
    assert np.mean([r["toxic"] == bool(truth[r["doc_id"]]["toxic"]) for r in severity]) > 0.97
    again = quality_classifier.train(seen.repartition(5), marks)
    assert again == quality_classifier.train(seen, marks)


def test_classifier_edge_cases(spark):
    docs = documents(spark)
    for run in (quality_classifier.classify, toxicity.grade):
        assert run(docs, labels(spark)).count() == docs.count()
        assert run(docs, labels(spark).limit(0)).count() == docs.count()
        assert run(empty(spark), labels(spark)).count() == 0
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs, labels(spark)).collect()}
    assert all(not got[i]["kept"] and got[i]["p_poor"] == 0 for i in (3, 4, 5))
    unlabelled = {r["doc_id"]: r for r in quality_classifier.classify(docs, labels(spark).limit(0)).collect()}
    assert unlabelled[0]["kept"] and not unlabelled[4]["kept"]
    good = quality_classifier.keep_good(docs, labels(spark))
    assert good.schema == docs.schema
    kept = {r["doc_id"] for r in quality_classifier.classify(docs, labels(spark)).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept


def slow_fit(rows, grades, l1, least, levels, steps=6000):
    """Plain gradient steps on the penalised likelihood of the cumulative-link model, on a dense matrix; names, weights, thresholds."""
    often = Counter(int(b) for bs, _ in rows for b in bs)
    names = sorted(b for b, n in often.items() if n >= least)
    x = np.zeros((len(rows), len(names)))
    for i, (bs, vs) in enumerate(rows):
        for b, v in zip(bs, vs, strict=True):
            if int(b) in names:
                x[i, names.index(int(b))] += v
    scale = np.sqrt((x**2).mean(axis=0))
    scale[scale == 0] = 1.0
    x, y = x / scale, np.array(grades)
    w, t = np.zeros(len(names)), np.arange(levels - 1) - (levels - 2) / 2.0
    rate = 1.0 / (0.3 * np.linalg.eigvalsh(x.T @ x / len(x)).max() + 0.5)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for _ in range(steps):
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        s = x @ w
        hi, lo = sig(edges[y + 1] - s), sig(edges[y] - s)
        p = np.maximum(hi - lo, 1e-12)
        grad_t = np.array([(-hi * (1 - hi) / p)[y == k].sum() + (lo * (1 - lo) / p)[y == k + 1].sum() for k in range(levels - 1)]) / len(y)
        w = w - rate * (x.T @ (1 - hi - lo) / len(y))
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        t = t - 0.5 * grad_t
    return names, w / scale, t


def test_quality_classifier_against_brute_force(spark):
    """Ratings, features, fit and scores in plain Python on a small table."""
    docs, marks = junk_and_good(spark, 120)
    truth = {r["doc_id"]: r["quality"] for r in marks.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    bad = {i: sum(int(v[0] < 0) for v in weak_supervision.rule_votes(weak_supervision.count_batch(pa.array([t]))).values()) for i, t in texts.items()}
    grades = [2 if truth[i] else 0 if bad[i] >= 3 else 1 for i in sorted(texts)]
    assert set(grades) == {0, 1, 2}

    def slow_features(text):
        words, out = text.split(), Counter()
        for w in words:
            shape = re.sub(r"([Aa0])\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in w))
            out[ordinal.bucket("w:" + w.lower())] += 1 / (len(words) + 8)
            out[ordinal.bucket("s:" + shape)] += 1 / (len(words) + 8)
        for b, v in quality_classifier.layout(text, words):
            out[b] += v
        return list(out), list(out.values())

    rows = [slow_features(texts[i]) for i in sorted(texts)]
    names, w, t = slow_fit(rows, grades, quality_classifier.L1, 3, 3)
    weight = dict(zip(names, w.tolist(), strict=True))
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs, marks).collect()}
    for i, (bs, vs) in zip(sorted(texts), rows, strict=True):
        s = sum(weight.get(b, 0.0) * v for b, v in zip(bs, vs, strict=True))
        tails = 1 / (1 + np.exp(-(s - t)))
        assert abs(got[i]["p_poor"] - tails[0]) < 0.02 and abs(got[i]["p_good"] - tails[1]) < 0.02
        assert got[i]["kept"] == (got[i]["p_good"] >= 0.5)


def test_toxicity_against_brute_force(spark):
    docs, marks = junk_and_good(spark, 120)
    truth = {r["doc_id"]: r["toxic"] for r in marks.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)

    def slow_features(text):
        words = set(re.findall(r"[^\W\d_]+", text.lower()))
        return sorted({ordinal.bucket("t:" + w) for w in words} | {ordinal.bucket(f"t{n}:{w[:n]}") for w in words for n in (4, 5, 6) if len(w) > n})

    rows = [(f, [1.0] * len(f)) for f in map(slow_features, (texts[i] for i in ids))]
    toxic = [truth[i] for i in ids]
    names, w, _ = slow_fit(rows, toxic, toxicity.SELECT_L1, 3, 2, 1500)
    left = {n for n, x in zip(names, w, strict=True) if x}
    wide = ordinal.fit(rows, toxic, l1=toxicity.SELECT_L1, steps=150, least_rows=3)
    assert left == set(wide.weights) and {ordinal.bucket("t:moron"), ordinal.bucket("t:stupid")} & left
    # The scores of the operator are those of its model on these features.
    model = toxicity.train(docs, marks)
    assert set(model.weights) <= left and len(model.thresholds) == 2
    for r in toxicity.score(docs, model).collect():
        s = sum(model.weights.get(b, 0.0) for b in slow_features(texts[r["doc_id"]]))
        tails = 1 / (1 + np.exp(-(s - np.array(model.thresholds))))
        assert abs(r["p_mild"] - tails[0]) < 1e-6 and abs(r["p_severe"] - tails[1]) < 1e-6 and r["toxic"] == (r["p_mild"] > 0.5)


def test_whole_words_and_texts_count():
    """Words that differ after 64 letters and more are different words, and no length is treated apart."""
    a, b = "x" * 70 + "a", "x" * 70 + "b"
    assert quality_classifier.word_buckets(a) != quality_classifier.word_buckets(b)
    assert quality_classifier.word_buckets("a!" * 40 + "b")[1] != quality_classifier.word_buckets("a!" * 40 + "?")[1]
    assert toxicity.chunk_buckets(a) != toxicity.chunk_buckets(b)
    for n in (50, 1999, 2001, 5000):
        votes = weak_supervision.rule_votes(weak_supervision.count_batch(pa.array([" ".join(["same", "old"] * n), " ".join(f"w{i}" for i in range(2 * n))])))
        assert votes["rich"].tolist() == [-1, 0]
    rich = [dict(quality_classifier.layout(t, t.split())) for t in (" ".join(f"w{i}" for i in range(n)) for n in (2000, 2100, 9000))]
    key = ordinal.bucket("rich:20")
    assert all(key in r for r in rich)


def test_repeated_ids_are_read_alike(spark):
    docs = spark.createDataFrame([(1, "b text"), (1, "a text"), (1, None), (2, None)], "doc_id bigint, text string")
    marks = spark.createDataFrame([(1, 1, 0), (1, 0, None), (2, 0, 0)], "doc_id int, quality int, toxic int")
    got = quality_classifier.labelled(docs, marks, "quality", 10).collect()
    assert sorted((r["doc_id"], r["text"], r["quality"]) for r in got) == [(1, "a text", 1), (2, None, 0)]
    renamed = docs.withColumnsRenamed({"doc_id": "key", "text": "body"})
    assert quality_classifier.train(renamed, marks, 10, "key", "body") == quality_classifier.train(docs, marks, 10)


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def check_counts(texts):
    got = weak_supervision.count_batch(pa.array(texts, pa.string()))
    want = [slow_counts(t) for t in texts]
    for i, name in enumerate(weak_supervision.COUNTS):
        assert got[name].tolist() == [w[i] for w in want], name


def test_counts_against_brute_force():
    check_counts([*TEXTS, "a b c d e f g h a b c d e f g h", "h a b c d e f g h", "x\n\nx\n \ny\nx ", "p q " * 9])
    check_counts([])
    check_counts([None])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t|\x1c\xa0", max_size=60), max_size=4))
def test_counts_on_any_text(texts):
    check_counts(texts)


def test_quality_rules_operator(spark):
    docs = documents(spark)
    got = weak_supervision.judge(docs)
    rows = got.collect()
    assert len(rows) == docs.count() and weak_supervision.judge(empty(spark)).count() == 0
    want = sorted((str(r["doc_id"]), *slow_counts(r["text"])) for r in docs.collect())
    assert sorted((str(r["doc_id"]), *(r[k] for k in weak_supervision.COUNTS)) for r in rows) == want
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"]) and 0 <= r["p_good"] <= 1


def test_posterior_replaces_all_must_pass():
    """Junk of several kinds goes; a good document that fails one weak rule may stay."""
    R = weak_supervision.RULES
    code = lambda **v: int(sum((v.get(r, 0) + 1) * 3**i for i, r in enumerate(R)))
    clean, junk = code(length=1, word_length=1), code(length=1, word_length=1, symbols=-1, plain=-1)
    loud, short = code(length=1, word_length=1, upper=-1, loud=-1, plain=-1), code(word_length=1)
    counts = {clean: 8000, junk: 600, loud: 500, short: 900}
    post, share, tables = weak_supervision.expectation_maximisation(counts)
    assert post[clean] > 0.5 > post[junk] and post[short] > 0.5 > post[loud] and 0.5 < share < 1
    scaled = weak_supervision.expectation_maximisation({k: 1000 * v for k, v in counts.items()})[0]
    assert all(abs(scaled[k] - post[k]) < 1e-6 for k in counts)
    assert np.allclose(tables.sum(axis=2), 1)
    assert weak_supervision.pattern_votes(junk) == [{"length": 1, "word_length": 1, "symbols": -1, "plain": -1}.get(r, 0) for r in R]


def test_digest_query_columns(spark, tmp_path):
    """The registered query derives its digests from the operator's ids and text."""
    from readloom.llm import queries

    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {str(r["doc_id"]): r for r in queries.op3_bpe(spark, str(tmp_path)).collect()}
    for r in trie_bpe.encode_decode(docs, trie_bpe.tokenizer_path()).collect():
        got = rows[str(r["doc_id"])]
        if r["doc_id"] is not None:
            assert got["n_tokens"] == len(r["ids"]) // 4
            assert got["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest()
            assert got["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
