import numpy as np
import pytest

import corpus_pipeline
from readloom.llm import poisson_mix, quality_classifier, simhash, trie_bpe
from tests.llm.cases import documents, labels
from tests.llm.test_data import copies_of
from tests.llm.test_text import junk_and_good


def folder(spark, tmp_path, docs, marks):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def brute(spark, docs, marks):
    """The stages on rows: the classifier's verdicts, then plain Python."""
    verdicts = {r["doc_id"]: r["kept"] for r in quality_classifier.classify(docs, marks).collect()}
    rows = [r for r in docs.collect() if verdicts[r["doc_id"]]]
    best = {}
    for r in rows:
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    rows = [r for r in rows if best[r["text"]] == r["doc_id"]]
    prints = [int.from_bytes(simhash.similar_fingerprint(r["text"])[0].tobytes(), "little") for r in rows]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= simhash.SIMILAR_RADIUS and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    stays = {}
    for i, r in enumerate(rows):
        stays[root[i]] = min(stays.get(root[i], r["doc_id"]), r["doc_id"])
    rows = [r for i, r in enumerate(rows) if stays[root[i]] == r["doc_id"]]
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + 1
    total = sum(np.sqrt(c) for c in sizes.values())
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(trie_bpe.tokenizer_path())
    out = []
    for r in rows:
        rate = len(rows) * np.sqrt(sizes[r["source"]]) / total / sizes[r["source"]]
        out += [(r["doc_id"], t.encode(r["text"], add_special_tokens=False).ids)] * copies_of(r["doc_id"], r["text"], rate)
    return sorted(out)


def test_run_against_brute_force(spark, tmp_path):
    docs, marks = junk_and_good(spark, 120)
    rows = [(r["doc_id"], r["text"], "en", f"s{r['doc_id'] % 3}", len(r["text"])) for r in docs.collect()]
    rows += [(200 + i, rows[2 * i][1], "en", "s1", 1) for i in range(10)]
    rows += [(300 + i, rows[2 * i][1] + " aeio", "en", "s2", 1) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.run(spark, folder(spark, tmp_path, docs, marks))
    assert sorted((r["doc_id"], list(r["ids"])) for r in got.collect()) == brute(spark, docs, marks)
    assert all(r["n_tokens"] == len(r["ids"]) for r in got.collect())


def test_stages_keep_columns_and_survive_edge_cases(spark, tmp_path):
    docs = documents(spark)
    sf_dir = folder(spark, tmp_path, docs, labels(spark))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.count() > 0
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["op5_html_extraction", "op7_warc"])
def test_page_queries_run_on_edge_cases(spark, tmp_path, name):
    from readloom.llm import queries

    rows = [(1, "http://a/", "<p>x</p>" * 40), (1, None, "<p>x</p>" * 40), (None, "u", None), (None, None, None), (2, "http://a/", ""), (3, "http://a/", "<p>" + "w " * 300_000)]
    pages = spark.createDataFrame([(*r, "t", 7, 7) for r in rows], "page_id bigint, url string, html string, text string, ref int, key int")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.queries()[name](spark, str(tmp_path)).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    pages.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none/pages.parquet")
    assert queries.queries()[name](spark, f"{tmp_path}/none").count() == 0


def test_null_and_repeated_ids_lose_no_text_in_any_stage(spark, tmp_path):
    """Unrelated texts under null and repeated ids: the dedup stages keep them all."""
    texts = [" ".join(f"{i}word{k}" for k in range(30)) for i in range(6)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in zip([None, None, None, 5, 5, 7], texts, strict=True)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sf_dir = folder(spark, tmp_path, docs, labels(spark).limit(0))
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert sorted(r["text"] for r in stage(spark, docs, sf_dir).collect()) == sorted(texts), name


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None and poisson_mix.SEED


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_sharding", "op3_bpe", "op4_quality_classifier", "op6_quality_rules", "op8_mixing", "op9_simhash_near_dedup", "op10_toxicity"])
def test_registered_queries_run_on_edge_cases(spark, tmp_path, name):
    from readloom.llm import queries

    sf_dir = folder(spark, tmp_path, documents(spark), labels(spark))
    got = queries.queries()[name](spark, sf_dir)
    assert "doc_id" in got.columns
    assert got.count() > 0 if name == "op8_mixing" else got.count() == documents(spark).count()
