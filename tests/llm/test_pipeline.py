"""The pipeline's stages beside brute force over a small table, and the registered queries beside their statements."""

import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from agentlog.llm import langid, queries
from tests.compare import compare, connect
from tests.llm.test_operators import brute_components, lower, targets

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    assert compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {k.split("_")[0] for k in [*queries.QUERIES, "pipeline"]}
    assert set(queries.QUERIES) < set(entry.queries()) and "pipeline" in entry.queries()


def test_stages_that_send_texts_to_python_do_so_in_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, inner = spark.conf.get(key), {}, corpus_pipeline.written
    monkeypatch.setattr(corpus_pipeline, "written", lambda df, name: seen.setdefault(name, int(spark.conf.get(key))) and inner(df, name))
    docs = spark.createDataFrame([(1, "a", "the thing", "en"), (2, "a", "das Ding", "de")], "doc_id long, source string, text string, lang string")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["language_id"](spark, docs, SF).count() == stages["sentencepiece"](spark, docs, SF).count() == 2
    assert len(seen) == 2 and max(seen.values()) <= 1000 and spark.conf.get(key) == before


def test_languages_are_predicted_once(spark):
    docs = spark.createDataFrame([(1, "a", "the thing", "en"), (2, "a", "das Ding", None)], "doc_id long, source string, text string, lang string")
    known = langid.with_known_language(docs, langid.Model(), lang="lang")
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        out = out.cache()
        before, after = docs.collect(), out.collect()
        rows[name] = after
        ids = {r.doc_id for r in after}
        if name == "language_id":
            assert {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")} == ids
        elif name == "exact_dedup":
            best = {}
            for r in before:
                best[lower(r.text)] = max(r.doc_id, best.get(lower(r.text), -1))
            assert ids == set(best.values()) and len(after) == len(best)
        elif name == "near_dedup":
            assert ids == {i for i, _, c in brute_components([(r.doc_id, r.text) for r in before], 5, 80) if i == c}
        elif name == "mix_sources":
            size = {}
            taken = {}
            for r in before:
                size[r.source] = size.get(r.source, 0) + len(r.text.encode().split())
            for r in after:
                taken[r.source] = taken.get(r.source, 0) + len(r.text.encode().split())
            expected = targets(size)
            assert all(abs(taken[s] - expected[s]) <= 1 for s in expected)
            assert all(r.n_chars == len(r.text) for r in after)
        else:
            lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            text = {r.doc_id: r.text for r in before}
            assert all(r.ids == lib.encode(text[r.doc_id]) for r in after) and len(after) == len(before)
        docs = out
