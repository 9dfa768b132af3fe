"""The pipeline: stages on odd rows, and the whole on the smallest tables."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import DOC, brute_classes
from tidemark.llm import catalog


@pytest.fixture(scope="module")
def result(spark, small):
    return corpus_pipeline.run(spark, small).cache()


def test_all_tokens_decode(spark, small, result):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = result.collect()
    assert rows and all(r["round_trip"] for r in rows)
    for r in rows:
        assert r["ids"] == t.encode(docs[r["doc_id"]], add_special_tokens=False).ids


def test_no_near_duplicates_are_left(spark, small, result):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    left = [r["doc_id"] for r in result.select("doc_id").collect()]
    classes = brute_classes({i: docs[i] for i in left})
    assert all(c == i for i, (_, c) in classes.items())


def test_stages_keep_columns_and_odd_rows(spark, small):
    rows = [(None, None, None, None, None, None, None, None)] + [(i, "of the in and to be that it is was " * 3 + str(i), "en", f"s{i % 2}", 5, 1, 0.1, 2) for i in range(40)]
    docs = spark.createDataFrame(rows, DOC)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
        assert stage(spark, docs.limit(0), small).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert last.count() == docs.count() and last.where("not round_trip").count() == 0


def test_mixing_loses_no_document(spark, small):
    sources = ["one"] + ["five"] * 5 + ["third"] * 300 + [f"s{i % 7}" for i in range(594)] + [None] * 3
    docs = spark.createDataFrame([(i, f"text {i}", "en", s, 6, 1, 0.1, 2) for i, s in enumerate(sources)], DOC)
    out = corpus_pipeline.mix_sources(spark, docs, small).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(len(sources)))
    assert all(r["source"] == sources[r["doc_id"]] for r in out)
    plan = corpus_pipeline.tokens(spark, docs, small).orderBy("slot", "place").collect()
    assert len({(r["slot"], r["place"]) for r in plan}) == len(sources)
    assert [r["doc_id"] for r in plan] == [r["doc_id"] for r in out]


def test_clean_documents_pass_the_language_stage(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert corpus_pipeline.drop_undetermined(spark, docs, small).count() >= 0.98 * docs.count()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_runs(spark, small, name):
    rows = catalog.QUERIES[name](spark, small)
    first = rows.columns[0]
    assert rows.count() > 0 and rows.where(F.col(first).isNull()).count() == 0


def test_digests_are_those_of_the_texts(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in catalog.QUERIES["op4_bpe_round_trip"](spark, small).collect():
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
