"""The trigram index against scans of folded texts."""

import random

import pytest

from tidemark.operators import ranking, search
from tidemark.sources import folders

ITEMS = "id long, title string, body string"


@pytest.fixture()
def index(spark, tmp_path):
    return search.TrigramIndex(spark, f"file://{tmp_path}/index", buckets=8)


def found(index, needle):
    return sorted(r["id"] for r in index.matches(needle).collect())


def scan(texts, needle):
    n = search.folded(needle)
    return sorted(i for i, fields in texts.items() if any(n in search.folded(f or "") for f in fields))


def test_folding():
    assert search.folded("ÀÉÎ Ünïcode Ω ё 한국 اَب") == "aei unicode ω е 한국 اب"
    assert search.folded("plain TEXT") == "plain text"


def test_searches_equal_a_folded_scan(spark, index):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abé😀 ") for _ in range(rng.randrange(12)))
    texts = {i: (word(), word() * rng.randrange(4)) for i in range(120)}
    texts |= {500: (None, None), 501: ("ab", "é"), 502: ("", "x" * 50_000 + "end of it"), 503: ("aaaaaaaa", None)}
    index.add(spark.createDataFrame([(i, *f) for i, f in texts.items()] + [(None, "aab", "aab")], ITEMS))
    for needle in ["aab", "ABE", "é😀a", " ab", "aaaaaaaaa", "aaaaaaaa", "end of it", "xxd of", "abéab", "b😀 a", "of it!"]:
        assert found(index, needle) == scan(texts, needle), needle
    with pytest.raises(ValueError):
        index.matches("ab")


def test_gram_in_one_field_and_rest_in_the_other_is_no_match(spark, index):
    index.add(spark.createDataFrame([(1, "abc", "cde"), (2, "abcde", None), (3, "abc abcd", "bcde cde")], ITEMS))
    assert found(index, "abcde") == [2]


def test_segments_replace_and_remove_items(spark, index):
    index.add(spark.createDataFrame([(1, "first words", None), (2, "first words", None), (3, "other", None)], ITEMS))
    before = {n: folders.names(spark, f"{index.path}/segment=1/{n}") for n in ("postings", "counts", "ids")}
    index.add(spark.createDataFrame([(2, "second words", None), (4, "first again", None)], ITEMS))
    assert found(index, "first") == [1, 4] and found(index, "words") == [1, 2] and found(index, "second") == [2]
    index.remove(spark.createDataFrame([(1,)], "id long"))
    assert found(index, "first") == [4] and found(index, "words") == [2]
    index.add(spark.createDataFrame([(1, "first back", None)], ITEMS))
    assert found(index, "first") == [1, 4]
    index.add(spark.createDataFrame([], ITEMS))
    assert found(index, "first") == [1, 4] and index.segments() == [1, 2, 3, 4, 5]
    assert before == {n: folders.names(spark, f"{index.path}/segment=1/{n}") for n in ("postings", "counts", "ids")}


def test_a_search_opens_the_buckets_of_its_grams_only(spark, index):
    rng = random.Random(2)
    index.add(spark.createDataFrame([(i, "".join(rng.choice("abcdefghijkl") for _ in range(60)), None) for i in range(200)], ITEMS))
    chosen = index.plan("abcd")
    n = {r["gram"]: r["n"] for r in index._read("counts", "gram bigint, n bigint", [g for g, _ in chosen]).collect()}
    assert [n[g] for g, _ in chosen] == sorted(n.values())  # the rarest first
    wanted = {r[0] for r in spark.createDataFrame(chosen, "gram bigint, at int").select(index._bucket()).collect()}
    plan = index.matches("abcd")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "positions" in line and "FileScan" in line]
    assert scans and all("PartitionFilters: [bucket#" in s or "PartitionFilters: [isnotnull(bucket#" in s for s in scans)
    assert all("EqualTo(gram" in s or "In(gram" in s for s in scans)
    opened = index._read("postings", search._POSTING, [g for g, _ in chosen]).select("bucket").distinct().collect()
    assert {r["bucket"] for r in opened} == wanted and len(wanted) < 8


def test_an_unfinished_segment_is_not_seen(spark, index):
    index.add(spark.createDataFrame([(1, "first words", None)], ITEMS))
    spark.range(3).write.parquet(f"{index.path}/_unfinished/ids")
    assert index.segments() == [1] and found(index, "first") == [1]


def test_the_page_asks_the_index(spark, index):
    rows = spark.createDataFrame([(1, "Élan vital", None, 5.0), (2, "elan", None, 9.0), (3, "else", None, 7.0)], ITEMS + ", score double")
    index.add(rows)
    ids = lambda q, **k: [r["id"] for r in ranking.page(rows, q, **k).collect()]
    assert ids(ranking.RankedQuery(text="ELAN"), index=index) == [2, 1]
    assert ids(ranking.RankedQuery(text="ELAN")) == [2]  # the scan does not fold marks
    assert ids(ranking.RankedQuery(text="el"), index=index) == [2, 3]  # too short for the index
    assert ranking.count(rows, ranking.RankedQuery(text="élan"), index=index).first()["total"] == 2
