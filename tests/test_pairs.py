"""All pairs of items, copies among them, against brute force."""

import random

import pytest

from tests.oracle import assert_same, views
from tidemark.operators import clusters
from tidemark.plans import catalog


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    """Documents with many copies of a title, and titles a word or two apart."""
    rng, folder = random.Random(4), str(tmp_path_factory.mktemp("copied"))
    words = [f"word{c}" for c in "abcdefghijkl"]
    titles = ["flood river city news", "the flood river city news", "river flood city news", "flood river city story", "", "the of", *(" ".join(rng.sample(words, rng.randrange(3, 6))) for _ in range(40))]
    rows = [(i, titles[i % 7 if i % 3 else rng.randrange(len(titles))] + "\nbody") for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "length(text) as n_chars")
    docs.toPandas().to_parquet(f"{folder}/documents.parquet")
    return folder


def same(spark, folder, name, most):
    want = views(folder).execute(catalog.ORACLE_SQL[name]).df()
    assert len(want) > most
    assert_same(catalog.QUERIES[name](spark, folder).toPandas(), want)


@pytest.mark.parametrize("together", [4, 512])
def test_copies_meet_all_that_their_first_meets(spark, monkeypatch, together):
    """Whatever the length of a list: large classes meet in several."""
    monkeypatch.setattr(clusters, "TOGETHER", together)
    first = {i: min(i % 5, i) for i in range(60)} | {i: i for i in range(60, 70)}
    alike = {(0, 1): 0.5, (1, 60): 0.75, (2, 61): 0.625, (62, 63): 0.875}
    members = spark.createDataFrame(list(first.items()), "id long, first long")
    pairs = spark.createDataFrame([(*p, v) for p, v in alike.items()], "a long, b long, jaccard double")
    got = sorted(map(tuple, clusters.every_pair(pairs, members, "jaccard").collect()))
    value = lambda x, y: 1.0 if x == y else alike.get((min(x, y), max(x, y)))
    assert got == [(a, b, value(first[a], first[b])) for a in range(70) for b in range(a + 1, 70) if value(first[a], first[b])]


def test_overlaps_of_copies(spark, copied):
    same(spark, copied, "jaccard_pairs", 1000)


def test_edges_of_copies(spark, copied):
    same(spark, copied, "topic_edges", 1000)
