"""Gaps against every pair of topic and item."""

import re

import numpy as np
import pytest

from tidemark.operators import gaps
from tidemark.sources.tables import written

ROWS = "id long, title string, v array<double>, score double, countries long"


def words(title):
    return {w for w in re.split(r"[\s\W_]+", (title or "").lower()) if len(w) >= 3}


def brute(topic, item, bar):
    if topic[2] is not None and item[2] is not None:
        n = min(len(topic[2]), len(item[2]))
        return round(float(np.dot(topic[2][:n], item[2][:n])), 9)
    a = words(topic[1])
    return round(len(a & words(item[1])) / len(a) * bar, 9) if a else 0.0


def sample(n, seed, first=0):
    rng = np.random.default_rng(seed)
    names = ["river", "flood", "Élan", "vote", "count!", "ash-cloud", "of", "star"]
    out = []
    for i in range(first, first + n):
        v = rng.normal(size=4 if i % 5 else 3)
        v = None if i % 4 == 1 else list(map(float, v / np.linalg.norm(v)))
        out.append((i, None if i % 11 == 0 else " ".join(rng.choice(names, 3)), v, float(i % 3), int(i % 2)))
    return out


@pytest.mark.parametrize("topics, items", [(512, 8192), (3, 7)])
def test_gaps_are_brute_force(spark, monkeypatch, topics, items):
    monkeypatch.setattr(gaps, "TOPICS", topics)
    monkeypatch.setattr(gaps, "ITEMS", items)
    demand, supply = sample(17, 1), sample(60, 2, 100)
    supply += [(900 + i, supply[3][1], supply[3][2], 0.0, 0) for i in range(5)]  # ties
    got = gaps.gap_report(spark.createDataFrame(demand, ROWS), spark.createDataFrame(supply, ROWS), keep=4, bar=0.6).collect()
    assert len(got) == len(demand)
    for r in got:
        topic = next(t for t in demand if t[0] == r["topic"])
        scores = sorted(((-brute(topic, i, 0.6), i[0]) for i in supply), key=lambda x: x)
        covered = sum(-s >= 0.6 for s, _ in scores)
        assert r["covered"] == covered
        assert r["verdict"] == ("uncovered" if not covered else "thin" if covered < 3 else "covered")
        assert [(m["item"], m["similarity"]) for m in r["matches"]] == [(i, pytest.approx(-s, abs=6e-4)) for s, i in scores if s < 0][:4]
        assert r["by_meaning"] == (topic[2] is not None) and r["title"] == topic[1]


def test_gaps_of_nothing(spark):
    some, none = spark.createDataFrame(sample(3, 1), ROWS), spark.createDataFrame([], ROWS)
    assert gaps.gap_report(none, some).collect() == []
    assert {(r["covered"], r["verdict"], len(r["matches"])) for r in gaps.gap_report(some, none).collect()} == {(0, "uncovered", 0)}


@pytest.mark.parametrize("blocks", [1, 30])
def test_copies_are_compared_once(spark, monkeypatch, blocks):
    """Equal rows travel as one, with as many ids as can be among the best; all of them count."""
    tables = {}
    monkeypatch.setattr(gaps, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    for name, value in (("TOPICS", 2), ("ITEMS", 4), ("BLOCKS", blocks), ("LEAST", 0.1), ("MOST", 1000)):
        monkeypatch.setattr(gaps, name, value)
    some = [(t, v) for _, t, v, _, _ in sample(12, 3)]
    demand = [(i, *some[i % 6], 0.0, 0) for i in range(24)]
    supply = [(1000 - i, *some[i % 12], 0.0, 0) for i in range(200)]
    matches, counts = gaps.compared(spark.createDataFrame(demand, ROWS), spark.createDataFrame(supply, ROWS), keep=4, bar=0.6)
    got, covered = {}, {r["topic"]: r["covered"] for r in counts.collect()}
    for r in sorted(matches.collect(), key=lambda r: r["place"]):
        got.setdefault(r["topic"], []).append((r["item"], pytest.approx(r["score"], abs=1e-9)))
    for topic in demand:
        scores = sorted((-brute(topic, i, 0.6), i[0]) for i in supply)
        assert got.get(topic[0], []) == [(i, -s) for s, i in scores if s < 0][:4]
        assert covered[topic[0]] == sum(-s >= 0.6 for s, _ in scores)
    sizes = [t.count() for name, t in tables.items() if name.startswith("compared")]
    assert sizes == [6, len({(frozenset(words(t)), str(v)) for t, v in some})]


def test_rows_are_copied_seldom():
    """Six times the rows are dealt as blocks of bounded size, not as six times as many copies."""
    copies = lambda topics, items: (lambda d, s: (topics * s + items * d) / (topics + items))(*gaps._dealt(topics, items))
    assert gaps._dealt(1, 0) == gaps._dealt(0, 1) == gaps._dealt(50, 950) == (1, 1)
    assert copies(12_800, 243_600) < 5 and copies(76_800, 1_461_600) < 12
    d, s = gaps._dealt(76_800, 1_461_600)
    assert 76_800 / d * 1_461_600 / s <= 1.2 * gaps.MOST * gaps.TOPICS * gaps.ITEMS
