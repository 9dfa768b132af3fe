"""Rounds of topics write what a round decides, not all that was decided before."""

import random

from tidemark.operators import leaders


def test_a_round_writes_what_it_decides(spark, monkeypatch):
    rng, tables = random.Random(7), {}
    words = [f"word{c}" for c in "abcdefghijklmnopqrst"]
    rows = [(i, " ".join(rng.sample(words, 5)), float(rng.randrange(50))) for i in range(120)]
    plain = leaders.written
    monkeypatch.setattr(leaders, "written", lambda df, name: tables.setdefault(name, plain(df, name)))
    got = leaders.led_topics(spark.createDataFrame(rows, "id long, title string, score double")).collect()
    count = lambda kind: [t.count() for name, t in tables.items() if name.startswith(kind)]
    assert len(got) == 120 and len(count("decided-")) > 3
    assert sum(count("decided-")) == count("nodes-")[0]
    # nor are texts read again that wait no more
    assert len(count("undecided-")) > 1 and count("undecided-")[-1] < count("nodes-")[0] / 2
