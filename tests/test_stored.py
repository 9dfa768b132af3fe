"""Stored tables: versions, failing writes, rebuilds; retention; rolling baselines."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.model import NOW
from tidemark.operators import retention, rolling, scoring
from tidemark.sources import folders, stored

ROW = "id long, name string, at long"


@pytest.fixture()
def make(spark, tmp_path):
    return lambda name="t", part=stored.buckets(["id"], 4): stored.StoredTable(spark, f"file://{tmp_path}/{name}", part)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upserts_write_the_buckets_they_touch(spark, make):
    table = make()
    table.upsert(spark.createDataFrame([(i, f"n{i}", i) for i in range(40)], ROW), stored.newest_by(["id"], "at"))
    first = table.version()
    table.upsert(spark.createDataFrame([(3, "new", 0), (3, "newer", 1), (99, "more", 2), (None, "none", 1)], ROW), stored.newest_by(["id"], "at"))
    second = table.version()
    assert rows_of(table.read()) == sorted([*[(i, f"n{i}", i) for i in range(40) if i != 3], (3, "newer", 1), (99, "more", 2), (None, "none", 1)], key=str)
    assert rows_of(table.read(1)) == sorted([(i, f"n{i}", i) for i in range(40)], key=str)  # the version before
    touched = {r[0] for r in spark.createDataFrame([(3,), (99,), (None,)], "id long").select(F.expr(table.part)).collect()}
    assert {p for p in first.parts if first.parts[p] != second.parts[p]} <= touched and set(first.parts) - touched


def test_column_rules(spark, make):
    table, cols = make(), "id long, title string, body string, lang string, last_seen_at long"
    merge = stored.merged_by(["id"], {"title": "last", "body": "newest", "lang": "oldest", "last_seen_at": "last"}, "last_seen_at")
    table.upsert(spark.createDataFrame([(1, "a", "x", None, 50)], cols), merge)
    table.upsert(spark.createDataFrame([(1, "b", None, "en", 40), (1, "c", None, "fr", 45)], cols), merge)  # arrives later
    table.upsert(spark.createDataFrame([(1, None, "y", "de", 60)], cols), merge)
    assert rows_of(table.read()) == [(1, None, "y", "en", 60)]


def test_a_write_that_breaks_leaves_the_version_before(spark, make, monkeypatch):
    table = make()
    table.put(spark.createDataFrame([(1, "one", 1)], ROW))

    @F.udf("string")
    def broken(i):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        table.put(spark.createDataFrame([(1, "two", 2)], ROW).withColumn("name", broken("id")))
    assert rows_of(table.read()) == [(1, "one", 1)] and table.versions() == [1]

    with monkeypatch.context() as m:  # killed between the data and the manifest
        m.setattr(folders, "renamed", lambda *a: (_ for _ in ()).throw(SystemExit()))
        with pytest.raises(SystemExit):
            table.put(spark.createDataFrame([(1, "three", 3)], ROW))
    assert rows_of(table.read()) == [(1, "one", 1)] and table.versions() == [1]
    table.put(spark.createDataFrame([(1, "four", 4)], ROW))
    assert rows_of(table.read()) == [(1, "four", 4)]
    assert len(table.vacuum(keep=1)) >= 2 and rows_of(table.read()) == [(1, "four", 4)] and table.versions() == [2]


def test_the_second_of_two_writers_is_refused(spark, make, monkeypatch):
    table = make()
    table.put(spark.createDataFrame([(1, "one", 1)], ROW))
    stale = table.version()
    table.put(spark.createDataFrame([(1, "two", 2)], ROW))
    with pytest.raises(stored.Conflict):
        table._commit(stale, stale.schema, spark.createDataFrame([(1, "late", 9)], ROW), [], None)
    assert rows_of(table.read()) == [(1, "two", 2)]


def test_a_batch_that_comes_again_changes_nothing(spark, make):
    table = make()
    for number in (0, 0, 1, 0, 1):
        table.append(spark.createDataFrame([(number, "x", 1)], ROW), tag=("stream", number))
    assert rows_of(table.read()) == [(0, "x", 1), (1, "x", 1)] and table.versions() == [1, 2]


def test_rebuild_writes_parts_that_differ_only(spark, make):
    table = make()
    _, changed = table.replace(spark.createDataFrame([(i, "a", None) for i in range(40)], ROW))
    assert len(changed) == 4
    _, changed = table.replace(spark.createDataFrame([(i, "a", None) for i in reversed(range(40))], ROW))
    assert changed == []
    _, changed = table.replace(spark.createDataFrame([(i, "b" if i == 5 else "a", None) for i in range(40)], ROW))
    assert len(changed) == 1
    _, changed = table.replace(spark.createDataFrame([(5, "b", None)], ROW))
    assert rows_of(table.read()) == [(5, "b", None)] and len(table.version().parts) == 1
    table.replace(spark.createDataFrame([], ROW))
    assert rows_of(table.read()) == [] and table.version().parts == {}
    with pytest.raises(ValueError):
        make("nothing").read()


# ── retention ────────────────────────────────────────────────────────────────


def test_a_sweep_drops_days_unread_and_cascades(spark, make):
    day, now = 86400, 100 * 86400 + 500
    items = make("items")
    items.put(spark.createDataFrame([(i, "x", now - i * day) for i in range(60)], ROW))
    metrics, events = make("metrics", stored.days("at")), make("events", stored.days("at"))
    observed = [(i % 60, "m", now - (i % 70) * day - i % 3) for i in range(400)]
    late = [(59, "late", now), (58, "late", now - day), (1, "timeless", None)]
    metrics.put(spark.createDataFrame(observed + late, ROW))
    events.put(spark.createDataFrame(observed, ROW))
    days = metrics.version().parts
    swept = retention.sweep(items, now, 30, {"metrics": (metrics, "at", 30), "events": (events, "at", 50.5)}, {"metrics": (metrics, "id")}, limit=20, seen="at")
    doomed = set(range(40, 60))  # the longest unseen
    assert swept.truncated and swept.rows["items"] == 20
    assert {r["id"] for r in items.read().collect()} == set(range(40))
    kept = [r for r in observed + late if (r[2] is None or r[2] >= now - 30 * day) and r[0] not in doomed]
    assert rows_of(metrics.read()) == sorted(kept, key=str) and swept.rows["metrics"] == len(observed + late) - len(kept)
    assert rows_of(events.read()) == sorted((r for r in observed if r[2] >= now - int(50.5 * day)), key=str)
    after = metrics.version().parts
    edge, hung = (now - 30 * day) // day, {r[2] // day for r in observed + late if r[2] is not None and r[0] in doomed and r[2] >= now - 30 * day}
    assert all(after[p] == days[p] for p in after if p is not None and p != edge and p not in hung)  # not written again
    again = retention.sweep(items, now, 30, {}, {}, limit=20, seen="at")
    assert again.rows == {"items": 9} and not again.truncated  # day 30 itself stays
    assert retention.sweep(items, now, 30, {"metrics": (metrics, "at", 30)}, {"metrics": (metrics, "id")}, seen="at").rows == {"items": 0, "metrics": 0}


# ── baselines ────────────────────────────────────────────────────────────────


def brute(samples, now, days=7):
    since = (now - days * 86400) // 3600 * 3600
    out, sources = {}, {s[0] for s in samples}
    for source in sources:
        mine = [s for s in samples if s[0] == source and s[1] >= since]
        for metric, at in (("velocity", 2), ("value", 3)):
            for bucket in ["all", *range(24)]:
                some = [s for s in mine if bucket == "all" or s[1] % 86400 // 3600 == bucket]
                if (bucket == "all" and mine) or (bucket != "all" and len(some) >= 20):
                    x = np.array([s[at] for s in some if s[at] is not None], float)
                    q = [float(np.quantile(x, p)) for p in (0.5, 0.75, 0.9, 0.99)] + [float(np.median(abs(x - np.median(x))))] if len(x) else [None] * 5
                    out[source, metric, bucket if bucket == "all" else f"h{bucket:02d}"] = (*q, len(x))
    return out


def test_baselines_over_a_moving_week(spark, make):
    """Each pass gives only the last two days' samples; the week behind them is merged."""
    rng = random.Random(7)
    samples = [(rng.choice("ab"), NOW - rng.randrange(12 * 86400), rng.choice([None, round(rng.gauss(5, 9), 1)]), round(rng.expovariate(0.01), 2)) for _ in range(1500)]
    samples += [("c", NOW - 11 * 86400, 1.0, 2.0), ("d", NOW - 3600, None, None)]
    schema = "source string, first_seen_at long, velocity double, value double"
    states, saved = make("states", "day"), make("saved", stored.buckets(rolling.KEY, 4))
    expected = {}
    for step in range(4, -1, -1):
        now = NOW - step * 86400 - 1234
        open_from = (now // 86400 - 1) * 86400 if step < 4 else 0
        some = [s for s in samples if open_from <= s[1] < now]
        got = {tuple(r[k] for k in rolling.KEY): r for r in rolling.rebuilt(spark.createDataFrame(some, schema), states, saved, now).collect()}
        fresh = brute([s for s in samples if s[1] < now], now)
        expected |= fresh  # a source without samples keeps what it had
        assert set(got) == set(expected)
        for key, want in expected.items():
            r = got[key]
            have = (*[r[c] for c in ("p50", "p75", "p90", "p99", "mad")], r["sample_count"])
            assert all(a == b or a == pytest.approx(b, abs=1e-9) for a, b in zip(have, want)), key
            assert (r["updated_at"] == now) == (key in fresh)


def test_lookups_fall_back_by_the_values_behind_them(spark):
    cols = "source string, metric string, bucket string, p50 double, p75 double, p90 double, p99 double, mad double, sample_count long, updated_at long"
    saved = spark.createDataFrame([("a", "value", "all", 1.0, 2.0, 3.0, 4.0, 0.0, 500, 0), ("a", "value", "h05", 10.0, 20.0, 30.0, 40.0, 0.0, 20, 0), ("a", "velocity", "all", 5.0, 6.0, 7.0, 8.0, 0.0, 90, 0), ("a", "velocity", "h05", 0.0, 0.0, 0.0, 0.0, 0.0, 19, 0)], cols)
    items = spark.createDataFrame([(1, "a", 5 * 3600), (2, "a", 6 * 3600), (3, "b", 5 * 3600)], "id long, source string, first_ts long")
    got = {r["id"]: (r["vq"] and r["vq"]["p50"], r["sq"] and r["sq"]["p50"]) for r in rolling.looked_up(items, saved).collect()}
    assert got == {1: (10.0, 5.0), 2: (1.0, 5.0), 3: (None, None)}


def test_the_scorer_uses_saved_baselines(spark):
    cols = "source string, metric string, bucket string, p50 double, p75 double, p90 double, p99 double, mad double, sample_count long, updated_at long"
    level = lambda p: spark.createDataFrame([("s", "value", "all", p, 2 * p, 3 * p, 4 * p, 0.0, 500, 0), ("s", "velocity", "all", p, 2 * p, 3 * p, 4 * p, 0.0, 500, 0)], cols)
    points = [("x", "s", 1, NOW - 3600 * (4 - i), 100.0 * 2**i, None, i + 1) for i in range(5)]
    snaps = spark.createDataFrame(points, "id string, source string, author long, ts long, views double, likes long, native_score long")
    low, high = (scoring.scored(snaps, NOW, saved=level(p)).first() for p in (10.0, 1600.0))
    assert low["popularity"] > 0.99 and high["popularity"] == pytest.approx(0.5) and low["score"] > high["score"]
    assert scoring.scored(snaps, NOW).first()["popularity"] is None  # one item is no distribution
