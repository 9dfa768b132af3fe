"""The lifecycle stream against a replay of all values in order of time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.streaming import lifecycle, stateful

HOT, FALL, IDLE = 50.0, 0.6, 1000


def replay(rows, end):
    """(key, t, level, value, peak, peak_at, recent) of every change, one value after the other."""
    out = []
    for key in sorted({r[0] for r in rows}):
        peak, peak_at, level, last, seen = None, 0, "NEW", None, []
        for _, t, value in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], -r[2])):
            if last is not None and t - last > IDLE:
                out.append((key, last + IDLE, "EXPIRED", None, peak, peak_at, 0))
                peak, level = None, "NEW"
            if peak is None or value > peak:
                peak, peak_at = value, t
            seen.append(t // 60)
            now = "HOT" if value >= HOT else "PEAK" if peak >= HOT and value <= FALL * peak else level
            if now != level:
                out.append((key, t, now, value, peak, peak_at, sum(m > t // 60 - 10 for m in seen)))
            level, last = now, t
        if last + IDLE <= end:
            out.append((key, last + IDLE, "EXPIRED", None, peak, peak_at, 0))
    return sorted(out, key=str)


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, lifecycle.PROVIDER)
    yield
    spark.conf.set(name, was)


def test_levels():
    level, peak = lifecycle.levels(np.array([10.0, 60.0, 55.0, 36.0, 40.0, 20.0]), 5.0, HOT, FALL)
    assert level.tolist() == ["", "HOT", "HOT", "PEAK", "", "PEAK"] and peak.tolist() == [10, 60, 60, 60, 60, 60]


def test_changes_are_told_once_over_micro_batches(spark, tmp_path, rocks):
    rng = random.Random(6)
    rows = [(f"k{i % 6}", 1_000_000 + rng.randrange(9000), float(rng.randrange(5, 90))) for i in range(120)]
    rows += [("silent", 1_000_000, 80.0), ("silent", 1_008_000, 20.0), ("late", 1_002_000, 70.0), ("end", 1_020_000, 1.0)]
    rows.sort(key=lambda r: r[1])
    step = len(rows) // 4 + 1
    for i in range(0, len(rows), step):
        part = spark.createDataFrame(rows[i : i + step], "key string, t long, value double")
        part.select("key", F.timestamp_seconds("t").alias("ts"), "value").coalesce(1).write.parquet(f"{tmp_path}/in/{i:04d}")
    stream = spark.readStream.schema("key string, ts timestamp, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    told = stateful.drained(spark, lifecycle.lifecycles(stream, HOT, FALL, IDLE, late="0 seconds", recent=600), "append", ["key"]).collect()
    got = sorted((tuple(r) for r in told), key=str)
    assert got == replay(rows, 1_020_000)
    assert [r[2] for r in got if r[0] == "silent"] == ["HOT", "EXPIRED", "EXPIRED"]  # two lives


def test_rows_without_a_key_or_value_are_nobody(spark, tmp_path, rocks):
    part = spark.createDataFrame([(None, 10, 99.0), ("a", 10, None), ("a", None, 99.0)], "key string, t long, value double")
    part.select("key", F.timestamp_seconds("t").alias("ts"), "value").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, ts timestamp, value double").parquet(f"{tmp_path}/in")
    assert stateful.drained(spark, lifecycle.lifecycles(stream, HOT), "append", ["key"]).collect() == []
