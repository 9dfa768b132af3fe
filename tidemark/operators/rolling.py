"""Rolling baselines: quantiles of a source's last seven days, in all and by hour of the day.

A day's state counts its samples by (hour, source, metric, value), so states of several days
merge by adding counts, and quantiles of the sum are exact.  A pass writes the states of the days
whose items are still observed; older ones are read as they are.  What a state does not hold
(which item a value is of) no quantile needs.

Saved baselines are keyed by (source, metric, bucket) and stay until a pass has samples of the
source again.  The window starts with the full hour in which the period began.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import baselines
from tidemark.sources.stored import StoredTable, newest_by

# Days of a baseline, and samples that an hour of the day needs for its own.
WINDOW_DAYS = 7
HOURLY_SAMPLES = 20

METRICS = ("velocity", "value")
KEY = ["source", "metric", "bucket"]


def day_states(samples: DataFrame) -> DataFrame:
    """(day, hour, source, metric, x, n) of (source, first_seen_at, velocity, value).

    Null values are counted too: they make an hour large enough, and no quantile.
    """
    at = F.col("first_seen_at")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in METRICS]))
    rows = samples.select(F.floor(at / 86400).alias("day"), F.floor(at % 86400 / 3600).cast("int").alias("hour"), "source", each.alias("s"))
    return rows.groupBy("day", "hour", "source", "s.metric", "s.x").agg(F.count(F.lit(1)).alias("n"))


def window(states: StoredTable, now: int, days: int = WINDOW_DAYS) -> DataFrame:
    """The states of the last ``days`` days; earlier parts are not opened."""
    since = (now - days * 86400) // 3600 * 3600
    return states.read(least=since // 86400).where(F.col("day") * 86400 + F.col("hour") * 3600 >= since)


def quantiles(states: DataFrame, now: int, least: int = HOURLY_SAMPLES) -> DataFrame:
    """(source, metric, bucket, p50, p75, p90, p99, mad, sample_count, updated_at).

    Buckets are ``all`` and ``h00`` to ``h23``; an hour needs ``least`` samples, nulls included.
    """
    bucket = F.explode(F.array(F.lit("all"), F.format_string("h%02d", F.col("hour"))))
    rows = states.withColumn("bucket", bucket).groupBy(*KEY, "x").agg(F.sum("n").alias("n"))
    enough = rows.groupBy(*KEY).agg(F.sum("n").alias("samples")).where((F.col("bucket") == "all") | (F.col("samples") >= least))
    q = baselines.exact_quantiles(rows, KEY, "x", weight="n")
    far = rows.join(q.select(*KEY, F.col("q")[0].alias("median")), KEY).withColumn("d", F.abs(F.col("x") - F.col("median")))
    mad = baselines.exact_quantiles(far, KEY, "d", (0.5,), weight="n").select(*KEY, F.col("q")[0].alias("mad"))
    out = enough.select(*KEY).join(q, KEY, "left").join(mad, KEY, "left")
    ps = [F.col("q")[i].alias(f"p{p}") for i, p in enumerate((50, 75, 90, 99))]
    return out.select(*KEY, *ps, "mad", F.coalesce("n", F.lit(0)).cast("long").alias("sample_count"), F.lit(now).cast("long").alias("updated_at"))


def rebuilt(samples: DataFrame, states: StoredTable, saved: StoredTable, now: int) -> DataFrame:
    """Takes in the samples of the days that are still observed, and saves the baselines of the
    window; returns all that are saved."""
    states.put(day_states(samples))
    saved.upsert(quantiles(window(states, now), now), newest_by(KEY, "updated_at"))
    return saved.read()


def looked_up(items: DataFrame, saved: DataFrame, least: int = HOURLY_SAMPLES, source: str = "source", first_seen: str = "first_ts") -> DataFrame:
    """Items with ``vq`` and ``sq``, the quantiles of values and velocities that they are held
    against: of their hour of the day if ``least`` values are behind them, else of all hours."""
    summary = F.struct(F.col("sample_count").alias("n"), *[F.col(f"p{p}") for p in (50, 75, 90, 99)])
    pick = lambda metric: F.max(F.when(F.col("metric") == metric, summary))
    by_source = saved.where("bucket = 'all'").groupBy("source").agg(pick("value").alias("va"), pick("velocity").alias("sa"))
    by_hour = saved.where((F.col("bucket") != "all") & (F.col("sample_count") >= least)).groupBy("source", "bucket").agg(pick("value").alias("vh"), pick("velocity").alias("sh"))
    rows = items.withColumn("bucket", F.format_string("h%02d", F.floor(F.col(first_seen) % 86400 / 3600).cast("int")))
    rows = rows.join(by_source.withColumnRenamed("source", source), source, "left").join(by_hour.withColumnRenamed("source", source), [source, "bucket"], "left")
    return rows.select(*items.columns, F.coalesce("vh", "va").alias("vq"), F.coalesce("sh", "sa").alias("sq"))
