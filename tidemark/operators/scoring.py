"""The score: null-aware weighted signals, confidence apart from it, and a lifecycle."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import mathx as m
from tidemark.model import HALF_LIFE_HOURS, MAX_AGE_HOURS, WEIGHTS
from tidemark.operators import baselines, rolling, series
from tidemark.sources.tables import written


def combine(signals: dict[str, Column]) -> tuple[Column, Column]:
    """Weighted mean over the signals that are there, and the weight they cover."""
    weights = {k: F.when(c.isNotNull(), WEIGHTS[k]).otherwise(0.0) for k, c in signals.items()}
    available = reduce(lambda a, b: a + b, weights.values())
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) * weights[k] for k, c in signals.items()])
    mean = F.when(available > 0, total / available).otherwise(0.0)
    return mean, available / sum(WEIGHTS.values())


def gated(mean: Column, coverage: Column, age: Column) -> Column:
    """Old items and thin evidence count less."""
    old = F.when(age > MAX_AGE_HOURS, 0.35).otherwise(1.0)
    return m.clamp(100 * mean * old * (0.55 + 0.45 * coverage), 0.0, 100.0)


def confidence(observations: Column, span: Column, last_age: Column, coverage: Column, reliability: Column, cross_source: Column) -> Column:
    stale = F.when(last_age.isNull(), 0.5).otherwise(m.clamp(1 - last_age / 6))
    value = 0.3 * m.clamp(observations / 6) + 0.2 * m.clamp(span / 6) + 0.2 * stale + 0.15 * m.clamp(coverage) + 0.15 * m.normalise_cross_source(cross_source)
    return m.clamp(value * m.clamp(reliability, 0.2, 1.0) + 0.05)


def lifecycle(score: Column, popularity: Column, velocity: Column, ratio: Column, norm: Column, observations: Column, age: Column, peak: Column) -> Column:
    """First rule that holds, in order; a comparison with null does not hold."""
    falling = (velocity <= 0) | F.coalesce(ratio < 0.6, F.lit(False))
    flat = (velocity == 0) & (peak.isNull() | (peak <= score + 1))
    held = F.when(flat, F.when(popularity >= 0.9, "PEAK").otherwise("NEW"))
    held = F.coalesce(
        held,
        F.when(score < 15, "DEAD").when(score < 0.6 * peak, "DECLINING").when((score >= 0.85 * peak) & (popularity >= 0.75), "PEAK").when(score >= 45, "PEAK").otherwise("DECLINING"),
    )
    return (
        F.when((age > MAX_AGE_HOURS) & (score < 40), "DEAD")
        .when((observations < 2) | velocity.isNull(), F.when(popularity >= 0.95, "HOT").otherwise("NEW"))
        .when(falling, held)
        .when((norm >= 0.35) & (popularity.isNull() | (popularity < 0.8)) & (score >= 45), "EMERGING")
        .when((score >= 78) & (popularity >= 0.9), "VIRAL")
        .when((score >= 62) & (popularity >= 0.7), "HOT")
        .when(score >= 40, "RISING")
        .otherwise("NEW")
    )


def _pooled(shapes: DataFrame) -> DataFrame:
    """(source, vq, sq): quantiles of all values and velocities of each source."""
    both = shapes.select("source", F.explode(F.array(F.struct(F.lit("v").alias("of"), F.col("value").cast("double").alias("x")), F.struct(F.lit("s").alias("of"), F.col("velocity").alias("x")))).alias("p")).select("source", "p.of", "p.x")
    q = baselines.exact_quantiles(both, ["source", "of"], "x")
    summary = F.struct(F.col("n"), *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((50, 75, 90, 99))])
    return q.groupBy("source").agg(F.max(F.when(F.col("of") == "v", summary)).alias("vq"), F.max(F.when(F.col("of") == "s", summary)).alias("sq"))


def scored(snapshots: DataFrame, now: int, engagement_reference: float = 0.05, reliability: float = 0.9, cross_source: Column | None = None, peaks: DataFrame | None = None, saved: DataFrame | None = None, crossed: DataFrame | None = None, capabilities: DataFrame | None = None) -> DataFrame:
    """Scores every item of (id, source, author, ts, views, likes, native_score).

    Acyclic: shapes, then baselines of those shapes, then scores.  ``peaks`` (id, peak)
    carries the high-water mark of earlier passes.  Baselines are those of ``saved`` (see
    ``rolling``), by source and hour of day, or else of the shapes, one row per source.
    ``crossed`` (id, cross_source) counts the sources of an item's topics, 1 where it has none;
    ``capabilities`` (source, engagement_reference, reliability) goes before the two numbers.
    """
    shapes = series.shape(snapshots, now, parts=["likes"], keep=["source", "author"])
    # read by both baselines, by creators' samples and by the score
    shapes = written(shapes, f"shapes-{uuid.uuid4().hex[:8]}")
    if saved is not None:
        x = rolling.looked_up(shapes, saved)
    else:
        x = shapes.join(_pooled(shapes), "source", "left")
    loo = baselines.leave_one_out(shapes.select("id", "author", "value", F.col("first_ts").alias("published_at")))
    x = x.join(loo.select("id", F.col("median").alias("creator_median")), "id", "left")
    x = x.join(peaks, "id", "left") if peaks is not None else x.withColumn("peak", F.lit(None).cast("double"))
    if crossed is not None:
        x = x.join(crossed.select("id", F.col("cross_source").alias("__cross")), "id", "left")
        cross_source = F.coalesce("__cross", F.lit(1))
    x = x.withColumn("cross_source", F.lit(1) if cross_source is None else cross_source)
    if capabilities is not None:
        x = x.join(capabilities.select("source", F.col("engagement_reference").alias("__reference"), F.col("reliability").alias("__reliability")), "source", "left")
    known = lambda name, default: F.coalesce(name, F.lit(default)) if capabilities is not None else F.lit(default)
    x = x.withColumn("age", F.greatest(F.lit(0.0), (now - F.col("first_ts")) / 3600.0))
    x = x.withColumn("popularity", m.percentile_from_quantiles(F.col("value").cast("double"), F.col("vq")))
    v = F.col("velocity")
    speed = F.when(v.isNotNull(), F.coalesce(m.percentile_from_quantiles(v, F.col("sq")), F.when(v > 0, m.log_normalise(v, F.coalesce(F.col("sq")["p50"], F.greatest(v, F.lit(1.0))))).otherwise(0.0)))
    x = x.withColumn("n_velocity", speed).withColumn("n_acceleration", m.normalise_acceleration(F.col("acceleration")))
    anomaly = m.normalise_anomaly(m.anomaly_ratio(F.col("value"), F.col("creator_median")))
    x = x.withColumn("n_anomaly", F.coalesce(anomaly, m.clamp((F.col("popularity") - 0.5) * 2)))
    signals = {
        "velocity": F.col("n_velocity"),
        "acceleration": F.col("n_acceleration"),
        "anomaly": F.col("n_anomaly"),
        "engagement": m.normalise_engagement(F.col("engagement"), known("__reference", engagement_reference)),
        "cross_source": m.normalise_cross_source(F.col("cross_source")),
        "freshness": m.decay(F.col("age"), HALF_LIFE_HOURS),
    }
    mean, coverage = combine(signals)
    x = x.withColumn("mean", mean).withColumn("coverage", coverage)
    x = x.withColumn("score", gated(F.col("mean"), F.col("coverage"), F.col("age")))
    span = F.when(F.col("observations") >= 2, (now - F.col("first_ts")) / 3600.0).otherwise(0.0)
    last_age = (now - F.col("last_ts")) / 3600.0
    x = x.withColumn("confidence", confidence(F.col("observations"), span, last_age, F.col("coverage"), known("__reliability", reliability), F.col("cross_source")))
    x = x.withColumn("state", lifecycle(F.col("score"), F.col("popularity"), v, F.col("acceleration"), F.col("n_acceleration"), F.col("observations"), F.col("age"), F.col("peak")))
    return x.select("id", "source", "author", "observations", "first_ts", "last_ts", "value", "velocity", "acceleration", "engagement", "popularity", "age", "coverage", "score", "confidence", "state", "cross_source")


def high_water(series_of_scores: DataFrame, key: str = "id", order: str = "day", score: str = "score") -> DataFrame:
    """Running peak, and the time it moved: only when strictly greater; no time is the last."""
    from pyspark.sql.window import Window

    so_far = Window.partitionBy(key).orderBy(F.col(order).asc_nulls_last())
    out = series_of_scores.withColumn("peak", F.max(score).over(so_far))
    moved = F.when((F.col("peak") > F.lag("peak").over(so_far)) | F.lag("peak").over(so_far).isNull(), F.col(order))
    out = out.withColumn("__moved", moved)
    return out.withColumn("peak_at", F.max("__moved").over(so_far)).drop("__moved")


def reliability(failed: Column, total: Column, consecutive: Column) -> Column:
    return m.clamp(1 - 0.7 * failed / F.greatest(total, F.lit(1)) - 0.05 * F.least(consecutive, F.lit(5)), 0.1, 1.0)
