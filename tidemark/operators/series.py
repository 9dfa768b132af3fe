"""Shapes of a growing series: last values, velocity, acceleration, engagement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.mathx import null_aware_sum


def latest_non_null(snapshots: DataFrame, metrics: list[str], key: str = "id", ts: str = "ts") -> DataFrame:
    """Latest value of each metric that is there, at its own time: one grouping, no window."""
    return snapshots.groupBy(key).agg(*[F.max_by(m, F.when(F.col(m).isNotNull(), F.col(ts))).alias(m) for m in metrics])


def last_n(snapshots: DataFrame, n: int = 60, key: str = "id", ts: str = "ts") -> DataFrame:
    newest = Window.partitionBy(key).orderBy(F.col(ts).desc())
    return snapshots.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= n).drop("__r")


def ordered_sum(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, value): sums that add a key's values by rising ``order``, so they are the same bits
    however the rows are dealt.  The rows of a key are sorted and pass one by one; none are gathered."""
    by = Window.partitionBy(*keys).orderBy(order, value)
    sums = rows.select(*keys, F.sum(value).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias(value), F.lead(F.lit(True)).over(by).alias("__more"))
    return sums.where("__more is null").drop("__more")


def _slope(value: Column, hours: Column, take: Column) -> Column:
    return F.regr_slope(F.when(take, value), F.when(take, hours))


def shape(snapshots: DataFrame, now: int, metric: str = "views", key: str = "id", ts: str = "ts", parts: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Per item: n, first and last time, latest value, velocity and acceleration; with ``parts``
    the engagement of the last point, and the ``keep`` columns of the item.

    Velocity is the slope of the last five points.  The halves of the acceleration share
    the midpoint; its ratio needs three points.  One sort per item feeds all of it.
    """
    points = snapshots.where(F.col(metric).isNotNull()).withColumn("__h", (F.col(ts) - now) / 3600.0)
    oldest = Window.partitionBy(key).orderBy(ts)
    whole = Window.partitionBy(key)
    points = points.withColumn("__i", F.row_number().over(oldest) - 1).withColumn("__n", F.count(F.lit(1)).over(whole))
    y, x, i, n = F.col(metric).cast("double"), F.col("__h"), F.col("__i"), F.col("__n")
    mid = F.floor(n / 2)
    out = points.groupBy(key).agg(
        F.count(F.lit(1)).alias("observations"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.max_by(metric, ts).alias("value"),
        _slope(y, x, i >= n - 5).alias("velocity"),
        _slope(y, x, i <= mid).alias("v1"),
        _slope(y, x, i >= mid).alias("v2"),
        *[F.first(c).alias(c) for c in keep],
        *([F.max_by(F.struct(metric, *parts), ts).alias("__last")] if parts else []),
    )
    if parts:
        out = out.withColumn("engagement", _rate(F.col("__last"), metric, parts)).drop("__last")
    ratio = (F.col("v2") + 1) / (F.greatest(F.col("v1"), F.lit(0.0)) + 1)
    enough = (F.col("observations") >= 3) & F.col("v1").isNotNull() & F.col("v2").isNotNull()
    return out.withColumn("acceleration", F.when(enough, ratio)).drop("v1", "v2")


def _rate(last: Column, base: str, parts: Sequence[str]) -> Column:
    return F.when(last[base] > 0, null_aware_sum([last[p] for p in parts]) / last[base])


def engagement_rate(snapshots: DataFrame, parts: list[str], base: str = "views", key: str = "id", ts: str = "ts") -> DataFrame:
    """Interactions over the base metric in the last snapshot row; null without either."""
    last = snapshots.groupBy(key).agg(F.max_by(F.struct(base, *parts), ts).alias("s"))
    return last.select(key, _rate(F.col("s"), base, parts).alias("engagement"))
