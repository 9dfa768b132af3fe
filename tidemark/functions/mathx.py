"""Null-aware scalar functions of the scorer, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | float | int

# Abramowitz-Stegun 26.2.17.
_P = 0.2316419
_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def _c(x: ColumnLike) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp(v: ColumnLike, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Null stays null: least and greatest alone would skip it."""
    return F.when(_c(v).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), _c(v))))


def rounded(v: ColumnLike, places: int = 1) -> Column:
    """Half toward plus infinity, as the reports round."""
    scale = 10.0**places
    return F.floor(_c(v) * scale + 0.5) / scale


def decay(age: ColumnLike, half_life: float) -> Column:
    if half_life <= 0:
        return F.when(_c(age).isNotNull(), 1.0)
    return F.when(_c(age) < 0, 1.0).otherwise(F.pow(F.lit(0.5), _c(age) / half_life))


def log_normalise(v: ColumnLike, middle: ColumnLike) -> Column:
    v, m = _c(v), _c(middle)
    return F.when(v <= 0, 0.0).when(m <= 0, 1.0).otherwise(clamp(F.log1p(v) / F.log1p(2 * m)))


def percentile_from_quantiles(v: Column, q: Column, least: int = 8) -> Column:
    """Place of ``v`` on the line through (0, 0), p50, p75, p90, p99; above p99 toward 1.

    ``q`` is a struct n, p50, p75, p90, p99.  Fewer than ``least`` samples give null.
    """
    def between(x0: ColumnLike, y0: float, x1: Column, y1: float) -> Column:
        return y0 + (y1 - y0) * (v - x0) / F.nullif(x1 - x0, F.lit(0.0))

    p50, p75, p90, p99 = (q[f"p{k}"] for k in (50, 75, 90, 99))
    above = 0.99 + 0.01 * (1 - 1 / (1 + F.log1p(v / F.greatest(p99, F.lit(1.0)))))
    return (
        F.when(v.isNull() | (F.coalesce(q["n"], F.lit(0)) < least), F.lit(None).cast("double"))
        .when(v <= 0, 0.0)
        .when(v <= p50, between(0.0, 0.0, p50, 0.5))
        .when(v <= p75, between(p50, 0.5, p75, 0.75))
        .when(v <= p90, between(p75, 0.75, p90, 0.9))
        .when(v <= p99, between(p90, 0.9, p99, 0.99))
        .otherwise(above)
    )


def normalise_acceleration(ratio: Column) -> Column:
    return F.when(ratio > 0, clamp(F.log2(ratio) / 3))


def normalise_anomaly(ratio: Column) -> Column:
    return F.when(ratio > 0, clamp(F.log10(ratio) / 2)).when(ratio.isNotNull(), 0.0)


def normalise_engagement(rate: Column, reference: ColumnLike) -> Column:
    r = _c(reference)
    return clamp(rate / F.when(r > 0, r).otherwise(0.05))


def normalise_cross_source(n: Column) -> Column:
    return clamp((n - 1) / 3)


def anomaly_ratio(observed: Column, baseline: Column) -> Column:
    return observed / F.when(baseline.isNotNull(), F.greatest(baseline, F.lit(1.0)))


def two_sided_p(z: Column) -> Column:
    """Normal tail by polynomial, so that it equals the published figures."""
    t = 1 / (1 + _P * F.abs(z))
    poly = reduce(lambda acc, b: (acc + b) * t, reversed(_B), F.lit(0.0))
    return F.least(F.lit(1.0), 2 * F.exp(-z * z / 2) / F.sqrt(F.lit(2.0) * F.pi()) * poly)


def null_aware_sum(columns: Sequence[Column]) -> Column:
    """Sum of the values there are; null only if all are."""
    return F.when(F.coalesce(*columns).isNotNull(), reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in columns]))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double; 0 for different lengths, null if either is null."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(product)


def views_per_follower(views: Column, followers: Column, least: int = 20) -> Column:
    return F.when(followers >= least, views / followers)


def size_band(followers: Column) -> Column:
    return F.when(followers < 100, "<100").when(followers < 1000, "<1k").when(followers < 10000, "<10k").when(followers < 100000, "<100k").when(followers.isNotNull(), "100k+")


def normalised(v: Column) -> Column:
    """``v`` scaled to length 1; a zero vector stays as it is."""
    norm = lambda u: F.sqrt(F.aggregate(u, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # vector and length in a list of one, so that the length is taken once and not for every place
    one = F.transform(F.transform(F.array(v), lambda u: F.struct(u.alias("v"), norm(u).alias("n"))), lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"]))
    return F.get(one, F.lit(0))


def dot_shortest(a: Column, b: Column) -> Column:
    """Dot product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return dot(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))
