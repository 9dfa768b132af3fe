"""The lift kernel: stratify confounds out, compare buckets, control false discoveries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.mathx import rounded, two_sided_p
from tidemark.operators.baselines import medians

MIN_SAMPLE = 25
Z = 1.96
NO_SPREAD = 1e-12
FALSE_DISCOVERY = 0.05


def stratified(rows: DataFrame, value: str, stratum: list[str], out: str = "adjusted") -> DataFrame:
    """value - mean of its stratum + mean of all: only within-stratum differences are left.

    Both means are grouped first and joined, so a large stratum is never one task's window.
    """
    means = rows.groupBy(*stratum).agg(F.avg(value).alias("__stratum"))
    overall = F.broadcast(rows.agg(F.avg(value).alias("__all")))  # one row
    same = [F.col(f"a.{s}").eqNullSafe(F.col(f"b.{s}")) for s in stratum]
    joined = rows.alias("a").join(means.alias("b"), same, "left").select("a.*", "b.__stratum").crossJoin(overall)
    return joined.withColumn(out, F.col(value) - F.col("__stratum") + F.col("__all")).drop("__stratum", "__all")


def _spread(n: Column, variance: Column) -> Column:
    """Sample variance, or null where it can't be measured: one value, or all alike."""
    return F.when((n >= 2) & (variance > NO_SPREAD), variance)


def summarise(rows: DataFrame, keys: list[str], value: str, score: str | None = None, baseline: DataFrame | None = None, complement: bool = False, least_complement: int = 25) -> DataFrame:
    """One row per bucket: n, percentile, lift, margin, p, significant, thin, median_score.

    The baseline is the mean of all rows, or the bucket's complement (moments of the whole
    less the bucket's), which also widens the margin; a complement of fewer than
    ``least_complement`` rows leaves the bucket out.  Null values take no part.
    """
    rows = rows.where(F.col(value).isNotNull())
    by = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    if score:
        middle = medians(rows, keys, score, "mid").select(*[F.col(k).alias(f"__{k}") for k in keys], "mid")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        by = by.join(middle, same, "left").drop(*[f"__{k}" for k in keys]).withColumn("mid", F.coalesce("mid", F.lit(0.0)))
    else:
        by = by.withColumn("mid", F.lit(0.0))
    total = rows if baseline is None else baseline.where(F.col(value).isNotNull())
    whole = F.broadcast(total.agg(F.count(F.lit(1)).alias("all_n"), F.avg(value).alias("all_m"), F.sum(value).alias("all_s"), F.sum(F.col(value) * F.col(value)).alias("all_ss")))
    x = by.crossJoin(whole)
    n, own = F.col("n"), _spread(F.col("n"), F.col("v"))
    if complement:
        rest = F.col("all_n") - n
        x = x.where(rest >= least_complement)
        base = (F.col("all_s") - F.col("s")) / rest
        other = _spread(rest, (F.col("all_ss") - F.col("ss") - rest * base * base) / F.nullif(rest - 1, F.lit(0)))
        margin = Z * F.sqrt(own / n + other / rest)
    else:
        base = F.col("all_m")
        margin = Z * F.sqrt(own / n)
    x = x.withColumn("base", base).withColumn("half", margin)
    lift = (F.col("m") - F.col("base")) * 100
    z = F.when(F.col("half") > 0, F.abs(F.col("m") - F.col("base")) * Z / F.col("half"))
    p = F.when(z.isNull() | (z == 0), 1.0).otherwise(two_sided_p(z))
    significant = F.coalesce((n >= MIN_SAMPLE) & (F.abs(lift) > F.col("half") * 100), F.lit(False))
    shown = F.when(F.col("half").isNull(), 100.0).otherwise(rounded(F.col("half") * 100))
    return x.select(*keys, "n", rounded(F.col("m") * 100).alias("percentile"), rounded(lift).alias("lift"), shown.alias("margin"), significant.alias("significant"), p.alias("p"), (n < MIN_SAMPLE).alias("thin"), rounded(F.col("mid")).alias("median_score"))


def control_discoveries(buckets: DataFrame, keys: list[str], q: float = FALSE_DISCOVERY) -> DataFrame:
    """Benjamini-Hochberg over the buckets that are not thin: it only withdraws findings.

    Ranks come in two steps, so tags without number are not one task's: p values are counted
    by part of an octave, of which there is a bounded number, and ranked inside their part.
    """
    octave = F.when(F.col("p") > 0, F.floor(-F.log2("p") * 64)).otherwise(F.lit(1 << 20))
    tested = buckets.where(~F.col("thin")).withColumn("__part", octave)
    parts = tested.groupBy("__part").agg(F.count(F.lit(1)).alias("c"))
    falling = Window.orderBy(F.desc("__part"))  # one row per part
    starts = parts.select(F.col("__part").alias("__at"), (F.sum("c").over(falling) - F.col("c")).alias("__before"), F.sum("c").over(Window.partitionBy()).alias("m"))
    inside = Window.partitionBy("__part").orderBy("p", *keys)
    ranked = tested.withColumn("__inside", F.row_number().over(inside)).join(starts, F.col("__part") == F.col("__at"))
    fits = F.col("p") <= (F.col("__before") + F.col("__inside")) / F.col("m") * q
    cut = F.broadcast(ranked.agg(F.max(F.when(fits, F.col("p"))).alias("__cut")))  # one row
    kept = ~F.col("thin") & (F.col("p") <= F.col("__cut"))
    return buckets.crossJoin(cut).withColumn("significant", F.col("significant") & F.coalesce(kept, F.lit(False))).drop("__cut")
