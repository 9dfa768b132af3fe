"""Robust baselines per source and per creator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


PROBABILITIES = (0.5, 0.75, 0.9, 0.99)
#: Parts of an octave that are told apart before values are sorted.
OCTAVE_PARTS = 256


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: tuple[float, ...] = PROBABILITIES, weight: str | None = None) -> DataFrame:
    """(keys, n, q): number of values and their exact interpolated quantiles, as an array.

    ``weight`` is how often a row's value counts, once unless it is named.

    No key is one task's: values are counted by (key, value), the counts summed by (key, part
    of an octave), of which a key has a bounded number, and only the parts that hold a wanted
    rank are sorted, each by itself.  Null values take no part; null keys are a key.
    """
    v = F.col("__v")
    part = F.signum(v) * F.floor(F.log2(1 + F.abs(v)) * OCTAVE_PARTS)
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    by = [f"__k{i}" for i in range(len(keys))]
    times = F.lit(1) if weight is None else F.col(weight)
    counts = rows.select(*named, F.col(value).cast("double").alias("__v"), times.cast("long").alias("__w")).where("__v is not null").groupBy(*by, "__v").agg(F.sum("__w").alias("c")).withColumn("__part", part)
    parts = counts.groupBy(*by, "__part").agg(F.sum("c").alias("c"))
    whole = Window.partitionBy(*by)
    parts = parts.withColumn("n", F.sum("c").over(whole)).withColumn("end", F.sum("c").over(whole.orderBy("__part")))
    ranks = F.array(*[f((F.col("n") - 1) * p) for p in probabilities for f in (F.floor, F.ceil)])
    parts = parts.withColumn("start", F.col("end") - F.col("c")).withColumn("ranks", ranks)
    held = parts.where(F.exists("ranks", lambda r: (r >= F.col("start")) & (r < F.col("end"))))
    held = held.select(*[F.col(k).alias(f"{k}_") for k in by], F.col("__part").alias("__part_"), "n", "start", "ranks")
    same = F.col("__part") == F.col("__part_")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    inside = Window.partitionBy(*by, "__part").orderBy("__v")
    x = counts.join(held, same).withColumn("to", F.col("start") + F.sum("c").over(inside)).withColumn("from", F.col("to") - F.col("c"))
    at = [F.max(F.when((F.col("ranks")[i] >= F.col("from")) & (F.col("ranks")[i] < F.col("to")), v)).alias(f"r{i}") for i in range(2 * len(probabilities))]
    x = x.groupBy(*by).agg(F.max("n").alias("n"), *at)
    q = []
    for i, p in enumerate(probabilities):
        lo, hi, weight = F.col(f"r{2 * i}"), F.col(f"r{2 * i + 1}"), (F.col("n") - 1) * p
        q.append(lo + (hi - lo) * (weight - F.floor(weight)))
    return x.select(*[F.col(k).alias(name) for k, name in zip(by, keys)], "n", F.array(*q).alias("q"))


def source_quantiles(items: DataFrame, value: str, keys: list[str], least_rows: int = 0) -> DataFrame:
    """n, p50, p75, p90, p99 per key; a key needs ``least_rows`` rows, nulls included."""
    out = exact_quantiles(items, keys, value)
    if least_rows:
        enough = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least_rows)
        out = out.join(enough.select(*keys), keys, "left_semi")
    return out.select(*keys, "n", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((50, 75, 90, 99))])


def medians(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return exact_quantiles(rows, keys, value, (0.5,)).select(*keys, F.col("q")[0].alias(name))


def source_mad(items: DataFrame, value: str, key: str) -> DataFrame:
    """Median and median absolute deviation: two passes, the second against the first."""
    middle = medians(items, [key], value, "median")
    far = items.join(middle, key).withColumn("__d", F.abs(F.col(value) - F.col("median")))
    return middle.join(medians(far, [key], "__d", "mad"), key)


def leave_one_out(items: DataFrame, value: str = "value", author: str = "author", item: str = "id", least: int = 3, newest: int = 200, order: str = "published_at") -> DataFrame:
    """Median and p90 of a creator's other items, at least ``least``, among the newest.

    Each creator's sample is a sorted array of ``newest`` values at most, so its size is bounded.
    It stays with the creator: a row meets only the values at the wanted ranks and those after
    them, which take their places where the row's own value is not above them.
    """
    known = F.col(value).isNotNull()
    recent = Window.partitionBy(author).orderBy(known.desc(), F.col(order).desc(), F.col(item).desc())
    ranked = items.withColumn("__own", known & (F.row_number().over(recent) <= newest))
    samples = ranked.where("__own").groupBy(author).agg(F.sort_array(F.collect_list(value)).alias("all"))
    at = lambda k: F.get("all", k.cast("int"))
    quantiles = {"median": 0.5, "p90": 0.9}
    held = [F.size("all").alias("__all")]
    for name, q in quantiles.items():
        whole, less = (F.size("all") - 1) * q, (F.size("all") - 2) * q
        held.append((at(F.floor(whole)) + (at(F.ceil(whole)) - at(F.floor(whole))) * (whole - F.floor(whole))).alias(name))
        held.append(F.struct(*[at(f(less) + i).alias(f"{end}{i}") for end, f in (("lo", F.floor), ("hi", F.ceil)) for i in (0, 1)], (less - F.floor(less)).alias("part")).alias(f"__{name}"))
    mine = ranked.join(samples.select(author, *held), author)
    mine = mine.withColumn("n", (F.col("__all") - F.col("__own").cast("int")).cast("long")).where(F.col("n") >= least)

    def without_own(name: str) -> Column:
        s = F.col(f"__{name}")
        lo, hi = [F.when(F.col(value) <= s[f"{end}0"], s[f"{end}1"]).otherwise(s[f"{end}0"]) for end in ("lo", "hi")]
        return F.when(F.col("__own"), lo + (hi - lo) * s["part"]).otherwise(F.col(name)).alias(name)

    return mine.select(item, author, value, "n", *[without_own(name) for name in quantiles])


def breakouts(loo: DataFrame, value: str = "value", least: int = 5, times: float = 5.0) -> DataFrame:
    ratio = F.col(value) / F.greatest(F.col("median"), F.lit(1.0))
    return loo.withColumn("ratio", ratio).where((F.col("n") >= least) & (F.col("ratio") >= times) & (F.col(value) >= F.col("p90")))
