"""Table upkeep: merges with per-column rules, retention, refresh tiers, hourly roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merged(rows: DataFrame, key: Sequence[str], seen: str, rules: Mapping[str, str], ties: Sequence[str] = ()) -> DataFrame:
    """One row per key from all versions of it.

    Rules: ``last`` and ``first`` take the newest and oldest version's value even if null,
    ``newest`` and ``oldest`` the newest and oldest that is not null, ``max`` and ``min``
    their name.  Grouped aggregates with map-side combining, so a hot key costs one row
    per task; ``ties`` order versions of one instant.
    """
    at = F.struct(seen, *ties) if ties else F.col(seen)
    take = {
        "last": lambda c: F.max_by(F.struct(c), at)[c],
        "first": lambda c: F.min_by(F.struct(c), at)[c],
        "newest": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)),
        "oldest": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at)),
        "max": F.max,
        "min": F.min,
    }
    return rows.groupBy(*key).agg(*[take[rule](c).alias(c) for c, rule in rules.items()])


#: Rules of the item table; the rest is first-writer-wins.
CONTENT_RULES = {"title": "last", "url": "last", "last_seen_at": "last", "keywords": "last", "hashtags": "last", "body": "newest", "thumbnail": "newest", "author_name": "newest", "simhash": "newest", "lang": "oldest", "country": "oldest", "published_at": "oldest", "content_type": "first", "first_seen_at": "first"}


def minute_snapshots(rows: DataFrame, key: str, ts: str, metrics: Sequence[str], seconds: int = 60) -> DataFrame:
    """Observations keyed by (item, minute): the newest value that is there, per metric."""
    b = rows.withColumn("minute", F.col(ts) - F.col(ts) % seconds)
    return merged(b, [key, "minute"], ts, {m: "newest" for m in metrics}, ties=metrics)


def retained(rows: DataFrame, now: int, days: float, ts: str) -> DataFrame:
    return rows.where(F.col(ts) >= now - int(days * 86400))


def refresh_tiers(items: DataFrame, budget: int, quotas: Sequence[tuple[str, float, Column]]) -> DataFrame:
    """Picks ``budget`` items by tier quotas, each tier taking what earlier ones left over.

    ``items`` has id, n (observations) and last_ts.  Tiers are disjoint by the first that
    fits; inside a tier the longest unseen come first.  A tier's quota is a share of the
    budget; unused places spill into the next tier.  Only the ``budget`` best rows of each
    tier are compared across tiers.
    """
    tier = F.lit(None).cast("int")
    for i in range(len(quotas) - 1, -1, -1):
        tier = F.when(quotas[i][2], i).otherwise(tier)
    rows = items.withColumn("tier", tier).where("tier is not null")
    order = Window.partitionBy("tier").orderBy("last_ts", "id")
    best = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= budget)
    sizes = best.groupBy("tier").agg(F.count(F.lit(1)).alias("have"))
    left, have = budget, {r["tier"]: r["have"] for r in sizes.collect()}  # one row per tier
    taken = []
    for i, (name, share, _) in enumerate(quotas):
        n = min(left, have.get(i, 0), budget if share >= 1 else int(budget * share + 0.5))
        left -= n
        taken.append((i, name, n))
    plan = items.sparkSession.createDataFrame(taken, "tier int, tier_name string, take int")
    return best.join(F.broadcast(plan), "tier").where(F.col("place") <= F.col("take")).select("id", "n", "last_ts", "tier_name", "place")


def keyword_hours(uses: DataFrame) -> DataFrame:
    """(keyword, hour) roll-up of (keyword, t, author, source, views)."""
    hour = F.col("t") - F.col("t") % 3600
    return uses.groupBy("keyword", hour.alias("hour")).agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("author").alias("creators"), F.count_distinct("source").alias("sources"), F.sum(F.coalesce("views", F.lit(0.0))).alias("views"))


def keyword_breakouts(hours: DataFrame, least: int = 2) -> DataFrame:
    """Growth against exactly the hour before; a missing hour is none, not the last one."""
    before = hours.select("keyword", (F.col("hour") + 3600).alias("hour"), F.col("mentions").alias("before"))
    x = hours.join(before, ["keyword", "hour"], "left").where(F.col("mentions") >= least)
    return x.select("keyword", "hour", "mentions", F.coalesce("before", F.lit(0)).alias("before"), (F.col("mentions") / F.greatest(F.coalesce("before", F.lit(0)), F.lit(1))).alias("growth"))
