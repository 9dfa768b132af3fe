"""The data model, its constants, and adapters from the benchmark tables.

Every operator takes the reference instant ``now`` as a parameter; nothing reads a clock.
NULL means that a platform does not expose a value, and is never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1706659200  # 2024-01-31 00:00:00 UTC, after the last event

# Scoring weights and limits.
WEIGHTS = {"velocity": 0.30, "acceleration": 0.30, "anomaly": 0.15, "engagement": 0.10, "cross_source": 0.10, "freshness": 0.05}
MAX_AGE_HOURS = 72.0
HALF_LIFE_HOURS = 8.0

# Lifecycle states, best first.
STATES = ["VIRAL", "HOT", "EMERGING", "RISING", "PEAK", "DECLINING", "NEW", "DEAD"]

# Source, primary metric, engagement reference, reliability, can be refreshed.
SOURCES = [
    ("youtube", "views", 0.08, 1.0, True),
    ("reddit", "nativeScore", 0.25, 0.90, True),
    ("hackernews", "nativeScore", 0.6, 0.95, True),
    ("rss", "nativeScore", 0.1, 0.60, False),
    ("googletrends", "nativeScore", 0.1, 0.75, True),
    ("googlenews", "nativeScore", 0.1, 0.70, False),
    ("wikipedia", "views", 0.02, 0.90, True),
    ("telegram", "views", 0.05, 0.80, True),
    ("mastodon", "nativeScore", 0.4, 0.85, True),
    ("bluesky", "nativeScore", 0.35, 0.85, True),
    ("github", "nativeScore", 0.2, 0.95, True),
    ("charts", "nativeScore", 0.1, 0.80, True),
    ("imgur", "views", 0.03, 0.90, True),
    ("twitch", "views", 0.05, 0.95, True),
    ("tmdb", "nativeScore", 0.5, 0.85, True),
    ("producthunt", "nativeScore", 0.15, 0.90, True),
    ("giphy", "nativeScore", 0.1, 0.60, True),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_dimension(spark: SparkSession) -> DataFrame:
    """Capabilities of the known sources: a fixed small dimension."""
    return spark.createDataFrame(SOURCES, "source string, primary_metric string, engagement_reference double, reliability double, refreshable boolean")


def epoch(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, t, author, source, value, k): k is the number inside props."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", epoch(F.col("ts")).alias("t"), F.col("user_id").alias("author"), F.col("event_type").alias("source"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def item_id() -> Column:
    return F.concat_ws(":", "source", F.col("author").cast("string"))


def event_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly observations of one item per (source, author), as a counter that grows.

    (id, source, author, ts, views, likes, native_score); likes are null where no event of
    the hour so far said one.
    """
    from pyspark.sql.window import Window

    e = events(spark, sf_dir).withColumn("ts", F.col("t") - F.col("t") % 3600)
    hourly = e.groupBy("source", "author", "ts").agg(F.sum("value").alias("v"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("source", "author").orderBy("ts")
    return hourly.select(item_id().alias("id"), "source", "author", "ts", F.sum("v").over(running).alias("views"), F.sum("k").over(running).alias("likes"), F.sum("n").over(running).alias("native_score"))


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items: id, source (priority), author (customer), value, published_at."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("author"), F.col("o_totalprice").alias("value"), epoch(F.col("o_orderdate")).alias("published_at"), F.col("o_orderstatus").alias("status"))


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text items: the title is the first line, whole."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), "lang", "source", "n_chars")


#: The same adapters in SQL, for the oracles.
EVENTS_SQL = """ev AS (
  SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, user_id AS author, event_type AS source, value,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""
SNAPSHOTS_SQL = EVENTS_SQL + """, hourly AS (
  SELECT source, author, t - t % 3600 AS ts, sum(value) AS v, sum(k) AS k, count(*) AS n FROM ev GROUP BY 1, 2, 3
), snap AS (
  SELECT source || ':' || author AS id, source, author, ts, sum(v) OVER w AS views,
         CAST(sum(k) OVER w AS BIGINT) AS likes, CAST(sum(n) OVER w AS BIGINT) AS native_score
  FROM hourly WINDOW w AS (PARTITION BY source, author ORDER BY ts))"""
ORDERS_SQL = """items AS (
  SELECT o_orderkey AS id, o_orderpriority AS source, o_custkey AS author, o_totalprice AS value,
         CAST(floor(epoch(o_orderdate)) AS BIGINT) AS published_at, o_orderstatus AS status FROM orders)"""
