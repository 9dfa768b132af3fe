"""Registered queries over the benchmark tables, each beside its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates as d
from tidemark.functions import mathx as m
from tidemark.functions import text as t
from tidemark.model import EVENTS_SQL, NOW, ORDERS_SQL, SNAPSHOTS_SQL, document_items, epoch, event_snapshots, events, order_items, table
from tidemark.operators import baselines, clusters, gaps, lift, ranking, scoring, series, tables
from tidemark.plans.oracle import SCORED_SQL, lift_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(event_snapshots(spark, sf_dir), NOW, cross_source=1 + F.col("author") % 4)


# ── series ────────────────────────────────────────────────────────────────────


@query("latest_nonnull_per_item", f"WITH {SNAPSHOTS_SQL} SELECT id, round(max_by(views, ts), 6) AS views, max_by(likes, ts) FILTER (likes IS NOT NULL) AS likes, max_by(native_score, ts) AS native_score FROM snap GROUP BY id")
def latest_nonnull_per_item(spark, sf_dir):
    return series.latest_non_null(event_snapshots(spark, sf_dir), ["views", "likes", "native_score"]).withColumn("views", r6("views"))


@query("series_last_n", f"WITH {SNAPSHOTS_SQL} SELECT id, ts, round(views, 6) AS views FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS r FROM snap) WHERE r <= 8")
def series_last_n(spark, sf_dir):
    return series.last_n(event_snapshots(spark, sf_dir), 8).select("id", "ts", r6("views").alias("views"))


@query("velocity_last5", f"WITH {SCORED_SQL} SELECT id, observations, round(velocity, 6) AS velocity FROM shapes")
def velocity_last5(spark, sf_dir):
    return series.shape(event_snapshots(spark, sf_dir), NOW).select("id", "observations", r6("velocity").alias("velocity"))


@query("acceleration_split", f"WITH {SCORED_SQL} SELECT id, round(acceleration, 6) AS acceleration FROM shapes")
def acceleration_split(spark, sf_dir):
    return series.shape(event_snapshots(spark, sf_dir), NOW).select("id", r6("acceleration").alias("acceleration"))


@query("engagement_rate", f"WITH {SCORED_SQL} SELECT id, round(engagement, 6) AS engagement FROM shapes")
def engagement_rate(spark, sf_dir):
    return series.engagement_rate(event_snapshots(spark, sf_dir), ["likes"]).select("id", r6("engagement").alias("engagement"))


_LINE_SERIES = "SELECT l_partkey AS id, epoch(l_shipdate)::BIGINT AS ts, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2"


@query("lineitem_velocity", f"WITH p AS ({_LINE_SERIES}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS k FROM p) SELECT id, count(*) AS n, round(CASE WHEN count(*) >= 2 THEN regr_slope(q, ts / 86400.0) END, 4) AS velocity FROM r WHERE k <= 5 GROUP BY id")
def lineitem_velocity(spark, sf_dir):
    daily = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id"), epoch(F.col("l_shipdate")).alias("ts")).agg(F.sum("l_quantity").alias("q"))
    last = series.last_n(daily, 5)
    return last.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("q", F.col("ts") / 86400.0), 4).alias("velocity"))


# ── baselines and creators ───────────────────────────────────────────────────

_Q = "count({0}) AS n, round(quantile_cont({0}, 0.5), 6) AS p50, round(quantile_cont({0}, 0.75), 6) AS p75, round(quantile_cont({0}, 0.9), 6) AS p90, round(quantile_cont({0}, 0.99), 6) AS p99"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c.startswith("p") and c[1:].isdigit() else F.col(c) for c in df.columns])


@query("source_quantiles_all", f"WITH {ORDERS_SQL} SELECT source, {_Q.format('value')} FROM items GROUP BY source")
def source_quantiles_all(spark, sf_dir):
    return _rounded(baselines.source_quantiles(order_items(spark, sf_dir), "value", ["source"]))


@query("source_quantiles_hourly", f"WITH {EVENTS_SQL} SELECT source, CAST(t % 86400 // 3600 AS INT) AS hour, {_Q.format('value')} FROM ev GROUP BY 1, 2 HAVING count(*) >= 20")
def source_quantiles_hourly(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("hour", d.hour(F.col("t")))
    return _rounded(baselines.source_quantiles(e, "value", ["source", "hour"], least_rows=20))


@query("source_mad", f"WITH {ORDERS_SQL} SELECT source, round(median(value), 6) AS median, round(mad(value), 6) AS mad FROM items GROUP BY source")
def source_mad(spark, sf_dir):
    return baselines.source_mad(order_items(spark, sf_dir), "value", "source").select("source", r6("median").alias("median"), r6("mad").alias("mad"))


@query("percentile_from_quantiles", f"WITH {SCORED_SQL} SELECT id, round(popularity, 6) AS popularity FROM scored")
def percentile_from_quantiles(spark, sf_dir):
    return scored(spark, sf_dir).select("id", r6("popularity").alias("popularity"))


_LOO_SQL = f"""WITH {ORDERS_SQL}, recent AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY published_at DESC, id DESC) AS r FROM items) WHERE r <= 200
), loo AS (
  SELECT a.id, a.author, a.value, count(*) AS n, quantile_cont(b.value, 0.5) AS median, quantile_cont(b.value, 0.9) AS p90
  FROM items a JOIN recent b ON a.author = b.author AND a.id <> b.id GROUP BY 1, 2, 3 HAVING count(*) >= 3)"""


@query("creator_baseline_loo", _LOO_SQL + " SELECT id, author, value, n, round(median, 6) AS median, round(p90, 6) AS p90 FROM loo")
def creator_baseline_loo(spark, sf_dir):
    loo = baselines.leave_one_out(order_items(spark, sf_dir))
    return loo.select("id", "author", "value", "n", r6("median").alias("median"), r6("p90").alias("p90"))


@query("creator_breakouts", _LOO_SQL + " SELECT id, author, n, round(value / greatest(median, 1), 6) AS ratio FROM loo WHERE n >= 5 AND value / greatest(median, 1) >= 2 AND value >= p90")
def creator_breakouts(spark, sf_dir):
    return baselines.breakouts(baselines.leave_one_out(order_items(spark, sf_dir)), times=2.0).select("id", "author", "n", r6("ratio").alias("ratio"))


# ── score ────────────────────────────────────────────────────────────────────


@query("score_combined", f"WITH {SCORED_SQL} SELECT id, round(coverage, 6) AS coverage, round(score, 6) AS score FROM scored")
def score_combined(spark, sf_dir):
    return scored(spark, sf_dir).select("id", r6("coverage").alias("coverage"), r6("score").alias("score"))


@query("score_confidence", f"WITH {SCORED_SQL} SELECT id, round(confidence, 6) AS confidence FROM scored")
def score_confidence(spark, sf_dir):
    return scored(spark, sf_dir).select("id", r6("confidence").alias("confidence"))


@query("lifecycle_state", f"WITH {SCORED_SQL} SELECT id, state FROM scored")
def lifecycle_state(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "state")


@query("ranked_velocity", f"WITH {SCORED_SQL} SELECT id, source, round(velocity, 6) AS velocity, round(popularity, 6) AS popularity, round(score, 6) AS score FROM scored ORDER BY velocity DESC NULLS LAST, scored.score DESC, id LIMIT 20")
def ranked_velocity(spark, sf_dir):
    top = ranking.page(scored(spark, sf_dir), ranking.RankedQuery(sort="velocity", limit=20))
    return top.select("id", "source", r6("velocity").alias("velocity"), r6("popularity").alias("popularity"), r6("score").alias("score"))


_DAILY_SQL = f"""WITH {EVENTS_SQL}, daily AS (SELECT author AS id, t - t % 86400 AS day, sum(value) AS score FROM ev GROUP BY 1, 2),
high AS (SELECT *, max(score) OVER w AS peak FROM daily WINDOW w AS (PARTITION BY id ORDER BY day)),
moved AS (SELECT *, CASE WHEN lag(peak) OVER w IS NULL OR peak > lag(peak) OVER w THEN day END AS mv FROM high WINDOW w AS (PARTITION BY id ORDER BY day)),
peaks AS (SELECT *, max(mv) OVER (PARTITION BY id ORDER BY day) AS peak_at FROM moved)"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of days, added in the order of the events: doubles added in another order differ in
    their last bit, which moves a peak or a state that is just reached."""
    day = F.col("t") - F.col("t") % 86400  # as in SQL: the two days around 1970 are one
    e = events(spark, sf_dir).select(F.col("author").alias("id"), day.alias("day"), "event_id", "value")
    return series.ordered_sum(e, ["id", "day"], "event_id", "value").withColumnRenamed("value", "score")


@query("peak_high_water", _DAILY_SQL + " SELECT id, day, round(score, 6) AS score, round(peak, 6) AS peak, peak_at FROM peaks")
def peak_high_water(spark, sf_dir):
    return scoring.high_water(_daily(spark, sf_dir)).select("id", "day", r6("score").alias("score"), r6("peak").alias("peak"), "peak_at")


@query("state_change_events", _DAILY_SQL + ", s AS (SELECT id, day, CASE WHEN score >= 0.8 * peak THEN 'HOT' WHEN score >= 0.4 * peak THEN 'RISING' ELSE 'DECLINING' END AS state FROM peaks), c AS (SELECT *, lag(state) OVER (PARTITION BY id ORDER BY day) AS was FROM s) SELECT id, day, was, state FROM c WHERE state = 'HOT' AND was IS DISTINCT FROM state")
def state_change_events(spark, sf_dir):
    from pyspark.sql.window import Window

    x = scoring.high_water(_daily(spark, sf_dir))
    state = F.when(F.col("score") >= 0.8 * F.col("peak"), "HOT").when(F.col("score") >= 0.4 * F.col("peak"), "RISING").otherwise("DECLINING")
    x = x.withColumn("state", state).withColumn("was", F.lag("state").over(Window.partitionBy("id").orderBy(F.col("day").asc_nulls_last())))
    return x.where((F.col("state") == "HOT") & ~F.col("was").eqNullSafe(F.col("state"))).select("id", "day", "was", "state")


@query("missed_peaks", _DAILY_SQL + f", l AS (SELECT id, max(day) AS day FROM peaks GROUP BY id) SELECT p.id, round(p.peak, 6) AS peak, p.peak_at FROM peaks p JOIN l USING (id, day) WHERE p.peak_at >= {NOW} - 14 * 86400 AND p.score < 0.6 * p.peak")
def missed_peaks(spark, sf_dir):
    x = scoring.high_water(_daily(spark, sf_dir))
    last = x.where("id is not null").groupBy("id").agg(F.max_by(F.struct("score", "peak", "peak_at"), "day").alias("l")).select("id", "l.*")
    return last.where((F.col("peak_at") >= NOW - 14 * 86400) & (F.col("score") < 0.6 * F.col("peak"))).select("id", r6("peak").alias("peak"), "peak_at")


# ── ranked read ──────────────────────────────────────────────────────────────


@query("ranked_page", f"WITH {SCORED_SQL} SELECT id, state, round(score, 6) AS score FROM scored WHERE source IN ('click', 'view', 'purchase') AND score >= 1 ORDER BY scored.score DESC NULLS LAST, id LIMIT 25 OFFSET 10")
def ranked_page(spark, sf_dir):
    q = ranking.RankedQuery(sources=["click", "view", "purchase"], least_score=1.0, limit=25, offset=10)
    return ranking.page(scored(spark, sf_dir), q).select("id", "state", r6("score").alias("score"))


@query("ranked_count", f"WITH {SCORED_SQL} SELECT count(*) AS total FROM scored WHERE source IN ('click', 'view', 'purchase') AND score >= 1")
def ranked_count(spark, sf_dir):
    return ranking.count(scored(spark, sf_dir), ranking.RankedQuery(sources=["click", "view", "purchase"], least_score=1.0))


_TITLE = "split_part(text, chr(10), 1)"


@query("ranked_lang_null_kept", "SELECT doc_id AS id, CASE WHEN doc_id % 7 <> 0 THEN lang END AS lang FROM documents WHERE doc_id % 7 = 0 OR lang IN ('en', 'fr')")
def ranked_lang_null_kept(spark, sf_dir):
    docs = document_items(spark, sf_dir).withColumn("lang", F.when(F.col("id") % 7 != 0, F.col("lang")))
    return ranking.filtered(docs, ranking.RankedQuery(languages=["en", "fr"])).select("id", "lang")


@query("substring_search", "SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'tion that')")
def substring_search(spark, sf_dir):
    return ranking.filtered(document_items(spark, sf_dir), ranking.RankedQuery(text="TION that")).select("id")


@query("hashtag_membership", "SELECT p_partkey AS id FROM part WHERE list_contains(string_split(lower(p_name), ' '), split_part(lower((SELECT p_name FROM part ORDER BY p_partkey LIMIT 1)), ' ', 1))")
def hashtag_membership(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split(F.lower("p_name"), " ").alias("hashtags"))
    wanted = F.broadcast(parts.orderBy("id").limit(1).select(F.col("hashtags")[0].alias("tag")))  # one row
    return parts.crossJoin(wanted).where(F.expr("array_contains(hashtags, tag)")).select("id")


_ARCHIVE = "SELECT doc_id FROM documents WHERE doc_id % 17 = 0"


def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("doc_id") % 17 == 0).select(F.col("doc_id").alias("id"))


@query("archive_hide", f"SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN ({_ARCHIVE})")
def archive_hide(spark, sf_dir):
    return ranking.filtered(document_items(spark, sf_dir), ranking.RankedQuery(), _archive(spark, sf_dir)).select("id", "source")


@query("archive_only", f"SELECT doc_id AS id, source FROM documents WHERE doc_id IN ({_ARCHIVE})")
def archive_only(spark, sf_dir):
    return ranking.filtered(document_items(spark, sf_dir), ranking.RankedQuery(archived="only"), _archive(spark, sf_dir)).select("id", "source")


@query("facets", "SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source")
def facets(spark, sf_dir):
    return ranking.facets(document_items(spark, sf_dir), ["lang", "source"])


@query("country_facets", "SELECT n_name AS country, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def country_facets(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("country")).agg(F.count(F.lit(1)).alias("n"))


@query("distribution_by_source", "SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM documents GROUP BY 1")
def distribution_by_source(spark, sf_dir):
    return document_items(spark, sf_dir).groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("hourly_timeline", f"WITH {EVENTS_SQL} SELECT source, t - t % 3600 AS hour, count(*) AS n FROM ev GROUP BY 1, 2")
def hourly_timeline(spark, sf_dir):
    return events(spark, sf_dir).groupBy("source", d.bucket(F.col("t"), 3600).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("activity_grid", f"WITH {EVENTS_SQL} SELECT CAST((t // 86400 + 4) % 7 AS INT) AS weekday, CAST(t % 86400 // 3600 AS INT) AS hour, count(*) AS n FROM ev GROUP BY 1, 2")
def activity_grid(spark, sf_dir):
    return events(spark, sf_dir).groupBy(d.weekday(F.col("t")).alias("weekday"), d.hour(F.col("t")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("local_activity_grid", f"WITH {EVENTS_SQL} SELECT CAST(((t + 12600) // 86400 + 4) % 7 AS INT) AS weekday, CAST((t + 12600) % 86400 // 3600 AS INT) AS hour, count(*) AS n FROM ev GROUP BY 1, 2")
def local_activity_grid(spark, sf_dir):
    zone = "Asia/Tehran"
    return events(spark, sf_dir).groupBy(d.weekday(F.col("t"), zone).alias("weekday"), d.hour(F.col("t"), zone).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("score_histogram", f"WITH {SCORED_SQL} SELECT CAST(least(floor(score / 10) * 10, 90) AS INT) AS bucket, count(*) AS n FROM scored GROUP BY 1")
def score_histogram(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(F.least(F.floor(F.col("score") / 10) * 10, F.lit(90)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("source_quality", f"WITH {SCORED_SQL} SELECT source, count(*) AS items, CAST(sum(CASE WHEN score >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS strong, round(avg(observations), 6) AS mean_observations, round(max(score), 6) AS best FROM scored GROUP BY source")
def source_quality(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("score") >= 10).alias("strong"), r6(F.avg("observations")).alias("mean_observations"), r6(F.max("score")).alias("best"))


# ── creators ─────────────────────────────────────────────────────────────────


@query("creator_leaderboard", f"WITH {ORDERS_SQL} SELECT author, c_name AS name, count(*) AS items, max(value) AS best, round(avg(value), 6) AS mean FROM items JOIN customer ON author = c_custkey GROUP BY 1, 2 HAVING count(*) >= 3")
def creator_leaderboard(spark, sf_dir):
    by = order_items(spark, sf_dir).groupBy("author").agg(F.count(F.lit(1)).alias("items"), F.max("value").alias("best"), r6(F.avg("value")).alias("mean")).where("items >= 3")
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("author"), F.col("c_name").alias("name"))
    return by.join(names, "author").select("author", "name", "items", "best", "mean")


@query("proven_creators", f"WITH {SCORED_SQL} SELECT author, count(*) AS items, round(avg(score), 6) AS mean FROM scored GROUP BY author HAVING count(*) >= 2 AND avg(score) >= 5")
def proven_creators(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("author").agg(F.count(F.lit(1)).alias("items"), F.avg("score").alias("m")).where("items >= 2 and m >= 5").select("author", "items", r6("m").alias("mean"))


@query("creators_needing_history", f"WITH {ORDERS_SQL}, h AS (SELECT author, count(*) AS kept FROM items WHERE id % 3 = 0 GROUP BY author) SELECT c_custkey AS author, count(DISTINCT i.id) AS items, coalesce(max(h.kept), 0) AS kept FROM customer LEFT JOIN items i ON i.author = c_custkey LEFT JOIN h ON h.author = c_custkey GROUP BY 1 HAVING count(DISTINCT i.id) >= 1 AND coalesce(max(h.kept), 0) < 4")
def creators_needing_history(spark, sf_dir):
    items = order_items(spark, sf_dir)
    by = items.groupBy("author").agg(F.count_distinct("id").alias("items"), F.count_if(F.col("id") % 3 == 0).alias("kept"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("author"))
    return by.where("kept < 4").join(known, "author", "left_semi").select("author", "items", "kept")


_NEWEST = "SELECT l_orderkey AS id, count(*) AS n, max(CAST(floor(epoch(l_shipdate)) AS BIGINT)) AS last_ts FROM lineitem GROUP BY 1"


def _refresh_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max(epoch(F.col("l_shipdate"))).alias("last_ts"))


@query("refresh_tiers", f"WITH i AS ({_NEWEST}), tiered AS (SELECT *, CASE WHEN n < 2 THEN 0 WHEN n < 4 THEN 1 WHEN n < 6 THEN 2 ELSE 3 END AS tier FROM i), p AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY last_ts, id) AS place FROM tiered), c AS (SELECT count(*) FILTER (tier = 0) AS a, count(*) FILTER (tier = 1) AS b, count(*) FILTER (tier = 2) AS c FROM tiered), q AS (SELECT least(55, a) AS t0, least(25, b) AS t1, least(20, c) AS t2 FROM c) SELECT id, n, last_ts, ['bootstrap', 'shape', 'track', 'refine'][tier + 1] AS tier_name, place FROM p, q WHERE place <= CASE tier WHEN 0 THEN t0 WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE 100 - t0 - t1 - t2 END")
def refresh_tiers(spark, sf_dir):
    n = F.col("n")
    quotas = [("bootstrap", 0.55, n < 2), ("shape", 0.25, n < 4), ("track", 0.20, n < 6), ("refine", 1.0, F.lit(True))]
    return tables.refresh_tiers(_refresh_items(spark, sf_dir), 100, quotas)


@query("refresh_coverage", f"WITH i AS ({_NEWEST}) SELECT count(*) AS items, count(*) FILTER (n < 2) AS once, count(*) FILTER (n >= 3) AS three, count(*) FILTER (n >= 10) AS ten FROM i")
def refresh_coverage(spark, sf_dir):
    n = F.col("n")
    return _refresh_items(spark, sf_dir).agg(F.count(F.lit(1)).alias("items"), F.count_if(n < 2).alias("once"), F.count_if(n >= 3).alias("three"), F.count_if(n >= 10).alias("ten"))


# ── keywords ─────────────────────────────────────────────────────────────────

_KEYWORDS_SQL = f"WITH {EVENTS_SQL}, kh AS (SELECT 'k' || (k % 10) AS keyword, t - t % 3600 AS hour, count(*) AS mentions, count(DISTINCT author) AS creators, count(DISTINCT source) AS sources, sum(coalesce(value, 0)) AS views FROM ev GROUP BY 1, 2)"


def _keyword_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = events(spark, sf_dir).select(F.concat(F.lit("k"), (F.col("k") % 10).cast("string")).alias("keyword"), "t", "author", "source", F.col("value").alias("views"))
    return tables.keyword_hours(uses)


@query("keyword_hourly_rollup", _KEYWORDS_SQL + " SELECT keyword, hour, mentions, creators, sources, round(views, 6) AS views FROM kh")
def keyword_hourly_rollup(spark, sf_dir):
    return _keyword_hours(spark, sf_dir).withColumn("views", r6("views"))


@query("keyword_breakouts", _KEYWORDS_SQL + " SELECT a.keyword, a.hour, a.mentions, coalesce(b.mentions, 0) AS before, round(a.mentions / greatest(coalesce(b.mentions, 0), 1), 6) AS growth FROM kh a LEFT JOIN kh b ON a.keyword = b.keyword AND b.hour = a.hour - 3600 WHERE a.mentions >= 2")
def keyword_breakouts(spark, sf_dir):
    return tables.keyword_breakouts(_keyword_hours(spark, sf_dir)).withColumn("growth", r6("growth"))


@query("term_yield", "SELECT p_brand AS term, count(*) AS found, CAST(sum(CASE WHEN l_quantity >= 40 THEN 1 ELSE 0 END) AS BIGINT) AS moving, round(avg(l_quantity), 1) AS mean, round(sum(CASE WHEN l_quantity >= 40 THEN 1 ELSE 0 END) / count(*), 6) AS hit_rate FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def term_yield(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("term"))
    x = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    moving = F.count_if(F.col("l_quantity") >= 40)
    return x.groupBy("term").agg(F.count(F.lit(1)).alias("found"), moving.alias("moving"), F.round(F.avg("l_quantity"), 1).alias("mean"), r6(moving / F.count(F.lit(1))).alias("hit_rate"))


@query("demand_grouped_by_topic", "SELECT lower(trim(p_name)) AS topic, count(DISTINCT p_brand) AS countries, min(p_partkey) AS first_id, max(p_retailprice) AS best FROM part GROUP BY 1")
def demand_grouped_by_topic(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.lower(F.trim("p_name")).alias("topic")).agg(F.count_distinct("p_brand").alias("countries"), F.min("p_partkey").alias("first_id"), F.max("p_retailprice").alias("best"))


@query("domain_topn", r"WITH x AS (SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS domain FROM pages) SELECT domain, count(*) AS n FROM x WHERE domain <> '' GROUP BY 1 ORDER BY n DESC, domain LIMIT 10")
def domain_topn(spark, sf_dir):
    by = table(spark, sf_dir, "pages").groupBy(t.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    return by.where("domain is not null").orderBy(F.desc("n"), "domain").limit(10)


@query("scatter_sample", f"WITH {ORDERS_SQL} SELECT id, value, c_acctbal AS followers FROM items JOIN customer ON author = c_custkey WHERE c_acctbal > 0 ORDER BY value DESC, id LIMIT 200")
def scatter_sample(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("author"), F.col("c_acctbal").alias("followers")).where("followers > 0")
    return order_items(spark, sf_dir).join(c, "author").orderBy(F.desc("value"), "id").limit(200).select("id", "value", "followers")


# ── lift reports ─────────────────────────────────────────────────────────────


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as format samples: percentile from length, score from quality."""
    docs = document_items(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality"), "id")
    return docs.withColumn("percentile", F.least(F.lit(1.0), F.col("n_chars") / 5000.0)).withColumn("score", F.col("quality") * 50.0 + F.col("id") % 50)


_OUTCOMES_SQL = f"""outcomes AS (SELECT d.doc_id AS id, {_TITLE} AS title, lang, source, least(1.0, n_chars / 5000.0) AS percentile,
  quality * 50.0 + d.doc_id % 50 AS score FROM documents d JOIN labels USING (doc_id)),
overall AS (SELECT avg(percentile) AS a FROM outcomes),
adj AS (SELECT o.*, percentile - avg(percentile) OVER (PARTITION BY lang) + a AS adjusted FROM outcomes o, overall)"""


def _p6(df: DataFrame) -> DataFrame:
    return df.withColumn("p", r6("p"))


_BAND = "CASE WHEN length(trim(title)) <= 30 THEN '0-30' WHEN length(trim(title)) <= 50 THEN '31-50' WHEN length(trim(title)) <= 70 THEN '51-70' WHEN length(trim(title)) <= 100 THEN '71-100' ELSE '100+' END"
_WORD_COUNT = "CASE WHEN trim(title) = '' THEN 0 ELSE len(regexp_split_to_array(trim(title), '\\s+')) END"
_WORD_BAND = f"CASE WHEN {_WORD_COUNT} <= 4 THEN '1-4' WHEN {_WORD_COUNT} <= 8 THEN '5-8' WHEN {_WORD_COUNT} <= 12 THEN '9-12' WHEN {_WORD_COUNT} <= 18 THEN '13-18' ELSE '19+' END"


def _format_lift(spark: SparkSession, sf_dir: str, bucket: Column) -> DataFrame:
    adj = lift.stratified(_outcomes(spark, sf_dir), "percentile", ["lang"])
    return _p6(lift.summarise(adj.withColumn("bucket", bucket), ["bucket"], "adjusted", "score"))


@query("format_lift", f"WITH {_OUTCOMES_SQL}, rows AS (SELECT {_BAND} AS bucket, adjusted AS v, score AS sc FROM adj), " + lift_sql(["bucket"]))
def format_lift(spark, sf_dir):
    return _format_lift(spark, sf_dir, t.length_band(t.char_count(F.col("title"))))


@query("format_lift_words", f"WITH {_OUTCOMES_SQL}, rows AS (SELECT {_WORD_BAND} AS bucket, adjusted AS v, score AS sc FROM adj), " + lift_sql(["bucket"]))
def format_lift_words(spark, sf_dir):
    return _format_lift(spark, sf_dir, t.word_band(t.word_count(F.col("title"))))


def _has(name: str, condition: str) -> str:
    return f"CASE WHEN {condition} THEN ['{name}'] ELSE [] END"


_FEATURES_SQL = " || ".join(
    _has(n, c)
    for n, c in {
        "question": "regexp_matches(title, '[?？؟]')",
        "exclaim": "regexp_matches(title, '[!！]')",
        "number": "regexp_matches(title, '[0-9۰-۹٠-٩]')",
        "hashtag": r"regexp_matches(title, '(^|\s)#\S')",
        "bracket": r"""regexp_matches(title, '["''«»“”()\[\]{}]')""",
        "shout": r"regexp_matches(title, '\b[A-Z]{3,}\b')",
        "you": r"lang = 'en' AND regexp_matches(title, '(?i)\b(you|your|yours|yourself)\b')",
        "listicle": r"regexp_matches(title, '^\s*[0-9۰-۹٠-٩]') OR (lang = 'en' AND regexp_matches(title, '[0-9۰-۹٠-٩]') AND regexp_matches(title, '(?i)\b(ways?|things?|tips?|reasons?|steps?|rules?|facts?)\b'))",
    }.items()
)


@query("title_pattern_two_sample", f"WITH {_OUTCOMES_SQL}, rows AS (SELECT unnest({_FEATURES_SQL}) AS feature, adjusted AS v, score AS sc FROM adj), whole AS (SELECT adjusted AS v FROM adj), " + lift_sql(["feature"], complement=True))
def title_pattern_two_sample(spark, sf_dir):
    adj = lift.stratified(_outcomes(spark, sf_dir), "percentile", ["lang"])
    features = t.title_features(F.col("title"), F.col("lang"))
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in features.items()]), lambda x: x.isNotNull())
    rows = adj.select(F.explode(found).alias("feature"), "adjusted", "score")
    return _p6(lift.summarise(rows, ["feature"], "adjusted", "score", baseline=adj.withColumnRenamed("adjusted", "__b").withColumn("adjusted", F.col("__b")), complement=True))


_TIMING_SQL = f"""WITH {EVENTS_SQL}, x AS (SELECT source, CASE WHEN ({NOW} - t) / 3600.0 < 48 THEN '<48h' WHEN ({NOW} - t) / 3600.0 < 96 THEN '<96h' WHEN ({NOW} - t) / 3600.0 < 240 THEN '<240h' ELSE 'older' END AS age_band,
  CASE WHEN t % 86400 // 3600 < 6 THEN 'night' WHEN t % 86400 // 3600 < 12 THEN 'morning' WHEN t % 86400 // 3600 < 18 THEN 'afternoon' ELSE 'evening' END AS day_part,
  least(1.0, value / 200.0) AS percentile, value AS sc FROM ev WHERE t <= {NOW} - 86400 AND t % 86400 <> 0),
rows AS (SELECT day_part, percentile - avg(percentile) OVER (PARTITION BY source, age_band) + (SELECT avg(percentile) FROM x) AS v, sc FROM x), """


@query("timing_lift", _TIMING_SQL + lift_sql(["day_part"]))
def timing_lift(spark, sf_dir):
    e = events(spark, sf_dir).where((F.col("t") <= NOW - 86400) & (F.col("t") % 86400 != 0))
    e = e.withColumn("age_band", d.age_band((NOW - F.col("t")) / 3600.0)).withColumn("day_part", d.day_part(d.hour(F.col("t"))))
    e = e.withColumn("percentile", F.least(F.lit(1.0), F.col("value") / 200.0))
    return _p6(lift.summarise(lift.stratified(e, "percentile", ["source", "age_band"]), ["day_part"], "adjusted", "value"))


@query("band_lift", "WITH x AS (SELECT p_brand, p_size, p_retailprice, (p_partkey % 97) / 97.0 AS percentile, p_partkey % 100 AS sc FROM part), u AS (SELECT 'size' AS measure, CASE WHEN p_size < 15 THEN 'low' WHEN p_size < 35 THEN 'middle' ELSE 'high' END AS band, percentile AS v, sc FROM x UNION ALL SELECT 'price', CASE WHEN p_retailprice < 1000 THEN 'low' WHEN p_retailprice < 1400 THEN 'middle' ELSE 'high' END, percentile, sc FROM x), rows AS (SELECT * FROM u), " + lift_sql(["measure", "band"]))
def band_lift(spark, sf_dir):
    def band(c: str, lo: float, hi: float) -> Column:
        return F.when(F.col(c) < lo, "low").when(F.col(c) < hi, "middle").otherwise("high")

    x = table(spark, sf_dir, "part").select(((F.col("p_partkey") % 97) / 97.0).alias("percentile"), (F.col("p_partkey") % 100).alias("sc"), band("p_size", 15, 35).alias("size"), band("p_retailprice", 1000, 1400).alias("price"))
    rows = x.selectExpr("percentile", "sc", "stack(2, 'size', size, 'price', price) as (measure, band)")
    return _p6(lift.summarise(rows, ["measure", "band"], "percentile", "sc"))


_TAG_SQL = "WITH x AS (SELECT unnest(list_distinct(string_split(lower(p_name), ' '))) AS tag, (p_partkey % 97) / 97.0 AS v, p_partkey % 100 AS sc FROM part), whole AS (SELECT (p_partkey % 97) / 97.0 AS v FROM part), rows AS (SELECT * FROM x), "


def _tag_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_name", ((F.col("p_partkey") % 97) / 97.0).alias("v"), (F.col("p_partkey") % 100).alias("sc"))
    rows = parts.select(F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("tag"), "v", "sc")
    return lift.summarise(rows, ["tag"], "v", "sc", baseline=parts)


@query("tag_lift", _TAG_SQL + lift_sql(["tag"], whole=True))
def tag_lift(spark, sf_dir):
    return _p6(_tag_lift(spark, sf_dir))


@query("bh_correction", _TAG_SQL + lift_sql(["tag"], whole=True, name="b", final=False) + ", r AS (SELECT tag, p, row_number() OVER (ORDER BY p, tag) AS k, count(*) OVER () AS m FROM b WHERE NOT thin), c AS (SELECT max(CASE WHEN p <= k / m * 0.05 THEN p END) AS cut FROM r) SELECT b.tag, b.n, b.lift, b.significant AND coalesce(r.p <= c.cut, false) AS significant FROM b LEFT JOIN r USING (tag), c")
def bh_correction(spark, sf_dir):
    return lift.control_discoveries(_tag_lift(spark, sf_dir), ["tag"]).select("tag", "n", "lift", "significant")


@query("niche_lift", "WITH x AS (SELECT l_quantity * 100 / s.s_acctbal AS ratio, CASE WHEN s_acctbal < 100 THEN '<100' WHEN s_acctbal < 1000 THEN '<1k' WHEN s_acctbal < 10000 THEN '<10k' ELSE '<100k' END AS band, p_type, l_suppkey, p_name FROM lineitem JOIN supplier s ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE s_acctbal >= 20), norm AS (SELECT band, median(ratio) AS mid FROM x GROUP BY band), y AS (SELECT unnest(list_distinct(string_split(lower(p_name), ' '))) AS subject, ratio / mid AS lift, l_suppkey FROM x JOIN norm USING (band) WHERE mid > 0) SELECT subject, count(*) AS n, count(DISTINCT l_suppkey) AS creators, round(median(lift), 4) AS lift FROM y GROUP BY 1 HAVING count(*) >= 10 AND count(DISTINCT l_suppkey) >= 8")
def niche_lift(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_acctbal").alias("followers"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.array_distinct(F.split(F.lower("p_name"), " ")).alias("subjects"))
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity").join(s, "l_suppkey").join(p, "l_partkey")
    x = x.withColumn("ratio", m.views_per_follower(F.col("l_quantity") * 100, F.col("followers"))).where("ratio is not null").withColumn("band", m.size_band(F.col("followers")))
    norm = F.broadcast(baselines.medians(x, ["band"], "ratio", "mid"))  # five bands
    y = x.join(norm, "band").where("mid > 0").select(F.explode("subjects").alias("subject"), (F.col("ratio") / F.col("mid")).alias("lift"), "l_suppkey")
    each = y.groupBy("subject", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    out = each.groupBy("subject").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("creators")).where("n >= 10 and creators >= 8")
    middle = baselines.medians(y, ["subject"], "lift", "lift")
    return out.join(middle, "subject").select("subject", "n", "creators", F.round("lift", 4).alias("lift"))


@query("examples_drilldown", f"WITH {_OUTCOMES_SQL} SELECT id, title, round(adjusted, 6) AS adjusted FROM adj WHERE {_BAND} = '71-100' ORDER BY adj.adjusted DESC, id LIMIT 20")
def examples_drilldown(spark, sf_dir):
    adj = lift.stratified(_outcomes(spark, sf_dir), "percentile", ["lang"]).where(t.length_band(t.char_count(F.col("title"))) == "71-100")
    return adj.orderBy(F.desc("adjusted"), "id").limit(20).select("id", "title", r6("adjusted").alias("adjusted"))


# ── vectors ──────────────────────────────────────────────────────────────────

_DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_GAPS_SQL = f"WITH sims AS (SELECT a.vec_id AS topic, b.vec_id AS item, {_DOT} AS sim FROM embeddings a, embeddings b WHERE a.label <= 1 AND a.vec_id % 20 = 0 AND b.label > 1)"


def _gaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Demand topics (labels 0 and 1) are a stated query set, every twentieth id, against all
    supply, by vectors alone."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(None).cast("string").alias("title"), F.col("embedding").alias("v"), "label")
    return gaps.compared(e.where("label <= 1 and id % 20 = 0"), e.where("label > 1"), bar=0.3)


@query("gaps_topk", _GAPS_SQL + " SELECT topic, item, round(sim, 6) AS sim, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY sim DESC, item) AS r FROM sims) WHERE r <= 3")
def gaps_topk(spark, sf_dir):
    return _gaps(spark, sf_dir)[0].select("topic", "item", r6("score").alias("sim"), F.col("place").cast("long").alias("place"))


@query("gap_verdicts", _GAPS_SQL + ", c AS (SELECT topic, CAST(sum(CASE WHEN sim >= 0.3 THEN 1 ELSE 0 END) AS BIGINT) AS covered FROM sims GROUP BY 1) SELECT topic, covered, CASE WHEN covered = 0 THEN 'open' WHEN covered < 3 THEN 'thin' ELSE 'covered' END AS verdict FROM c")
def gap_verdicts(spark, sf_dir):
    counts = _gaps(spark, sf_dir)[1]
    return counts.withColumn("verdict", gaps.verdict(F.col("covered"), ("open", "thin", "covered")))


@query("relevance_score", "WITH i AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS relevance FROM embeddings, i")
def relevance_score(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    interest = F.broadcast(e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("v")))  # one vector
    return e.join(interest).select("vec_id", r6(m.dot(F.col("embedding"), F.col("v"))).alias("relevance"))


@query("label_centroids", "WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings) SELECT label, CAST(i AS INT) AS dim, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM x GROUP BY 1, 2")
def label_centroids(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return x.groupBy("label", (F.col("i") + 1).alias("dim")).agg(r6(F.avg(F.col("v").cast("double"))).alias("mean"))


# ── text ─────────────────────────────────────────────────────────────────────

_STOP_SQL = "[" + ", ".join("'" + w + "'" for w in t.ALL_STOPWORDS) + "]"
_NORM = (
    r"regexp_replace(regexp_replace(translate(regexp_replace(lower(regexp_replace(translate(regexp_replace({0}, '[\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{FEFF}}]', ' ', 'g'), 'أإآٱىيكة', 'ااااییکه'),"
    r" '[\x{{64B}}-\x{{652}}\x{{670}}]', '', 'g')), 'https?://\S+', ' ', 'g'), '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), '[^\p{{L}}\p{{N}}#@_\s]+', ' ', 'g'), '\s+', ' ', 'g')"
)
_WORDS = (
    "flatten(list_transform(list_filter(string_split(" + _NORM + ", ' '), lambda p: p <> ''), lambda p: CASE WHEN regexp_matches(p, '^[\\x{{3040}}-\\x{{30FF}}\\x{{4E00}}-\\x{{9FFF}}]+$')"
    " THEN list_transform(range(1, greatest(length(p), 2)), lambda i: substr(p, i, 2)) ELSE [p] END))"
)
_TOKENS = "list_filter(" + _WORDS + ", lambda w: length(w) > 1 AND NOT list_contains(" + _STOP_SQL + ", w) AND NOT regexp_matches(w, '^[0-9]+$') AND NOT starts_with(w, '@'))"
_STEMS = "list_transform(" + _TOKENS + ", lambda w: CASE WHEN regexp_matches(w, '^[a-z]{{4,}}$') THEN '~' || w ELSE w END)"
for _pattern, _left in t.STEM_STEPS:
    _STEMS = f"list_transform({_STEMS}, lambda w: regexp_replace(w, '{_pattern.replace('{', '{{').replace('}', '}}')}', '{_left.replace('$', chr(92))}'))"
_STEMS = f"list_transform({_STEMS}, lambda w: ltrim(w, '~'))"


_TITLE_WORDS = f"list_distinct(list_filter(regexp_split_to_array(lower({_TITLE}), '[\\s\\p{{P}}]+'), lambda w: length(w) >= 3))"


@query("gap_word_overlap", f"WITH w AS (SELECT doc_id AS id, {_TITLE_WORDS} AS w FROM documents), s AS (SELECT t.id AS topic, i.id AS item, round(len(list_intersect(t.w, i.w)) / len(t.w) * 0.7, 9) AS score FROM w t, w i WHERE t.id % 20 = 0 AND i.id % 20 <> 0 AND list_has_any(t.w, i.w)) SELECT topic, item, round(score / 0.7, 6) AS overlap, place FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, item) AS place FROM s) WHERE place <= 3")
def gap_word_overlap(spark, sf_dir):
    """Every twentieth title as a topic, against the other titles by their words."""
    docs = document_items(spark, sf_dir).select("id", "title", F.lit(None).cast("array<double>").alias("v"))
    matches, _ = gaps.compared(docs.where("id % 20 = 0"), docs.where("id % 20 <> 0"))
    return matches.select("topic", "item", r6(F.col("score") / gaps.COVERED_AT).alias("overlap"), F.col("place").cast("long").alias("place"))


#: Texts with tags, mentions and links: the documents' titles marked by rules on the id.
_TAGGED_SQL = f"""tagged AS (SELECT doc_id AS id, '#Topic' || doc_id % 13 || ' @User.' || doc_id % 7 || ' (https://www.Site' || doc_id % 5 || '.example/a?b=' || doc_id || ') #topic' || doc_id % 3 || ' ' || {_TITLE} AS body FROM documents)"""


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    marks = F.concat(F.lit("#Topic"), i % 13, F.lit(" @User."), i % 7, F.lit(" (https://www.Site"), i % 5, F.lit(".example/a?b="), i, F.lit(") #topic"), i % 3, F.lit(" "), F.col("title"))
    return document_items(spark, sf_dir).select("id", marks.alias("body"))


@query("entities_hashtags", rf"WITH {_TAGGED_SQL}, x AS (SELECT id, list_distinct(list_transform(regexp_extract_all(body, '#([\p{{L}}\p{{N}}_]{{2,50}})', 1), lambda h: lower(h))) AS h FROM tagged), y AS (SELECT id, unnest(h) AS tag FROM x) SELECT tag, count(*) AS n FROM y GROUP BY 1")
def entities_hashtags(spark, sf_dir):
    x = _tagged(spark, sf_dir).select(F.explode(t.hashtags(F.col("body"))).alias("tag"))
    return x.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("entities_mentions", rf"WITH {_TAGGED_SQL}, x AS (SELECT id, unnest(list_distinct(list_transform(regexp_extract_all(body, '@([A-Za-z0-9_.]{{2,40}})', 1), lambda h: lower(h)))) AS mention FROM tagged) SELECT mention, count(*) AS n FROM x GROUP BY 1")
def entities_mentions(spark, sf_dir):
    x = _tagged(spark, sf_dir).select(F.explode(t.mentions(F.col("body"))).alias("mention"))
    return x.groupBy("mention").agg(F.count(F.lit(1)).alias("n"))


@query("entities_domains", rf"""WITH {_TAGGED_SQL}, x AS (SELECT id, unnest(list_distinct(regexp_extract_all(body, 'https?://[^\s<>"'')]+'))) AS url FROM tagged UNION ALL SELECT page_id, url FROM pages) SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS domain, count(*) AS n FROM x GROUP BY 1 HAVING domain <> ''""")
def entities_domains(spark, sf_dir):
    x = _tagged(spark, sf_dir).select(F.explode(t.urls(F.col("body"))).alias("url")).unionByName(table(spark, sf_dir, "pages").select("url"))
    return x.groupBy(t.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n")).where("domain is not null")


@query("entities_proper_nouns", rf"""WITH x AS (SELECT doc_id AS id, list_slice(list_filter(list_reduce(list_prepend([]::VARCHAR[], list_transform(regexp_extract_all(text, '\b([A-Z][a-z]{{2,}}(?:\s+[A-Z][a-z]{{2,}}){{0,3}})\b', 1), lambda p: [p])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE a || b END), lambda p: NOT list_contains({_STOP_SQL}, lower(p))), 1, 12) AS p FROM documents) SELECT id, array_to_string(p, '|') AS nouns FROM x""")
def entities_proper_nouns(spark, sf_dir):
    return document_items(spark, sf_dir).select("id", F.array_join(t.proper_nouns(F.col("body")), "|").alias("nouns"))


_STRIP = r"regexp_replace(html, '<[^>]*>', ' ', 'gs')"
for _name, _to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _STRIP = f"replace({_STRIP}, '{_name}', '{_to}')"


@query("html_strip", rf"SELECT page_id, sha256(trim(regexp_replace({_STRIP}, '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS text_sha256 FROM pages")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(t.strip_html(F.col("html")), 256).alias("text_sha256"))


@query("keywords_top10", f"WITH x AS (SELECT doc_id AS id, unnest({_TOKENS.format('text')}) AS term FROM documents), c AS (SELECT id, term, count(*) AS n FROM x GROUP BY 1, 2) SELECT id, term, n, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, term) AS r FROM c) WHERE r <= 10")
def keywords_top10(spark, sf_dir):
    return t.top_words(document_items(spark, sf_dir), F.col("body")).select("id", "term", "n", "place")


_TFIDF_SQL = f"""WITH w AS (SELECT doc_id AS id, {_STEMS.format(_TITLE)} AS w FROM documents), k AS (SELECT * FROM w WHERE len(w) > 0),
u AS (SELECT id, len(w) AS l, unnest(w) AS term, 1.0::DOUBLE AS x FROM k UNION ALL SELECT id, len(w), unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 1.5::DOUBLE FROM k),
tf AS (SELECT id, term, sum(x) / max(l) AS tf FROM u GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
wt AS (SELECT id, term, df, tf * (ln(((SELECT count(*) FROM w) + 1) / (df + 1)) + 1) AS weight FROM tf JOIN df USING (term)),
top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) AS rank FROM wt),
vec AS (SELECT id, term, rank, df, weight / sqrt(sum(weight * weight) OVER (PARTITION BY id)) AS weight FROM top WHERE rank <= 14)"""


@query("tfidf_top_terms", _TFIDF_SQL + " SELECT id, count(*) AS terms, round(max(weight), 6) AS heaviest, CAST(sum(df) AS BIGINT) AS df FROM vec GROUP BY 1")
def tfidf_top_terms(spark, sf_dir):
    x = clusters.tfidf(document_items(spark, sf_dir))
    return x.groupBy("id").agg(F.count(F.lit(1)).alias("terms"), r6(F.max("weight")).alias("heaviest"), F.sum("df").alias("df"))


_OVERLAP_SQL = f"s AS (SELECT doc_id AS id, list_distinct({_STEMS.format(_TITLE)}) AS s FROM documents), pairs AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.s, y.s)) AS shared, len(x.s) + len(y.s) AS sizes FROM s x JOIN s y ON x.id < y.id AND 0.55 * greatest(len(x.s), len(y.s)) <= least(len(x.s), len(y.s)) + 1e-9 WHERE len(x.s) > 0 AND len(y.s) > 0), overlap AS (SELECT a, b, shared / (sizes - shared) AS jaccard FROM pairs WHERE shared / (sizes - shared) >= 0.55)"
_COSINE_SQL = "cosine AS (SELECT x.id AS a, y.id AS b, sum(x.weight * y.weight) AS similarity FROM vec x JOIN vec y ON x.term = y.term AND x.id < y.id GROUP BY 1, 2 HAVING sum(x.weight * y.weight) >= 0.34)"


@query("jaccard_pairs", f"WITH {_OVERLAP_SQL} SELECT a, b, round(jaccard, 6) AS jaccard FROM overlap")
def jaccard_pairs(spark, sf_dir):
    """All pairs of titles that share most of their words, copies among them."""
    return clusters.overlapping_pairs(clusters.stemmed(document_items(spark, sf_dir)), every=True).withColumn("jaccard", r6("jaccard"))


@query("topic_edges", f"{_TFIDF_SQL}, {_COSINE_SQL} SELECT a, b, round(similarity, 6) AS similarity FROM cosine")
def topic_edges(spark, sf_dir):
    """All pairs of titles whose vectors are close, copies among them."""
    members, texts = clusters.text_classes(document_items(spark, sf_dir))
    told = members.join(texts.where(F.size("w") > 0).select(F.col("id").alias("first")), "first", "left_semi")
    return clusters.every_pair(clusters.similar_pairs(clusters.weighted(texts)), told, "similarity").withColumn("similarity", r6("similarity"))


#: FNV-1a over the code units of a word, in steps modulo 2**64.
_FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(w) + 1), lambda i: unicode(substr(w, i, 1))::UHUGEINT)), lambda h, u: (xor(h, u) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


def _simhash_ctes(text: str) -> str:
    return f"""raw AS (SELECT doc_id AS id, {_TOKENS.format(text)} AS w FROM documents), uses AS (SELECT id, unnest(w) AS w FROM raw), counts AS (SELECT id, w, count(*) AS n FROM uses GROUP BY 1, 2),
hashes AS (SELECT w, {_FNV} AS h FROM (SELECT DISTINCT w FROM counts)), powers AS (SELECT i, (1::UHUGEINT << i::UHUGEINT) AS p FROM (SELECT unnest(range(64)) AS i)),
votes AS (SELECT id, i, sum(CASE WHEN (h // p) % 2::UHUGEINT = 1::UHUGEINT THEN n ELSE -n END) AS v FROM counts JOIN hashes USING (w), powers GROUP BY 1, 2),
sims AS (SELECT raw.id, CASE WHEN count(v) = 0 THEN repeat('0', 64) ELSE string_agg(CASE WHEN v > 0 THEN '1' ELSE '0' END, '' ORDER BY i DESC) END AS bits FROM raw LEFT JOIN votes USING (id) GROUP BY raw.id)"""


_SIMHASH_SQL = _simhash_ctes("text")


@query("simhash_documents", f"WITH {_SIMHASH_SQL} SELECT id, bits FROM sims")
def simhash_documents(spark, sf_dir):
    return clusters.simhashes(document_items(spark, sf_dir), "body").select("id", F.lpad(F.bin("simhash"), 64, "0").alias("bits"))


@query("reposts", f"WITH {_SIMHASH_SQL}, d AS (SELECT x.id AS a, y.id AS b, hamming(x.bits, y.bits) AS distance FROM sims x JOIN sims y ON x.id < y.id WHERE contains(x.bits, '1') AND contains(y.bits, '1') AND hamming(x.bits, y.bits) <= 6), c AS (SELECT bits, min(id) AS f FROM sims GROUP BY bits) SELECT a, b, distance FROM d JOIN sims x ON x.id = a JOIN c ON c.bits = x.bits JOIN sims y ON y.id = b JOIN c c2 ON c2.bits = y.bits WHERE c.f = a AND (distance = 0 OR c2.f = b)")
def reposts(spark, sf_dir):
    x = clusters.simhashes(document_items(spark, sf_dir), "body")
    return clusters.reposts(x).select("a", "b", F.col("distance").cast("long").alias("distance"))


#: Smallest reachable id over undirected edges, for every item.
_REACH = "WITH RECURSIVE {0}, both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, root FROM reach JOIN both_ways ON a = reach.id WHERE root < b), topics AS (SELECT id, min(root) AS component FROM reach GROUP BY id)"
_LINKS_SQL = "links AS (SELECT a, b FROM cosine UNION SELECT a, b FROM overlap UNION SELECT x.id, y.id FROM sims x JOIN sims y ON x.id < y.id JOIN s p ON p.id = x.id JOIN s q ON q.id = y.id WHERE contains(x.bits, '1') AND contains(y.bits, '1') AND hamming(x.bits, y.bits) <= 6 AND list_has_any(p.s, q.s))"
_TOPICS_SQL = _REACH.format(", ".join([_TFIDF_SQL.removeprefix("WITH "), _COSINE_SQL, _OVERLAP_SQL, _simhash_ctes(_TITLE), _LINKS_SQL]))


@query("cluster_scalable", _TOPICS_SQL + " SELECT id, component FROM topics")
def cluster_scalable(spark, sf_dir):
    return clusters.topics(document_items(spark, sf_dir))


def _topic_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_items(spark, sf_dir)
    rows = docs.select("id", "source", "lang", (F.col("id") % 100).cast("double").alias("score"), (NOW - (F.col("id") % 50) * 600).alias("seen_at"))
    return clusters.topics(docs).join(rows, "id")


_MEMBERS_SQL = _TOPICS_SQL + f", members AS (SELECT t.id, component, source, lang, (t.id % 100)::DOUBLE AS score, {NOW} - (t.id % 50) * 600 AS seen_at FROM topics t JOIN documents d ON d.doc_id = t.id)"


@query("cluster_summary", _MEMBERS_SQL + f", x AS (SELECT component, count(*) AS items, count(DISTINCT source) AS sources, max(score) AS best, count(*) FILTER ({NOW} - seen_at <= 3600) AS velocity, count(*) FILTER ({NOW} - seen_at > 3600 AND {NOW} - seen_at <= 7200) AS earlier FROM members GROUP BY 1) SELECT component, items, sources, velocity, velocity - earlier AS acceleration, round(least(100.0, 0.62 * best + 100 * (0.24 * least(1.0, (sources - 1) / 3) + 0.14 * least(1.0, ln(1 + items) / ln(13)))), 6) AS score, round(least(1.0, 0.35 + 0.2 * sources + 0.02 * items), 6) AS confidence FROM x")
def cluster_summary(spark, sf_dir):
    x = clusters.topic_summary(_topic_members(spark, sf_dir), NOW)
    return x.select("component", "items", "sources", "velocity", "acceleration", r6("score").alias("score"), r6("confidence").alias("confidence"))


@query("cluster_languages", _MEMBERS_SQL + " SELECT component, lang AS code, count(*) AS n, CAST(floor(count(*) / sum(count(*)) OVER (PARTITION BY component) * 100 + 0.5) AS INT) AS pct FROM members WHERE lang IS NOT NULL GROUP BY 1, 2")
def cluster_languages(spark, sf_dir):
    x = clusters.distribution(_topic_members(spark, sf_dir), "lang")
    return x.withColumnRenamed("lang", "code")


@query("stem_tokens", f"WITH x AS (SELECT unnest({_STEMS.format('text')}) AS stem FROM documents) SELECT stem, count(*) AS n FROM x GROUP BY 1")
def stem_tokens(spark, sf_dir):
    words = t.content_words(document_items(spark, sf_dir), F.col("body")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return words.groupBy(t.stem(F.col("term")).alias("stem")).agg(F.sum("n").alias("n"))


@query("csv_field_guard", """SELECT doc_id AS id, CASE WHEN regexp_matches(s, '[",\\r\\n]') THEN '"' || replace(s, '"', '""') || '"' ELSE s END AS field FROM (SELECT doc_id, CASE WHEN regexp_matches(x, '^[=+@\\t\\r-]') THEN '''' || x ELSE x END AS s FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '=' ELSE '' END || """ + _TITLE + """ AS x FROM documents))""")
def csv_field_guard(spark, sf_dir):
    x = F.concat(F.when(F.col("id") % 5 == 0, "=").otherwise(""), F.col("title"))
    return document_items(spark, sf_dir).select("id", t.csv_field(x).alias("field"))


@query("export_columns", f"WITH {SCORED_SQL} SELECT id, source, CAST(author AS VARCHAR) AS author, state, floor(score * 10 + 0.5) / 10 AS score, floor(confidence * 100 + 0.5) / 100 AS confidence, floor(popularity * 1000 + 0.5) / 10 AS platform_rank, strftime(make_timestamp(first_ts * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS first_seen, strftime(make_timestamp(last_ts * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS last_seen FROM scored")
def export_columns(spark, sf_dir):
    return ranking.export_rows(scored(spark, sf_dir))


# ── tables ───────────────────────────────────────────────────────────────────


@query("upsert_merge_coalesce", f"WITH {EVENTS_SQL} SELECT author, max_by(source, t * 1000000 + event_id) AS last_source, min_by(source, t * 1000000 + event_id) AS first_source, max_by(k, t * 1000000 + event_id) FILTER (k IS NOT NULL AND k % 2 = 0) AS newest_even, max(value) AS best FROM ev GROUP BY author")
def upsert_merge_coalesce(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("last_source", F.col("source")).withColumn("first_source", F.col("source"))
    e = e.withColumn("newest_even", F.when(F.col("k") % 2 == 0, F.col("k"))).withColumn("best", F.col("value"))
    rules = {"last_source": "last", "first_source": "first", "newest_even": "newest", "best": "max"}
    return tables.merged(e, ["author"], "t", rules, ties=["event_id"])


@query("retention_filter", f"WITH {EVENTS_SQL} SELECT event_id FROM ev WHERE t >= {NOW - 14 * 86400}")
def retention_filter(spark, sf_dir):
    return tables.retained(events(spark, sf_dir), NOW, 14, "t").select("event_id")


@query("minute_bucket_dedup", f"WITH {EVENTS_SQL} SELECT author AS id, t - t % 60 AS minute, max_by(value, t * 1000000 + event_id) AS value FROM ev GROUP BY 1, 2")
def minute_bucket_dedup(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("id", F.col("author")).withColumn("minute", F.col("t") - F.col("t") % 60)
    return tables.merged(e, ["id", "minute"], "t", {"value": "newest"}, ties=["event_id"])


# ── streaming ────────────────────────────────────────────────────────────────


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_hourly_rollup", f"WITH {EVENTS_SQL} SELECT t - t % 3600 AS hour, source AS event_type, count(*) AS n, round(sum(value), 6) AS total FROM ev GROUP BY 1, 2")
def stream_hourly_rollup(spark, sf_dir):
    from tidemark.streaming import stateful

    out = stateful.drained(spark, stateful.hourly_rollup(_stream(spark, sf_dir)), "complete", ["hour", "event_type"])
    return out.withColumn("total", r6("total"))


@query("stream_peak_state", f"WITH {EVENTS_SQL} SELECT author, max(value) AS peak, min_by(t, t) FILTER (value = top) AS peak_at, count(*) AS observations FROM (SELECT *, max(value) OVER (PARTITION BY author) AS top FROM ev) WHERE value IS NOT NULL GROUP BY author")
def stream_peak_state(spark, sf_dir):
    from tidemark.streaming import stateful

    s = _stream(spark, sf_dir).select(F.col("user_id").alias("author"), "value", F.unix_seconds("ts").alias("t"))
    return stateful.drained(spark, stateful.peaks(s), "update", ["author"], "observations").select("author", "peak", "peak_at", "observations")


@query("stream_dedup", "SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, sf_dir):
    from tidemark.streaming import stateful

    twice = _stream(spark, sf_dir)
    both = twice.select("event_id", "ts").union(twice.select("event_id", "ts"))
    return stateful.drained(spark, stateful.deduplicated(both), "append", ["event_id"]).select("event_id")


import tidemark.plans.reads  # noqa: E402, F401  registers its queries here
import tidemark.plans.search_queries  # noqa: E402, F401
import tidemark.plans.topic_queries  # noqa: E402, F401
import tidemark.plans.upkeep_queries  # noqa: E402, F401
