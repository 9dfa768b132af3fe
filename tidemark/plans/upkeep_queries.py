"""Stored tables: upserts, rebuilds, retention and rolling baselines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import mathx as m
from tidemark.model import EVENTS_SQL, NOW, document_items, event_snapshots, events
from tidemark.operators import enrichment, retention, rolling, series
from tidemark.operators import tables as upkeep
from tidemark.plans.catalog import _simhash_ctes, _stream, _TITLE, _TOKENS, query, r6
from tidemark.plans.oracle import SCORED_SQL, _percentile
from tidemark.sources import stored, tail
from tidemark.sources.tables import shared_folder
from tidemark.streaming import digest, lifecycle, stateful


def stored_table(spark: SparkSession, name: str, part: str) -> stored.StoredTable:
    return stored.StoredTable(spark, f"{shared_folder(spark)}/stored-{name}-{uuid.uuid4().hex[:8]}", part)


# ── items ────────────────────────────────────────────────────────────────────

#: Each document arrives up to three times, at changing times and with changing gaps.
_ARRIVALS_SQL = f"""arrivals AS (SELECT doc_id AS id, k, source || k AS title, {NOW} - doc_id * 60 + k * 1000 AS last_seen_at, CASE WHEN (doc_id + k) % 3 <> 0 THEN 'body' || k END AS body,
  CASE WHEN (doc_id + k) % 2 = 0 THEN lang || k END AS lang, CASE WHEN k > 0 THEN {NOW} - doc_id - k END AS published_at, 'kind' || (doc_id + k) % 5 AS content_type FROM documents, range(3) r(k) WHERE (doc_id + k) % 4 <> 0)"""


def _arrivals(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    i = F.col("id")
    rows = document_items(spark, sf_dir).where((i + k) % 4 != 0)
    seen = NOW - i * 60 + k * 1000
    return rows.select("id", F.concat("source", F.lit(str(k))).alias("title"), seen.alias("last_seen_at"), F.when((i + k) % 3 != 0, f"body{k}").alias("body"), F.when((i + k) % 2 == 0, F.concat("lang", F.lit(str(k)))).alias("lang"), F.when(F.lit(k > 0), NOW - i - k).alias("published_at"), F.concat(F.lit("kind"), ((i + k) % 5).cast("string")).alias("content_type"), seen.alias("first_seen_at"))


@query("stored_upserts", f"WITH {_ARRIVALS_SQL} SELECT id, max_by(title, k) AS title, max_by(last_seen_at, k) AS last_seen_at, max_by(body, k) FILTER (body IS NOT NULL) AS body, min_by(lang, k) FILTER (lang IS NOT NULL) AS lang, min_by(published_at, k) FILTER (published_at IS NOT NULL) AS published_at, min_by(content_type, k) AS content_type, min_by(last_seen_at, k) AS first_seen_at FROM arrivals GROUP BY id")
def stored_upserts(spark, sf_dir):
    """Three arrivals merged into a stored table of items by the rules of its columns."""
    table = stored_table(spark, "items", stored.buckets(["id"], 8))
    for k in range(3):
        rows = _arrivals(spark, sf_dir, k)
        rules = {c: upkeep.CONTENT_RULES[c] for c in rows.columns if c != "id"}
        table.upsert(rows, stored.merged_by(["id"], rules, "last_seen_at"), tag=("arrivals", k))
        table.upsert(rows, stored.merged_by(["id"], rules, "last_seen_at"), tag=("arrivals", k))  # sent again
    return table.read()


@query("stored_rebuild", "WITH a AS (SELECT doc_id AS id, lang AS label FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id AS id, CASE WHEN doc_id % 16 = 0 THEN 'renamed' ELSE lang END AS label FROM documents WHERE doc_id % 3 <> 1) SELECT id, coalesce(b.label, a.label) AS label, CASE WHEN a.id IS NULL THEN 'inserted' WHEN b.id IS NULL THEN 'deleted' ELSE 'updated' END AS change FROM a FULL JOIN b USING (id) WHERE a.id IS NULL OR b.id IS NULL OR a.label <> b.label")
def stored_rebuild(spark, sf_dir):
    """What changed between two versions of a table that is rebuilt whole, read from both."""
    table = stored_table(spark, "topics", stored.buckets(["id"], 8))
    docs = document_items(spark, sf_dir).select("id", F.col("lang").alias("label"))
    first, _ = table.replace(docs.where("id % 3 <> 0"))
    second, _ = table.replace(docs.where("id % 3 <> 1").withColumn("label", F.when(F.col("id") % 16 == 0, "renamed").otherwise(F.col("label"))))
    old, new = table.read(first.number).withColumnRenamed("label", "was"), table.read(second.number).withColumnRenamed("label", "now")
    both = old.withColumn("had", F.lit(True)).join(new.withColumn("has", F.lit(True)), "id", "full")
    change = F.when(F.col("had").isNull(), "inserted").when(F.col("has").isNull(), "deleted").when(F.col("was") != F.col("now"), "updated")
    return both.select("id", F.coalesce("now", "was").alias("label"), change.alias("change")).where("change is not null")


# ── retention ────────────────────────────────────────────────────────────────

_KEEP = {"metrics": 10.0, "events": 20.0, "keywords": 2.5}
_SWEEP_SQL = f"""WITH {EVENTS_SQL}, items AS (SELECT source || ':' || author AS id, max(t) AS seen FROM ev GROUP BY 1), doomed AS (SELECT id FROM items WHERE seen < {NOW - 10 * 86400} ORDER BY seen, id LIMIT 400),
gone AS (SELECT 'items' AS name, (SELECT count(*) FROM doomed) AS gone, (SELECT count(*) FROM items) AS total UNION ALL SELECT 'events', count(*) FILTER (t < {NOW - 20 * 86400}), count(*) FROM ev UNION ALL SELECT 'keywords', count(*) FILTER (t < {NOW - 216000}), count(*) FROM ev
UNION ALL SELECT 'metrics', count(*) FILTER (t < {NOW - 10 * 86400}), count(*) FROM ev UNION ALL SELECT 'scores', count(*) FILTER (source || ':' || author IN (SELECT id FROM doomed)), count(*) FROM ev WHERE event_id % 3 = 0)"""


@query("retention_sweep", _SWEEP_SQL + " SELECT name, gone, total - gone AS kept FROM gone")
def retention_sweep(spark, sf_dir):
    """Rows that one sweep takes from five stored tables, and those that they hold after it."""
    e = events(spark, sf_dir).withColumn("id", F.concat_ws(":", "source", F.col("author").cast("string")))
    items = stored_table(spark, "items", stored.buckets(["id"], 8))
    items.put(e.groupBy("id").agg(F.max("t").alias("last_seen_at")))
    dated = {name: stored_table(spark, name, stored.days("t")) for name in _KEEP}
    for table in dated.values():
        table.put(e.select("event_id", "id", "t", "value"))
    scores = stored_table(spark, "scores", stored.buckets(["id"], 8))
    scores.put(e.where("event_id % 3 = 0").select("event_id", "id", "value"))
    swept = retention.sweep(items, NOW, 10, {name: (table, "t", _KEEP[name]) for name, table in dated.items()}, {"scores": (scores, "id"), "metrics": (dated["metrics"], "id")}, limit=400)
    held = [table.read().agg(F.lit(name).alias("name"), F.lit(swept.rows[name]).cast("long").alias("gone"), F.count(F.lit(1)).alias("kept")) for name, table in {**dated, "scores": scores, "items": items}.items()]
    out = held[0]
    for more in held[1:]:
        out = out.unionByName(more)
    return out


# ── baselines ────────────────────────────────────────────────────────────────

_ROLLING_SQL = f"""samples AS (SELECT source, t // 3600 % 24 AS hour, value, k::DOUBLE AS velocity FROM ev WHERE t >= {NOW - 7 * 86400}),
each AS (SELECT source, hour, 'value' AS metric, value AS x FROM samples UNION ALL SELECT source, hour, 'velocity', velocity FROM samples),
labelled AS (SELECT source, metric, 'all' AS bucket, x FROM each UNION ALL SELECT source, metric, printf('h%02d', hour), x FROM each),
saved AS (SELECT source, metric, bucket, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.9) AS p90, quantile_cont(x, 0.99) AS p99, mad(x) AS mad, count(x) AS sample_count FROM labelled GROUP BY 1, 2, 3 HAVING bucket = 'all' OR count(*) >= 20)"""


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines after two passes: one two days ago, and one now that takes in the last days."""
    samples = events(spark, sf_dir).select("source", F.col("t").alias("first_seen_at"), F.col("k").alias("velocity"), "value", "event_id")
    states, saved = stored_table(spark, "states", "day"), stored_table(spark, "baselines", stored.buckets(["source", "metric", "bucket"], 4))
    earlier = NOW - 2 * 86400
    # the pass before saw half of its last day's items
    rolling.rebuilt(samples.where(F.col("first_seen_at") < earlier - 43200), states, saved, earlier)
    saved.delete(lambda rows: rows.where("false"))
    return rolling.rebuilt(samples.where(F.col("first_seen_at") >= earlier - 86400), states, saved, NOW)


@query("rolling_baselines", f"WITH {EVENTS_SQL}, {_ROLLING_SQL} SELECT source, metric, bucket, round(p50, 6) AS p50, round(p75, 6) AS p75, round(p90, 6) AS p90, round(p99, 6) AS p99, round(mad, 6) AS mad, sample_count FROM saved")
def rolling_baselines(spark, sf_dir):
    rows = _saved(spark, sf_dir)
    return rows.select("source", "metric", "bucket", *[r6(c).alias(c) for c in ("p50", "p75", "p90", "p99", "mad")], "sample_count")


@query("rolling_percentiles", f"WITH {SCORED_SQL}, {_ROLLING_SQL}, looked AS (SELECT x.id, x.value, coalesce(h.sample_count, a.sample_count) AS vn, " + ", ".join(f"CASE WHEN h.source IS NULL THEN a.p{p} ELSE h.p{p} END AS v{p}" for p in (50, 75, 90, 99)) + f" FROM shapes x LEFT JOIN saved a ON a.source = x.source AND a.metric = 'value' AND a.bucket = 'all' LEFT JOIN saved h ON h.source = x.source AND h.metric = 'value' AND h.bucket = printf('h%02d', x.first_ts // 3600 % 24) AND h.sample_count >= 20) SELECT id, vn AS samples, round({_percentile('value', 'v')}, 6) AS popularity FROM looked")
def rolling_percentiles(spark, sf_dir):
    """Items against the baseline of their hour, or of all hours where it is thin."""
    shapes = series.shape(event_snapshots(spark, sf_dir), NOW, keep=["source"])
    x = rolling.looked_up(shapes, _saved(spark, sf_dir))
    return x.select("id", F.col("vq.n").alias("samples"), r6(m.percentile_from_quantiles(F.col("value").cast("double"), F.col("vq"))).alias("popularity"))


# ── digests ──────────────────────────────────────────────────────────────────

_TYPES = {"click": "viral", "purchase": "breakout", "error": "intervention"}
_DIGEST_ITEMS_SQL = "items AS (SELECT source || ':' || author AS id, (min(author) * 13 % 100)::DOUBLE AS score, min(author) % 10 / 10.0 AS confidence, CASE min(author) % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' END AS lang FROM ev GROUP BY 1)"
_KIND_SQL = "CASE source " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items()) + " END"


@query("pending_digest", f"""WITH {EVENTS_SQL}, {_DIGEST_ITEMS_SQL}, size AS (SELECT count(*) // 3 + 1 AS n FROM ev), log AS (SELECT event_id, source || ':' || author AS ref, {_KIND_SQL} AS kind, (row_number() OVER (ORDER BY event_id) - 1) // n AS batch FROM ev, size),
told AS (SELECT batch, event_id, kind, NULL::DOUBLE AS score FROM log WHERE kind = 'intervention' UNION ALL SELECT batch, min(event_id), first(kind ORDER BY event_id), any_value(score) FROM log JOIN items ON items.id = ref WHERE kind IN ('viral', 'breakout') AND score >= 20 AND confidence >= 0.2 AND (lang IS NULL OR lang IN ('en', 'fr')) GROUP BY batch, ref)
SELECT batch, place, event_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY coalesce(score, 0) DESC, event_id) AS place FROM told) WHERE place <= 15""")
def pending_digest(spark, sf_dir):
    """What a consumer tells of the whole log in three batches, after a night on which it holds
    the first."""
    e = events(spark, sf_dir).withColumn("id", F.concat_ws(":", "source", F.col("author").cast("string")))
    lang = F.when(F.col("author") % 4 == 0, "en").when(F.col("author") % 4 == 1, "fr").when(F.col("author") % 4 == 2, "de")
    items = e.groupBy("id").agg(F.min("author").alias("author")).select("id", (F.col("author") * 13 % 100).cast("double").alias("score"), (F.col("author") % 10 / 10).alias("confidence"), lang.alias("lang"))
    # a log's numbers begin with 1
    log = e.select((F.col("event_id") + 1).alias("event_id"), "t", F.col("source").alias("type"), "source", F.col("id").alias("ref_id"))
    wanted = digest.Wanted(types=_TYPES, least_score=20.0, least_confidence=0.2, languages=("en", "fr"), most=15, batch=e.count() // 3 + 1, quiet=(22, 7))
    consumer = digest.Digest(stored_table(spark, "cursor", "0"), "mail", wanted)
    told: list[tuple] = []

    def mail(rows, batch):
        told.extend((batch, place, r["event_id"] - 1, r["kind"]) for place, r in enumerate(rows, 1))

    for hour in (23, 32, 33, 34, 35):
        consumer.dispatch(log, items, NOW + hour * 3600, {"mail": mail})
    return spark.createDataFrame(told, "batch long, place long, event_id long, kind string")


# ── enrichment ───────────────────────────────────────────────────────────────

_BOTH = f"{_TITLE} || chr(10) || text"
_KEYWORDS_SQL = f"k AS (SELECT id, string_agg(term, '|' ORDER BY place) AS keywords FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY n DESC, term) AS place FROM (SELECT id, term, count(*) AS n FROM (SELECT doc_id AS id, unnest({_TOKENS.format(_BOTH)}) AS term FROM documents) GROUP BY 1, 2)) WHERE place <= 10 GROUP BY id)"


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as their sources give them: every sixth with a country, some with tags."""
    i = F.col("id")
    docs = document_items(spark, sf_dir).select("id", "title", "body")
    stated = F.when(i % 6 == 0, F.lit("CH"))
    tags = F.when(i % 4 == 0, F.array(F.concat(F.lit("tag"), (i % 9).cast("string")), F.lit("same"), F.lit("same")))
    return docs.select("*", tags.alias("tags"), stated.alias("stated_country"), F.when(i % 6 == 0, 0.9).alias("stated_confidence"), F.when(i % 6 == 0, "platform").alias("stated_source"))


@query("item_fields", f"WITH {_simhash_ctes(_BOTH)}, {_KEYWORDS_SQL}, h AS (SELECT doc_id AS id, list_slice(list_distinct_ordered, 1, 15) AS tags FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN ['tag' || doc_id % 9, 'same'] ELSE [] END AS list_distinct_ordered FROM documents)) SELECT sims.id, bits, coalesce(keywords, '') AS keywords, array_to_string(tags, '|') AS hashtags, CASE WHEN sims.id % 6 = 0 THEN 'CH' END AS country, CASE WHEN sims.id % 6 = 0 THEN 'platform' END AS country_source FROM sims JOIN h USING (id) LEFT JOIN k USING (id)")
def item_fields(spark, sf_dir):
    """All that an item gets from its text but the language, which has a query of its own; no
    language of these texts is one country's."""
    x = enrichment.enriched(_incoming(spark, sf_dir))
    return x.select("id", F.lpad(F.bin("simhash"), 64, "0").alias("bits"), F.array_join("keywords", "|").alias("keywords"), F.array_join("hashtags", "|").alias("hashtags"), "country", "country_source")


@query("reenriched_items", f"WITH {_KEYWORDS_SQL} SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'as stored' ELSE coalesce(keywords, '') END AS keywords, CASE WHEN doc_id % 6 = 0 THEN 'CH' WHEN doc_id % 3 = 0 THEN 'XX' END AS country FROM documents LEFT JOIN k ON k.id = doc_id")
def reenriched_items(spark, sf_dir):
    """A sweep over stored items: those of older rules are worked out again, a country that the
    source stated stays, one that was read off the language does not."""
    stored_items = stored_table(spark, "enriched", stored.buckets(["id"], 8))
    rows = enrichment.enriched(_incoming(spark, sf_dir)).withColumn("keywords", F.array(F.lit("as stored")))
    rows = rows.withColumn("country_source", F.coalesce("country_source", F.lit(enrichment.BY_LANGUAGE))).withColumn("country", F.coalesce("country", F.lit("XX")))
    rows = rows.withColumn("digest", enrichment.digest()).withColumn("rules", F.when(F.col("id") % 3 == 0, enrichment.RULES).otherwise(0))
    stored_items.put(rows.drop("stated_country", "stated_confidence", "stated_source"))
    enrichment.reenriched(stored_items)
    return stored_items.read().select("id", F.array_join("keywords", "|").alias("keywords"), "country")


# ── streams ──────────────────────────────────────────────────────────────────

_HOT, _IDLE = 90.0, 3 * 86400
_LIVES_SQL = f"""rows AS (SELECT author::VARCHAR AS key, t, value FROM ev WHERE value IS NOT NULL),
gaps AS (SELECT *, row_number() OVER w AS r, CASE WHEN t - lag(t) OVER w > {_IDLE} THEN 1 ELSE 0 END AS cut FROM rows WINDOW w AS (PARTITION BY key ORDER BY t, value DESC)),
lives AS (SELECT *, sum(cut) OVER (PARTITION BY key ORDER BY r) AS life FROM gaps),
high AS (SELECT *, max(value) OVER (PARTITION BY key, life ORDER BY r) AS peak FROM lives),
level AS (SELECT *, CASE WHEN value >= {_HOT} THEN 'HOT' WHEN peak >= {_HOT} AND value <= 0.6 * peak THEN 'PEAK' END AS l FROM high),
held AS (SELECT *, coalesce(last_value(l IGNORE NULLS) OVER (PARTITION BY key, life ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'NEW') AS h FROM level),
said AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY key, life ORDER BY r), 'NEW') AS before FROM held),
firsts AS (SELECT key, life, value AS peak, min(t) AS peak_at FROM lives GROUP BY 1, 2, 3),
ends AS (SELECT key, life, max(t) AS last, max(value) AS peak, max(life) OVER (PARTITION BY key) AS newest FROM lives GROUP BY key, life),
changes AS (SELECT key, t, h AS level, value, peak, life FROM said WHERE h <> before UNION ALL SELECT key, last + {_IDLE}, 'EXPIRED', NULL, peak, life FROM ends WHERE life < newest OR last + {_IDLE} <= (SELECT max(t) FROM ev) - 3600)"""


@query("stream_lifecycle", f"WITH {EVENTS_SQL}, {_LIVES_SQL} SELECT key, t, level, value, peak, peak_at FROM changes JOIN firsts USING (key, life, peak)")
def stream_lifecycle(spark, sf_dir):
    """Changes of level of every author, each told once, and the ends of silent ones."""
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", lifecycle.PROVIDER)
    try:
        stream = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), "ts", "value")
        out = stateful.drained(spark, lifecycle.lifecycles(stream, _HOT, idle=_IDLE), "append", ["key"])
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    return out.select("key", "t", "level", "value", "peak", "peak_at")


# ── growing files ────────────────────────────────────────────────────────────


@query("tailed_records", f"WITH {EVENTS_SQL} SELECT event_id, source, event_id % 97 = 0 AS broken FROM ev")
def tailed_records(spark, sf_dir):
    """Events written as JSON lines, some cut short, and read back; broken ones lie aside."""
    spark.dataSource.register(tail.TailSource)
    root = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex[:8]}"
    whole = F.to_json(F.struct("event_id", "source", "value"))
    line = F.when(F.col("event_id") % 97 == 0, F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"source":"'), F.col("source"))).otherwise(whole)
    events(spark, sf_dir).select(line.alias("value")).write.text(root)
    at = root if "://" in root else f"file://{root}"
    read = spark.read.format("tidemark_tail").options(path=at, splitBytes=str(1 << 16)).load()
    event = F.regexp_extract("record", r'"event_id":(\d+)', 1).cast("long")
    source = F.regexp_extract("record", r'"source":"(\w+)', 1)
    return read.select(event.alias("event_id"), source.alias("source"), F.col("problem").isNotNull().alias("broken"))
