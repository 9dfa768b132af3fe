"""Topics by strongest-first rounds, and topics merged by meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import mathx as m
from tidemark.model import EVENTS_SQL, NOW, document_items, event_snapshots, table
from tidemark.operators import analysis, clusters, gaps, leaders, topic_reads
from tidemark.plans.catalog import _STEMS, _TITLE, _TITLE_WORDS, _TOKENS, _TOPICS_SQL, query, r6
from tidemark.plans.oracle import SCORED_SQL


@query("leader_topics")
def leader_topics(spark, sf_dir):
    """Every document's topic and its similarity to it; a test replays the rounds."""
    docs = document_items(spark, sf_dir).withColumn("score", F.col("n_chars").cast("double"))
    return leaders.led_topics(docs).withColumn("similarity", F.round("similarity", 4))


@query("display_forms", f"WITH x AS (SELECT {_TOKENS.format(_TITLE)} AS raw, {_STEMS.format(_TITLE)} AS stems FROM documents), y AS (SELECT unnest(raw) AS form, unnest(stems) AS stem FROM x), c AS (SELECT stem, form, count(*) AS n FROM y GROUP BY 1, 2) SELECT stem, first(form ORDER BY n DESC, form) AS form FROM c GROUP BY stem")
def display_forms(spark, sf_dir):
    return clusters.display_forms(document_items(spark, sf_dir))


_NAMES_SQL = f"""{_TOPICS_SQL}, sizes AS (SELECT component, count(*) AS items FROM topics GROUP BY 1), means AS (SELECT component, term, round(sum(weight) / max(items), 9) AS w FROM vec JOIN topics USING (id) JOIN sizes USING (component) GROUP BY 1, 2),
best AS (SELECT component, term, place FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY w DESC, term) AS place FROM means) WHERE place <= 8),
raw_stems AS (SELECT unnest({_TOKENS.format(_TITLE)}) AS form, unnest({_STEMS.format(_TITLE)}) AS stem FROM documents), forms AS (SELECT stem, first(form ORDER BY n DESC, form) AS form FROM (SELECT stem, form, count(*) AS n FROM raw_stems GROUP BY 1, 2) GROUP BY stem),
parts AS (SELECT component, place, unnest(string_split(term, ' ')) AS stem, generate_subscripts(string_split(term, ' '), 1) AS i FROM best),
words AS (SELECT component, place, string_agg(coalesce(form, stem), ' ' ORDER BY i) AS k FROM parts LEFT JOIN forms USING (stem) GROUP BY 1, 2),
named AS (SELECT component, list(k ORDER BY place) AS keywords FROM words GROUP BY 1)"""


@query("topic_names", _NAMES_SQL + " SELECT component, array_to_string(keywords, '|') AS keywords, array_to_string(list_sort(list_transform(keywords[1:4], lambda k: replace(k, ' ', '_'))), '|') AS key FROM named")
def topic_names(spark, sf_dir):
    """Keywords of every topic, in words that people wrote, and the name that outlasts a pass."""
    named = clusters.named_topics(document_items(spark, sf_dir))
    return named.select("component", F.array_join("keywords", "|").alias("keywords"), "key")


#: Vectors that tell a story again: every third is an original, the others lie near it, and
#: topics of one or two stories.
_STORIES_SQL = f"""stories AS (SELECT a.vec_id AS id, CASE WHEN a.vec_id % 4 = 3 THEN a.vec_id - 1 ELSE a.vec_id END AS component, (a.vec_id * 37 % 101)::DOUBLE AS score, 's' || a.vec_id % 3 AS source, {NOW} - (a.vec_id % 50) * 600 AS seen_at,
  list_transform(list_zip(b.embedding, a.embedding), lambda p: p[1]::DOUBLE + (0.3 + 0.2 * (a.vec_id % 2)) * p[2]::DOUBLE) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 3)"""


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, component, score, source, seen_at, v): vectors of stories told up to three times."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    base = e.select(F.col("id").alias("base"), F.col("embedding").alias("original"))
    rows = e.withColumn("base", F.col("id") - F.col("id") % 3).join(base, "base")
    mixed = F.zip_with("original", "embedding", lambda o, x: o.cast("double") + (0.3 + 0.2 * (F.col("id") % 2)) * x.cast("double"))
    component = F.when(F.col("id") % 4 == 3, F.col("id") - 1).otherwise(F.col("id"))
    return rows.select("id", component.alias("component"), (F.col("id") * 37 % 101).cast("double").alias("score"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), (NOW - (F.col("id") % 50) * 600).alias("seen_at"), mixed.alias("v"))


_MERGED_SQL = f"""WITH RECURSIVE {_STORIES_SQL}, u AS (SELECT component, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM stories), s AS (SELECT component, i, sum(x) AS x FROM u GROUP BY 1, 2),
c AS (SELECT component, i, x / sqrt(sum(x * x) OVER (PARTITION BY component)) AS x FROM s), vecs AS (SELECT component, list(x ORDER BY i) AS x FROM c GROUP BY 1),
pairs AS (SELECT a.component AS a, b.component AS b FROM vecs a JOIN vecs b ON a.component <> b.component AND list_dot_product(a.x, b.x) >= 0.86),
reach(component, root) AS (SELECT component, component FROM vecs UNION SELECT b, root FROM reach JOIN pairs ON a = reach.component WHERE root < b), groups AS (SELECT component, min(root) AS g FROM reach GROUP BY 1),
strength AS (SELECT component, max(score) AS score FROM stories GROUP BY 1), named AS (SELECT g, first(component ORDER BY score DESC, component) AS merged FROM groups JOIN strength USING (component) GROUP BY g),
topics AS (SELECT component, merged FROM groups JOIN named USING (g))"""


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    told = stories(spark, sf_dir)
    strength = told.groupBy("component").agg(F.max("score").alias("score"))
    return told, topic_reads.merged_topics(clusters.centroids(told, "v"), strength)


@query("merged_topics", _MERGED_SQL + " SELECT component, merged FROM topics")
def merged_topics(spark, sf_dir):
    return _merged(spark, sf_dir)[1]


@query("merged_summary", _MERGED_SQL + f", x AS (SELECT merged, count(*) AS items, count(DISTINCT component) AS topics, count(DISTINCT source) AS sources, max(score) AS best, count(*) FILTER ({NOW} - seen_at <= 3600) AS velocity, count(*) FILTER ({NOW} - seen_at > 3600 AND {NOW} - seen_at <= 7200) AS earlier FROM stories JOIN topics USING (component) GROUP BY 1) SELECT merged AS component, topics, items, sources, velocity, velocity - earlier AS acceleration, round(least(100.0, 0.62 * best + 100 * (0.24 * least(1.0, (sources - 1) / 3) + 0.14 * least(1.0, ln(1 + items) / ln(13)))), 6) AS score, round(least(1.0, 0.35 + 0.2 * sources + 0.02 * items), 6) AS confidence FROM x")
def merged_summary(spark, sf_dir):
    told, merged = _merged(spark, sf_dir)
    counts = merged.groupBy(F.col("merged").alias("component")).agg(F.count(F.lit(1)).alias("topics"))
    out = clusters.topic_summary(topic_reads.contracted(told, merged), NOW).join(counts, "component")
    return out.withColumn("score", r6("score")).withColumn("confidence", r6("confidence"))


_GAP_ROWS_SQL = f"""{_STORIES_SQL}, rows AS (SELECT d.doc_id AS id, {_TITLE_WORDS} AS w, CASE WHEN d.doc_id % 40 <> 0 THEN v END AS v, n_chars % 100 AS score, d.doc_id % 7 AS countries FROM documents d LEFT JOIN stories s ON s.id = d.doc_id),
scaled AS (SELECT id, w, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v, score, countries FROM rows),
sims AS (SELECT t.id AS topic, i.id AS item, round(CASE WHEN t.v IS NOT NULL AND i.v IS NOT NULL THEN list_dot_product(t.v, i.v) WHEN len(t.w) = 0 THEN 0 ELSE len(list_intersect(t.w, i.w)) / len(t.w) * 0.7 END, 9) AS score FROM scaled t, scaled i WHERE t.id % 20 = 0 AND i.id % 20 <> 0),
best AS (SELECT topic, string_agg(item || ':' || printf('%.3f', round(score, 3)), '|' ORDER BY place) AS matches FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, item) AS place FROM sims WHERE score > 0) WHERE place <= 3 GROUP BY topic),
counts AS (SELECT topic, count(*) FILTER (score >= 0.7) AS covered FROM sims GROUP BY topic)"""


@query("gap_report", f"WITH {_GAP_ROWS_SQL} SELECT id AS topic, score, countries, covered, CASE WHEN covered = 0 THEN 'uncovered' WHEN covered < 3 THEN 'thin' ELSE 'covered' END AS verdict, v IS NOT NULL AS by_meaning, coalesce(matches, '') AS matches FROM scaled JOIN counts ON topic = id LEFT JOIN best USING (topic)")
def gap_report(spark, sf_dir):
    """Every twentieth document as a topic against all others: by meaning where both have a
    vector, by the words of their titles elsewhere."""
    docs = document_items(spark, sf_dir).select("id", "title", (F.col("n_chars") % 100).alias("score"), (F.col("id") % 7).alias("countries"))
    told = stories(spark, sf_dir).select("id", m.normalised(F.col("v")).alias("v"))
    rows = docs.join(told, "id", "left").withColumn("v", F.when(F.col("id") % 40 != 0, F.col("v")))
    out = gaps.gap_report(rows.where("id % 20 = 0"), rows.where("id % 20 <> 0"))
    listed = F.array_join(F.transform("matches", lambda x: F.format_string("%d:%.3f", x["item"], x["similarity"])), "|")
    return out.select("topic", "score", "countries", "covered", "verdict", "by_meaning", listed.alias("matches"))


# ── the whole pass ───────────────────────────────────────────────────────────

_CROSSED_SQL = f"""sources_seen AS (SELECT source, author, source || ':' || author AS name, dense_rank() OVER (ORDER BY author, source) AS n FROM (SELECT DISTINCT source, author FROM ev)),
written AS (SELECT doc_id AS author, text FROM documents), documents AS (SELECT n AS doc_id, text FROM sources_seen JOIN written USING (author) WHERE author % 3 <> 1 OR source IN ('click', 'view'))"""
_PASS_SQL = (
    f"WITH RECURSIVE {EVENTS_SQL}, {_CROSSED_SQL}, "
    + _TOPICS_SQL.removeprefix("WITH RECURSIVE ")
    + ", breadth AS (SELECT component, count(DISTINCT source) AS k FROM topics JOIN sources_seen ON n = id GROUP BY 1), crossed AS (SELECT name AS id, k FROM topics JOIN sources_seen ON n = topics.id JOIN breadth USING (component)), "
    + SCORED_SQL.removeprefix(EVENTS_SQL).lstrip(", \n").replace("1 + x.author % 4 AS cross_source", "coalesce(cs.k, 1) AS cross_source").replace("LEFT JOIN creator c ON c.id = x.id", "LEFT JOIN creator c ON c.id = x.id LEFT JOIN crossed cs ON cs.id = x.id")
)


@query("analysis_pass", _PASS_SQL + " SELECT scored.id, coalesce(k, 1) AS cross_source, round(score, 6) AS score, round(confidence, 6) AS confidence, state, CASE WHEN author % 4 = 0 AND state = 'HOT' THEN NULL WHEN state IN ('VIRAL', 'HOT') THEN 'trend.detected' WHEN state = 'PEAK' THEN 'trend.peaked' END AS event FROM scored LEFT JOIN crossed ON crossed.id = scored.id")
def analysis_pass(spark, sf_dir):
    """Topics over the titles of all observed items, scores that count their topics' sources, and
    the events of the pass; every fourth author's items were hot before."""
    snapshots = event_snapshots(spark, sf_dir)
    seen = snapshots.select("id", "source", "author").distinct()
    titles = document_items(spark, sf_dir).select(F.col("id").alias("author"), "title")
    items = seen.join(titles, "author", "left").withColumn("title", F.when((F.col("author") % 3 != 1) | F.col("source").isin("click", "view"), F.col("title")))
    before = seen.where("author % 4 = 0").select("id", F.lit("HOT").alias("state"), F.lit(None).cast("double").alias("peak"))
    out = analysis.analysed(items, snapshots, NOW, before)
    return out.select("id", "cross_source", r6("score").alias("score"), r6("confidence").alias("confidence"), "state", "event")
