"""Topics by strongest-first assignment, in rounds over all items at once.

Taken one by one, strongest first, an item joins the topic that is most similar to it, or leads a
new one if none reaches the threshold.  Here an item waits only for stronger items that are
similar to it.  In every round, the items that wait for nobody any more, or are similar to a
leader, look at the topics of their stronger neighbours:

- similarity to a topic is the largest of the cosine with the topic's mean vector as it is after
  the round before, and of the firm links (word overlap, SimHash) to its members;
- an item joins the best topic that reaches the threshold, the one of the smallest leader among
  equals; if none does and nobody is left to wait for, it leads.

Each round the strongest undecided item is decided, so rounds end; a set of items all alike
takes two rounds, whatever its size.  Against the sequential pass, a mean holds the members of
earlier rounds rather than the stronger members, it is the plain mean of all its members, and a
topic is a candidate only through a similar member.  Items that are exact copies are one node.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import clusters
from tidemark.sources.tables import shared_folder, written

#: Rows that are so few that they are sent to every task.
FEW = 100_000

#: Similarity that a near-identical text has to its like, however thin its wording.
DUPLICATE = 0.95


def firm_links(texts: DataFrame, item: str = "id") -> DataFrame:
    """(a, b, firm) of (item, w, simhash): overlapping words, or SimHashes a few bits apart of
    texts that share a word."""
    overlap = clusters.overlapping_pairs(texts, item=item).select("a", "b", F.col("jaccard").alias("firm"))
    near = clusters.sharing(clusters.reposts(texts, item=item), texts, item).select("a", "b", F.lit(DUPLICATE).alias("firm"))
    return overlap.unionByName(near)


def elected(nodes: DataFrame, vectors: DataFrame, links: DataFrame, threshold: float = clusters.THRESHOLD, item: str = "id") -> DataFrame:
    """(item, leader, similarity) for every node.

    ``nodes`` is (item, score, copies), ``vectors`` (item, term, weight) of length 1, and
    ``links`` (a, b, firm) the pairs that are similar at all, ``firm`` null where only their
    cosine says so.  Tables are written between rounds; the driver sees whether rows are left.
    """
    run, spark = uuid.uuid4().hex[:8], nodes.sparkSession
    nodes = written(nodes.select(F.col(item).alias("item"), F.coalesce("score", F.lit(float("-inf"))).alias("score"), "copies"), f"nodes-{run}")
    # a node's vector is one row, and goes with the node when it is decided
    rows = vectors.groupBy(F.col(item).alias("item")).agg(F.collect_list(F.struct("term", "weight")).alias("v"))
    undecided = written(nodes.select("item", "copies").join(rows, "item", "left"), f"undecided-{run}-0")
    strength = lambda side: nodes.select(F.col("item").alias(side), F.col("score").alias(f"s_{side}"))
    both = links.groupBy("a", "b").agg(F.max("firm").alias("firm")).join(strength("a"), "a").join(strength("b"), "b")
    first = (F.col("s_a") > F.col("s_b")) | ((F.col("s_a") == F.col("s_b")) & (F.col("a") < F.col("b")))
    links = written(both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("up"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("down"), "firm"), f"links-{run}")
    alone = undecided.join(links.select(F.col("down").alias("item")), "item", "left_anti")
    made = written(alone.select("item", F.col("item").alias("leader"), F.lit(1.0).alias("similarity"), "copies", "v"), f"decided-{run}-0")
    shape, paths = made.schema, [f"{shared_folder(spark)}/decided-{run}-0"]
    # a link knows the leader of its upper node as soon as there is one
    led = lambda made: made.select(F.col("item").alias("up"), F.col("leader").alias("now"))
    waiting = written(links.join(led(made), "up", "left").withColumnRenamed("now", "leader"), f"waiting-{run}-0")
    here, turn, left = Window.partitionBy("down"), 0, waiting.count()
    held, live = left, list(paths)
    while left:
        turn += 1
        seen = waiting.withColumn("waits", F.count_if(F.col("leader").isNull()).over(here)).withColumn("led", F.max(F.coalesce(F.col("up") == F.col("leader"), F.lit(False))).over(here))
        asked = seen.where("(waits = 0 or led) and leader is not null").groupBy("down", "leader").agg(F.max("firm").alias("firm"), F.max("waits").alias("waits"))
        asked = written(asked, f"ready-{run}-{turn}")
        few = F.broadcast if asked.count() <= FEW else lambda df: df
        members = spark.read.schema(shape).parquet(*live).join(few(asked.select("leader").distinct()), "leader", "left_semi").select("leader", "copies", F.explode("v").alias("x"))
        means = members.groupBy("leader", F.col("x.term").alias("term")).agg(F.sum(F.col("x.weight") * F.col("copies")).alias("mean"))
        length = means.groupBy("leader").agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("length"))
        dots = undecided.select(F.col("item").alias("down"), "v").join(few(asked.select("down", "leader")), "down").select("down", "leader", F.explode("v").alias("x"))
        dots = dots.select("down", "leader", "x.term", "x.weight").join(means, ["leader", "term"])
        cosine = dots.groupBy("down", "leader").agg(F.sum(F.col("weight") * F.col("mean")).alias("dot")).join(length, "leader").select("down", "leader", (F.col("dot") / F.col("length")).alias("cosine"))
        sims = asked.join(cosine, ["down", "leader"], "left").withColumn("similarity", F.greatest(F.coalesce("cosine", F.lit(0.0)), F.coalesce("firm", F.lit(0.0))))
        sims = sims.withColumn("similarity", F.round("similarity", 9))  # sums in another order are the same
        fits = F.when(F.col("similarity") >= threshold, F.struct((-F.col("similarity")).alias("m"), "leader"))
        made = sims.groupBy(F.col("down").alias("item")).agg(F.min(fits).alias("best"), F.max("waits").alias("waits")).where("best is not null or waits = 0")
        made = made.select("item", F.coalesce("best.leader", "item").alias("leader"), F.coalesce(-F.col("best.m"), F.lit(1.0)).alias("similarity"))
        made = written(made.join(undecided, "item").select(shape.names), f"decided-{run}-{turn}")
        few = F.broadcast if made.count() <= FEW else lambda df: df
        paths.append(f"{shared_folder(spark)}/decided-{run}-{turn}")
        live.append(paths[-1])
        rest = waiting.join(few(made.select(F.col("item").alias("down"))), "down", "left_anti").join(few(led(made)), "up", "left")
        waiting = written(rest.select("up", "down", "firm", F.coalesce("leader", "now").alias("leader")), f"waiting-{run}-{turn}")
        left = waiting.count()
        if 2 * left <= held:
            # who waits no more is not read again, nor are topics that nobody can join
            held = left
            undecided = written(undecided.join(waiting.select(F.col("down").alias("item")), "item", "left_semi"), f"undecided-{run}-{turn}")
            written(spark.read.schema(shape).parquet(*live).join(waiting.where("leader is not null").select("leader"), "leader", "left_semi").select(shape.names), f"topics-{run}-{turn}")
            live = [f"{shared_folder(spark)}/topics-{run}-{turn}"]
    return spark.read.schema(shape).parquet(*paths).select(F.col("item").alias(item), "leader", "similarity")


def led_topics(items: DataFrame, text: str = "title", item: str = "id", score: str = "score", threshold: float = clusters.THRESHOLD) -> DataFrame:
    """(item, leader, similarity) for every item of (item, text, score).

    The leader of a topic is the smallest id of its strongest text; items without words lead
    themselves, and a null score is the weakest.
    """
    members, texts = clusters.text_classes(items, text, item)
    strongest = items.select(item, score).join(members, item).groupBy("first").agg(F.max(score).alias("score"))
    nodes = texts.where(F.size("w") > 0).select(item, "copies").join(strongest.withColumnRenamed("first", item), item)
    vectors = written(clusters.weighted(texts, item), f"vectors-{uuid.uuid4().hex[:8]}")
    cosine = clusters.similar_pairs(vectors, threshold, item).select("a", "b", F.lit(None).cast("double").alias("firm"))
    found = elected(nodes, vectors, cosine.unionByName(firm_links(texts, item)), threshold, item)
    placed = members.join(found.withColumnRenamed(item, "first"), "first")
    return items.select(item).join(placed, item, "left").select(item, F.coalesce("leader", F.col(item)).alias("leader"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
