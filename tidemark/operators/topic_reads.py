"""Reads over topics: membership filters, orders, traces, states, cross-source counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import clusters, vectors

#: Orders of topics, each falling.
ORDERS = {"score": ("score",), "recent": ("last_seen_at",), "platforms": ("sources", "score"), "velocity": ("velocity", "score")}


def reaching(topics: DataFrame, memberships: DataFrame, items: DataFrame, wanted: Mapping[str, Sequence], topic: str = "topic", item: str = "id") -> DataFrame:
    """Topics with a member that has one of the wanted values, for every wanted column.

    One member may meet one column and another the next, as separate EXISTS tests would.
    """
    for column, values in wanted.items():
        fits = memberships.join(items.where(F.col(column).isin(*values)).select(item), item, "left_semi")
        topics = topics.join(fits, topic, "left_semi")
    return topics


def ordered(topics: DataFrame, order: str, limit: int, topic: str = "topic") -> DataFrame:
    return topics.orderBy(*[F.desc_nulls_last(c) for c in ORDERS[order]], topic).limit(limit)


def traces(topics: DataFrame, history: DataFrame, most: int = 6, points: int = 200, topic: str = "topic") -> DataFrame:
    """The first ``points`` observations of each of the strongest topics."""
    strongest = F.broadcast(ordered(topics, "score", most, topic).select(topic))  # ``most`` rows
    oldest = Window.partitionBy(topic).orderBy("ts")
    return history.join(strongest, topic).withColumn("place", F.row_number().over(oldest)).where(F.col("place") <= points)


def cross_source(items: DataFrame, memberships: DataFrame, topics: DataFrame, topic: str = "topic", item: str = "id") -> DataFrame:
    """(item, cross_source): the most sources of a topic that the item is in, 1 without any."""
    most = memberships.join(topics.select(topic, "sources"), topic).groupBy(item).agg(F.max("sources").alias("sources"))
    return items.select(item).join(most, item, "left").select(item, F.greatest(F.coalesce("sources", F.lit(1)), F.lit(1)).cast("long").alias("cross_source"))


def merged_topics(centres: DataFrame, strengths: DataFrame, threshold: float = clusters.SEMANTIC, topic: str = "component", vector: str = "c", score: str = "score") -> DataFrame:
    """(topic, merged): topics whose centroids' cosine reaches the threshold become one, and
    those that such pairs connect with them; it is called after its strongest topic (the
    smallest name among equals), which also keeps its keywords.  Topics without a centroid stay.
    """
    groups = clusters.components(vectors.similar_vectors(centres, threshold, topic, vector)).select(F.col("id").alias(topic), F.col("component").alias("group"))
    strength = F.struct(-F.coalesce(F.col(score), F.lit(float("-inf"))), F.col(topic))
    named = groups.join(strengths, topic).groupBy("group").agg(F.min_by(topic, strength).alias("merged"))
    merged = groups.join(named, "group").select(topic, "merged")
    return strengths.select(topic).join(merged, topic, "left").select(topic, F.coalesce("merged", topic).alias("merged"))


def contracted(members: DataFrame, merged: DataFrame, topic: str = "component") -> DataFrame:
    """Members under the names of the merged topics."""
    return members.join(merged, topic).drop(topic).withColumnRenamed("merged", topic)


def seed_match(hashtags: Column, title: Column, seed: str, least: int = 3) -> Column:
    """A tag that is the seed, or, for seeds of ``least`` code points, a title that holds it."""
    seed = seed.strip().lower().removeprefix("#")
    tagged = F.coalesce(F.array_contains(F.transform(hashtags, F.lower), seed), F.lit(False))
    return tagged | F.coalesce(F.lower(title).contains(seed), F.lit(False)) if len(seed) >= least else tagged


def section(rows: DataFrame, name: str, by: str, limit: int, key: str = "id") -> DataFrame:
    """(section, place, id, value): the rows with the highest ``by``, one section of a page."""
    best = rows.where(F.col(by).isNotNull()).orderBy(F.desc(by), key).limit(limit).select(F.col(key).alias("id"), F.col(by).cast("double").alias("value"))
    place = F.row_number().over(Window.orderBy(F.desc("value"), "id"))  # ``limit`` rows
    return best.select(F.lit(name).alias("section"), place.cast("long").alias("place"), "id", "value")
