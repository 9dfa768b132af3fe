"""One pass over all that is observed: topics, then scores that know of them, then events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import clusters, scoring, topic_reads

# The events of a state that is entered.
EVENTS = {"VIRAL": "trend.detected", "HOT": "trend.detected", "PEAK": "trend.peaked"}


def analysed(items: DataFrame, snapshots: DataFrame, now: int, previous: DataFrame | None = None, saved: DataFrame | None = None, capabilities: DataFrame | None = None) -> DataFrame:
    """The scores of all observed items, with ``was`` and ``event``.

    ``items`` is (id, source, title): items of one topic count each other's sources, so a score
    always knows the topics of the same pass and none has to be mended afterwards.  ``previous``
    (id, state, peak) is the pass before: it carries the peaks, and an event is a state of
    ``EVENTS`` that the item was not in.  Items without a title are topics of their own.
    """
    # topics are numbered; items are called by name
    named = items.where(F.col("title").isNotNull()).select("id", "source", "title")
    members = clusters.topics(named).withColumnRenamed("component", "topic")
    sources = members.join(named, "id").groupBy("topic").agg(F.count_distinct("source").alias("sources"))
    crossed = topic_reads.cross_source(items.select("id"), members, sources)
    peaks = previous.select("id", "peak") if previous is not None else None
    out = scoring.scored(snapshots, now, peaks=peaks, saved=saved, crossed=crossed, capabilities=capabilities)
    was = previous.select("id", F.col("state").alias("was")) if previous is not None else out.select("id", F.lit(None).cast("string").alias("was"))
    out = out.join(was, "id", "left")
    event = F.create_map(*[F.lit(x) for pair in EVENTS.items() for x in pair])[F.col("state")]
    return out.withColumn("event", F.when(~F.col("was").eqNullSafe(F.col("state")), event))
