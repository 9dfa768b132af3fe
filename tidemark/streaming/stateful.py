"""Structured Streaming forms of the stateful parts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import shared_folder


def hourly_rollup(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events per hour and type; late events count while the watermark lets them."""
    windowed = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    counted = windowed.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.unix_seconds("window.start").alias("hour"), "event_type", "n", "total")


def deduplicated(stream: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark: re-observed rows change nothing."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def peaks(stream: DataFrame) -> DataFrame:
    """High-water mark per author of (author, value, t), carried across micro-batches: strictly
    greater, or the same value seen earlier in event time."""
    best = F.min(F.struct((-F.col("value")).alias("m"), "t"))
    kept = stream.where("value is not null").groupBy("author").agg(best.alias("best"), F.count(F.lit(1)).alias("observations"))
    return kept.select("author", (-F.col("best.m")).alias("peak"), F.col("best.t").alias("peak_at"), "observations")


def drained(spark: SparkSession, result: DataFrame, mode: str, key: list[str], order: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its final rows: the newest per key.

    Batches go to Parquet below the shared folder, where a repeated batch replaces itself;
    nothing passes the driver.
    """
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={0 if mode == 'complete' else number}")
        done.append(number)

    batches = result.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(keep).trigger(availableNow=True).start()
    batches.awaitTermination()
    if not done:
        return spark.createDataFrame([], result.schema)
    rows = spark.read.schema(result.schema).option("recursiveFileLookup", "true").parquet(f"{root}/rows")
    if mode == "complete" or order is None:
        return rows
    return rows.groupBy(*key).agg(*[F.max_by(c, order).alias(c) for c in rows.columns if c not in key])
