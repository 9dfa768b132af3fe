"""Sharding by longest-processing-time scheduling of groups that must stay together.

Rows of equal texts form a group.  Groups sorted by size, largest first, go to the least
loaded shard, found by a heap.  To keep what the scheduler sees bounded at any corpus size,
every group of at least 1 / (shards * ``LARGE_PARTS``) of all bytes is scheduled by itself
(there are at most shards * LARGE_PARTS of those), and smaller groups are scheduled in
``BUNDLES`` bundles dealt by a hash of the group, whole groups each.  Group sizes come from
a partial aggregation, so a hot group is one row per task before it is shuffled.

Defined edge results: null texts are one group of size 1 each, apart from empty texts,
which are another; an empty table gives an empty result; rows of one id are numbered one
by one; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import gapless_number, written

LARGE_PARTS = 512
BUNDLES = 1 << 15


def longest_first(sizes: Sequence[tuple[int, str]], shards: int) -> dict[str, int]:
    """Item name to shard: items by falling size (then name) to the least loaded shard."""
    loads = [(0, shard) for shard in range(shards)]
    placed = {}
    for size, name in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(loads)
        placed[name] = shard
        heapq.heappush(loads, (load + size, shard))
    return placed


def sharded(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): shards of nearly equal bytes, slots from 0."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    group = F.when(F.col(text_col).isNull(), F.lit("null")).otherwise(F.sha2(F.col(text_col), 256))
    size = F.octet_length(text).cast("long") + 1
    rows = docs.select(F.col(id_col).cast("long").alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), group.alias("grp"))
    rows = written(rows, "sizes")
    groups = written(rows.groupBy("grp").agg(F.sum("size").alias("bytes")), "group-sizes")
    total = groups.agg(F.sum("bytes")).first()[0] or 0

    large = F.col("bytes") * (shards * LARGE_PARTS) >= F.lit(total)
    bundle = F.pmod(F.xxhash64("grp"), F.lit(BUNDLES)).cast("string")
    # at most shards * LARGE_PARTS + BUNDLES rows, whatever the corpus
    items = groups.groupBy(F.when(large, F.col("grp")).otherwise(bundle).alias("item"), large.alias("alone")).agg(F.sum("bytes").alias("bytes")).collect()
    placed = longest_first([(r["bytes"], r["item"]) for r in items], shards)
    shape = "item string, shard int"
    alone = spark.createDataFrame([(r["item"], placed[r["item"]]) for r in items if r["alone"]], shape)
    bundled = spark.createDataFrame([(r["item"], placed[r["item"]]) for r in items if not r["alone"]], shape)
    at_group = F.broadcast(alone.select(F.col("item").alias("grp"), F.col("shard").alias("own_shard")))
    at_bundle = F.broadcast(bundled.select(F.col("item").alias("bundle"), F.col("shard").alias("bundle_shard")))
    out = rows.join(at_group, "grp", "left").withColumn("bundle", bundle).join(at_bundle, "bundle", "left")
    out = written(out.select("id", "size", "text_crc32", F.coalesce("own_shard", "bundle_shard").alias("shard")), "shards")
    return gapless_number(out, ["shard"], ["id", "text_crc32", "size"], "slot")
