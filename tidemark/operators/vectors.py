"""Pairs of close vectors: strips of angles to two pivots, then matrix products in blocks.

Two unit vectors within the angle t have angles to any third vector that differ by t at most
(the triangle inequality on the sphere).  Vectors are dealt into strips of width t of their
angles to two pivots; a close pair lies in the same cell of strips or in neighbouring ones, and
only those are compared, in blocks of bounded size.  Nothing is missed; how much the strips save
depends on how the vectors lie.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import mathx as m
from tidemark.sources.tables import written

#: Vectors of one side of a block.
BLOCK = 2048


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of a column of lists of one length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _close(threshold: float):
    def run(meeting: pa.Table) -> pa.Table:
        ids, side = meeting["id"].to_numpy(), meeting["side"].to_numpy()
        x = matrix(meeting["v"])
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2 is both
        a, b = np.nonzero(x[left] @ x[right].T >= threshold)
        a, b = left[a], right[b]
        use = (ids[a] < ids[b]) | (side[a] != 2)
        a, b = a[use], b[use]
        sim = np.einsum("ij,ij->i", x[a], x[b])
        return pa.table({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b]), "similarity": sim})

    return run


def similar_vectors(rows: DataFrame, threshold: float, item: str = "id", vector: str = "c", block: int = BLOCK) -> DataFrame:
    """(a, b, similarity): a < b of vectors whose cosine is ``threshold`` (over 0) or more.

    Equal vectors collapse first: each links to the smallest id of its vector, and pairs are
    made between different vectors.  Null and zero vectors, and pairs of different lengths, have
    no cosine.  Blocks follow from the number of vectors, so they are alike at every size.
    """
    width = math.acos(min(threshold, 1.0)) + 1e-6
    units = rows.select(F.col(item).cast("long").alias("id"), m.normalised(F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    run = uuid.uuid4().hex[:8]
    units = written(units.where("size(v) > 0 and exists(v, x -> x <> 0) and forall(v, x -> not isnan(x))"), f"units-{run}")
    firsts = written(units.groupBy("v").agg(F.min("id").alias("id")), f"firsts-{run}")
    copies = units.join(firsts.withColumnRenamed("id", "first"), "v").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))

    pivots = [r["v"] for r in firsts.orderBy(F.xxhash64("id")).limit(2).collect()]
    angle = lambda p: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m.dot(F.col("v"), F.array(*[F.lit(x) for x in p])))))
    strips = [F.floor(angle(p) / width).cast("int") for p in (pivots * 2)[:2]] or [F.lit(0), F.lit(0)]
    placed = firsts.select("id", "v", F.struct(F.size("v").alias("n"), strips[0].alias("s"), strips[1].alias("t")).alias("cell"))
    # a row a cell: no more than a few strips each way
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).select("cell", F.ceil(F.col("rows") / block).cast("int").alias("parts"))
    near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    around = cells.select("cell", "parts", F.explode(F.array(*[F.struct(F.col("cell.n").alias("n"), (F.col("cell.s") + i).alias("s"), (F.col("cell.t") + j).alias("t")) for i, j in near])).alias("other"))
    around = around.join(cells.select(F.col("cell").alias("other"), F.col("parts").alias("other_parts")), "other")
    dealt = placed.join(F.broadcast(around), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
    me, other = F.struct("cell", "part"), F.struct(F.col("other").alias("cell"), F.col("other_part").alias("part"))
    side = F.when(me == other, 2).when(me < other, 0).otherwise(1)
    meeting = dealt.select("id", "v", side.alias("side"), F.least(me, other).alias("low"), F.greatest(me, other).alias("high"))
    pairs = meeting.groupBy("low", "high").applyInArrow(_close(threshold), "a bigint, b bigint, similarity double")
    return pairs.unionByName(copies)
