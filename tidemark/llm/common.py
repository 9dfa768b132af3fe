"""Shared Spark helpers: shared scratch tables, gapless numbering, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_scratch_roots: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


#: Bytes of rows handed to Python at once; a batch of long texts is held several times over.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes too: by rows alone, long texts make them huge."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``.

    That setting names storage which every executor sees.  Only where it is unset
    (local tests) a temporary folder stands in for it.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch_roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(_remove, spark, base)
        _scratch_roots[app] = f"{base.rstrip('/')}/tidemark/{app}"
        atexit.register(_remove, spark, _scratch_roots[app])
    return _scratch_roots[app]


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort at exit: by then the JVM may be gone, and leftovers are harmless."""
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # noqa: BLE001
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    small_batches(df.sparkSession)
    path = f"{scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes tables of ``written`` that nothing reads any more."""
    for table in tables:
        if table is not None and table in _paths:
            _remove(table.sparkSession, _paths.pop(table))


def tasks_for(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: as many as the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def gapless_number(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str, rows_per_chunk: int = 4096) -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... within each ``key``, without putting a key into one task.

    Rows are dealt into chunks by a hash of the ``order`` columns, numbered inside
    (chunk, key), and shifted by the counts of the key's earlier chunks.  The order
    is fixed by the data: by chunk, then by ``order`` (which should be unique per
    row; rows that tie there get neighbouring numbers).  ``rows_per_chunk`` sets how
    many chunks there are from the row count, so chunks stay alike at every size.
    """
    spark = df.sparkSession
    chunks = max(1, df.count() // rows_per_chunk)
    keyed = df.withColumn("__chunk", F.pmod(F.xxhash64(*order, F.lit("deal")), F.lit(chunks)))
    keyed = keyed.repartition(tasks_for(spark), "__chunk")
    inside = Window.partitionBy("__chunk", *key).orderBy(*order)
    numbered = keyed.withColumn("__inside", F.row_number().over(inside) - 1)
    counts = df.withColumn("__chunk", F.pmod(F.xxhash64(*order, F.lit("deal")), F.lit(chunks)))
    counts = counts.groupBy("__chunk", *key).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__chunk", *key, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    renamed = starts.select(F.col("__chunk").alias("__c"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], "__start")
    same = (F.col("__chunk") == F.col("__c"))
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = numbered.join(renamed, same, "left")
    return joined.withColumn(name, (F.col("__start") + F.col("__inside")).cast("long")).select(*df.columns, name)


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has an edge.

    Each round hooks every id to its smallest neighbour, jumps pointers once, relabels
    the edges and drops those inside one label, so the edge table shrinks until it is
    empty.  All tables are written between rounds; the driver sees only row counts.
    """
    spark = edges.sparkSession
    rest = written(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b").distinct(), "cc-edges")
    labels: DataFrame | None = None
    for _ in range(max_rounds):
        if rest.isEmpty():
            break
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("to"))
        hook = written(hook, "cc-hook")
        onward = hook.select(F.col("id").alias("to"), F.col("to").alias("far"))
        jumped = written(hook.join(onward, "to").select("id", F.least("to", "far").alias("to")), "cc-jump")
        at_a = jumped.select(F.col("id").alias("a"), F.col("to").alias("ra"))
        at_b = jumped.select(F.col("id").alias("b"), F.col("to").alias("rb"))
        moved = rest.join(at_a, "a").join(at_b, "b").where("ra <> rb")
        left_over = written(moved.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "cc-edges")
        discard(rest, hook)
        rest = left_over
        if labels is None:
            labels = jumped
        else:
            step = jumped.select(F.col("id").alias("to"), F.col("to").alias("next"))
            moved = written(labels.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to")), "cc-labels")
            discard(labels, jumped)
            labels = moved
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    discard(rest)
    if labels is None:
        return spark.createDataFrame([], "id bigint, component bigint")
    return labels.select("id", F.col("to").alias("component"))


#: Bits of the bitmap that preselects rows: a broadcast of two megabytes at most.
BITMAP_BITS = 1 << 23


def probably_in(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``wanted``, and a few others, without a shuffle.

    ``wanted`` becomes a bitmap of fixed size, which is broadcast; with more keys it lets
    more other rows pass, so an exact join must follow.  It keeps that join's shuffle small.
    """
    place = F.pmod(F.xxhash64(F.col(key).cast("long"), F.lit("bit")), F.lit(BITMAP_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    words = wanted.groupBy(F.floor(place / 64).alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    hit = df.join(F.broadcast(words), F.floor(place / 64) == F.col("__word"))
    return hit.where(F.col("__bits").bitwiseAND(bit) != 0).select(*df.columns)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def unused(columns: Sequence[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    while name in columns:
        name = "_" + name
    return name
