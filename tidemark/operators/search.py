"""Substring search through a positional trigram index.

Texts are folded (lower case, no diacritics); every run of three code points is a gram, and a
posting says where a gram stands in a field of an item.  A text of m code points is found by
grams that cover it: the rarest first, each at its distance from the start, joined on (item,
field, start).  That is exact, so no text is read again.

Postings are partitioned by a hash of the gram and sorted by gram, so a search opens only its
grams' buckets and skips row groups inside them.  Items are added as segments: a later segment
replaces an item, without touching what is there, and a removed item is listed without
postings.  A segment is written aside and renamed, so readers never see a part of one.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import folders

GRAM = 3
#: Bits of a code point; three of them fit into a number.
_BITS = 21
#: Items whose postings of one bucket are sorted by one task, so that a gram found everywhere
#: is no single task's work.
ITEMS_PER_FILE = 1 << 16
#: Positions that a task holds before it gives them out, beside those of one text.
_HELD = 1 << 18
_POSTING = "gram bigint, field string, id bigint, positions array<int>"


def folded(text: str) -> str:
    """Lower case, without marks."""
    if text.isascii():
        return text.lower()
    apart = unicodedata.normalize("NFD", text.lower())
    return unicodedata.normalize("NFC", "".join(c for c in apart if unicodedata.category(c) != "Mn"))


def grams(text: str) -> np.ndarray:
    """The number of the gram at every place of a folded text."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    return points[:-2] << 2 * _BITS | points[1:-1] << _BITS | points[2:] if len(points) >= GRAM else np.zeros(0, np.int64)


def _postings(fields: Sequence[str]):
    """One row per (item, field, distinct gram) of (id, *fields), in batches of bounded size."""

    def packed(name: str, distinct: list, counts: list, places: list, items: list) -> pa.RecordBatch:
        starts = np.r_[0, np.cumsum(np.concatenate(counts))]
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.concatenate(places), pa.int32()))
        number = np.concatenate(distinct)
        return pa.RecordBatch.from_arrays([pa.array(number), pa.array([name] * len(number), pa.string()), pa.array(np.concatenate(items)), lists], ["gram", "field", "id", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for name, column in zip(fields, batch.columns[1:]):
                parts, held = ([], [], [], []), 0
                for item, text in zip(ids, column):
                    text = text.as_py()
                    found = grams(folded(text)) if text and item is not None else ()
                    if len(found):
                        order = np.argsort(found, kind="stable").astype(np.int32)
                        some, n = np.unique(found[order], return_counts=True)
                        for part, more in zip(parts, (some, n, order, np.full(len(some), item))):
                            part.append(more)
                        held += len(order)
                    if held >= _HELD:
                        yield packed(name, *parts)
                        parts, held = ([], [], [], []), 0
                if held:
                    yield packed(name, *parts)

    return run


#: Mixes the three code points of a gram; a prime takes part of all bits.
_MIX, _PRIME = (7919, 104_729, 1_299_709), 1_000_003


def _parcels(fields: Sequence[str], buckets: int):
    """``_postings`` as one row per batch and bucket, for the way to the bucket's task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _postings(fields)(batches):
            gram = batch.column(0).to_numpy()
            mixed = sum((gram >> k * _BITS & (1 << _BITS) - 1) * by for k, by in enumerate(_MIX))
            bucket = mixed % _PRIME % buckets
            order = np.lexsort((gram, bucket))
            batch, bucket = batch.take(pa.array(order)), bucket[order]
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            parcels = []
            for low, high in zip(starts, np.r_[starts[1:], len(bucket)]):
                sink = pa.BufferOutputStream()
                # a slice shares its buffers with the batch, so its rows are taken
                part = batch.take(pa.array(np.arange(low, high)))
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                parcels.append(sink.getvalue().to_pybytes())
            first = batch.column(2)[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array([first] * len(starts), pa.int64()), pa.array(parcels, pa.binary())], ["bucket", "first", "parcel"])

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, parcel in zip(batch.column(0).to_pylist(), batch.column(2)):
            for part in pa.ipc.open_stream(parcel.as_buffer()):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, bucket, np.int32))], [*part.schema.names, "bucket"])


@dataclass(frozen=True)
class TrigramIndex:
    """The index below ``path``, a folder that all executors see."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def _bucket(self):
        mixed = sum(F.shiftright("gram", k * _BITS).bitwiseAND((1 << _BITS) - 1) * F.lit(by).cast("long") for k, by in enumerate(_MIX))
        return (mixed % _PRIME % self.buckets).cast("int")

    def segments(self) -> list[int]:
        return [int(n.removeprefix("segment=")) for n in folders.names(self.spark, self.path) if n.startswith("segment=")]

    def add(self, items: DataFrame, fields: Sequence[str] = ("title", "body"), item: str = "id") -> int:
        """Indexes items as a new segment, which takes the place of earlier versions of them.

        Null texts have no postings; rows that repeat an id are one item with all their texts.
        """
        rows = items.select(F.col(item).cast("long").alias("id"), *fields)
        parcels = rows.mapInArrow(_parcels(list(fields), self.buckets), "bucket int, first bigint, parcel binary")
        files = 1 + items.count() // ITEMS_PER_FILE
        dealt = parcels.repartition(self.buckets * files, "bucket", F.pmod(F.xxhash64("first"), F.lit(files)))
        dealt = dealt.mapInArrow(_opened, _POSTING + ", bucket int")
        return self._commit(rows.select("id"), dealt.sortWithinPartitions("bucket", "gram", "field", "id"))

    def remove(self, ids: DataFrame, item: str = "id") -> int:
        """Forgets items: a segment that names them and has no postings."""
        return self._commit(ids.select(F.col(item).cast("long").alias("id")), None)

    def _commit(self, ids: DataFrame, postings: DataFrame | None) -> int:
        aside = f"{self.path}/_{uuid.uuid4().hex}"
        ids.where("id is not null").distinct().sortWithinPartitions("id").write.parquet(f"{aside}/ids")
        if postings is not None:
            postings.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{aside}/postings")
            kept = self.spark.read.schema(_POSTING + ", bucket int").parquet(f"{aside}/postings")
            counts = kept.groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n"))
            counts.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{aside}/counts")
        number = max(self.segments(), default=0) + 1
        while not folders.renamed(self.spark, aside, f"{self.path}/segment={number}"):
            number += 1  # another writer was first
        return number

    def _read(self, part: str, schema: str, wanted: Sequence[int]) -> DataFrame | None:
        """Rows of one part of all segments whose gram is wanted; only their buckets are opened."""
        out = None
        rows = self.spark.createDataFrame([(g,) for g in wanted], "gram bigint")
        found = [r["bucket"] for r in rows.select(self._bucket().alias("bucket")).distinct().collect()]  # a row a gram
        for number in self.segments():
            at = f"{self.path}/segment={number}/{part}"
            if folders.exists(self.spark, at):
                rows = self.spark.read.schema(schema + ", bucket int").parquet(at)
                rows = rows.where(F.col("bucket").isin(*found) & F.col("gram").isin(*wanted)).withColumn("segment", F.lit(number))
                out = rows if out is None else out.unionByName(rows)
        return out

    def plan(self, needle: str) -> list[tuple[int, int]]:
        """(gram, offset) that cover the needle, rarest first; nothing if a gram is in no text.

        Reads the counts of the needle's grams, a row for each.
        """
        all_of = grams(folded(needle)).tolist()
        if not all_of:
            raise ValueError(f"the index answers for {GRAM} code points or more")
        counts = self._read("counts", "gram bigint, n bigint", sorted(set(all_of)))
        n = {r["gram"]: r["n"] for r in counts.groupBy("gram").agg(F.sum("n").alias("n")).collect()} if counts is not None else {}
        if any(g not in n for g in all_of):
            return []
        chosen, covered = [], set()
        for offset in sorted(range(len(all_of)), key=lambda i: (n[all_of[i]], i)):
            if not {offset, offset + 1, offset + 2} <= covered:
                chosen.append((all_of[offset], offset))
                covered |= {offset, offset + 1, offset + 2}
        return chosen

    def matches(self, needle: str) -> DataFrame:
        """(id) of the items with the folded needle in one of their fields, as last added."""
        chosen = self.plan(needle)
        if not chosen:
            return self.spark.createDataFrame([], "id bigint")
        postings = self._read("postings", _POSTING, sorted({g for g, _ in chosen}))
        key = ["segment", "id", "field", "start"]
        starts = None
        for gram, offset in chosen:
            here = postings.where(F.col("gram") == gram).select("segment", "id", "field", F.explode("positions").alias("at"))
            here = here.select("segment", "id", "field", (F.col("at") - offset).alias("start"))
            starts = here if starts is None else starts.join(here, key, "left_semi")
        found = starts.select("id", "segment").distinct()
        for number in self.segments():  # a later segment speaks for its items
            if number > 1:
                later = self.spark.read.schema("id bigint").parquet(f"{self.path}/segment={number}/ids")
                found = found.join(later.withColumn("from", F.lit(number)), (found["id"] == later["id"]) & (F.col("segment") < F.col("from")), "left_anti")
        return found.select("id")
