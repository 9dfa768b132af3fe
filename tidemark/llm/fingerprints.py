"""Document fingerprints: exact digests of canonical texts.

Canonical means NFKC, case folding, NFKC again, and every run of white space as one space,
none at the ends.  The fingerprint is the 128-bit xxhash of those bytes.  Rows of equal
digests form a bucket whose canonical bytes are compared; should two texts of a bucket
differ, their fingerprints get a SHA-256 suffix and are unequal again.

Neighbours (the next document by falling id) come from one range-wise shuffle: explicit id
bounds split the rows, the first row of each range is sent to the range above it too, and
a task streams its sorted range with one row held.  Byte comparison fetches only texts
whose digests repeat: a bitmap of fixed size selects them before anything is shuffled.

Defined edge results: null texts are empty; empty and white-space texts share one
fingerprint; one document alone is its own next; rows of one id are documents of their own,
ordered by text, and equal texts have equal fingerprints under any ids; null ids come last;
very long texts are digested whole; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import probably_in, tasks_for, written

NULL_ID = -(1 << 63)
MOST_RANGES = 8192


def canonical(text: str | None) -> bytes:
    if not text:
        return b""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "replace")


def edited(text: str | None, following: str | None) -> str:
    """``text`` with its last third replaced by the start of ``following``."""
    text, following = text or "", following or ""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def digest(data: bytes, bits: int = 128) -> str:
    return xxhash.xxh3_128_hexdigest(data)[: bits // 4]


def _bucket_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``, by binary search."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = F.array(*[F.lit(1 << s) for s in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(table, at + s - 1) <= value), at + s).otherwise(at))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Rows (bucket, carried, id, text, h) dealt and sorted so that each row's successor by
    falling id is the next row of its bucket; carried rows end a bucket and are no rows
    of their own."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))  # with the id it names a row's text
    ids = rows.select("id")
    # several ranges a task even out; their bounds stay a short list
    n = ranges or min(6 * tasks_for(spark), MOST_RANGES)
    cuts = ids.approxQuantile("id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    bounds = sorted({int(c) for c in cuts})
    bucket = _bucket_of(F.col("id"), bounds)
    # one row per range
    tops = sorted((r["bucket"], r["top"]) for r in ids.groupBy(bucket.alias("bucket")).agg(F.max("id").alias("top")).collect())
    sent: dict[int, list[int]] = {}
    for i, (b, _) in enumerate(tops):
        sent.setdefault(tops[i - 1][1], []).append(b)  # the lowest range wraps to the highest
    carried = spark.createDataFrame([(top, to) for top, to in sent.items()], "top long, to array<int>")
    at = rows.join(F.broadcast(carried), F.col("id") == F.col("top"), "left")  # a row per range
    own = F.array(F.struct(bucket.alias("bucket"), F.lit(0).alias("carried")))
    more = F.transform(F.coalesce("to", F.array().cast("array<int>")), lambda b: F.struct(b.alias("bucket"), F.lit(1).alias("carried")))
    dealt = at.select("id", "text", "h", F.explode(F.concat(own, more)).alias("p")).select("p.bucket", "p.carried", "id", "text", "h")
    return dealt.repartition(tasks_for(spark), "bucket").sortWithinPartitions(F.col("bucket"), F.col("carried"), F.col("id").desc(), F.col("text"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple]]:
    """(id, text, h) of each row and of the row after it."""
    held = None
    for batch in batches:
        for bucket, carried, doc, text, h in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3), batch.column(4).to_pylist()):
            row = (doc, text.as_py(), h)
            if held is not None and held[0] == bucket and not held[1]:
                yield held[2], row
            held = (bucket, carried, row)


_DIGESTS = {"id": "long", "h": "long", "n_chars": "long", "edited_sha256": "string", "d": "string", "e": "string", "next_id": "long", "next_h": "long", "next_d": "string"}
_ARROW = {"long": pa.int64(), "string": pa.string()}


def _digests(bits: int):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(zip(*rows), _DIGESTS.values())], names=list(_DIGESTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last = [], (None, None)
        for (doc, text, h), following in _pairs(batches):
            changed = edited(text, following[1])
            mine = last[1] if last[0] == (doc, h) else digest(canonical(text), bits)
            theirs = digest(canonical(following[1]), bits)
            last = ((following[0], following[2]), theirs)
            out.append((doc, h, len(text), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), mine, digest(canonical(changed), bits), following[0], following[2], theirs))
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return run


_NAME = ("g", "id", "h", "next_id", "next_h")


def _canonical_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [canonical(a.as_py() if b is None else edited(a.as_py(), b)) for a, b in zip(batch.column(5), batch.column(6).to_pylist())]
        suffix = [hashlib.sha256(x).hexdigest()[:16] for x in data]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(data, pa.binary()), pa.array(suffix, pa.string())], names=[*_NAME, "bytes", "suffix"])


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_id, next_fingerprint)."""
    shape = ", ".join(f"{n} {t}" for n, t in _DIGESTS.items())
    rows = written(with_next(docs, id_col, text_col).mapInArrow(_digests(bits), shape), "digests")
    none = F.lit(None).cast("long")
    plain = rows.select(F.col("d").alias("g"), "id", "h", none.alias("next_id"), none.alias("next_h"))
    uses = plain.unionByName(rows.select(F.col("e").alias("g"), "id", "h", "next_id", "next_h"))
    again = uses.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
    checks = written(uses.join(again, "g").distinct(), "repeated")
    wanted = checks.select("id").unionByName(checks.where("next_id is not null").select(F.col("next_id").alias("id")))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = probably_in(base, wanted, "id").withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"])
    texts = written(texts, "repeated-texts")
    following = texts.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("text").alias("following"))
    changed = checks.where("next_id is not null").join(texts, ["id", "h"]).join(following, ["next_id", "next_h"])
    whole = checks.where("next_id is null").join(texts, ["id", "h"]).withColumn("following", F.lit(None).cast("string"))
    every = whole.select(*_NAME, "text", "following").unionByName(changed.select(*_NAME, "text", "following"))
    compared = every.mapInArrow(_canonical_rows, "g string, id long, h long, next_id long, next_h long, bytes binary, suffix string")
    buckets = compared.groupBy("g").agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi")).where("lo <> hi").select("g")
    clashes = written(buckets, "clashes")
    if clashes.isEmpty():
        return rows.select("id", "n_chars", "edited_sha256", F.col("d").alias("fingerprint"), F.col("e").alias("edited_fingerprint"), "next_id", F.col("next_d").alias("next_fingerprint"))
    suffixes = written(compared.join(clashes, "g").select(*_NAME, "suffix"), "suffixes")

    def told(frame: DataFrame, key: str, own: dict[str, str], is_changed: bool, name: str) -> DataFrame:
        """``frame`` and the digest ``key`` with the suffix of the text that ``own`` names."""
        s = suffixes.where(F.col("next_id").isNotNull() == is_changed).select(F.col("suffix").alias("__s"), F.col("g").alias("__g"), *[F.col(c).alias(f"__{c}") for c in own])
        same = F.col(key) == F.col("__g")
        for c, at in own.items():
            same = same & (F.col(at) == F.col(f"__{c}"))
        joined = frame.join(s, same, "left")
        return joined.withColumn(name, F.when(F.col("__s").isNull(), F.col(key)).otherwise(F.concat_ws("-", key, "__s"))).drop("__s", "__g", *[f"__{c}" for c in own])

    out = told(rows, "d", {"id": "id", "h": "h"}, False, "fingerprint")
    out = told(out, "e", {c: c for c in _NAME[1:]}, True, "edited_fingerprint")
    out = told(out, "next_d", {"id": "next_id", "h": "next_h"}, False, "next_fingerprint")
    return out.select("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_id", "next_fingerprint")
