"""Token ids as fixed-width packed bits in files, with offsets for random access.

Every id takes the fewest bits that hold the vocabulary's largest id.  A file is

    magic ``TMBP0001`` | width u32 | block ids u32 | documents u64 | ids u64 | index bytes u64
    packed blocks, each starting at a byte: ids, lowest bit first
    index: block byte offsets (u64 each), then per document doc_id (i64) and first id (u64)

so numpy unpacks a block, or any range of ids, by shifts of whole arrays.  The files of one
data set hold ascending ranges of doc_id; a manifest table names the files that successful
tasks wrote, with their ranges and first ids, so a repeated or lost task leaves no trace.

Texts are range-partitioned by doc_id once and then encoded, so each executor writes its
range; the driver sees one row per file.

Defined edge results: null and empty texts are the end id alone; an empty table gives no
file; a null doc_id sorts first; repeated doc_ids are separate documents, ordered by text;
a very long text is encoded whole and fills several blocks; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import scratch_root, tasks_for, written
from tidemark.llm.pretoken import ChunkIds, chunk_lists

MAGIC = b"TMBP0001"
HEADER = struct.Struct("<8sIIQQQ")
BLOCK_IDS = 1 << 15
CACHED_CHUNKS = 250_000
#: Chunks that the library reads as one text: its own result takes some 100 bytes a token.
LEARNT_AT_ONCE = 5_000
#: Ids that are read from a file at once, more only for one document that holds more.
READ_IDS = 1 << 19
END_ID = 0
NULL_ID = -(1 << 63)
ROWS_AT_ONCE = 1024


def bits_for(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``ids`` as consecutive fields of ``width`` bits, lowest bit first, padded to a byte."""
    if width in (8, 16, 32):  # whole bytes: the same layout without touching bits
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, width: int, n: int, first: int = 0) -> np.ndarray:
    """``n`` ids from field ``first`` on, each read from the eight bytes that hold it."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n, first * width // 8).astype(np.uint32)
    raw = np.frombuffer(data, np.uint8)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    bit = (first + np.arange(n, dtype=np.int64)) * width
    byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range((width + 7 + 7) // 8):
        word |= padded[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> shift) & np.uint64((1 << width) - 1)).astype(np.uint32)


class Encoder:
    """The tokenizers library over chunks that it treats alone, with a cache of their ids.

    New chunks of a batch go to the library as one text, joined by newlines: a lone newline
    is a token of its own, so its id tells the chunks' ids apart again.  Texts that are not
    cut into chunks go to it whole, marked by a leading zero character.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.newline = self._library("\n")
        self.chunks = ChunkIds(self._learn, CACHED_CHUNKS)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _learn(self, new: list[str]) -> list[bytes]:
        known = {c: self._library(c[1:]).tobytes() for c in new if c[:1] == "\0"} | {"\n": self.newline.tobytes(), "": b""}
        plain = [c for c in new if c not in known]
        for lo in range(0, len(plain), LEARNT_AT_ONCE):
            part = plain[lo : lo + LEARNT_AT_ONCE]
            ids = self._library("\n".join(part))
            cuts = np.flatnonzero(ids == self.newline[0])
            starts, ends = [0, *(4 * (cuts + 1)).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)]
            if len(starts) != len(part):
                raise ValueError("the vocabulary does not keep newlines apart")
            data = ids.tobytes()
            known.update((chunk, data[lo:hi]) for chunk, lo, hi in zip(part, starts, ends))
        return [known[c] for c in new]

    def lists(self, texts: pa.Array) -> pa.ListArray:
        return self.chunks.lists(chunk_lists(texts, lambda t: ["\0" + t], self.added))


_encoders: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


class _Writer:
    """One file, block by block; memory holds one block and the index."""

    def __init__(self, root: str, width: int):
        self.fs, base = pafs.FileSystem.from_uri(root)
        self.path = f"{base}/part-{uuid.uuid4().hex}.bits"
        self.width, self.held, self.n_held = width, [], 0
        self.offsets, self.doc_ids, self.firsts, self.n_ids = [], [], [], 0
        self.body = self.fs.open_output_stream(self.path + ".body")
        self.size = 0

    def add(self, doc_ids: list[int], lengths: np.ndarray, ids: np.ndarray) -> None:
        """Whole documents: their ids one after another."""
        self.doc_ids += doc_ids
        self.firsts += (self.n_ids + np.cumsum(lengths) - lengths).tolist()
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK_IDS:
            every = np.concatenate(self.held)
            for lo in range(0, len(every) - BLOCK_IDS + 1, BLOCK_IDS):
                self._block(every[lo : lo + BLOCK_IDS])
            rest = every[len(every) // BLOCK_IDS * BLOCK_IDS :].copy()
            self.held, self.n_held = [rest], len(rest)

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.offsets.append(HEADER.size + self.size)
        self.size += len(data)
        self.body.write(data)

    def close(self) -> tuple[str, int, int]:
        if self.n_held:
            self._block(np.concatenate(self.held))
        self.body.close()
        index = np.array(self.offsets, np.uint64).tobytes() + np.array(self.doc_ids, np.int64).tobytes() + np.array(self.firsts, np.uint64).tobytes()
        with self.fs.open_output_stream(self.path) as out, self.fs.open_input_stream(self.path + ".body") as body:
            out.write(HEADER.pack(MAGIC, self.width, BLOCK_IDS, len(self.doc_ids), self.n_ids, len(index)))
            while data := body.read(1 << 22):
                out.write(data)
            out.write(index)
        self.fs.delete_file(self.path + ".body")
        return self.path, len(self.doc_ids), self.n_ids


def _write(spec_ref, root: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, least = _encoder(spec_ref.value), None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(lo, ROWS_AT_ONCE)
                lists = encoder.lists(part.column(1))
                doc_ids = [NULL_ID if d is None else d for d in part.column(0).to_pylist()]
                if writer is None:
                    writer, least = _Writer(root, width), doc_ids[0]
                ends = lists.offsets.to_numpy()
                writer.add(doc_ids, np.diff(ends) + 1, np.insert(lists.values.to_numpy(), ends[1:], END_ID))
        if writer is not None:
            path, docs, ids = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([least]), pa.array([writer.doc_ids[-1]]), pa.array([docs]), pa.array([ids])], names=["path", "first_doc", "last_doc", "docs", "ids"])

    return run


def write_ids(docs: DataFrame, spec: str, root: str | None = None, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Writes the files and returns their manifest: path, first_doc, last_doc, docs, ids, start.

    ``root`` is a URI of storage that all executors share; by default it is below
    ``spark.checkpoint.dir``.  ``start`` is the number of ids in all files before.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    root = root or f"{scratch_root(spark)}/ids-{uuid.uuid4().hex[:12]}"
    width = bits_for(Tokenizer.from_str(spec).get_vocab_size())
    files, base = pafs.FileSystem.from_uri(root)
    files.create_dir(base, recursive=True)
    ref = spark.sparkContext.broadcast(spec)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(partitions or tasks_for(spark), "id").sortWithinPartitions("id", "text")
    shape = "path string, first_doc long, last_doc long, docs long, ids long"
    manifest = written(rows.mapInArrow(_write(ref, root, width), shape), "id-files")
    # one row per file: a window over the manifest only
    before = Window.orderBy("first_doc", "last_doc", "path").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


class IdFile:
    """Random access to one file: the index is read once, ids by byte range."""

    def __init__(self, path: str, root: str):
        self.file = pafs.FileSystem.from_uri(root)[0].open_input_file(path)
        magic, self.width, self.block, self.n_docs, self.n_ids, index = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{path} is no packed id file")
        data = self.file.read_at(index, self.file.size() - index)
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, np.uint64, blocks)
        self.doc_ids = np.frombuffer(data, np.int64, self.n_docs, 8 * blocks)
        self.firsts = np.append(np.frombuffer(data, np.uint64, self.n_docs, 8 * (blocks + self.n_docs)), np.uint64(self.n_ids)).astype(np.int64)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids number ``lo`` to ``hi`` of the file, reading only their blocks' bytes."""
        out = []
        while lo < hi:
            block, at = divmod(lo, self.block)
            n = min(hi - lo, self.block - at)
            first = at * self.width // 8
            last = -(-(at + n) * self.width // 8)
            data = self.file.read_at(last - first, int(self.offsets[block]) + first)
            bits = np.frombuffer(data, np.uint8)
            skip = at * self.width - first * 8
            out.append(unpack(bits, self.width, n) if skip == 0 else _unpack_from(bits, self.width, n, skip))
            lo += n
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def document(self, place: int) -> np.ndarray:
        return self.ids(int(self.firsts[place]), int(self.firsts[place + 1]))


def _unpack_from(raw: np.ndarray, width: int, n: int, skip: int) -> np.ndarray:
    bits = np.unpackbits(raw, bitorder="little")[skip : skip + n * width].reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def _ranges(batches: Iterator[pa.RecordBatch], root: str):
    """(doc ids, first ids in the whole data set, ids, bounds) of ranges of documents."""
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            source, lo = IdFile(path, root), 0
            while lo < source.n_docs:
                base = source.firsts[lo]
                hi = max(lo + 1, int(np.searchsorted(source.firsts, base + READ_IDS, side="right")) - 1)
                keys = pa.array([None if k == NULL_ID else k for k in source.doc_ids[lo:hi].tolist()], pa.int64())
                yield keys, pa.array(source.firsts[lo:hi] + start), source.ids(int(base), int(source.firsts[hi])), source.firsts[lo : hi + 1] - base
                lo = hi


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, starts, every, bounds in _ranges(batches, root):
            ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(every.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([keys, starts, ids], names=["doc_id", "start", "ids"])

    return run


def _sum_up(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, starts, every, bounds in _ranges(batches, root):
            raw = memoryview(every.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * lo : 4 * hi]) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([keys, starts, pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_ids(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """(doc_id, start, ids) of every document, read back from the packed files."""
    files = manifest.select("path", "start").repartition(tasks_for(spark), "path")
    return files.mapInArrow(_read(root), "doc_id long, start long, ids array<int>")


def read_checksums(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its ids read back.

    The checksum is that of the ids as little-endian unsigned 32-bit integers, unsigned.
    """
    files = manifest.select("path", "start").repartition(tasks_for(spark), "path")
    return files.mapInArrow(_sum_up(root), "doc_id long, start long, n_tokens long, ids_crc32 long")
