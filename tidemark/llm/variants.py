"""Spelling variants: every word points to a far commoner word that differs in one code point.

1.  Runs of letters are counted per task and summed by word; words long and frequent enough
    are written once, each with a number.
2.  For every word and position, prefix and suffix sums of a polynomial hash give the key of the
    word without that code point, over all words of a batch at once in numpy; the word itself
    has a key as well.  No shortened string is built.
3.  Keys are dealt by their leading bits (radix) and sorted.  One pass over the sorted keys
    keeps the rows that can meet: the same key at the same position of two words (a replaced
    code point), or the key of a word among the deletions of others (an inserted one).
4.  Those rows fetch their words, and the shortened strings themselves are the groups of the
    next step, so a hash collision parts there.

Words that share a shortened string at one position differ in that code point alone, so such a
group has a member a letter at most and each member takes the count and the best of the others;
no pairs are made.  Forms are followed by pointer doubling; counts at least double on the way, so
six rounds reach the end of the longest path.

Runs are counted in bounded dictionaries and long texts in pieces cut between runs.  A run of a
million letters costs a row a letter, and carries its text only where it meets another word.

Defined edge results: null and empty texts have no runs; a null id is hashed as an empty string;
repeated rows and rows of one id are all counted; of equal counts the smaller word (by code
point) is taken; an empty table gives no words; further columns are not read, whatever their
names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import discard, small_batches, tasks_for, written
from tidemark.llm.shingles import mix

LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: How many times commoner a word's form must be.
TIMES = 2
#: Distinct words that a task holds before it hands on what it has counted.
_HELD = 150_000
#: Code points of a text that are read at once.
_PIECE = 1 << 18
#: Leading bits of a key that deal it; far more digits than partitions.
_RADIX_BITS = 24
#: Pointer doublings: a path is shorter than the number of bits of a count.
_ROUNDS = 7
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_SELF = -1


def _pieces(text: str, end: re.Pattern) -> Iterator[str]:
    """``text`` in pieces that end between runs."""
    at = 0
    while at < len(text):
        cut = end.search(text, at + _PIECE)
        to = cut.start() if cut else len(text)
        yield text[at:to]
        at = to


def _count_runs(least: int, every: int | None):
    """Counts lower-cased runs; with ``every``, the runs of a document whose hash it divides lose
    one code point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, end = re.compile(f"[{LETTERS}]{{{least},}}"), re.compile(f"[^{LETTERS}]")
        total: dict[str, int] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            words, counts = list(total), list(total.values())
            total.clear()
            for i in range(0, len(words), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + (1 << 14)], pa.string()), pa.array(counts[i : i + (1 << 14)], pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for piece in _pieces(text.encode().lower().decode(), end):  # bytes lower A-Z alone
                    for word, n in Counter(runs.findall(piece)).items():
                        if every:
                            h = zlib.crc32(word.encode(), seed)
                            if h % every == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least:
                                    continue
                        total[word] = total.get(word, 0) + n
                    if len(total) >= _HELD:
                        yield from handed()
        yield from handed()

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int | None = None) -> DataFrame:
    """(word, n) of the runs of letters that are long and frequent enough."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_count_runs(least_length, every), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word index, position, first, key): a row for each code point left out, and one with
    position -1 for the word itself.

    With p(i) the hash of the first i code points and s(i) that of the rest, both under the
    powers of their places, the word without place i has the hash p(i) + s(i + 1) / base.
    ``first`` is false where the code point before is the same, as that deletes to the same.
    """
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    index = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(points)) - starts[index]
    longest = int(lengths.max(initial=0))
    powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(longest, _BASE, np.uint64)])
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * powers[place], out=sums[1:])
    whole = sums[ends] - sums[starts]
    prefix, suffix = sums[:-1] - sums[starts][index], sums[ends][index] - sums[1:]
    first = np.r_[True, points[1:] != points[:-1]][: len(points)] | (place == 0)
    key = mix(np.r_[prefix + suffix * _INVERSE, whole])
    return np.r_[index, np.arange(len(words))], np.r_[place, np.full(len(words), _SELF)], np.r_[first, np.zeros(len(words), bool)], key


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        index, place, first, key = deletion_keys(batch.column(1).to_pylist())
        for i in range(0, len(key), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(place[part].astype(np.int32)), pa.array(first[part]), pa.array(ids[index[part]])], ["key", "place", "first", "word_id"])


def _may_meet(key: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of rows sorted by key and place, whole keys only: those that may have a near word."""
    starts = np.r_[True, key[1:] != key[:-1]]
    group = np.cumsum(starts) - 1
    spot = np.cumsum(starts | np.r_[True, place[1:] != place[:-1]]) - 1
    itself = place == _SELF
    replaced = ~itself & (np.bincount(spot)[spot] > 1)
    has_word = np.bincount(group, itself)[group] > 0
    has_longer = np.bincount(group, first)[group] > 0
    return replaced | (itself & has_longer) | (first & has_word)


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the sorted keys that may meet; the last key of a batch waits for the next."""
    held: list[list[np.ndarray]] = []

    def found(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, place, first, word = (np.concatenate(c) for c in zip(*parts))
        use = _may_meet(key, place, first)
        if use.any():
            yield pa.RecordBatch.from_arrays([pa.array(place[use]), pa.array(first[use]), pa.array(word[use])], ["place", "first", "word_id"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        open_from = int(np.searchsorted(columns[0], columns[0][-1]))
        if open_from or (held and held[0][0][0] != columns[0][0]):
            yield from found([*held, [c[:open_from] for c in columns]])
            held = []
        held.append([c[open_from:].copy() for c in columns])
    if held:
        yield from found(held)


def _near(words: DataFrame) -> DataFrame:
    """(word_id, n_near, best): how many words are near and (-n, word, id) of the first of them."""
    spark = words.sparkSession
    keys = words.select("word_id", "word").mapInArrow(_keyed, "key bigint, place int, first boolean, word_id bigint")
    radix = F.shiftrightunsigned("key", 64 - _RADIX_BITS)
    dealt = keys.repartition(tasks_for(spark), radix).sortWithinPartitions("key", "place")
    rows = dealt.mapInArrow(_meeting, "place int, first boolean, word_id bigint").join(words, "word_id")
    shorter = F.concat(F.substr("word", F.lit(1), F.col("place")), F.substr("word", F.col("place") + 2))
    rows = rows.withColumn("rest", F.when(F.col("place") == _SELF, F.col("word")).otherwise(shorter))
    rows = rows.withColumn("me", F.struct((-F.col("n")).alias("m"), "word", "word_id")).select("word_id", "place", "first", "rest", "me").repartition(tasks_for(spark), "rest")
    spot = Window.partitionBy("rest", "place")
    order = spot.orderBy("me")
    rows = rows.withColumn("others", F.count(F.lit(1)).over(spot) - 1)
    rows = rows.withColumn("lead", F.lead("me").over(order)).withColumn("head", F.first("me").over(order))
    all_of = Window.partitionBy("rest")
    rows = rows.withColumn("shorter", F.min(F.when(F.col("place") == _SELF, F.col("me"))).over(all_of))
    rows = rows.withColumn("longer", F.min(F.when(F.col("first"), F.col("me"))).over(all_of))
    rows = rows.withColumn("n_longer", F.sum(F.when(F.col("first"), 1).otherwise(0)).over(all_of))
    replaced = F.when(F.col("head") == F.col("me"), F.col("lead")).otherwise(F.col("head"))
    itself = F.col("place") == _SELF
    inserted = F.when(itself, F.col("longer")).when(F.col("first"), F.col("shorter"))
    more = F.when(itself, F.col("n_longer")).when(F.col("first") & F.col("shorter").isNotNull(), 1).otherwise(0)
    each = rows.select("word_id", (F.when(itself, 0).otherwise(F.col("others")) + more).alias("near"), F.least(F.when(~itself, replaced), inserted).alias("best"))
    return each.groupBy("word_id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """(id, to): the end of the path from every id that points on."""
    now = written(links, "variant-links")
    for _ in range(_ROUNDS):
        onward = now.select(F.col("id").alias("to"), F.col("to").alias("next"))
        moved = now.join(onward, "to", "left")
        if moved.where(F.col("next").isNotNull()).isEmpty():
            return now
        further = written(moved.select("id", F.coalesce("next", "to").alias("to")), "variant-links")
        discard(now)
        now = further
    return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, every: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word.

    ``form`` is the near word of largest count if that is at least ``times`` the word's, ``root``
    the end of the forms from the word on.  ``times`` must be 2 or more, so that paths end.
    """
    if times < 2:
        raise ValueError("a form must be at least twice as frequent")
    counted = word_counts(docs, id_col, text_col, least_length, least_count, every)
    words = written(counted.select(F.monotonically_increasing_id().alias("word_id"), "word", "n"), "variant-words")
    close = written(_near(words), "variant-near")
    far = -F.col("best.m") >= times * F.col("n")
    formed = words.join(close, "word_id", "left").select("word_id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.word")).alias("form"), F.when(far, -F.col("best.m")).alias("form_n"), F.when(far, F.col("best.word_id")).alias("to"))
    formed = written(formed, "variant-forms")
    discard(close)
    ends = _roots(formed.where("to is not null").select(F.col("word_id").alias("id"), "to"))
    named = ends.join(words.select(F.col("word_id").alias("to"), F.col("word").alias("root")), "to").select(F.col("id").alias("word_id"), "root")
    return formed.join(named, "word_id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
