"""Demand against supply: what is asked for and how much of what there is answers it.

A topic is compared with every item: by the dot product of their vectors over the shorter
length, or, where either has none, by the share of the topic's words in the item's title, times
the bar, so that both are on one scale.  Rows of the same words and vector are compared once.
They are dealt into blocks whose number follows from the pairs, so that few copies of a row
travel; in a task, blocks meet piece by piece in matrix products, and only each topic's best few
and its count over the bar leave it.  Both merge over blocks.

Scores are rounded to nine places before they are ranked, so that the order of a sum does not
tell equal items apart; ties go to the smaller item.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.tables import written

# The bar, and how many items over it are few.
COVERED_AT = 0.7
THIN_BELOW = 3

#: A word of more than one match in so many pairs is a column of a product; other matches are
#: counted, so many at once.
COMMON, MATCHES = 256, 1 << 22

#: Rows of a piece: their product has so many cells of eight bytes.
TOPICS, ITEMS = 512, 8192

#: Pieces of a block at least and at most, and the blocks that are wanted between.
LEAST, MOST, BLOCKS = 1, 64, 64


class Words(NamedTuple):
    """Words of some rows: ``word[i]`` is one of row ``row[i]``."""

    rows: int
    row: np.ndarray
    word: np.ndarray


def title_words(title: Column) -> Column:
    """Distinct words of three characters or more, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(title), r"[\s\p{P}]+"), lambda w: F.char_length(w) >= 3))


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as rows that zeros fill up, and which rows are there."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[np.arange(out.shape[1]) < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out, column.is_valid().to_numpy(zero_copy_only=False)


def _shared(topics: Words, items: Words) -> np.ndarray:
    """How many words each topic has in common with each item.

    Words of many matches are columns of a product; of the others, a match a pair is counted.
    """
    vocabulary, code = np.unique(topics.word, return_inverse=True)
    there = np.searchsorted(vocabulary, items.word)
    known = vocabulary[np.minimum(there, max(0, len(vocabulary) - 1))] == items.word if len(vocabulary) else np.zeros(len(there), bool)
    there, owner = there[known], items.row[known]
    uses = np.bincount(code, minlength=len(vocabulary))
    common = uses * np.bincount(there, minlength=len(vocabulary)) * COMMON > topics.rows * items.rows
    place = np.cumsum(common) - 1
    left = np.zeros((topics.rows, int(common.sum())), np.float32)
    left[topics.row[common[code]], place[code[common[code]]]] = 1
    right = np.zeros((items.rows, left.shape[1]), np.float32)
    right[owner[common[there]], place[there[common[there]]]] = 1
    out = left @ right.T
    # the topics of each other word of the items
    order = np.argsort(code, kind="stable")
    starts = np.cumsum(uses) - uses
    rare = ~common[there]
    there, owner = there[rare], owner[rare]
    n = uses[there]
    for some in np.array_split(np.arange(len(there)), 1 + int(n.sum()) // MATCHES):
        k = n[some]
        each = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(starts[there[some]], k)
        cells = topics.row[order[each]] * items.rows + np.repeat(owner[some], k)
        np.add.at(out.reshape(-1), cells, np.float32(1))
    return out


def _words(lists: pa.ChunkedArray, codes: dict[str, int], rows: np.ndarray) -> Words:
    """The words of some rows by number; a word that ``codes`` has not gets the next one."""
    flat = lists.combine_chunks().take(pa.array(rows))
    n = flat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    said = flat.flatten().dictionary_encode()
    number = np.array([codes.setdefault(w, len(codes)) for w in said.dictionary.to_pylist()], np.int64)
    return Words(len(rows), np.repeat(np.arange(len(rows)), n), number[said.indices.to_numpy()] if len(said) else number)


def _part(words: Words, rows: slice) -> Words:
    """Some of the rows, which are in order."""
    low, high = np.searchsorted(words.row, [rows.start, rows.stop])
    return Words(min(rows.stop, words.rows) - rows.start, words.row[low:high] - rows.start, words.word[low:high])


def _first(scores: np.ndarray, places: np.ndarray, rows: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are among the ``keep`` of their row with the highest score, the smaller place
    first among equals, in order; and their rank."""
    order = np.lexsort((places, -scores, rows))
    new = np.flatnonzero(np.diff(rows[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(new, np.diff(new, append=len(order)))
    return order[rank < keep], rank[rank < keep]


def _best(topics: int, weights: np.ndarray, product: Callable[[slice, slice], np.ndarray], reach: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, place, covered): each topic's best items over zero, by rank, with -1 where there
    are fewer, and the weight of those that reach its ``reach``.  ``product`` gives the scores of
    a piece; the first pieces are small, so that later ones find only what is better."""
    score, place, covered = np.zeros((topics, keep)), np.full((topics, keep), -1), np.zeros(topics, np.int64)
    low, wide = 0, max(1, ITEMS // 32)
    while low < len(weights):
        items = slice(low, min(low + wide, len(weights)))
        for at in range(0, topics, TOPICS):
            some = slice(at, min(at + TOPICS, topics))
            cells = product(some, items)
            row, item = np.nonzero(cells >= reach[some, None])
            covered[some] += np.bincount(row, weights[low + item], some.stop - at).astype(np.int64)
            row, item = np.nonzero(cells > score[some, -1:])
            if len(row):
                was, rank = np.nonzero(place[some] >= 0)
                rows, scores = np.concatenate([was, row]), np.concatenate([score[some][was, rank], cells[row, item]])
                places = np.concatenate([place[some][was, rank], low + item])
                best, rank = _first(scores, places, rows, keep)
                score[at + rows[best], rank], place[at + rows[best], rank] = scores[best], places[best]
        low, wide = items.stop, min(2 * wide, ITEMS)
    return score, place, covered


def _compared(keep: int, bar: float):
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("id")
        asked = block["asked"].to_numpy(zero_copy_only=False)
        topics, items = block.filter(pa.array(asked)), block.filter(pa.array(~asked))
        ids, copies = items["ids"].combine_chunks(), items["n"].to_numpy().astype(np.float64)
        starts, listed = ids.offsets.to_numpy(), ids.values.to_numpy()
        (a, has_a), (b, has_b) = (padded(side["v"].combine_chunks()) for side in (topics, items))
        long, codes = min(a.shape[1], b.shape[1]), {}
        name, out = topics["id"].to_numpy(), []

        def met(rows: np.ndarray, columns: np.ndarray, by_words: bool) -> None:
            if not len(rows) or not len(columns):
                return
            if by_words:
                said, there = (_words(side["words"], codes, some) for side, some in ((topics, rows), (items, columns)))
                sizes = np.maximum(1, np.bincount(said.row, minlength=len(rows))).astype(float)
                # counts are in the order of the scores
                reach = np.where(np.round(bar, 9) >= bar, sizes, np.inf)
                score, place, covered = _best(len(rows), copies[columns], lambda t, i: _shared(_part(said, t), _part(there, i)), reach, keep)
                score = np.round(score / sizes[:, None] * bar, 9)
            else:
                x, y = a[rows, :long], b[columns, :long]
                score, place, covered = _best(len(rows), copies[columns], lambda t, i: np.round(x[t] @ y[i].T, 9), np.full(len(rows), bar), keep)
            # the items of the best classes
            row, rank = np.nonzero(place >= 0)
            these = columns[place[row, rank]]
            k = starts[these + 1] - starts[these]
            at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(starts[these], k)
            row, value = np.repeat(row, k), np.repeat(score[row, rank], k)
            best, _ = _first(value, listed[at], row, keep)
            out.append(pa.table({"topic": name[rows[row[best]]], "item": listed[at[best]], "score": value[best], "covered": pa.nulls(len(best), pa.int64())}))
            out.append(pa.table({"topic": name[rows], "item": pa.nulls(len(rows), pa.int64()), "score": pa.nulls(len(rows), pa.float64()), "covered": covered}))

        every = np.arange(len(items))
        met(np.flatnonzero(~has_a), every, True)
        met(np.flatnonzero(has_a), np.flatnonzero(~has_b), True)
        met(np.flatnonzero(has_a), np.flatnonzero(has_b), False)
        none = pa.table({"topic": pa.array([], pa.int64()), "item": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "covered": pa.array([], pa.int64())})
        return pa.concat_tables([none, *out])

    return run


def _dealt(topics: int, items: int) -> tuple[int, int]:
    """Blocks of topics and of items: as many as are wanted, of bounded size, and dealt so that a
    row of either is copied as seldom as can be."""
    pieces = topics * items / (TOPICS * ITEMS)
    blocks = max(pieces / MOST, min(pieces / LEAST, BLOCKS), 1)
    of_topics = max(1, round(math.sqrt(blocks * topics / max(1, items))))
    return of_topics, max(1, math.ceil(blocks / of_topics))


def _classes(rows: DataFrame, most: int | None) -> DataFrame:
    """(id, words, v, ids, n), written: rows of the same words and vector as one, with its ``most``
    smallest ids, or all, and their number."""
    shaped = rows.select(F.col("id").cast("long").alias("id"), F.array_sort(title_words(F.col("title"))).alias("words"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    same = shaped.groupBy("words", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count(F.lit(1)).alias("n"))
    ids = F.col("ids") if most is None else F.slice("ids", 1, most)
    return written(same.select(F.col("ids")[0].alias("id"), "words", "v", ids.alias("ids"), "n"), f"compared-{uuid.uuid4().hex[:8]}")


def compared(demand: DataFrame, supply: DataFrame, keep: int = 3, bar: float = COVERED_AT) -> tuple[DataFrame, DataFrame]:
    """(matches, counts) of (id, title, v) against (id, title, v); titles and vectors may be null.

    matches (topic, place, item, score): the ``keep`` best items with a score over zero.
    counts (topic, covered): the items that reach the bar; topics without supply have none.
    """
    topics, items = _classes(demand, None), _classes(supply, keep)
    asked, there = _dealt(topics.count(), items.count())
    shaped = lambda rows, is_asked, ids: rows.select(F.lit(is_asked).alias("asked"), "id", "words", "v", ids.alias("ids"), "n")
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = shaped(topics, True, F.array().cast("array<bigint>")).withColumn("d", own(asked)).withColumn("s", every(there))
    sides = sides.unionByName(shaped(items, False, F.col("ids")).withColumn("s", own(there)).withColumn("d", every(asked)))
    # blocks are few bytes and much work: a task each, or nearly
    sides = sides.repartition(min(4 * asked * there, 8192), "d", "s")
    found = sides.groupBy("d", "s").applyInArrow(_compared(keep, bar), "topic bigint, item bigint, score double, covered bigint")
    found = written(found, f"found-{uuid.uuid4().hex[:8]}")
    members = topics.select(F.col("id").alias("class"), F.explode("ids").alias("topic"))
    best = Window.partitionBy("class").orderBy(F.desc("score"), "item")
    matches = found.withColumnRenamed("topic", "class").where("item is not null").withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep)
    counts = found.where("item is null").groupBy(F.col("topic").alias("class")).agg(F.sum("covered").alias("covered"))
    counts = members.join(counts, "class", "left").select("topic", F.coalesce("covered", F.lit(0)).cast("long").alias("covered"))
    return matches.join(members, "class").select("topic", "place", "item", "score"), counts


def verdict(covered: Column, names: tuple[str, str, str] = ("uncovered", "thin", "covered")) -> Column:
    return F.when(covered == 0, names[0]).when(covered < THIN_BELOW, names[1]).otherwise(names[2])


def gap_report(demand: DataFrame, supply: DataFrame, keep: int = 3, bar: float = COVERED_AT) -> DataFrame:
    """One row per topic of (id, title, v, score, countries): covered, verdict, whether it was
    compared by meaning, and the matches by falling score, whether or not any reaches the bar.

    Rows come in no order; ``countries`` and then ``score``, both falling, is the page's.
    """
    matches, counts = compared(demand, supply, keep, bar)
    listed = matches.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("place", "item", F.round("score", 3).alias("similarity")))).alias("matches"))
    topics = demand.select(F.col("id").cast("long").alias("topic"), "title", "score", "countries", F.col("v").isNotNull().alias("by_meaning"))
    out = topics.join(counts, "topic").join(listed, "topic", "left")
    return out.withColumn("verdict", verdict(F.col("covered"))).withColumn("matches", F.coalesce("matches", F.array().cast("array<struct<place:int,item:bigint,similarity:double>>")))
