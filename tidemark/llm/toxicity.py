"""Toxicity from class-conditional Kneser-Ney models.

Two character 5-gram models, one of toxic and one of ordinary labelled texts, score
every word.  Their highest order is counted per class; all lower orders are Kneser-Ney
continuation counts over both classes together, so an expression that is rare in either
class backs off to the same shared estimate and says little.  A text's evidence is the
difference of both log-likelihoods of all its words, divided by their letters, and that of
its three strongest words, divided by theirs; a logistic fit turns these into a probability.

A word is an unbroken run of letters, marks and digits and is counted and scored whole; the
models do not read across words.  One of more than ``LONG_RUN`` letters may be a text
without spaces: it counts whole in the text's evidence, and its strongest stretches of
``STRETCH`` letters, which do not overlap, stand among the strongest words.

Counting is grouped aggregation over all labelled training rows: words, then 5-grams,
then continuation counts.  The finished statistics are hash tables of every gram and context
under its own 64-bit key, so grams never share a count (n keys collide with probability
n**2 / 2**65).  They are broadcast and grow with the distinct grams of the labelled texts,
by 17 to 33 bytes a gram.  Texts are never shuffled for scoring.

The logistic is fitted on one part of the labelled rows, scored by models of the other
parts, and sees at most ``CALIBRATION_ROWS`` rows, the only bound on what is learnt from;
the final models then count all parts.

Defined edge results: null texts, empty ones and texts without a letter or digit score the calibrated prior without evidence;
labels that are null are ignored; an id labelled twice counts with each label; with no
label of either class every score is the prior 0.5-smoothed share of toxic labels; other
columns may have any names; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import nlargest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, probably_in, unused, written
from tidemark.llm.pretoken import Learnt
from tidemark.llm.shingles import mix

ORDER = 5
DISCOUNT = 0.9
ALPHABET = 4096.0
CALIBRATION_ROWS = 20_000
CACHED_WORDS = 150_000
#: Rows whose words are looked up together.
ROWS_AT_ONCE = 1024
LONG_RUN = 64
STRETCH = 12
#: Letters of a long run that are scored at once.
RUN_LETTERS = 1 << 16
_PIECE = "\u0001"
#: Key of the empty context.
_ROOT = np.uint64(1)
_PAD = "\u0002" * (ORDER - 1)
_END = "\u0003"


def word_lists(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(row, distinct words, code): word i of all texts is ``distinct[code[i]]`` of ``row[i]``."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}\p{N}]+")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    named = lists.flatten().dictionary_encode()
    distinct, code = named.dictionary.to_numpy(zero_copy_only=False).tolist(), named.indices.to_numpy()
    if "" in distinct:  # before the first word or after the last one
        words = code != distinct.index("")
        row, code = row[words], code[words]
    return row, distinct, code


def _gram_hash(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` code points that end at each position."""
    h = np.full(len(codes), order, np.uint64)
    for k in range(order - 1, -1, -1):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[k:] = codes[: len(codes) - k] if k else codes
        h = (h + shifted + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return mix(h)


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


class Cells:
    """Pairs of counts by 64-bit key: open addressing, laid out in one pass."""

    def __init__(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray):
        order = np.argsort(keys)
        keys = np.maximum(keys[order], 1)  # 0 marks an empty cell
        self.shift = np.uint64(64 - max(int(len(keys) / 0.7).bit_length(), 1))
        i = np.arange(len(keys))
        at = np.maximum.accumulate((keys >> self.shift).astype(np.int64) - i) + i
        size = max(1 << (64 - int(self.shift)), int(at[-1]) + 1 if len(at) else 0) + 1  # the last cell is empty
        self.keys, self.values = np.zeros(size, np.uint64), np.zeros((2, size), np.float32)
        self.keys[at], self.values[:, at] = keys, (a[order], b[order])

    def at(self, h: np.ndarray) -> np.ndarray:
        """The cell of each key, or an empty one."""
        h = np.maximum(h, np.uint64(1))
        cell = (h >> self.shift).astype(np.int64)
        key = self.keys[cell]
        other = np.flatnonzero((key != h) & (key != 0))
        while len(other):
            cell[other] += 1
            key = self.keys[cell[other]]
            other = other[(key != h[other]) & (key != 0)]
        return cell


def _no_cells() -> Cells:
    return Cells(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))


@dataclass
class KneserNey:
    """Per-class top order, shared lower orders; ``context`` k stands before a k-gram."""

    gram: Cells = field(default_factory=_no_cells)
    total: Cells = field(default_factory=_no_cells)
    types: Cells = field(default_factory=_no_cells)  # has the keys of total, so its cells too
    low_gram: dict[int, Cells] = field(default_factory=lambda: {k: _no_cells() for k in range(1, ORDER)})
    low_context: dict[int, Cells] = field(default_factory=lambda: {k: _no_cells() for k in range(1, ORDER)})

    def evidence(self, words: list[str], at_once: int = 8192) -> np.ndarray:
        """(log p(word | toxic) - log p(word | ordinary)) / length, for each word."""
        return np.concatenate([self._evidence(words[i : i + at_once]) for i in range(0, len(words), at_once)])

    def _evidence(self, words: list[str]) -> np.ndarray:
        padded = [_PAD + w + _END for w in words]
        codes = _codes(padded)
        lengths = np.fromiter((len(p) for p in padded), np.int64, len(padded))
        starts = np.cumsum(lengths) - lengths
        real = np.arange(len(codes)) - np.repeat(starts, lengths) >= ORDER - 1
        sums = np.add.reduceat(self._ratios(codes) * real, starts)
        return sums / (lengths - (ORDER - 1))

    def run_evidence(self, run: str, strongest: int = 3) -> tuple[float, list[float]]:
        """A long run's evidence over all its letters, and that of its strongest stretches."""
        codes = _codes([_PAD + run + _END])
        first = range(ORDER - 1, len(codes), RUN_LETTERS)
        ratio = np.concatenate([self._ratios(codes[i - (ORDER - 1) : i + RUN_LETTERS])[ORDER - 1 :] for i in first])
        sums = np.concatenate([[0.0], np.cumsum(ratio)])
        stretches = (sums[STRETCH:] - sums[:-STRETCH]) / STRETCH
        best = []
        while len(best) < strongest:
            at = int(stretches.argmax())
            if stretches[at] == -np.inf:
                break
            best.append(float(stretches[at]))
            stretches[max(at - STRETCH + 1, 0) : at + STRETCH] = -np.inf
        return float(ratio.mean()), best

    def _ratios(self, codes: np.ndarray) -> np.ndarray:
        """log p(code | toxic) - log p(code | ordinary) after the four codes before it."""
        p = np.full(len(codes), 1 / ALPHABET)
        hashes = {k: _gram_hash(codes, k) for k in range(1, ORDER + 1)}
        before = {k: np.concatenate([[np.uint64(0)], hashes[k][:-1]]) for k in range(1, ORDER)}
        for k in range(1, ORDER):
            context = self.low_context[k].at(before[k - 1] if k > 1 else np.full(len(codes), _ROOT))
            total, types = self.low_context[k].values[:, context]
            own = np.maximum(self.low_gram[k].values[0, self.low_gram[k].at(hashes[k])] - DISCOUNT, 0)
            p = np.where(total > 0, (own + DISCOUNT * types * p) / np.maximum(total, 1), p)
        context, gram = self.total.at(before[ORDER - 1]), self.gram.at(hashes[ORDER])
        logs = []
        for y in (1, 0):
            total, types = self.total.values[y, context], self.types.values[y, context]
            own = np.maximum(self.gram.values[y, gram] - DISCOUNT, 0)
            logs.append(np.log(np.where(total > 0, (own + DISCOUNT * types * p) / np.maximum(total, 1), p)))
        return logs[0] - logs[1]


def remainder(id_col: Column, parts: int = 4) -> Column:
    """crc32 of the id as text, modulo ``parts``: the split of labelled rows."""
    return F.crc32(id_col.cast("string").cast("binary")) % parts


def counted_pieces(words: list[str]) -> list[str]:
    """The words, long runs as marked pieces of their padded form.

    Pieces overlap by ``ORDER`` - 1 letters, so each 5-gram of a run lies in one of them.
    """
    if not words or max(map(len, words)) <= LONG_RUN:
        return words
    out = []
    for w in words:
        if len(w) <= LONG_RUN:
            out.append(w)
        else:
            padded = _PAD + w + _END
            out += [_PIECE + padded[i : i + LONG_RUN + ORDER - 1] for i in range(0, len(padded) - ORDER + 1, LONG_RUN)]
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic, later = batch.column(1).to_numpy() == 1, batch.column(2).to_numpy(zero_copy_only=False)
        row, distinct, code = word_lists(batch.column(0))
        counts = []
        for of_class, rows in ((~toxic, ~later), (toxic, ~later), (~toxic, ~later | later), (toxic, ~later | later)):
            counts.append(np.bincount(code, (of_class & rows)[row], len(distinct)).astype(np.int64))
        long = [i for i, w in enumerate(distinct) if len(w) > LONG_RUN]
        pieces = [(piece, i) for i in long for piece in counted_pieces([distinct[i]])]
        at = np.array([*np.setdiff1d(np.flatnonzero(counts[2] + counts[3]), long), *[i for _, i in pieces]], np.int64)
        words = [distinct[i] for i in at[: len(at) - len(pieces)]] + [p for p, _ in pieces]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array(c[at]) for c in counts]], names=["word", "first0", "first1", "all0", "all1"])


def word_counts(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", later_col: str = "later") -> DataFrame:
    """(word, first0, first1, all0, all1): uses of each word, or piece of a long run, in
    ordinary (0) and toxic (1) texts, over the rows that are not ``later`` and over all."""
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(text_col, F.col(label_col).cast("int"), later_col)
    names = ["first0", "first1", "all0", "all1"]
    counted = rows.mapInArrow(_count_words, "word string, " + ", ".join(f"{n} long" for n in names))
    return counted.groupBy("word").agg(*[F.sum(n).alias(n) for n in names])


def _keyed(kind: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(0).to_pylist()
            if grams and order:
                key = _gram_hash(_codes(grams), order)[order - 1 :: order]
            else:
                key = np.full(len(grams), _ROOT)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), kind, np.int32)), pa.array(key.view(np.int64)), batch.column(1).cast(pa.float64()), batch.column(2).cast(pa.float64())], names=["kind", "key", "a", "b"])

    return run


def gram_counts(words: DataFrame) -> DataFrame:
    """(g, first0, first1, all0, all1): padded character 5-grams of all words."""
    names = ["first0", "first1", "all0", "all1"]
    whole = F.concat(F.lit(_PAD), F.col("word"), F.lit(_END))
    padded = F.when(F.col("word").startswith(_PIECE), F.col("word").substr(2, LONG_RUN + ORDER - 1)).otherwise(whole)
    places = F.sequence(F.lit(1), F.char_length(padded) - (ORDER - 1))
    grams = words.select(*names, F.explode(F.transform(places, lambda i: padded.substr(i, F.lit(ORDER)))).alias("g"))
    return grams.groupBy("g").agg(*[F.sum(n).alias(n) for n in names])


def statistics(grams: DataFrame, which: str) -> DataFrame:
    """(kind, key, a, b): every Kneser-Ney statistic, one row a gram; kinds are table numbers.

    0: 5-gram counts by class; 1: context totals by class; 2: context types by class;
    10 + k: continuation counts of k-grams; 20 + k: their contexts' totals and types.
    """
    top = grams.select("g", F.col(f"{which}0").alias("a"), F.col(f"{which}1").alias("b")).where("a + b > 0")
    seen = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0))
    context = top.groupBy(F.substring("g", 1, ORDER - 1).alias("c"))
    shape = "kind int, key long, a double, b double"
    parts = [
        top.select("g", "a", "b").mapInArrow(_keyed(0, ORDER), shape),
        context.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).mapInArrow(_keyed(1, ORDER - 1), shape),
        context.agg(seen("a").alias("a"), seen("b").alias("b")).mapInArrow(_keyed(2, ORDER - 1), shape),
    ]
    higher = top.select("g")
    for k in range(ORDER - 1, 0, -1):
        level = written(higher.groupBy(F.substring("g", 2, k).alias("g")).agg(F.count(F.lit(1)).alias("n")), "continuations")
        parts.append(level.select("g", "n", F.lit(0).alias("z")).mapInArrow(_keyed(10 + k, k), shape))
        contexts = level.groupBy(F.substring("g", 1, k - 1).alias("c")).agg(F.sum("n").alias("a"), F.count(F.lit(1)).alias("b"))
        parts.append(contexts.mapInArrow(_keyed(20 + k, k - 1), shape))
        higher = level.select("g")
    keyed = parts[0]
    for part in parts[1:]:
        keyed = keyed.unionByName(part)
    return keyed


def collected(stats: DataFrame) -> KneserNey:
    """The tables on the driver: a row for each distinct gram and context."""
    table = stats.select("kind", "key", F.col("a").cast("float").alias("a"), F.col("b").cast("float").alias("b")).toArrow()
    kind, key, a, b = (table.column(c).to_numpy() for c in ("kind", "key", "a", "b"))

    def cells(which: int) -> Cells:
        mine = np.flatnonzero(kind == which)
        return Cells(key[mine].view(np.uint64), a[mine], b[mine])

    orders = range(1, ORDER)
    return KneserNey(cells(0), cells(1), cells(2), {k: cells(10 + k) for k in orders}, {k: cells(20 + k) for k in orders})


FEATURES = ("mean", "first", "second", "third", "length")


def _evidence_rows(model: KneserNey, texts: pa.Array, known: Learnt) -> np.ndarray:
    """The features of each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    row, distinct, code = word_lists(texts)
    if not len(code):
        return out
    runs = {i: model.run_evidence(w) for i, w in enumerate(distinct) if len(w) > LONG_RUN}
    value = np.zeros(len(distinct))
    short = [i for i, w in enumerate(distinct) if w and i not in runs]
    value[short] = known.of([distinct[i] for i in short])
    for i, (whole, _) in runs.items():
        value[i] = whole
    letters = np.fromiter(map(len, distinct), np.float64, len(distinct)) + 1  # and the end of the word
    total = np.bincount(row, letters[code], len(texts))
    out[:, 0] = np.bincount(row, value[code] * letters[code], len(texts)) / np.maximum(total, 1)
    out[:, 4] = np.log1p(np.bincount(row, minlength=len(texts)))

    pairs = np.unique(row * len(distinct) + code)
    row, code = pairs // len(distinct), pairs % len(distinct)
    order = np.lexsort((-value[code], row))
    row, code = row[order], code[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    best = place < 3
    out[row[best], 1 + place[best]] = value[code[best]]
    for text in np.unique(row[np.isin(code, list(runs))]) if runs else ():
        mine = code[row == text].tolist()
        stretches = [x for i in mine for x in (runs[i][1] if i in runs else [value[i]])]
        strongest = nlargest(3, stretches)
        out[text, 1:4] = 0
        out[text, 1 : 1 + len(strongest)] = strongest
    return out


def _features(model_ref):
    """The features in place of the text, which is the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_ref.value
        known = Learnt(lambda words: model.evidence(words).tolist(), CACHED_WORDS)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(lo, ROWS_AT_ONCE)
                values = _evidence_rows(model, part.columns[-1], known)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(c) for c in values.T]], names=[*part.schema.names[:-1], *FEATURES])

    return run


@dataclass
class Scorer:
    model_ref: object
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def _scores(self, out: str):
        ref, mean, scale, weights, bias = self.model_ref, self.mean, self.scale, self.weights, self.bias

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _features(ref)(batches):
                columns, values = part.columns[: -len(FEATURES)], part.columns[-len(FEATURES) :]
                z = (np.column_stack([v.to_numpy() for v in values]) - mean) / scale @ weights + bias
                yield pa.RecordBatch.from_arrays([*columns, pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], names=[*part.schema.names[: -len(FEATURES)], out])

        return run

    def scored_rows(self, docs: DataFrame, text_col: str = "text", out: str = "score") -> DataFrame:
        """All columns of ``docs`` and the score as ``out``, a new name, without moving a row."""
        if out in docs.columns:
            raise ValueError(f"there is a column {out}")
        rows = docs.withColumn(unused(docs.columns, "text_"), F.col(text_col).cast("string"))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        return rows.mapInArrow(self._scores(out), f"{fields}, `{out}` double")

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, score): probability that a text is toxic, for every row."""
        base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        return self.scored_rows(base).select("id", "score")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, float]:
    """Newton's method on the ridge-penalised logistic loss."""
    design = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        slope = design.T @ (p - y) + penalty * w
        curve = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(penalty)
        move = np.linalg.solve(curve, slope)
        w -= move * min(1.0, 5 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", calibration: int = 3, parts: int = 4, held_out: int | None = 2) -> Scorer:
    """Models from the labelled rows, leaving out remainder ``held_out``.

    Remainder ``calibration`` fits the logistic.
    """
    spark = docs.sparkSession
    part = remainder(F.col(id_col), parts)
    used = F.lit(True) if held_out is None else part != held_out
    texts = docs.select(id_col, text_col).where(F.col(id_col).isNotNull() & used)
    marks = labels.select(id_col, label_col).where(F.col(label_col).isin(0, 1) & used)
    # a sorted join at every size: labels grow with the corpus, and so does what it moves
    both = probably_in(texts, marks, id_col).join(marks.hint("merge"), id_col).withColumn("later", part == calibration)
    grams = written(gram_counts(word_counts(both, text_col, label_col)), "grams")
    model_ref = spark.sparkContext.broadcast(collected(statistics(grams, "first")))

    few = marks.where(part == calibration).orderBy(F.xxhash64(id_col), id_col, label_col).limit(CALIBRATION_ROWS)
    sample = probably_in(texts.where(part == calibration), few, id_col).join(few, id_col)
    rows = sample.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(_features(model_ref), "id long, " + ", ".join(f"{f} double" for f in FEATURES))
    rows = rows.join(few.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")), "id")
    table = rows.select(*FEATURES, "y").toPandas()
    model_ref.destroy()
    model_ref = spark.sparkContext.broadcast(collected(statistics(grams, "all")))
    discard(grams)
    x, y = table[list(FEATURES)].to_numpy(), table["y"].to_numpy()
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        zero = np.zeros(len(FEATURES))
        return Scorer(model_ref, zero, zero + 1, zero, float(np.log(share / (1 - share))))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights, bias = _logistic((x - mean) / scale, y)
    return Scorer(model_ref, mean, scale, weights, bias)
