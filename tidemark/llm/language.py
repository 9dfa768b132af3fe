"""Language identification by Bayesian fusion of text, markup, address and host evidence.

Text: letter trigrams of the whole text under one multinomial per language, learnt by
grouped counting from labelled texts and folded into ``BUCKETS`` cells, so the model that
is broadcast has a fixed size per language.  An extra class ``und`` gives every cell the
same probability; empty texts and unknown scripts fall to it.  A text's log-likelihood is
that of ``EFFECTIVE_TRIGRAMS`` average trigrams at most, as neighbouring ones depend.

Priors: text posteriors are summed per host and per address suffix; a host's prior shrinks
to its suffix's, a suffix's to that of all rows, and each row's own posterior is taken out
of its host first.  Declared languages enter by how often each is declared per language.

Defined edge results: null or empty texts are ``und`` unless declared language and host
say more; null declared languages, hosts and suffixes are no evidence; repeated rows and
ids are scored one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.shingles import in_pieces, mix

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
EFFECTIVE_TRIGRAMS = 40
SMOOTHING = 0.01
HOST_WEIGHT = 20.0
SUFFIX_WEIGHT = 50.0
DECLARED_WEIGHT = 20.0
#: A host says at most this much about one of its pages.
LEAST_PRIOR = 1e-3
UNDETERMINED = "und"
_OTHER = re.compile(r"[\W\d_]+")


def _cells(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every letter trigram; words are set off by single spaces."""
    clean = [" " + _OTHER.sub(" ", t.lower()).strip() + " " if t else "" for t in texts]
    codes = np.frombuffer("".join(clean).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(clean)), np.fromiter((len(c) for c in clean), np.int64, len(clean)))
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    packed = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
    whole = (row[:-2] == row[2:]) & ((codes[1:-1] != 32) | (codes[:-2] != 32))
    whole &= codes[1:-1] != 32
    return row[:-2][whole], (mix(packed[whole]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
        for lo, hi in in_pieces(texts):
            row, cell = _cells(texts[lo:hi])
            for lang in set(langs[lo:hi]):
                mine = cell[langs[lo:hi][row] == lang] if len(row) else cell
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums[lang] += np.bincount(mine, minlength=BUCKETS)
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "bucket", "n"])


@dataclass
class TextModel:
    languages: list[str]
    ref: object  # broadcast (bucket, language + und) log probabilities


def learn(texts: DataFrame, text_col: str = "text", lang_col: str = "lang") -> TextModel:
    """Trigram multinomials of every language that labels a text with a letter."""
    rows = texts.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col)
    counts = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    names = table.column("lang").to_pylist()
    languages = sorted(set(names))
    dense = np.zeros((BUCKETS, len(languages)))
    if names:
        dense[table.column("bucket").to_numpy(), np.searchsorted(languages, names)] = table.column("n").to_numpy()
    logs = np.log((dense + SMOOTHING) / (dense.sum(axis=0) + SMOOTHING * BUCKETS))
    logs = np.column_stack([logs, np.full(BUCKETS, -np.log(BUCKETS))]).astype(np.float32)
    return TextModel(languages, texts.sparkSession.sparkContext.broadcast(logs))


def _likelihoods(ref):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = ref.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for lo, hi in in_pieces(texts):
                row, cell = _cells(texts[lo:hi])
                n = np.bincount(row, minlength=hi - lo)
                means = np.column_stack([np.bincount(row, logs[cell, k], minlength=hi - lo) for k in range(logs.shape[1])]) / np.maximum(n, 1)[:, None]
                weighted = means * np.minimum(n, EFFECTIVE_TRIGRAMS)[:, None]
                weighted[n == 0, :-1] = -3.0  # no letters: und is likelier, but other evidence may win
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(list(weighted), pa.list_(pa.float64()))], names=[*part.schema.names[:-1], "text_log"])

    return run


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raw = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))


def identify(rows: DataFrame, model: TextModel, id_col: str, text: Column, declared: Column | None = None, host: Column | None = None, suffix: Column | None = None) -> DataFrame:
    """(id, language, confidence, text_language, declared, host, suffix), one row per row."""
    classes = [*model.languages, UNDETERMINED]
    none = F.lit(None).cast("string")
    base = rows.select(F.col(id_col).cast("long").alias("id"), (none if declared is None else declared).alias("declared"), (none if host is None else host).alias("host"), (none if suffix is None else suffix).alias("suffix"), text.alias("__text"))
    scored = base.mapInArrow(_likelihoods(model.ref), "id long, declared string, host string, suffix string, text_log array<double>")
    scored = written(scored.withColumn("p", _softmax(F.col("text_log"))), "language-text")

    def sums(*keys: str) -> DataFrame:
        return scored.groupBy(*keys).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(len(classes))]).alias("s"))

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def shrunk(s: Column, parent: Column, weight: float) -> Column:
        return F.transform(F.zip_with(s, parent, lambda x, q: F.struct(F.greatest(x, F.lit(0.0)).alias("x"), q.alias("q"))), lambda z: (z["x"] + weight * z["q"]) / (total(s) + weight))

    # one row for all: the root prior, a fixed number of values
    everything = F.broadcast(scored.agg(F.array(*[F.sum(F.col("p")[i]) + F.lit(1.0) for i in range(len(classes))]).alias("a")).select(F.transform("a", lambda x: x / total(F.col("a"))).alias("root")))
    by_suffix = sums("suffix").where("suffix is not null").crossJoin(everything).select("suffix", shrunk(F.col("s"), F.col("root"), SUFFIX_WEIGHT).alias("suffix_prior"))
    by_host = sums("host").where("host is not null").select("host", F.col("s").alias("host_sum"))
    by_declared = sums("declared").where("declared is not null").select("declared", F.col("s").alias("declared_sum"))

    out = scored.crossJoin(everything).join(by_suffix, "suffix", "left").join(by_host, "host", "left").join(by_declared, "declared", "left")
    parent = F.coalesce("suffix_prior", "root")
    # a row's own posterior is no evidence about itself
    others = F.zip_with(F.col("host_sum"), F.col("p"), lambda s, x: F.greatest(s - x, F.lit(0.0)))
    prior = F.when(F.col("host_sum").isNull(), parent).otherwise(shrunk(others, parent, HOST_WEIGHT))
    out = out.withColumn("prior", F.transform(prior, lambda x: F.greatest(x, F.lit(LEAST_PRIOR))))
    # share of the declared language that each class accounts for, over the class's own share
    lift = F.zip_with(F.zip_with("declared_sum", "p", lambda s, x: F.greatest(s - x, F.lit(0.0))), "root", lambda s, q: F.log((s + DECLARED_WEIGHT * q) / (q + 1e-9)))
    evidence = F.when(F.col("declared_sum").isNull(), F.transform("root", lambda _: F.lit(0.0))).otherwise(lift)
    logs = F.zip_with(F.zip_with("text_log", "prior", lambda t, q: t + F.log(q)), evidence, lambda t, e: t + e)
    out = out.withColumn("posterior", _softmax(logs))
    names = F.array(*[F.lit(c) for c in classes])
    best = lambda c: names[F.array_position(F.col(c), F.array_max(c)).cast("int") - 1]
    return out.select("id", best("posterior").alias("language"), F.array_max("posterior").alias("confidence"), best("p").alias("text_language"), "declared", "host", "suffix")


def page_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags removed."""
    clean = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(clean, r"(?s)<[^>]*>", " "), r"&[#\w]+;", " ")


def declared_language(html: Column) -> Column:
    found = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.when(found != "", found)


def url_host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    host = url_host(F.col("url"))
    suffix = F.when(host.contains("."), F.substring_index(host, ".", -1))
    return identify(pages, model, "page_id", page_text(F.col("html")), declared_language(F.col("html")), host, suffix)
