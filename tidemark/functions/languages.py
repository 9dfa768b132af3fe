"""Language of short texts by script and function words, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.mathx import clamp
from tidemark.functions.text import STOPWORDS, normalise, tokens

SAMPLE, LEAST_CHARS, LEAST_WORDS = 600, 8, 3
# Scripts in the order in which a tie is settled: name, characters, language and
# the most that the script alone says for it.
SCRIPTS = (
    ("arabic", r"\x{600}-\x{6FF}\x{750}-\x{77F}", None, 0.0),
    ("cyrillic", r"\x{400}-\x{4FF}", "ru", 0.85),
    ("han", r"\x{4E00}-\x{9FFF}", "zh", 0.85),
    ("kana", r"\x{3040}-\x{30FF}", "ja", 0.9),
    ("hangul", r"\x{AC00}-\x{D7AF}", "ko", 0.9),
    ("devanagari", r"\x{900}-\x{97F}", "hi", 0.8),
    ("hebrew", r"\x{590}-\x{5FF}", "he", 0.85),
    ("greek", r"\x{370}-\x{3FF}", "el", 0.85),
    ("thai", r"\x{E00}-\x{E7F}", "th", 0.9),
    ("latin", "A-Za-z", None, 0.0),
)
_PERSIAN = "[پچژگکی]"


def _found(words: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in wanted]))) if wanted else F.lit(0)


def _guess(code: Column | None, confidence: Column | float) -> Column:
    return F.struct((F.lit(None) if code is None else code).cast("string").alias("code"), (F.lit(confidence) if isinstance(confidence, float) else confidence).cast("double").alias("confidence"))


def _scores(words: Column, lists: Mapping[str, Sequence[str]]) -> Column:
    """The languages by falling weight of their function words; those that no other language of
    ``lists`` has count fully, shared ones a fifth.  ``fa`` and ``ar`` take no part."""
    lists = {code: own for code, own in lists.items() if code not in ("fa", "ar")}
    owners = {w: sum(w in words for words in lists.values()) for each in lists.values() for w in each}
    scores = []
    for order, (code, own) in enumerate(lists.items()):
        unique = _found(words, [w for w in own if owners[w] == 1])
        shared = _found(words, [w for w in own if owners[w] > 1])
        scores.append(F.struct((unique + 0.2 * shared).alias("score"), F.lit(-order).alias("order"), unique.alias("unique"), F.lit(code).alias("code")))
    return F.sort_array(F.array(*scores), asc=False)


def _latin(best: Column, share: Column) -> Column:
    """The language with most function words."""
    first, second = best[0], F.get(best, F.lit(1))
    margin = F.when(second.isNull() | (first["score"] == 0), 1.0).otherwise((first["score"] - second["score"]) / first["score"])
    sure = clamp(0.4 + 0.5 * margin, 0.3, 0.95) * clamp(first["unique"] / 3, 0.3, 1.0) * share
    # no word that is one language's own: taken for English, with little confidence
    return F.when(first["unique"] == 0, _guess(F.lit("en"), 0.3 * share)).otherwise(_guess(first["code"], sure))


def detect(text: Column, lists: Mapping[str, Sequence[str]] | None = None) -> Column:
    """struct(code, confidence); code null where the text does not say.

    ``lists`` has function words by language (the known ones by default); of them ``fa`` and
    ``ar`` tell texts in Arabic letters apart, the others Latin ones.  Over many rows
    ``detected`` does the same with less work.
    """
    lists = dict(STOPWORDS if lists is None else lists)
    sample = F.substring(text, 1, SAMPLE)
    words = tokens(normalise(sample))
    distinct, counts = F.array_distinct(words), _script_counts(sample)
    total = F.aggregate(counts, F.lit(0), lambda s, n: s + n)
    return _detected(text, sample, words, distinct, total, _top_script(counts), _scores(distinct, lists), lists)


def detected(rows: DataFrame, text: Column, out: str, lists: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``rows`` with ``out``, the ``detect`` of ``text``.

    Words, counts and shares of scripts are columns before anything asks for them, so each is
    made once a row however often it is read.
    """
    before = rows.columns
    rows = rows.withColumn("__sample", F.substring(text, 1, SAMPLE))
    rows = rows.withColumn("__normal", normalise(F.col("__sample"))).withColumn("__sampled", tokens(F.col("__normal")))
    rows = rows.withColumn("__distinct", F.array_distinct("__sampled")).withColumn("__counts", _script_counts(F.col("__sample")))
    rows = rows.withColumn("__total", F.aggregate("__counts", F.lit(0), lambda s, n: s + n)).withColumn("__top", _top_script(F.col("__counts")))
    lists = dict(STOPWORDS if lists is None else lists)
    rows = rows.withColumn("__scores", _scores(F.col("__distinct"), lists))
    found = _detected(text, F.col("__sample"), F.col("__sampled"), F.col("__distinct"), F.col("__total"), F.col("__top"), F.col("__scores"), lists)
    return rows.withColumn(out, found).select(*before, out)


def _script_counts(sample: Column) -> Column:
    """Characters of each of ``SCRIPTS``; ASCII texts hold Latin ones alone."""
    counts = F.array(*[F.char_length(F.regexp_replace(sample, f"[^{chars}]", "")) for _, chars, _, _ in SCRIPTS])
    latin = F.char_length(F.regexp_replace(sample, f"[^{SCRIPTS[-1][1]}]", ""))
    plain = F.array(*[F.lit(0)] * (len(SCRIPTS) - 1), latin)
    return F.when(sample.rlike(r"[^\x00-\x7F]"), counts).otherwise(plain)


def _top_script(counts: Column) -> Column:
    tagged = F.array(*[F.struct(counts[i].alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("script")) for i, (name, *_) in enumerate(SCRIPTS)])
    return F.array_max(tagged)


def _detected(text: Column, sample: Column, words: Column, distinct: Column, total: Column, top: Column, scores: Column, lists: Mapping[str, Sequence[str]]) -> Column:
    share, script = top["n"] / total, top["script"]
    persian, arab = _found(distinct, lists.get("fa", ())), _found(distinct, lists.get("ar", ()))
    by_letters = F.when(sample.rlike(_PERSIAN) | (persian > arab), _guess(F.lit("fa"), clamp(0.55 + 0.05 * persian, 0.0, 0.9))).otherwise(_guess(F.lit("ar"), clamp(0.5 + 0.05 * arab, 0.0, 0.85)))
    nothing = _guess(None, 0.0)
    out = F.when(text.isNull() | (F.char_length(F.trim(sample)) < LEAST_CHARS) | (total == 0), nothing)
    for name, _, code, most in SCRIPTS:
        if code is not None:
            out = out.when(script == name, _guess(F.lit(code), clamp(share, 0.0, most)))
    out = out.when(script == "arabic", by_letters)
    return out.when(F.size(words) < LEAST_WORDS, nothing).otherwise(_latin(scores, share))


def country_of(language: Column, confidence: Column, countries: Mapping[str, str]) -> Column:
    """struct(country, confidence): the one country of a language that has one, at a low confidence."""
    found = F.coalesce(*[F.when(language == code, country) for code, country in countries.items()], F.lit(None).cast("string"))
    return F.struct(found.alias("country"), F.when(found.isNotNull(), clamp(confidence, 0.0, 0.35)).otherwise(0.0).alias("confidence"))
