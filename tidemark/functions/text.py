"""Text functions: normalising, tokens, entities, title features, markup, near-duplicates."""

from __future__ import annotations

import heapq
import re
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.sources.tables import written

# Words that carry no topic, by language.  Further languages are a parameter
# of the functions that take ``stop``.
STOPWORDS = {
    "en": (
        "the a an and or but if of to in on for with as at by from is are was were be been being it its this that these those i you he she we they my your his her our their "
        "not no so than then there here what which who whom how when where why all any can will just do does did have has had about after before over under up down out into new "
        "more most very also get got one two like make made best top via vs dont quot amp nbsp apos href http https www com"
    ).split(),
    "es": "el la los las un una de del y o que en con por para se su al lo como más pero sus le ya este esta son fue ser es no muy".split(),
    "fr": "le la les un une de des du et ou que qui en dans avec pour par sur au aux ce cette est sont pas ne plus comme mais".split(),
    "de": "der die das ein eine und oder von zu mit für auf im in den dem des ist sind war nicht auch als aber wie man sich bei nach".split(),
}
ALL_STOPWORDS = sorted({w for words in STOPWORDS.values() for w in words})

#: Edges of words of ASCII letters, digits and underscores; the engine's own edge is Unicode's.
_START, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

# Patterns of titles and entities.
_DIGIT = "[0-9۰-۹٠-٩]"
_HASHTAG = r"#([\p{L}\p{N}_]{2,50})"
_MENTION = r"@([A-Za-z0-9_.]{2,40})"
_URL = r"https?://[^\s<>\"')]+"
_PROPER = _START + r"([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,}){0,3})" + _END
_YOU = {
    "en": "(?i)" + _START + "(you|your|yours|yourself)" + _END,
    "fa": r"(^|\s)(شما|تو|شمارو|تورو|خودت|خودتان|خودتون)(\s|$)|(ید|تون|تان)(\s|$)",
    "ar": r"(^|\s)(أنت|أنتم|انت|انتم|لك|لكم|نفسك)(\s|$)",
}
_LISTED = {
    "en": "(?i)" + _START + "(ways?|things?|tips?|reasons?|steps?|rules?|facts?)" + _END,
    "fa": "(روش|راه|نکته|دلیل|مورد|قدم|ترفند|چیز)",
    "ar": "(طرق|طريقة|أشياء|نصائح|أسباب|خطوات|حقائق)",
}
#: Pictographs lie in these blocks.
_EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F000}-\x{1F2FF}\x{2B05}-\x{2B55}\x{2190}-\x{21AA}\x{231A}-\x{23FF}\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}]"
_LENGTHS = ((30, "0-30"), (50, "31-50"), (70, "51-70"), (100, "71-100"), (None, "100+"))
_WORDS = ((4, "1-4"), (8, "5-8"), (12, "9-12"), (18, "13-18"), (None, "19+"))


#: Characters that folding changes: Arabic letters, digits and marks, and marks without width.
_FOLDED = r"[\x{600}-\x{6FF}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}]"


def _folded(text: Column) -> Column:
    """Arabic letters and digits in one form each, no vowel marks; texts without any are left."""
    t = F.regexp_replace(text, r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}]", " ")
    # alef forms to alef, both yehs to Persian yeh, kaf to Persian kaf, teh marbuta to heh; digits
    t = F.translate(t, "أإآٱىيكة٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "ااااییکه01234567890123456789")
    return F.when(text.rlike(_FOLDED), F.regexp_replace(t, r"[\x{64B}-\x{652}\x{670}]", "")).otherwise(text)


def normalise_composed(text: Column) -> Column:
    """The part of normalising that Spark has: fold Arabic letters and digits, lower, drop URLs."""
    t = F.regexp_replace(F.lower(_folded(text)), r"https?://\S+", " ")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}#@_\s]+", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition: the one step without a built-in."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalise(text: Column) -> Column:
    """ASCII is composed already, so only other texts go through Python."""
    other = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return normalise_composed(F.coalesce(nfkc(other), text))


def tokens(normalised: Column) -> Column:
    """Words of a normalised text; a run of Chinese or Japanese characters gives its pairs."""
    def pairs(run: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.char_length(run) - 1, F.lit(1)))
        return F.transform(places, lambda i: F.substr(run, i, F.lit(2)))

    parts = F.filter(F.split(normalised, " "), lambda p: p != "")
    return F.flatten(F.transform(parts, lambda p: F.when(p.rlike(r"^[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]+$"), pairs(p)).otherwise(F.array(p))))


def words_of(text: Column) -> Column:
    return tokens(normalise(text))


def content_tokens(words: Column, stop: Sequence[str] = ALL_STOPWORDS) -> Column:
    """Longer than one character, no stop word, not all digits."""
    return F.filter(words, lambda t: (F.char_length(t) > 1) & ~t.isin(*stop) & ~t.rlike(r"^[0-9]+$") & ~t.startswith("@"))


def content_words(rows: DataFrame, text: Column, *keep: str, stop: Sequence[str] = ALL_STOPWORDS) -> DataFrame:
    """One row per content token of ``text``: ``keep`` and ``term``; plain filters after the split."""
    t = F.col("term")
    return rows.select(*keep, F.explode(words_of(text)).alias("term")).where((F.char_length(t) > 1) & ~t.isin(*stop) & ~t.rlike("^[0-9]+$") & ~t.startswith("@"))


def top_words(rows: DataFrame, text: Column, key: str = "id") -> DataFrame:
    """(key, place, term, n): the ``KEYWORDS`` most used content tokens of each key, ties by name.

    A key's words are counted in its row; those of keys that stand in several rows are
    counted over all of these.
    """
    rows = rows.select(key, normalise(text).alias("__normal"))
    rows = written(rows, f"normal-{uuid.uuid4().hex[:8]}")
    many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col(key).alias("__many"))
    same = F.col(key).eqNullSafe(F.col("__many"))
    single = rows.join(many, same, "left_anti").select(key, F.posexplode(most_used("__normal")).alias("place", "x")).select(key, (F.col("place") + 1).cast("long").alias("place"), "x.term", "x.n")
    words = rows.join(many, same, "left_semi").select(key, F.explode(content_tokens(tokens(F.col("__normal")))).alias("term"))
    best = Window.partitionBy(key).orderBy(F.desc("n"), "term")
    counts = words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.row_number().over(best).cast("long"))
    return single.unionByName(counts.where(F.col("place") <= KEYWORDS))


# In turn, endings that go, and what is left.  A mark before the word says that it
# may change.
STEM_STEPS = (
    ("^~(.{2,})ies$", "~$1i"),
    ("^~(.*ss)es$", "~$1"),
    ("^~(.{2,}[^s])s$", "~$1"),
    ("^~(?:(.{3,})ing|(.{3,})ed)$", "~$1$2"),
    ("^~(.{3,})ion$", "~$1"),
    ("^~(.{3,})y$", "~$1i"),
    ("^~(.{4,})e$", "~$1"),
)


def _replacing(pattern: str, left: str):
    return lambda w: F.regexp_replace(w, pattern, left)


def stems(words: Column) -> Column:
    """Folds endings of Latin words of four letters or more, so that variants of a word meet."""
    out = F.transform(words, lambda w: F.when(w.rlike("^[a-z]{4,}$"), F.concat(F.lit("~"), w)).otherwise(w))
    for pattern, left in STEM_STEPS:
        out = F.transform(out, _replacing(pattern, left))
    return F.transform(out, lambda w: F.ltrim(w, F.lit("~")))


def stem(token: Column) -> Column:
    return F.get(stems(F.array(token)), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    places = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    return F.when(F.size(tokens) >= n, F.transform(places, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def hashtags(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_HASHTAG), 1), F.lower))


def mentions(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_MENTION), 1), F.lower))


def urls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_URL), 0))


def proper_nouns(text: Column, most: int = 12) -> Column:
    """Runs of one to four capitalised words, stop words left out; the first ``most``."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(_PROPER), 1))
    return F.slice(F.filter(found, lambda p: ~F.lower(p).isin(*ALL_STOPWORDS)), 1, most)


def domain(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))
    return F.when(host != "", F.regexp_replace(host, r"^www\.", ""))


def strip_html(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for name, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(to))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def title_features(title: Column, lang: Column) -> dict[str, Column]:
    """Nine features; address and lists have words in the languages that are known."""
    def spoken(patterns: dict[str, str]) -> Column:
        return F.coalesce(*[F.when(lang == code, title.rlike(pattern)) for code, pattern in patterns.items()], F.lit(False))

    return {
        "question": title.rlike("[?？؟]"),
        "exclaim": title.rlike("[!！]"),
        "number": title.rlike(_DIGIT),
        "emoji": title.rlike(_EMOJI),
        "hashtag": title.rlike(r"(^|\s)#\S"),
        "bracket": title.rlike("[\"'«»“”()\\[\\]{}]"),
        "shout": title.rlike(_START + "[A-Z]{3,}" + _END),
        "you": spoken(_YOU),
        "listicle": title.rlike(r"^\s*" + _DIGIT) | (title.rlike(_DIGIT) & spoken(_LISTED)),
    }


def _band(value: Column, bands: tuple) -> Column:
    out = F.lit(bands[-1][1])
    for top, name in reversed(bands[:-1]):
        out = F.when(value <= top, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def length_band(chars: Column) -> Column:
    return _band(chars, _LENGTHS)


def word_band(words: Column) -> Column:
    return _band(words, _WORDS)


def char_count(title: Column) -> Column:
    """Code points, white space at the ends apart."""
    return F.char_length(F.trim(title))


def word_count(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def word_overlap(topic: Column, item: Column) -> Column:
    """Shared words of three characters or more over the topic's words."""
    def words(t: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(t), r"[\s\p{P}]+"), lambda w: F.char_length(w) >= 3))

    a, b = words(topic), words(item)
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two 64-bit numbers."""
    return F.bit_count(a.bitwiseXOR(b))


def fnv64(word: str) -> int:
    """FNV-1a over UTF-16 code units, 64 bits."""
    h = 0xCBF29CE484222325
    for unit in array("H", word.encode("utf-16-le", "surrogatepass")):
        h = (h ^ unit) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def _voted(uses: Mapping[str, int], hashes: dict[str, int]) -> int:
    for name in uses:
        if name not in hashes:
            hashes[name] = fnv64(name)
    h = np.fromiter((hashes[name] for name in uses), "<u8", len(uses))
    n = np.fromiter(uses.values(), np.float64, len(uses))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * (n @ bits) > n.sum(), bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def simhash(words: pd.Series) -> pd.Series:
    """64-bit SimHash of a list of content tokens: each token's hash votes on each bit, once per
    use.  No token, no bit; null stays null."""
    hashes: dict[str, int] = {}
    return pd.Series([None if some is None else _voted(Counter(some), hashes) for some in words], dtype="Int64")


_RUN = re.compile("[\u3040-\u30FF\u4E00-\u9FFF]+")
_NO_TOPIC = frozenset(ALL_STOPWORDS)


def _content(normalised: str | None) -> list[str]:
    """``content_tokens`` of ``tokens``, in one pass over a normalised text."""
    words = (normalised or "").split(" ")
    if _RUN.search(normalised or ""):
        words = [w for p in words for w in ([p[i : i + 2] for i in range(max(1, len(p) - 1))] if _RUN.fullmatch(p) else (p,))]
    return [w for w in words if len(w) > 1 and w not in _NO_TOPIC and w[0] != "@" and not (w.isascii() and w.isdigit())]


_LATIN = re.compile("[a-z]{4,}")
_ENDINGS = tuple((re.compile(pattern), re.sub(r"\$(\d)", r"\\\1", left)) for pattern, left in STEM_STEPS)


@lru_cache(1 << 17)
def _stem(word: str) -> str:
    """``stems`` of one word."""
    if _LATIN.fullmatch(word):
        word = "~" + word
        for pattern, left in _ENDINGS:
            word = pattern.sub(left, word)
    return word.lstrip("~")


_PARSED = T.StructType([T.StructField("raw", T.ArrayType(T.StringType())), T.StructField("w", T.ArrayType(T.StringType())), T.StructField("simhash", T.LongType())])


@F.pandas_udf(_PARSED)
def parsed(normalised: pd.Series) -> pd.DataFrame:
    """Content tokens, their stems and their SimHash of normalised texts, in one pass; null has none."""
    hashes: dict[str, int] = {}
    lists = [_content(some) for some in normalised]
    return pd.DataFrame({"raw": lists, "w": [[_stem(w) for w in some] for some in lists], "simhash": pd.Series([_voted(Counter(some), hashes) for some in lists], dtype="int64")})


#: Content tokens that become an item's keywords.
KEYWORDS = 10


def _best(uses: Mapping[str, int]) -> list[tuple[str, int]]:
    return heapq.nsmallest(KEYWORDS, uses.items(), key=lambda p: (-p[1], p[0]))


_DIGEST = T.StructType([T.StructField("simhash", T.LongType()), T.StructField("keywords", T.ArrayType(T.StringType()))])


def _digested(lists: Iterable[Sequence[str]]) -> pd.DataFrame:
    hashes: dict[str, int] = {}
    counts = [Counter(some) for some in lists]
    return pd.DataFrame([(_voted(uses, hashes), [name for name, _ in _best(uses)]) for uses in counts], columns=["simhash", "keywords"])


@F.pandas_udf(_DIGEST)
def token_digest(words: pd.Series) -> pd.DataFrame:
    """SimHash and most used tokens, ties by name, in one pass over the tokens."""
    return _digested(() if some is None else some for some in words)


@F.pandas_udf(_DIGEST)
def text_digest(normalised: pd.Series) -> pd.DataFrame:
    """``token_digest`` of the content tokens of normalised texts, which leave no list of tokens."""
    return _digested(map(_content, normalised))


@F.pandas_udf(T.LongType())
def text_simhash(normalised: pd.Series) -> pd.Series:
    """``simhash`` of the content tokens of normalised texts; null stays null."""
    hashes: dict[str, int] = {}
    return pd.Series([None if some is None else _voted(Counter(_content(some)), hashes) for some in normalised], dtype="Int64")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])))
def most_used(normalised: pd.Series) -> pd.Series:
    """The ``KEYWORDS`` most used content tokens of normalised texts with their uses, ties by name."""
    return pd.Series([[{"term": name, "n": n} for name, n in _best(Counter(_content(some)))] for some in normalised], dtype=object)


@F.pandas_udf(T.StringType())
def content_id(source: pd.Series, external: pd.Series) -> pd.Series:
    """``source:`` and the base-36 hash of the source's own id; null if either is."""
    return pd.Series([None if a is None or b is None else f"{a}:{np.base_repr(fnv64(b), 36).lower()}" for a, b in zip(source, external)], dtype=object)


def csv_field(value: Column) -> Column:
    """Quoted where needed; text that a spreadsheet would run gets an apostrophe first."""
    safe = F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(safe.rlike(r'[",\r\n]'), quoted).otherwise(F.coalesce(safe, F.lit("")))
