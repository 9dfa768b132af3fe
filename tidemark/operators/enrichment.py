"""What an item gets from its own text, and when it has to be worked out again.

Enriching looks at one row at a time: no row is shuffled.  A stored row keeps a digest of the text it
was enriched from and the number of the rules that did it, so a sweep over all that is stored
computes only rows whose text or rules have changed, and writes only the parts that hold any.

A country that a source stated is never touched; one that was read off the language may change
with it, and the row says which it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import languages
from tidemark.functions import text as t
from tidemark.sources.stored import StoredTable, newest_by
from tidemark.sources.tables import written

# Languages that are mostly one country's.
LANGUAGE_COUNTRY = {"fa": "IR", "ja": "JP", "ko": "KR", "th": "TH", "he": "IL", "el": "GR", "tr": "TR", "pl": "PL", "id": "ID", "vi": "VN", "hi": "IN"}
# How many hashtags an item keeps.
HASHTAGS = 15
#: How a country that was read off the language is marked.
BY_LANGUAGE = "language"
#: Number of the rules below; a change of any of them takes the next.
RULES = 1

FIELDS = ("lang", "lang_confidence", "country", "country_confidence", "country_source", "keywords", "hashtags", "simhash")


def item_text() -> Column:
    return F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))


def digest() -> Column:
    """Of what enriching reads: title, body and the tags that the source gave."""
    return F.xxhash64("title", "body", F.to_json(F.array_sort(F.coalesce("tags", F.array().cast("array<string>")))))


def enriched(items: DataFrame, lists: Mapping[str, Sequence[str]] | None = None, countries: Mapping[str, str] = LANGUAGE_COUNTRY) -> DataFrame:
    """Items with ``FIELDS``, of (title, body, tags, stated_country, stated_confidence,
    stated_source); a stated country goes before the one of the language.

    Null titles and bodies are empty; a text that says no language has none, and no country by
    it.  Keywords are the ten most used content tokens, ties by name.  Normalised texts are written when
    this is called.
    """
    rows = items.withColumn("__text", item_text()).withColumn("__normal", t.normalise(F.col("__text")))
    rows = rows.withColumn("__tags", t.hashtags(F.col("__text"))).withColumn("__text", F.substring("__text", 1, languages.SAMPLE))
    # composed texts come out of one Python step and go into the next, which the planner does not
    # always split; written, they are read by the second alone, and made once
    rows = written(rows, f"texts-{uuid.uuid4().hex[:8]}").withColumn("__tokens", t.text_digest("__normal")).drop("__normal")
    rows = languages.detected(rows, F.col("__text"), "__lang", lists)
    guess = languages.country_of(F.col("__lang.code"), F.col("__lang.confidence"), countries)
    rows = rows.withColumn("__guess", guess)
    stated, guessed = F.col("stated_country").isNotNull(), F.col("__guess.country").isNotNull()
    known = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda x: x)
    fields = {
        "lang": F.col("__lang.code"),
        "lang_confidence": F.when(F.col("__lang.code").isNotNull(), F.col("__lang.confidence")),
        "country": F.when(stated, F.col("stated_country")).otherwise(F.col("__guess.country")),
        "country_confidence": F.when(stated, F.col("stated_confidence")).when(guessed, F.col("__guess.confidence")),
        "country_source": F.when(stated, F.col("stated_source")).when(guessed, F.lit(BY_LANGUAGE)),
        "keywords": F.col("__tokens.keywords"),
        "hashtags": F.slice(F.array_distinct(F.concat(known, "__tags")), 1, HASHTAGS),
        "simhash": F.col("__tokens.simhash"),
    }
    kept = [c for c in items.columns if c not in FIELDS]
    return rows.select(*kept, *[c.alias(name) for name, c in fields.items()])


@dataclass(frozen=True)
class Swept:
    examined: int
    stale: int
    language_changed: int


def reenriched(table: StoredTable, rules: int = RULES, lists: Mapping[str, Sequence[str]] | None = None, countries: Mapping[str, str] = LANGUAGE_COUNTRY, key: str = "id") -> Swept:
    """Works out again the stored rows whose text has changed since, or whose rules are others.

    Rows are of (key, title, body, tags, FIELDS, digest, rules), the digest that of the stored
    text.  Their stated country is what is stored unless that was read off the language.
    """
    rows = table.read()
    fresh = F.col("digest").eqNullSafe(digest()) & F.col("rules").eqNullSafe(F.lit(rules))
    stale = rows.where(~fresh)
    ours = F.coalesce(F.col("country_source"), F.lit(BY_LANGUAGE)) == BY_LANGUAGE
    stated = {"stated_country": F.when(~ours, F.col("country")), "stated_confidence": F.when(~ours, F.col("country_confidence")), "stated_source": F.when(~ours, F.col("country_source"))}
    asked = stale.withColumn("__was", F.col("lang")).withColumns(stated).withColumn("digest", digest()).withColumn("rules", F.lit(rules))
    done = written(enriched(asked, lists, countries).drop(*stated), f"enriched-{table.version().number}-{abs(hash(table.path))}")
    counts = done.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("lang").eqNullSafe(F.col("__was"))).alias("changed")).first()
    if counts["n"]:
        schema = rows.schema
        table.upsert(done.select(*[F.col(f.name).cast(f.dataType) for f in schema]), newest_by([key]))
    return Swept(rows.count(), counts["n"], counts["changed"])
