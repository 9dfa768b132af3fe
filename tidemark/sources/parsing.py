"""What source adapters need: counts, titles, ranks and feeds as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact_count(text: Column) -> Column:
    """"14.7M", "20K+", "1,234" as a number; null where there is none."""
    clean = F.upper(F.regexp_replace(text, r"[\s,+]", ""))
    number = F.nullif(F.regexp_extract(clean, r"^(\d+(?:\.\d+)?)([KMB]?)$", 1), F.lit("")).cast("double")
    unit = F.regexp_extract(clean, r"^(\d+(?:\.\d+)?)([KMB]?)$", 2)
    times = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.floor(number * times + 0.5).cast("long")


def headline(title: Column) -> Column:
    """(headline, publisher) of "Headline - Publisher"; with its dash a publisher has 60
    characters at most, and longer tails are part of the headline."""
    tail = F.char_length(F.substring_index(title, " - ", -1)) + 3
    head = F.char_length(title) - tail
    has = title.contains(" - ") & (head > 0) & (tail <= 60)
    first, last = F.trim(F.substr(title, F.lit(1), head)), F.trim(F.substr(title, head + 4))
    return F.struct(F.when(has, first).otherwise(title).alias("headline"), F.when(has, last).alias("publisher"))


def rank_score(rank: Column, size: Column) -> Column:
    return F.greatest(F.lit(1), size - rank + 1)


def short_video(seconds: Column) -> Column:
    return F.when(seconds <= 60, "short").when(seconds.isNotNull(), "video")


def feed_items(xml: Column) -> Column:
    """array<struct<title, link, published>> of RSS items and Atom entries, tolerantly."""
    def field(block: Column, pattern: str) -> Column:
        found = F.regexp_extract(block, pattern, 1)
        found = F.regexp_replace(found, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
        for _ in range(2):  # feeds encode entities twice
            for name, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
                found = F.replace(found, F.lit(name), F.lit(to))
        return F.nullif(F.trim(found), F.lit(""))

    blocks = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:\w+:)?(item|entry)\b.*?</(?:\w+:)?\1>"), 0)
    return F.transform(blocks, lambda b: F.struct(
        field(b, r"(?is)<(?:\w+:)?title\b[^>]*>(.*?)</(?:\w+:)?title>").alias("title"),
        F.coalesce(field(b, r"(?is)<link\b[^>]*>(.+?)</link>"), field(b, r"(?is)<link\b[^>]*?\bhref\s*=\s*[\"']([^\"']+)")).alias("link"),
        field(b, r"(?is)<(?:\w+:)?(?:pubDate|published|updated|date)\b[^>]*>(.*?)<").alias("published"),
    ))


def feed_date(text: Column) -> Column:
    """Epoch seconds of RFC 822 and ISO dates; null where unparseable."""
    clean = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3}, ", "")
    forms = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd"]
    return F.unix_seconds(F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in forms]))
