"""The ranked read: one set of predicates for page and count, orders, facets, export."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.mathx import rounded
from tidemark.functions.text import csv_field
from tidemark.operators.search import GRAM, TrigramIndex, folded

ORDERS = ("score", "velocity", "acceleration", "value", "confidence", "newest")


@dataclass(frozen=True)
class RankedQuery:
    """Filters and paging of the ranked read; None means no filter."""

    states: Sequence[str] | None = None
    sources: Sequence[str] | None = None
    languages: Sequence[str] | None = None
    countries: Sequence[str] | None = None
    content_types: Sequence[str] | None = None
    ids: Sequence[object] | None = None
    least_score: float | None = None
    most_age_hours: float | None = None
    least_relevance: float | None = None
    creator: str | None = None
    hashtag: str | None = None
    text: str | None = None
    archived: str = "hide"
    sort: str = "score"
    limit: int = 40
    offset: int = 0

    def clamped(self) -> RankedQuery:
        sort = self.sort if self.sort in ORDERS else "score"
        values = {**self.__dict__, "sort": sort, "limit": min(max(self.limit, 1), 200), "offset": min(max(self.offset, 0), 100_000)}
        return RankedQuery(**values)


def predicates(q: RankedQuery, columns: Sequence[str]) -> list[Column]:
    """Filters on the columns that the table has; rows of unknown language, age or
    relevance stay in, as only the ranked read allows."""
    have, out = set(columns), []
    for values, name in ((q.ids, "id"), (q.states, "state"), (q.sources, "source"), (q.countries, "country"), (q.content_types, "content_type")):
        if values is not None and name in have:
            out.append(F.col(name).isin(*values))
    if q.languages is not None and "lang" in have:
        out.append(F.col("lang").isin(*q.languages) | F.col("lang").isNull())
    if q.least_score is not None:
        out.append(F.col("score") >= q.least_score)
    if q.most_age_hours is not None:
        out.append(F.col("age").isNull() | (F.col("age") <= q.most_age_hours))
    if q.least_relevance is not None and "relevance" in have:
        out.append(F.col("relevance").isNull() | (F.col("relevance") >= q.least_relevance))
    if q.creator is not None:
        names = [F.col(c).cast("string") == q.creator for c in ("author", "author_name") if c in have]
        out.append(names[0] if len(names) == 1 else names[0] | names[1])
    if q.hashtag is not None and "hashtags" in have:
        out.append(F.array_contains("hashtags", q.hashtag.lstrip("#").lower()))
    if q.text:
        out.append(contains_text(q.text, [c for c in ("title", "body") if c in have]))
    return out


def contains_text(needle: str, columns: Sequence[str]) -> Column:
    """Case-insensitive literal substring in any of the columns; null columns don't match."""
    found = [F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False)) for c in columns]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def filtered(items: DataFrame, q: RankedQuery, archive: DataFrame | None = None, index: TrigramIndex | None = None) -> DataFrame:
    """The rows that the query lets pass; with an index, it answers texts long enough for it."""
    q = q.clamped()
    out = items
    if index is not None and q.text and len(folded(q.text)) >= GRAM:
        out, q = out.join(index.matches(q.text), "id", "left_semi"), replace(q, text=None)
    for p in predicates(q, items.columns):
        out = out.where(p)
    if archive is not None and q.archived != "include":
        out = out.join(archive.select("id"), "id", "left_semi" if q.archived == "only" else "left_anti")
    return out


def page(items: DataFrame, q: RankedQuery, archive: DataFrame | None = None, index: TrigramIndex | None = None) -> DataFrame:
    """The asked-for page; ties are broken by score and then id, so pages never overlap."""
    q = q.clamped()
    by = {"newest": "first_ts"}.get(q.sort, q.sort)
    order = [F.col(by).desc_nulls_last(), F.col("score").desc_nulls_last(), F.col("id")]
    out = filtered(items, q, archive, index).orderBy(*order)
    return (out.offset(q.offset) if q.offset else out).limit(q.limit)


def count(items: DataFrame, q: RankedQuery, archive: DataFrame | None = None, index: TrigramIndex | None = None) -> DataFrame:
    return filtered(items, q, archive, index).agg(F.count(F.lit(1)).alias("total"))


def facets(items: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(facet, value, n) of the values that are there: one pass over all dimensions."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("facet"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    rows = items.select(pairs.alias("p")).select("p.facet", "p.value").where("value is not null")
    return rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def export_rows(items: DataFrame) -> DataFrame:
    """Export columns, rounded, text guarded, instants as ISO, rank in percent."""
    iso = lambda c: F.date_format(F.timestamp_seconds(F.col(c)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return items.select(
        F.col("id").cast("string").alias("id"),
        csv_field(F.col("source")).alias("source"),
        csv_field(F.col("author").cast("string")).alias("author"),
        F.col("state"),
        rounded(F.col("score"), 1).alias("score"),
        rounded(F.col("confidence"), 2).alias("confidence"),
        rounded(F.col("popularity") * 100, 1).alias("platform_rank"),
        iso("first_ts").alias("first_seen"),
        iso("last_ts").alias("last_seen"),
    )
