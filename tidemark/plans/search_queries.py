"""Searches through the trigram index, beside scans of the folded texts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from tidemark.model import document_items
from tidemark.operators import ranking, search
from tidemark.plans.catalog import query
from tidemark.sources.tables import shared_folder

NEEDLES = ["TION thát", "ère", "the ", "and the on", "zzzzq"]
_NEEDLES_SQL = "needles AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in NEEDLES) + "]) AS needle)"


def _index(spark, sf_dir) -> search.TrigramIndex:
    """Three segments: most documents, some of them outdated; the rest and new versions of the
    outdated; and the removal of every eleventh."""
    index = search.TrigramIndex(spark, f"{shared_folder(spark)}/trigrams-{uuid.uuid4().hex[:8]}", buckets=16)
    docs = document_items(spark, sf_dir).select("id", "title", "body")
    stale = F.when(F.col("id") % 7 == 0, F.concat(F.lit("tion that "), "body")).otherwise(F.col("body"))
    index.add(docs.where("id % 5 <> 0").withColumn("body", stale))
    index.add(docs.where("id % 5 = 0 or id % 7 = 0"))
    index.remove(docs.where("id % 11 = 0"))
    return index


@query("indexed_search", f"WITH {_NEEDLES_SQL} SELECT needle, doc_id AS id FROM documents, needles WHERE contains(strip_accents(lower(text)), strip_accents(lower(needle))) AND doc_id % 11 <> 0")
def indexed_search(spark, sf_dir):
    index = _index(spark, sf_dir)
    return reduce(lambda a, b: a.unionByName(b), [index.matches(n).select(F.lit(n).alias("needle"), "id") for n in NEEDLES])


@query("indexed_page", "SELECT doc_id AS id, n_chars AS score FROM documents WHERE contains(strip_accents(lower(text)), 'on the') AND lang IN ('en', 'fr') AND doc_id % 11 <> 0 ORDER BY n_chars DESC, doc_id LIMIT 40")
def indexed_page(spark, sf_dir):
    """The ranked page with its text filter answered by the index."""
    docs = document_items(spark, sf_dir).withColumn("score", F.col("n_chars"))
    asked = ranking.RankedQuery(text="ON THÉ", languages=["en", "fr"], sort="score", limit=40)
    known = docs.where("lang is not null")
    return ranking.page(known, asked, index=_index(spark, sf_dir)).select("id", "score")
