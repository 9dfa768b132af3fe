"""A training-corpus pipeline: five stages over ``documents``, each one operator of llm.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps; its result is written
as Parquet and read again before the next.  All but the last return the columns of docs.

Odd inputs: an empty table stays empty in every stage; extra columns pass through, whatever
their names (the last stage returns a fixed set); nulls in any column are kept unless the
stage says otherwise; repeated rows are judged alike, so all of them stay or go, but rows of
one id are one document to the near-duplicate stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, language, mixing, near_dedup, toxicity
from tidemark.llm.common import read_table, unused, written

TOXIC_FROM = 0.3
LEAST_CONFIDENCE = 0.5
SOURCE_POWER = 0.5
VOCABULARY = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that the toxicity models score ``TOXIC_FROM`` or more.

    A row without id trains nothing but is scored; a text without words scores the prior.
    """
    scorer = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), held_out=None)
    risk = unused(docs.columns, "risk")
    return scorer.scored_rows(docs, out=risk).where(F.col(risk) < TOXIC_FROM).select(*docs.columns)


def drop_undetermined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows in no language of the corpus, by text, declared language and source.

    Rows of one id go together; a row without id stays.  A text without letters is judged by
    its declared language and source alone.
    """
    model = language.learn(docs)
    found = language.identify(docs, model, "doc_id", F.col("text"), declared=F.lower("lang"), host=F.col("source"))
    bad = (F.col("language") == language.UNDETERMINED) | (F.col("confidence") < LEAST_CONFIDENCE)
    rejected = found.where(bad & F.col("id").isNotNull()).select(F.col("id").alias("doc_id")).distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows with the smallest id of every near-duplicate class.

    Rows without id or without words stay.
    """
    found = near_dedup.near_duplicates(docs)
    dropped = found.where(~F.col("kept")).select(F.col("id").alias("doc_id")).distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def _mix(docs: DataFrame) -> DataFrame:
    return mixing.positions(docs, mixing.tempered_weights(docs, power=SOURCE_POWER))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lays all rows out in the order of the Pfair mix; drops none.

    Targets are the sources' sizes to the power ``SOURCE_POWER``, so a source that holds a
    third of all rows does not hold a third of the mix while the others last.  A source
    without rows left drops out and the others go on.  A null source is one of its own.
    """
    slot, place = unused(docs.columns, "slot"), unused(docs.columns, "place")
    ordered = mixing.placed(docs, _mix(docs), slot=slot, place=place)
    return ordered.orderBy(F.asc_nulls_last(slot), place, "doc_id").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds exact BPE ids, whether decoding them gives the text back, and the row's ``slot``
    and ``place`` in the mix, because tables that are read again come in no order.

    A null text has no ids and decodes to an empty text.
    """
    spec = bpe.read_spec(public_tokenizers.path(VOCABULARY))
    keep = ("doc_id", "lang", "source", "n_chars", "text_sha256")
    marked = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    back = bpe.round_trip(marked, spec, keep=keep)
    same = F.sha2("decoded", 256) == F.col("text_sha256")
    out = back.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))
    return mixing.placed(out, _mix(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_undetermined),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", tokens),
]

#: Kneser-Ney fitting, register bands and BPE are not SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
