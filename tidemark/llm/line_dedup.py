"""Line deduplication over a corpus, in DataFrame functions only.

A line's key is the line without white space at its ends, A-Z lower-cased.  A key that is long
enough and found in enough documents stays only in the largest id that holds it.

1.  Lines become (hash of the key, document, position); texts stay where they are.
2.  Hashes are dealt by range with the document's salt behind them, and sorted inside each range
    by document (largest first) and position.  The first row of a (hash, salt) is its first
    occurrence; at most ``least`` documents of it are passed on, enough to decide.
3.  One row per hash says its keeper and whether enough documents hold it; lines of other
    documents are marked through (hash, salt), so no hash is one join key for all its lines.
4.  A document gets back the 64-line words of its keep bitmap that are not all ones.

A line in a third of all documents is spread over ``SALTS`` groups, and repeated lines of a
document, or of rows with one id, are combined before they are shuffled.  Hashes have 128 bits.

Defined edge results: a null or empty text is one empty line; rows of one id are one document,
so they count once and a key's lines stay in all rows of its keeper; a null id is a document
smaller than all others; an empty table gives no rows; further columns are not read, whatever
their names.  A text that is one long line is one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import discard, tasks_for, text_or_empty, written

WHITE = " \t\n\v\f\r"
LEAST_CHARS = 40
LEAST_DOCUMENTS = 5
#: Groups that one hash is dealt into by document.
SALTS = 4096
_WORD = 64


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def key_hashes(line: Column) -> tuple[Column, Column]:
    """128 bits of a stripped line with A-Z lower-cased and nothing else.

    ``lower`` would fold every script.  Read byte by byte as ISO-8859-1, lower-casing changes A-Z
    and, among the rest, only lead bytes of UTF-8 (C0-DE to E0-FE); the number of continuation
    bytes behind a lead byte still tells which it was, so different texts stay different.
    """
    folded = F.lower(F.decode(F.encode(line, "UTF-8"), "ISO-8859-1"))
    return F.xxhash64(folded), F.xxhash64(F.lit("line"), folded)


def row_hash(text: Column) -> Column:
    """Tells rows of one id apart; equal rows lose the same lines."""
    return F.xxhash64(F.lit("row"), F.coalesce(text, F.lit("")))


def _occurrences(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(h1, h2, salt, doc, row, pos) of every line that is long enough."""
    rows = docs.select(F.col(id_col).alias("doc"), row_hash(F.col(text_col)).alias("row"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    rows = rows.select("doc", "row", "pos", stripped(F.col("line")).alias("line")).where(F.char_length("line") >= least_chars)
    h1, h2 = key_hashes(F.col("line"))
    salt = F.pmod(F.xxhash64(F.lit("salt"), F.coalesce(F.col("doc"), F.lit(0))), F.lit(SALTS)).cast("int")
    return rows.select(h1.alias("h1"), h2.alias("h2"), salt.alias("salt"), "doc", "row", "pos")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc, row, keep): map from word number to its 64 keep bits, of rows that lose lines.

    Lines 64 w to 64 w + 63 are bits 0 to 63 of word w; a word that is absent keeps all its
    lines and a row that is absent all its words.  ``row`` is ``row_hash`` of the text.
    """
    spark = docs.sparkSession
    lines = written(_occurrences(docs, id_col, text_col, least_chars), "line-hashes")
    held = lines.groupBy("h1", "h2", "salt", "doc").agg(F.min("pos").alias("pos"))
    dealt = held.repartitionByRange(tasks_for(spark), "h1", "h2", "salt")
    order = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc_nulls_last("doc"), "pos")
    firsts = dealt.withColumn("place", F.row_number().over(order)).where(F.col("place") <= least_documents)
    firsts = written(firsts.select("h1", "h2", "salt", "doc", "place"), "line-firsts")
    keepers = firsts.groupBy("h1", "h2").agg(F.max("doc").alias("keeper"), F.count(F.lit(1)).alias("documents"))
    keepers = keepers.where(F.col("documents") >= least_documents).select("h1", "h2", "keeper")
    groups = written(firsts.where("place = 1").select("h1", "h2", "salt").join(keepers, ["h1", "h2"]), "line-keepers")
    lost = lines.join(groups, ["h1", "h2", "salt"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % _WORD)
    words = lost.groupBy("doc", "row", F.expr(f"pos div {_WORD}").cast("int").alias("word")).agg(F.bit_or(bit).alias("lost"))
    maps = words.groupBy("doc", "row").agg(F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("lost").alias("bits")))).alias("keep"))
    out = written(maps, "line-bitmaps")
    discard(lines, firsts, groups)
    return out


def keeps(keep: Column, position: Column) -> Column:
    """Whether the bitmap keeps the line at ``position`` (from 0); a null bitmap keeps all."""
    bits = F.try_element_at(keep, F.floor(position / _WORD).cast("int"))
    return bits.isNull() | (F.getbit(bits, (position % _WORD).cast("int")) == 1)


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that the bitmap keeps, joined by line feeds; the text itself without a bitmap."""
    some = F.array_join(F.filter(lines_of(text), lambda line, i: keeps(keep, i)), "\n")
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(some)


def dropped_lines(keep: Column) -> Column:
    count = F.aggregate(F.map_values(keep), F.lit(0).cast("long"), lambda n, bits: n + F.bit_count(F.bitwise_not(bits)))
    return F.coalesce(count, F.lit(0).cast("long"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(id, n_lines, n_dropped, kept), one row per row of ``docs``."""
    bitmaps = keep_bitmaps(docs, id_col, text_col, least_chars, least_documents)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body")).withColumn("at", row_hash(F.col("body")))
    joined = rows.join(bitmaps, F.col("id").eqNullSafe(F.col("doc")) & (F.col("at") == F.col("row")), "left")
    return joined.select("id", F.size(lines_of(F.col("body"))).cast("long").alias("n_lines"), dropped_lines(F.col("keep")).alias("n_dropped"), kept_text(F.col("body"), F.col("keep")).alias("kept"))
