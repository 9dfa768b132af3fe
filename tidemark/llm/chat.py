"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation := turn*          turn := "<|turn|>" role "\\n" text "<|end|>\\n"

A deterministic parser splits at the end marks and cuts each part after the role.  Every
turn is rendered plainly, parsed again and compared with its source; where they differ,
its role and text are escaped until they come back alike.  Escaping puts a backslash after
the "<" of every "<", backslashes, "|" sequence and the parser takes one away, so one
round is always enough; ``identical`` in the result checks that.  Plain text has no such
sequence and costs nothing.

The loss mask is a list of spans (start, length), in code points of the rendered text, one
per assistant turn, over its text and nothing else.

A conversation is one string, so its turns meet in one task: its length is bounded by what
one string may hold, and copies of a conversation under other ids are other groups.

Defined edge results: null texts and roles are empty; turns are ordered by turn (null
first), then role and text, and repeated turns are all kept; rows with a null conversation
are one conversation of their own; an empty table gives no conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<|n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<|n"), F.lit("\n")))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def parsed(conversation: Column) -> Column:
    """array<struct<role, text>>: the turns that a rendered conversation says."""
    ended = F.split(conversation, r"<\|end\|>\n", -1)
    parts = F.slice(ended, F.lit(1), F.size(ended) - 1)

    def turn(part: Column) -> Column:
        body = F.substr(part, F.lit(len(OPEN) + 1))
        role = F.substring_index(body, "\n", 1)
        text = F.substr(body, F.char_length(role) + 2)
        return F.struct(unescaped_role(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(parts, turn)


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans, identical), one row per conversation."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = F.array(F.struct("role", "text"))
    plain = parsed(rendered(F.col("role"), F.col("text"))) == source
    rows = rows.withColumn("plain", plain)
    rows = rows.withColumn("role_out", F.when(F.col("plain"), F.col("role")).otherwise(escaped_role(F.col("role"))))
    rows = rows.withColumn("text_out", F.when(F.col("plain"), F.col("text")).otherwise(escaped(F.col("text"))))
    rows = rows.withColumn("out", rendered(F.col("role_out"), F.col("text_out")))
    rows = rows.withColumn("alike", F.col("plain") | (parsed(F.col("out")) == source))
    head = F.char_length("role_out") + len(OPEN) + 1
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("out")).over(before), F.lit(0)) + head
    rows = rows.withColumn("span", F.when(F.col("role") == LOSS_ROLE, F.struct(start.cast("long").alias("start"), F.char_length("text_out").cast("long").alias("length"))))
    pieces = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "out", "span")))
    grouped = rows.groupBy("conv_id").agg(pieces.alias("pieces"), F.min("alike").alias("identical"))
    whole = F.array_join(F.transform("pieces", lambda p: p["out"]), "")
    spans = F.filter(F.transform("pieces", lambda p: p["span"]), lambda s: s.isNotNull())
    return grouped.select("conv_id", whole.alias("formatted"), spans.alias("loss_spans"), "identical")


def loss_text(conversation: Column, spans: Column) -> Column:
    """Unescaped text under the mask, spans in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(conversation, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
