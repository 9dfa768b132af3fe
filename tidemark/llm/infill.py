"""Fill-in-middle examples: each text is cut at two units and its parts are reordered.

A text is stored as its maximal runs of characters of one class (separator or not), with the
units that are complete at the end of each run.  Two hashes of the id say after how many units
the prefix and the middle end; a binary search finds the run that holds each cut, and the
offset inside it follows by arithmetic, so nothing is split into lines or words.

    psm   <P> prefix <S> suffix <M> middle
    spm   <S> suffix <P> prefix <M> middle
    plain the text as it is

Rows are transformed one by one, without a shuffle.  Batches are bounded by bytes; a text longer
than a batch is one batch, with four bytes of class codes a character besides it.

Defined edge results: a null text is empty and an empty text is plain with 0 units; a text that
contains a mark is plain, because it could not be read back; a null id is hashed as an empty
string; repeated ids are cut at the same hashes, repeated rows alike; an empty table gives no
rows; further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

MARKS = ("<P>", "<S>", "<M>")

#: unit: (code points that separate, whether each separator ends a unit or only the whole run).
UNITS: dict[str, tuple[tuple[int, ...] | None, bool]] = {
    "line": ((10,), True),
    "word": ((9, 10, 11, 12, 13, 32), False),
    "char": (None, True),
}


class ClassRuns:
    """The runs of a text: where each starts and ends and how many units are complete there."""

    def __init__(self, text: str, unit: str = "line"):
        separators, each = UNITS[unit]
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        if separators is None:
            closing = np.ones(len(points), bool)
        else:
            closing = np.isin(points, separators) if len(separators) > 1 else points == separators[0]
        edges = np.flatnonzero(closing[1:] != closing[:-1]) + 1
        self.starts = np.r_[0, edges][: len(points)]
        self.ends = np.r_[edges, len(points)][: len(self.starts)]
        self.stepped = closing[self.starts] & each
        counts = np.where(closing[self.starts], np.where(each, self.ends - self.starts, 1), 0)
        if len(counts) and not closing[-1]:
            counts[-1] = 1  # the text ends inside a unit
        self.counts, self.complete = counts, np.cumsum(counts)

    @property
    def units(self) -> int:
        return int(self.complete[-1]) if len(self.complete) else 0

    def offset(self, units: int) -> int:
        """The code point after the first ``units`` units."""
        if units == 0:
            return 0
        run = int(np.searchsorted(self.complete, units))
        if not self.stepped[run]:
            return int(self.ends[run])
        return int(self.starts[run] + units - (self.complete[run] - self.counts[run]))


def _draws(doc_id: int | None, seed: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def example(doc_id: int | None, text: str | None, unit: str = "line", seed: str = "7", fim_percent: int = 100, spm_percent: int = 50) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    runs = ClassRuns(text, unit)
    n, (h1, h2, h3, h4) = runs.units, _draws(doc_id, seed)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    a, b = (runs.offset(u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKS
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, "".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a, b - a, "".join((p, prefix, s, suffix, m, middle))


SCHEMA = "id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def infilled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", seed: str = "7", fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output), one row per row of ``docs``."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            made = [(i, *example(i, x, unit, seed, fim_percent, spm_percent)) for i, x in zip(ids, batch.column(1).to_pylist())]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text behind an output: no part holds a mark, so the marks split it exactly."""
    parts = F.split(F.substr(output, F.lit(len(MARKS[0]) + 1)), "|".join(MARKS), -1)
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(at(0), at(2), at(1))).when(form == "spm", F.concat(at(1), at(2), at(0))).otherwise(output)
