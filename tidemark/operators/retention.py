"""Retention: four cutoffs over stored tables, and what hangs on the items that go.

Time series are stored by day, so days that are over drop out of the manifest unread and only
the day of the cutoff is written again.  Items are stored by key; the longest unseen go first, no
more than ``limit`` a sweep, and rows that hang on them go by semi-joins, in those parts alone
that hold any.  A sweep that reaches its limit says so.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.stored import StoredTable
from tidemark.sources.tables import written

# Rows of items that one sweep takes at most.
SWEEP = 20_000


@dataclass(frozen=True)
class Swept:
    """Rows that went, by table, and whether more are waiting."""

    rows: Mapping[str, int]
    truncated: bool


def expired(table: StoredTable, cutoff: int, ts: str) -> int:
    """Removes the rows before ``cutoff`` of a table stored by days of ``ts``; how many went.

    Rows without a time stay.
    """
    version = table.version()
    over = [p for p in version.parts if p is not None and (p + 1) * 86400 <= cutoff]
    edge = [p for p in version.parts if p == cutoff // 86400 and cutoff % 86400]
    gone = table._read(version, over).count() if over else 0  # from the files' footers
    table.drop(over)
    if edge:
        old = table._read(version, edge).where(F.col(ts) < cutoff).count()
        if old:
            table.delete(lambda rows: rows.where(F.col(ts) >= cutoff), edge)
        gone += old
    return gone


def cascade(table: StoredTable, doomed: DataFrame, on: str, item: str = "id") -> int:
    """Removes the rows whose ``on`` is a doomed item; only parts that hold such rows are
    written."""
    version = table.version()
    if not version.parts:
        return 0
    ids = doomed.select(F.col(item).alias(on))
    held = table._read(version, version.parts).join(ids, on, "left_semi").groupBy(F.expr(table.part).cast("long").alias("p")).count().collect()  # a row a part
    if held:
        table.delete(lambda rows: rows.join(ids, on, "left_anti"), [r["p"] for r in held])
    return sum(r["count"] for r in held)


def sweep(items: StoredTable, now: int, retention_days: float, series: Mapping[str, tuple[StoredTable, str, float]], hanging: Mapping[str, tuple[StoredTable, str]], limit: int = SWEEP, item: str = "id", seen: str = "last_seen_at") -> Swept:
    """One sweep at the instant ``now``.

    ``series`` names tables stored by day with their time column and the days that they keep,
    ``hanging`` tables and the column that holds an item's id.  Items go last, so a sweep that
    breaks off leaves rows without time to go at the next, and none that point nowhere.
    """
    old = items.read().where(F.col(seen) < now - int(retention_days * 86400))
    doomed = written(old.orderBy(seen, item).limit(limit).select(item), f"doomed-{items.version().number}-{abs(hash(items.path))}")
    rows = {name: expired(table, now - int(keep * 86400), ts) for name, (table, ts, keep) in series.items()}
    for name, (table, on) in hanging.items():
        rows[name] = rows.get(name, 0) + cascade(table, doomed, on, item)
    rows["items"] = cascade(items, doomed, item, item)
    return Swept(rows, rows["items"] >= limit)
