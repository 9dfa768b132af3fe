"""A consumer of the event log that tells of each batch once.

The cursor and the batch that is being delivered are one row of a stored table.  A run fixes the
end of its batch before it tells anybody, delivers it channel by channel, notes every channel
that took it, and only then moves the cursor.  A run that breaks off anywhere is repeated with the
same batch: channels that have taken it are not told again, and a channel that took it just
before the break can know the batch by its number.

In quiet hours of the reference instant a batch with something to say is held: nothing moves.  A
batch without anything to say moves the cursor.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.sources.stored import StoredTable, newest_by

# What an event of the log is told as.
KINDS = {"trend.detected": "viral", "creator.breakout": "breakout", "manual.intervention.required": "intervention"}
#: A kind that needs no item and passes no filter.
INTERVENTION = "intervention"

Channel = Callable[[Sequence[Row], int], None]


@dataclass(frozen=True)
class Wanted:
    """What the reader wants to be told, and when."""

    kinds: Sequence[str] = ("viral", "breakout", "intervention")
    least_score: float = 0.0
    least_confidence: float = 0.0
    languages: Sequence[str] = ()
    most: int = 20
    batch: int = 200
    quiet: tuple[int, int] = (0, 0)
    zone: str = "UTC"
    types: Mapping[str, str] = field(default_factory=lambda: KINDS)

    def is_quiet(self, now: int) -> bool:
        """Whether the hour at ``now`` is quiet; a window may wrap midnight, an empty one is none."""
        start, end = self.quiet
        hour = datetime.fromtimestamp(now, ZoneInfo(self.zone)).hour
        return start != end and (start <= hour < end if start < end else hour >= start or hour < end)


@dataclass(frozen=True)
class Told:
    considered: int
    sent: int
    channels: tuple[str, ...]
    held: bool
    cursor: int


def notices(events: DataFrame, items: DataFrame, wanted: Wanted) -> DataFrame:
    """(event_id, kind, ref_id, source, score, t): what a batch of events has to say.

    ``events`` is (event_id, t, type, source, ref_id) and ``items`` (id, score, confidence,
    lang).  An item is told once a batch, by its first event; one of a language that is not
    wanted is left out, one of unknown language is not.  Strongest first, ``most`` at most.
    """
    kind = F.create_map(*[F.lit(x) for pair in wanted.types.items() for x in pair])[F.col("type")]
    rows = events.withColumn("kind", kind).where(F.col("kind").isin(*wanted.kinds))
    human = rows.where(F.col("kind") == INTERVENTION).select("event_id", "kind", "ref_id", "source", F.lit(None).cast("double").alias("score"), "t")
    first = rows.where((F.col("kind") != INTERVENTION) & F.col("ref_id").isNotNull()).groupBy("ref_id").agg(F.min_by(F.struct("event_id", "kind", "source", "t"), "event_id").alias("e"))
    good = items.where((F.col("score") >= wanted.least_score) & (F.col("confidence") >= wanted.least_confidence))
    if wanted.languages:
        good = good.where(F.col("lang").isNull() | F.col("lang").isin(*wanted.languages))
    told = first.join(good.select(F.col("id").alias("ref_id"), F.col("score").cast("double").alias("score")), "ref_id").select("e.event_id", "e.kind", "ref_id", "e.source", "score", "e.t")
    return human.unionByName(told).orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "event_id").limit(wanted.most)


@dataclass(frozen=True)
class Digest:
    """The consumer ``name``; ``state`` is a stored table of its own kind, shared by consumers."""

    state: StoredTable
    name: str
    wanted: Wanted

    def _position(self) -> tuple[int, int | None, int]:
        """(cursor, end of the batch under way, number of the batch)."""
        if self.state.version().schema is None:
            return 0, None, 0
        row = self.state.read().where(F.col("name") == self.name).first()
        return (row["cursor"], row["upto"], row["batch"]) if row else (0, None, 0)

    def _move(self, cursor: int, upto: int | None, batch: int, tag: tuple[str, int] | None = None) -> None:
        rows = self.state.spark.createDataFrame([(self.name, cursor, upto, batch)], "name string, cursor long, upto long, batch long")
        self.state.upsert(rows, newest_by(["name"], "batch"), tag)

    def told(self, channel: str, batch: int) -> bool:
        return self.state.applied((f"{self.name}/{channel}", batch), self.state.version())

    def dispatch(self, events: DataFrame, items: DataFrame, now: int, channels: Mapping[str, Channel]) -> Told:
        """One run at the instant ``now``; a channel that raises misses the batch, unless all do."""
        cursor, upto, batch = self._position()
        if not channels:
            return Told(0, 0, (), False, cursor)
        end = upto
        if end is None:
            end = events.where(F.col("event_id") > cursor).orderBy("event_id").limit(self.wanted.batch).agg(F.max("event_id")).first()[0]
        if end is None:
            return Told(0, 0, (), False, cursor)
        inside = events.where((F.col("event_id") > cursor) & (F.col("event_id") <= end))
        rows = notices(inside, items, self.wanted).collect()  # ``most`` at most
        if not rows:
            self._move(end, None, batch + 1)
            return Told(0, 0, (), False, end)
        if self.wanted.is_quiet(now):
            return Told(len(rows), 0, (), True, cursor)
        if upto is None:
            self._move(cursor, end, batch)
        took = []
        for name, send in channels.items():
            if not self.told(name, batch):
                try:
                    send(rows, batch)
                except Exception:  # noqa: BLE001  a channel that is down must not cost the others theirs
                    continue
                self._move(cursor, end, batch, (f"{self.name}/{name}", batch))
            took.append(name)
        if not took:
            return Told(len(rows), 0, (), False, cursor)
        self._move(end, None, batch + 1)
        return Told(len(rows), len(rows), tuple(took), False, end)
