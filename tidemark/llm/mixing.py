"""Mixing sources to target weights by Pfair scheduling.

Every source's documents form blocks.  Block k (from 0) of a source of weight w may be
placed from slot floor(k / w) on and must be placed before slot ceil((k + 1) / w); earliest
deadline first over the released blocks then keeps every source within one block of its
target share at every slot.

Weights are whole shares, so the schedule repeats exactly after as many slots as there are
shares: one period is scheduled on the driver, and block k of a source with n shares lies in
period k div n at that period's (k mod n)-th slot of the source.  When a source has no
block left, it leaves, and a new phase is scheduled for the others and their shares: there
are no more phases than sources, and in each of them every source is within one block of its
share.  Documents get their blocks by gapless numbering, so no source, however large, is
gathered in one task.

Defined edge results: no row is lost, every row of a weighted source has a slot, whatever
the sizes of the sources, and a source's last block may be short; a null source is a source
of its own; weights of unknown sources are ignored; sources without weight or with weight 0
are left out of the mix (``in_mix`` false, no slot); a negative weight is an error; an empty
table gives an empty result; repeated rows are numbered one by one; text and other columns
play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from dataclasses import dataclass
from fractions import Fraction
from math import floor, gcd, lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import gapless_number, written

#: Shares that weights are rounded to if their own common period is longer; more for many sources.
PERIOD = 4096
BLOCK_ROWS = 8
#: Plans of at most so many rows (of some 40 bytes) are broadcast.
BROADCAST_ROWS = 1 << 18

Source = str | None


def _order(source: Source) -> tuple[bool, str]:
    return source is None, source or ""


def whole_shares(weights: Mapping[Source, float], period: int = PERIOD) -> dict[Source, int]:
    """Weights as whole shares; weight 0 has none.

    Exact if the weights (taken as the nearest fractions of denominators up to a million)
    have at most max(period, 8 * sources) shares in common, else rounded to so many by
    largest remainders, one share at least.  The schedule is exact for the shares.
    """
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    used = {s: Fraction(weights[s]).limit_denominator(10**6) or Fraction(weights[s]) for s in sorted(weights, key=_order) if weights[s] > 0}
    period, total = max(period, 8 * len(used)), sum(used.values())
    if not used:
        return {}
    common = lcm(*[w.denominator for w in used.values()])
    whole = {s: int(w * common) for s, w in used.items()}
    least = gcd(*whole.values())
    if sum(whole.values()) // least <= period:
        return {s: n // least for s, n in whole.items()}
    exact = {s: w / total * (period - len(used)) for s, w in used.items()}
    shares = {s: 1 + floor(x) for s, x in exact.items()}
    for s in sorted(used, key=lambda s: (floor(exact[s]) - exact[s], *_order(s)))[: period - sum(shares.values())]:
        shares[s] += 1
    return shares


def pfair_period(shares: Mapping[Source, int]) -> list[Source]:
    """The source of each slot of one period: earliest deadline first over released blocks."""
    period = sum(shares.values())
    ranks = {s: i for i, s in enumerate(sorted(shares, key=_order))}
    waiting, ready, slots = [(0, r, 0, s) for s, r in ranks.items()], [], []
    heapq.heapify(waiting)
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, rank, k, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // shares[s]), rank, k, s))
        _, rank, k, s = heapq.heappop(ready)
        slots.append(s)
        if k + 1 < shares[s]:
            heapq.heappush(waiting, ((k + 1) * period // shares[s], rank, k + 1, s))
    return slots


@dataclass(frozen=True)
class Phase:
    """Slots from ``start`` on, while the sources of ``turns`` all have blocks left."""

    start: int
    period: int
    turns: dict[Source, list[int]]  # slots of a source in a period
    first: dict[Source, int]  # blocks placed before
    end: dict[Source, int]


def phases(shares: Mapping[Source, int], blocks: Mapping[Source, int]) -> list[Phase]:
    """The schedule of all blocks; sources without blocks take no part."""
    placed = {s: 0 for s in shares if blocks.get(s, 0) > 0}
    out, start = [], 0
    while placed:
        slots = pfair_period({s: shares[s] for s in placed})
        turns: dict[Source, list[int]] = {s: [] for s in placed}
        for slot, s in enumerate(slots):
            turns[s].append(slot)

        def slot_of(s: Source, k: int, turns=turns, slots=slots) -> int:
            return k // len(turns[s]) * len(slots) + turns[s][k % len(turns[s])]

        length = min(slot_of(s, blocks[s] - n - 1) for s, n in placed.items()) + 1
        whole, rest = divmod(length, len(slots))
        end = {s: n + whole * len(turns[s]) + sum(slot < rest for slot in turns[s]) for s, n in placed.items()}
        out.append(Phase(start, len(slots), turns, placed, end))
        start += length
        placed = {s: n for s, n in end.items() if n < blocks[s]}
    return out


def tempered_weights(docs: DataFrame, source_col: str = "source", power: float = 0.5) -> dict[Source, int]:
    """Row counts per source raised to ``power``, as whole shares: large sources weigh less
    than their size."""
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).count().collect()  # one row per source
    return whole_shares({r["source"]: float(r["count"]) ** power for r in counts})


def mixed(docs: DataFrame, weights: Mapping[Source, float], id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, source, block, place, slot, in_mix) for every row.

    ``slot`` orders blocks, ``place`` the rows inside one; both are long.  ``in_mix`` holds
    in the first phase: while every weighted source has blocks left, so that the target
    weights are met.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"))
    counts = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}  # one row per source
    plan = phases(whole_shares(weights), {s: -(-n // block_rows) for s, n in counts.items()})
    spans, slots = [], []
    for i, phase in enumerate(plan):
        for s, turns in phase.turns.items():
            spans.append((s, i, phase.first[s], phase.end[s], len(turns), phase.start, phase.period))
            slots += [(s, i, turn, at) for turn, at in enumerate(turns[: phase.end[s] - phase.first[s]])]
    small = len(slots) <= BROADCAST_ROWS
    spans = spark.createDataFrame(spans, "p_source string, phase int, first long, end long, shares long, start long, period long")
    slots = spark.createDataFrame(slots, "q_source string, q_phase int, q_turn long, at long")

    rows = gapless_number(rows, ["source"], ["id"], "number")
    rows = rows.withColumn("block", F.floor(F.col("number") / block_rows)).withColumn("place", F.col("number") % block_rows)
    inside = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("end"))
    at = rows.join(F.broadcast(spans) if small else spans, inside, "left")
    at = at.withColumn("k", F.col("block") - F.col("first")).withColumn("turn", F.col("k") % F.col("shares"))
    same = F.col("source").eqNullSafe(F.col("q_source")) & (F.col("phase") == F.col("q_phase")) & (F.col("turn") == F.col("q_turn"))
    at = at.join(F.broadcast(slots) if small else slots, same, "left")
    slot = F.col("start") + F.floor(F.col("k") / F.col("shares")) * F.col("period") + F.col("at")
    return at.select("id", "source", "block", "place", slot.cast("long").alias("slot"), F.coalesce(F.col("phase") == 0, F.lit(False)).alias("in_mix"))


def positions(docs: DataFrame, weights: Mapping[str | None, float], id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(mix_id, mix_source, slot, place), written: where each id of a source lies in the mix.

    Rows that repeat an id within a source share its first position.
    """
    at = mixed(docs, weights, id_col, source_col).groupBy("id", "source").agg(F.min(F.struct("slot", "place")).alias("at"))
    return written(at.select(F.col("id").alias("mix_id"), F.col("source").alias("mix_source"), "at.slot", "at.place"), "mix")


def placed(rows: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source", slot: str = "slot", place: str = "place") -> DataFrame:
    """Every row of ``rows`` with its position in ``plan`` as ``slot`` and ``place``."""
    at = plan.select("mix_id", "mix_source", F.col("slot").alias(slot), F.col("place").alias(place))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("mix_id")) & F.col(source_col).cast("string").eqNullSafe(F.col("mix_source"))
    return rows.join(at, same, "left").select(*rows.columns, slot, place)
