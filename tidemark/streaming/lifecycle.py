"""States of items as a stream: each change is told once, and items that fall silent leave.

An item's level follows from its values: HOT from ``hot`` on, PEAK once a value falls to
``fall`` of the highest so far, which must have been hot, else NEW.  A row is given out when an
item becomes HOT or PEAK; the same level again is none.  After ``idle`` seconds of event time
without a value the item is told EXPIRED and its state goes, so what is held follows the live
items and not all that ever were.

The state of an item is its highest value and when it was first reached, its level and its last
time, and a list of how many values came in each minute of a recent while, of bounded length.
Rows of a micro-batch are put in order of time; rows older than what an item has seen count as if
they came after it, so a highest value among them is not missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A change: the item, when, to which level, at which value; its highest so far and when it was
#: reached, and how many values came in the recent while.
OUT = "key string, t long, level string, value double, peak double, peak_at long, recent long"
_NAMES = [field.split()[0] for field in OUT.split(", ")]
_SUMMARY = "peak double, peak_at long, level string, last long, due long"

#: Needed by the session for state with timers and lists.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def levels(values: np.ndarray, peak: float, hot: float, fall: float) -> tuple[np.ndarray, np.ndarray]:
    """(level, highest so far) after each value, given the highest before."""
    highest = np.maximum.accumulate(np.r_[peak, values])[1:]
    out = np.where(values >= hot, "HOT", np.where((highest >= hot) & (values <= fall * highest), "PEAK", ""))
    return out, highest


class Lifecycle(StatefulProcessor):
    def __init__(self, hot: float, fall: float, idle: int, recent: int):
        self.hot, self.fall, self.idle, self.recent = hot, fall, idle, recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.summary = handle.getValueState("summary", _SUMMARY)
        self.minutes = handle.getListState("minutes", "minute long, n long")

    def close(self) -> None:
        pass

    def _expired(self, key: str, peak: float, peak_at: int, last: int) -> tuple:
        return key, last + self.idle, "EXPIRED", None, peak, peak_at, 0

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values(["t", "value"], ascending=[True, False], kind="stable")
        times, values = batch["t"].to_numpy(np.int64), batch["value"].to_numpy(float)
        life = tuple(self.summary.get())[:4] if self.summary.exists() else (-np.inf, 0, "NEW", int(times[0]))
        earlier = np.array([tuple(m) for m in self.minutes.get()], np.int64).reshape(-1, 2)
        minute = np.r_[np.repeat(earlier[:, 0], earlier[:, 1]), times // 60]
        out: list[tuple] = []
        # a silence longer than ``idle`` ends one life of the item and begins the next
        silent = np.flatnonzero(np.diff(np.r_[life[3], times]) > self.idle)
        starts = np.union1d(0, silent)
        for start, end in zip(starts, np.r_[starts[1:], len(times)]):
            if start in silent:
                out.append(self._expired(key[0], life[0], life[1], life[3]))
                life = (-np.inf, 0, "NEW", int(times[start]))
            said, life = self._lived(life, times[start:end], values[start:end])
            for at, level, value, peak, peak_at in said:
                seen = minute[: len(minute) - len(times) + start + at + 1]
                t = int(times[start + at])
                out.append((key[0], t, level, value, peak, peak_at, int((seen > t // 60 - self.recent // 60).sum())))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        due = (life[3] + self.idle) * 1000
        self.handle.registerTimer(due)
        self.summary.update((*life, due))
        left, n = np.unique(minute[minute > life[3] // 60 - self.recent // 60], return_counts=True)
        self.minutes.put([(int(m), int(k)) for m, k in zip(left, n)])
        yield pd.DataFrame(out, columns=_NAMES)

    def _lived(self, life: tuple, times: np.ndarray, values: np.ndarray) -> tuple[list[tuple], tuple]:
        """The changes (row, level, value, peak, peak_at) of a stretch of rows, and the life after it."""
        peak, peak_at, level, last = life
        after, highest = levels(values, peak, self.hot, self.fall)
        raised = np.flatnonzero(highest > np.r_[peak, highest[:-1]])
        known = np.concatenate([[level], after])
        # a value without a level of its own leaves the one before
        held = known[np.maximum.accumulate(np.where(known != "", np.arange(len(known)), 0))]
        said = []
        for i in np.flatnonzero(held[1:] != held[:-1]):
            rise = raised[raised <= i]
            said.append((int(i), str(held[i + 1]), float(values[i]), float(highest[i]), int(times[rise[-1]]) if len(rise) else peak_at))
        if len(raised):
            peak, peak_at = float(highest[-1]), int(times[raised[-1]])
        return said, (peak, int(peak_at), str(held[-1]), int(max(last, times[-1])))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.summary.exists():
            peak, peak_at, _, last, due = self.summary.get()
            if expiredTimerInfo.getExpiryTimeInMs() >= due:
                self.summary.clear()
                self.minutes.clear()
                yield pd.DataFrame([self._expired(key[0], peak, peak_at, last)], columns=_NAMES)


def lifecycles(stream: DataFrame, hot: float, fall: float = 0.6, idle: int = 86400, late: str = "1 hour", recent: int = 3600) -> DataFrame:
    """Changes of (key, ts, value), ``ts`` a timestamp; the session needs ``PROVIDER``."""
    rows = stream.where("key is not null and ts is not null and value is not null").withWatermark("ts", late)
    rows = rows.select("key", "ts", F.unix_seconds("ts").alias("t"), F.col("value").cast("double"))
    return rows.groupBy("key").transformWithStateInPandas(Lifecycle(hot, fall, idle, recent), OUT, "Append", "EventTime")
