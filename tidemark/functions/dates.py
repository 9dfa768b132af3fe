"""Epoch-second date functions; zones are applied by name, never by fixed offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(ts: Column, seconds: int) -> Column:
    return ts - F.pmod(ts, F.lit(seconds))


def at(ts: Column, zone: str = "UTC") -> Column:
    stamp = F.timestamp_seconds(ts)
    return stamp if zone == "UTC" else F.from_utc_timestamp(stamp, zone)


def hour(ts: Column, zone: str = "UTC") -> Column:
    return F.hour(at(ts, zone))


def weekday(ts: Column, zone: str = "UTC") -> Column:
    """0 is Sunday."""
    return F.dayofweek(at(ts, zone)) - 1


def day_part(hours: Column) -> Column:
    return F.when(hours < 6, "night").when(hours < 12, "morning").when(hours < 18, "afternoon").otherwise("evening")


def age_band(hours: Column) -> Column:
    return F.when(hours < 48, "<48h").when(hours < 96, "<96h").when(hours < 240, "<240h").otherwise("older")


def iso_duration_seconds(text: Column) -> Column:
    """ISO-8601 durations such as P1DT2H3M4S; null where the text is none."""
    pattern = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"
    parts = [F.coalesce(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("long"), F.lit(0)) for i in (1, 2, 3, 4)]
    return F.when(text.rlike(pattern), parts[0] * 86400 + parts[1] * 3600 + parts[2] * 60 + parts[3])


def quiet(hours: Column, start: int, end: int) -> Column:
    """Whether an hour is in a window that may wrap midnight; equal ends are no window."""
    if start == end:
        return F.lit(False)
    if start < end:
        return (hours >= start) & (hours < end)
    return (hours >= start) | (hours < end)


def complete_day(now: int) -> int:
    """Start of the last whole UTC day."""
    return now - now % 86400 - 86400
