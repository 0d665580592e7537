"""Naive local time: windows (t - H, t], seconds, hours, archive segments. Timestamps are timestamp_ntz throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b)


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds, as a double with microseconds."""
    return micros_between(a, b).cast("double") / 1_000_000


def hours_later(at: Column, hours: int) -> Column:
    return at + F.expr(f"INTERVAL '{hours}' HOUR")


def seconds_later(at: Column, seconds: int) -> Column:
    return at + F.expr(f"INTERVAL '{seconds}' SECOND")


def floor_hour(at: Column) -> Column:
    return F.date_trunc("HOUR", at).cast("timestamp_ntz")


def ceil_hour(at: Column) -> Column:
    """The first whole hour not before."""
    low = floor_hour(at)
    return F.when(low == at, low).otherwise(hours_later(low, 1))


def segment_of(at: Column, segments: list[tuple[str, str]]) -> Column:
    """Number of the half-open segment [start, end) that holds the time; null outside all."""
    out = F.lit(None).cast("int")
    for i, (start, end) in reversed(list(enumerate(segments))):
        out = F.when((at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz")), i).otherwise(out)
    return out


def split_of(at: Column, splits: list[tuple[str, str, str]], horizon_hours: int) -> Column:
    """Struct (split, split_status): assigned if the whole horizon ends strictly inside the split, else purged_boundary; outside_splits elsewhere."""
    name, status = F.lit(None).cast("string"), F.lit("outside_splits")
    for label, start, end in reversed(splits):
        a, z = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
        here = (at >= a) & (at < z)
        name = F.when(here, label).otherwise(name)
        status = F.when(here, F.when(hours_later(at, horizon_hours) < z, "assigned").otherwise("purged_boundary")).otherwise(status)
    return F.struct(name.alias("split"), status.alias("split_status"))
