"""Intervals: merging, union length, hours inside, runs of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.timeops import seconds_between


def merged(intervals: DataFrame, by: list[str], start: str, end: str, join_gap_seconds: int = 0) -> DataFrame:
    """Islands: by, start, end, members. Intervals join if one starts at most the gap after the latest end so far."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.expr(f"INTERVAL '{join_gap_seconds}' SECOND")
    opened = intervals.withColumn("new_", F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0))
    numbered = opened.withColumn("island_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "island_").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("members")).drop("island_")


def union_seconds(intervals: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Seconds that the intervals of each key cover together."""
    islands = merged(intervals, by, start, end)
    return islands.groupBy(*by).agg(F.sum(seconds_between(F.col(start), F.col(end))).alias("seconds"))


def hours_inside(intervals: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """A row for each whole hour in [start, end); start and end are whole hours."""
    inside = intervals.where(F.col(start) < F.col(end))
    return inside.withColumn(name, F.explode(F.sequence(F.col(start), F.col(end) - F.expr("INTERVAL '1' HOUR"), F.expr("INTERVAL '1' HOUR"))))


def observed_runs(events: DataFrame, by: list[str], at: str, most_gap_seconds: int) -> DataFrame:
    """Runs of different times with no gap over the most: by, start_at, end_at, observations."""
    times = events.select(*by, at).distinct()
    w = Window.partitionBy(*by).orderBy(at)
    late = F.col(at) > F.lag(at).over(w) + F.expr(f"INTERVAL '{most_gap_seconds}' SECOND")
    numbered = times.withColumn("new_", F.when(late, 1).otherwise(0)).withColumn("run_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "run_").agg(F.min(at).alias("start_at"), F.max(at).alias("end_at"), F.count(F.lit(1)).alias("observations")).drop("run_")
