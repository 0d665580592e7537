"""As-of lookups and counts in trailing windows, by one sort and no inequality join.

Keys and facts are united and sorted together by (keys, time); a running aggregate carries facts to keys. Work is
n log n however many facts a key's window holds, and one shuffle serves any number of lookups. The keys to
partition by (channel, or channel and segment) bound a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_last(points: DataFrame, facts: DataFrame, by: list[str], at: str, fact_at: str, payload: str, strict: bool = False, forward: bool = False) -> DataFrame:
    """points with `payload`: a struct of the latest fact at or before each point (strict: before); null if none.

    forward: the first fact at or after (strict: after). Of facts with one time any but always the same
    (greatest by all columns) is taken; give facts with one row a time where that matters.
    """
    fact_columns = [c for c in facts.columns if c not in by]
    left = points.select(*by, F.col(at).alias("o_"), F.lit(1).alias("side_"), F.struct(*points.columns).alias("point_"), F.lit(None).cast(facts.select(F.struct(*fact_columns)).schema[0].dataType).alias("fact_"))
    right = facts.select(*by, F.col(fact_at).alias("o_"), F.lit(0).alias("side_"), F.lit(None).cast(left.schema["point_"].dataType).alias("point_"), F.struct(*fact_columns).alias("fact_"))
    side = F.col("side_") if strict == forward else -F.col("side_")
    window = Window.partitionBy(*by).orderBy(F.desc("o_") if forward else F.asc("o_"), side if not forward else -side, F.asc("fact_") if not forward else F.desc("fact_")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = left.unionByName(right).withColumn("found_", F.last("fact_", ignorenulls=True).over(window)).where("side_ = 1")
    return out.select("point_.*", F.col("found_").alias(payload))


def running_max(points: DataFrame, facts: DataFrame, by: list[str], at: str, fact_at: str, value: str, name: str) -> DataFrame:
    """points with `name`: the greatest value of the facts at or before each point; null if none.

    With spans as facts (start, end as the value) it tells whether a span that began by then reaches a time.
    """
    left = points.select(*by, F.col(at).alias("o_"), F.lit(1).alias("side_"), F.struct(*points.columns).alias("point_"), F.lit(None).cast(facts.schema[value].dataType).alias("v_"))
    right = facts.select(*by, F.col(fact_at).alias("o_"), F.lit(0).alias("side_"), F.lit(None).cast(left.schema["point_"].dataType).alias("point_"), F.col(value).alias("v_"))
    window = Window.partitionBy(*by).orderBy("o_", "side_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = left.unionByName(right).withColumn("found_", F.max("v_").over(window)).where("side_ = 1")
    return out.select("point_.*", F.col("found_").alias(name))


def trailing_sums(points: DataFrame, facts: DataFrame, by: list[str], at: str, fact_at: str, values: dict[str, Column], hours: list[int]) -> DataFrame:
    """points with `name_{h}h` for every value and window: its sum over facts in (at - h, at].

    Each point enters the sort once for its own time and once for the far edge of every window; a running sum
    read at the four edges gives all windows by differences.
    """
    names = list(values)
    edges = F.array(*[F.struct(F.lit(h).alias("h"), (F.col(at) - F.expr(f"INTERVAL '{h}' HOUR")).alias("o")) for h in [0, *hours]])
    marked = points.withColumn("point_", F.struct(*points.columns))
    left = marked.select(*by, "point_", F.explode(edges).alias("e")).select(*by, F.col("e.o").alias("o_"), F.lit(1).alias("side_"), F.col("e.h").alias("h_"), "point_", *[F.lit(0).cast("long").alias(f"v_{n}") for n in names])
    right = facts.select(*by, F.col(fact_at).alias("o_"), F.lit(0).alias("side_"), F.lit(None).cast("int").alias("h_"), F.lit(None).cast(left.schema["point_"].dataType).alias("point_"), *[F.coalesce(values[n].cast("long"), F.lit(0).cast("long")).alias(f"v_{n}") for n in names])
    window = Window.partitionBy(*by).orderBy("o_", "side_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = left.unionByName(right).select(*by, "side_", "h_", "point_", *[F.sum(f"v_{n}").over(window).alias(f"s_{n}") for n in names]).where("side_ = 1")
    picked = [F.max(F.when(F.col("h_") == h, F.col(f"s_{n}"))).alias(f"s_{n}_{h}") for n in names for h in [0, *hours]]
    wide = running.groupBy(*by, "point_").agg(*picked)
    return wide.select("point_.*", *[(F.col(f"s_{n}_0") - F.col(f"s_{n}_{h}")).alias(f"{n}_{h}h") for n in names for h in hours])


def window_rows(points: DataFrame, facts: DataFrame, by: list[str], at: str, fact_at: str, hours: int, bucket_hours: int = 24) -> DataFrame:
    """Every pair of a point and a fact in (at - hours, at], points without any kept with null facts.

    For statistics that need the rows (order statistics, distinct counts). Facts meet points in buckets of time,
    so that the join has an equality key of (by, bucket) and a busy channel spreads over its buckets. Spark takes
    exploded points for as small as what they were made of and would broadcast them, so the joins ask for a merge.
    """
    seconds = bucket_hours * 3600
    bucket = lambda c: F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c) / seconds)
    far = F.col(at) - F.expr(f"INTERVAL '{hours}' HOUR")
    keyed = points.withColumn("b_", F.explode(F.sequence(bucket(far), bucket(F.col(at)))))
    f = facts.select(*[F.col(c).alias(f"f_{c}") for c in facts.columns]).withColumn("fb_", bucket(F.col(f"f_{fact_at}")))
    same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"f_{c}") for c in by])
    inside = (F.col(f"f_{fact_at}") > far) & (F.col(f"f_{fact_at}") <= F.col(at))
    hits = keyed.hint("merge").join(f, same & (F.col("b_") == F.col("fb_")) & inside).drop("b_", "fb_")
    # Whether a point has facts depends on its key and time alone, so only these are compared: other columns may be null.
    met = hits.select(*[F.col(c).alias(f"m_{i}") for i, c in enumerate([*by, at])]).distinct()
    missing = points.hint("merge").join(met, reduce(lambda x, y: x & y, [F.col(c) == F.col(f"m_{i}") for i, c in enumerate([*by, at])]), "left_anti")
    nulls = [F.lit(None).cast(t.dataType).alias(t.name) for t in hits.schema if t.name not in points.columns]
    return hits.unionByName(missing.select("*", *nulls))
