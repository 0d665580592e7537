"""Feature queries on the driver's journal. The grid has every hour from the first event to the last; windows are 1, 6, 24 and 168 h."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import timeops
from tidelog.operators import asof, features, intervals
from tidelog.plans.registry import journal, query

#: The first and the last whole hour around all events, and every hour between them for every channel.
DUCK_HOURS = "(SELECT unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS t FROM (SELECT CAST(date_trunc('hour', min(ts)) AS TIMESTAMP) AS a, CAST(date_trunc('hour', max(ts) + INTERVAL '59 minutes 59.999999 seconds') AS TIMESTAMP) AS z FROM {ev}))"
DUCK_GRID = f"grid AS (SELECT channel_id, t FROM (SELECT DISTINCT channel_id FROM {{ev}}), {DUCK_HOURS})"
DUCK_PAIRS = "ev AS (SELECT * FROM {ev}), " + DUCK_GRID + ", pairs AS (SELECT g.channel_id, g.t, e.ts, e.value, e.state, e.alarm FROM grid g LEFT JOIN ev e ON g.channel_id = e.channel_id AND e.ts <= g.t AND e.ts > g.t - INTERVAL 24 HOUR)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = journal(spark, sf_dir)
    return features.hourly_grid(ev, features.hours_of(ev))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.window_rows(grid(spark, sf_dir), journal(spark, sf_dir), ["channel_id"], "t", "ts", 24)


@query("WITH e AS (SELECT * FROM {ev} WHERE state = 'signup'), p AS (SELECT row_id, channel_id, ts FROM {ev} WHERE alarm) SELECT p.row_id, coalesce(e.row_id, -1) AS normal_id, e.ts AS normal_at FROM p ASOF LEFT JOIN e ON p.channel_id = e.channel_id AND p.ts >= e.ts")
def j08_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = journal(spark, sf_dir)
    got = asof.asof_last(ev.where("alarm").select("row_id", "channel_id", "ts"), ev.where("state = 'signup'").select("channel_id", "row_id", "ts"), ["channel_id"], "ts", "ts", "n")
    return got.select("row_id", F.coalesce(F.col("n.row_id"), F.lit(-1)).alias("normal_id"), F.col("n.ts").alias("normal_at"))


_sums = ", ".join(f"count(e.ts) FILTER (WHERE e.ts > g.t - INTERVAL {h} HOUR) AS events_{h}h, count(e.ts) FILTER (WHERE e.alarm AND e.ts > g.t - INTERVAL {h} HOUR) AS alarms_{h}h" for h in (1, 6, 24, 168))


@query(f"WITH ev AS (SELECT * FROM {{ev}}), {DUCK_GRID} SELECT g.channel_id, g.t, {_sums} FROM grid g LEFT JOIN ev e ON g.channel_id = e.channel_id AND e.ts <= g.t AND e.ts > g.t - INTERVAL 168 HOUR GROUP BY 1, 2")
def j09_prefix_difference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.hourly_counts(grid(spark, sf_dir), journal(spark, sf_dir), {"events": F.lit(1), "alarms": F.col("alarm").cast("long")})


@query(f"WITH {DUCK_PAIRS} SELECT channel_id, t, count(ts) AS n, count(DISTINCT state) AS states FROM pairs GROUP BY 1, 2")
def j10_range_join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).groupBy("channel_id", "t").agg(F.count("f_ts").alias("n"), F.countDistinct("f_state").alias("states"))


@query("WITH e AS (SELECT * FROM {ev}), p AS (SELECT channel_id, ts AS t FROM e WHERE state = 'purchase') SELECT p.channel_id, p.t, count(e.ts) FILTER (WHERE e.ts > p.t - INTERVAL 24 HOUR) AS inside, max(e.ts) FILTER (WHERE e.ts <= p.t - INTERVAL 24 HOUR) AS predecessor_at FROM p JOIN e ON p.channel_id = e.channel_id AND e.ts <= p.t GROUP BY 1, 2")
def j11_slice_and_predecessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = journal(spark, sf_dir)
    points = ev.where("state = 'purchase'").select("channel_id", F.col("ts").alias("t")).withColumn("far", F.col("t") - F.expr("INTERVAL '24' HOUR"))
    with_before = asof.asof_last(points, ev.select("channel_id", "ts"), ["channel_id"], "far", "ts", "p").withColumn("predecessor_at", F.col("p.ts")).drop("p", "far")
    return asof.trailing_sums(with_before, ev, ["channel_id"], "t", "ts", {"inside": F.lit(1)}, [24]).withColumnRenamed("inside_24h", "inside")


@query("WITH a AS (SELECT * FROM {ev}) SELECT a.row_id, min(b.ts) AS next_alarm_at FROM a LEFT JOIN a b ON a.channel_id = b.channel_id AND b.alarm AND b.ts > a.ts WHERE a.state = 'signup' GROUP BY 1")
def j12_next_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = journal(spark, sf_dir)
    got = asof.asof_last(ev.where("state = 'signup'").select("row_id", "channel_id", "ts"), ev.where("alarm").select("channel_id", F.col("ts").alias("at")), ["channel_id"], "ts", "at", "n", strict=True, forward=True)
    return got.select("row_id", F.col("n.at").alias("next_alarm_at"))


@query("WITH a AS (SELECT * FROM {ev}) SELECT a.row_id, round(min(date_diff('microsecond', a.ts, b.ts)) FILTER (WHERE b.ts >= a.ts) / 3.6e9, 6) AS hours_to_next, round(min(date_diff('microsecond', b.ts, a.ts)) FILTER (WHERE b.ts <= a.ts) / 3.6e9, 6) AS hours_since_last FROM a LEFT JOIN a b ON a.channel_id = b.channel_id AND b.alarm WHERE a.state = 'view' GROUP BY 1")
def j13_nearest_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = journal(spark, sf_dir)
    facts = ev.where("alarm").select("channel_id", F.col("ts").alias("at"))
    back = asof.asof_last(ev.where("state = 'view'").select("row_id", "channel_id", "ts"), facts, ["channel_id"], "ts", "at", "b").withColumn("b", F.col("b.at"))
    both = asof.asof_last(back, facts, ["channel_id"], "ts", "at", "n", forward=True)
    return both.select("row_id", F.round(timeops.seconds_between(F.col("ts"), F.col("n.at")) / 3600, 6).alias("hours_to_next"), F.round(timeops.seconds_between(F.col("b"), F.col("ts")) / 3600, 6).alias("hours_since_last"))


@query("WITH e AS (SELECT e.*, c_nationkey AS obj FROM {ev} e JOIN customer ON e.channel_id = CAST(c_custkey AS VARCHAR)) SELECT a.row_id, arg_max(b.row_id, b.ts) AS other_id FROM e a JOIN e b ON a.obj = b.obj AND a.channel_id <> b.channel_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 2 HOUR WHERE a.alarm AND b.alarm GROUP BY 1")
def j14_coincidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.plans.registry import table

    objects = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("channel_id"), F.col("c_nationkey").alias("obj"))
    e = journal(spark, sf_dir).where("alarm").join(objects, "channel_id").select("row_id", "channel_id", "ts", "obj")
    hits = asof.window_rows(e.withColumnRenamed("ts", "t"), e, ["obj"], "t", "ts", 3, 3).where("f_channel_id <> channel_id AND f_ts >= t - INTERVAL '2' HOUR")
    return hits.groupBy("row_id").agg(F.max_by("f_row_id", "f_ts").alias("other_id"))


@query("WITH m AS (SELECT channel_id, median(value) AS md FROM {ev} GROUP BY 1) SELECT e.channel_id, round(any_value(md), 6) AS median, round(median(abs(e.value - md)), 6) AS mad FROM {ev} e JOIN m ON e.channel_id = m.channel_id GROUP BY 1")
def g14_median_and_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = features.numeric_block(journal(spark, sf_dir), ["channel_id"], "value", "ts")
    return block.select("channel_id", F.round("numeric_median", 6).alias("median"), F.round("numeric_mad", 6).alias("mad"))


@query("WITH h AS (SELECT channel_id, date_trunc('hour', ts) AS a, median(value) AS y FROM {ev} GROUP BY 1, 2), x AS (SELECT *, date_diff('second', min(a) OVER (PARTITION BY channel_id), a) / 3600.0 AS x FROM h) SELECT channel_id, round(CASE WHEN count(*) >= 2 THEN regr_slope(y, x) END, 6) AS slope, round(arg_max(y, a) - arg_min(y, a), 6) AS delta FROM x GROUP BY 1")
def g17_slope_on_time_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = journal(spark, sf_dir).withColumn("hour", timeops.floor_hour(F.col("ts")))
    block = features.numeric_block(rows, ["channel_id"], "value", "hour")
    return block.select("channel_id", F.round("numeric_slope_per_hour", 6).alias("slope"), F.round("numeric_delta", 6).alias("delta"))


@query(f"WITH {DUCK_PAIRS}, m AS (SELECT channel_id, t, median(value) AS md FROM pairs GROUP BY 1, 2) SELECT p.channel_id, p.t, round(any_value(md), 6) AS numeric_median, round(median(abs(value - md)), 6) AS numeric_mad, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS numeric_iqr, round(CASE WHEN count(value) >= 2 THEN stddev_pop(value) END, 6) AS numeric_std, round(max(value) - min(value), 6) AS numeric_range FROM pairs p JOIN m ON p.channel_id = m.channel_id AND p.t = m.t WHERE value IS NOT NULL GROUP BY 1, 2")
def e03_numeric_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = features.numeric_block(pairs(spark, sf_dir), ["channel_id", "t"], "f_value", "f_ts")
    return block.select("channel_id", "t", *[F.round(c, 6).alias(c) for c in ("numeric_median", "numeric_mad", "numeric_iqr", "numeric_std", "numeric_range")])


@query(f"WITH {DUCK_PAIRS}, h AS (SELECT channel_id, t, date_trunc('day', ts) + INTERVAL (hour(ts) // 6 * 6) HOUR AS a, min(state) AS lo, max(state) AS hi FROM pairs WHERE ts IS NOT NULL GROUP BY 1, 2, 3), s AS (SELECT *, CASE WHEN lo = hi THEN lo END AS s FROM h), l AS (SELECT *, s <> lag(s) OVER (PARTITION BY channel_id, t ORDER BY a) AS moved FROM s), d AS (SELECT channel_id, t, count(DISTINCT state) AS state_distinct_count FROM pairs GROUP BY 1, 2) SELECT l.channel_id, l.t, count(*) FILTER (WHERE moved) AS state_transitions, any_value(CAST(d.state_distinct_count AS INT)) AS state_distinct_count, bool_or(lo <> hi) AS ambiguous FROM l JOIN d ON l.channel_id = d.channel_id AND l.t = d.t GROUP BY 1, 2")
def w12_state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = F.date_trunc("DAY", "f_ts").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.floor(F.hour("f_ts") / 6).cast("int") * 6)
    return features.state_block(pairs(spark, sf_dir).withColumn("a6", coarse.cast("timestamp_ntz")), ["channel_id", "t"], "f_state", "a6")


@query(f"WITH {DUCK_PAIRS}, g AS (SELECT channel_id, t, ts, lag(ts) OVER (PARTITION BY channel_id, t ORDER BY ts) AS p FROM pairs WHERE ts IS NOT NULL) SELECT channel_id, t, round(greatest(max(date_diff('microsecond', p, ts)), date_diff('microsecond', t - INTERVAL 24 HOUR, min(ts)), date_diff('microsecond', max(ts), t)) / 1e6, 6) AS maximum_gap_seconds FROM g GROUP BY 1, 2")
def w11_maximum_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = features.maximum_gap(pairs(spark, sf_dir), ["channel_id", "t"], "f_ts", "t", 24)
    return got.select("channel_id", "t", F.round("maximum_gap_seconds", 6).alias("maximum_gap_seconds"))


@query(f"WITH {DUCK_PAIRS} SELECT channel_id, t, count(DISTINCT state) AS states FROM pairs WHERE state <> 'view' GROUP BY 1, 2")
def w13_distinct_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).where("f_state <> 'view'").groupBy("channel_id", "t").agg(F.countDistinct("f_state").alias("states"))


@query(f"WITH {DUCK_PAIRS} SELECT channel_id, t, CAST(count(ts) AS BIGINT) AS n_times, least(1.0, count(ts) / 4.0)::DOUBLE AS coverage, CASE WHEN count(ts) = 0 THEN 'no_usable_observations,insufficient_window_events,coverage_below_threshold' WHEN count(ts) = 1 THEN 'insufficient_window_events,coverage_below_threshold' WHEN count(ts) = 2 THEN 'insufficient_window_events' ELSE '' END AS reasons FROM pairs GROUP BY 1, 2")
def e02_window_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = pairs(spark, sf_dir).groupBy("channel_id", "t").agg(F.count("f_ts").alias("n_usable"), F.lit(0).alias("n_excluded"), F.countDistinct("f_ts").alias("n_times"), F.lit(None).cast("double").alias("maximum_gap_seconds"), F.lit(False).alias("ambiguous"))
    status = features.window_status(24, 6 * 3600)
    return counted.select("channel_id", "t", "n_times", status["coverage"].alias("coverage"), F.array_join(status["window_reasons"], ",").alias("reasons"))


@query("WITH e AS (SELECT * FROM {ev}), f AS (SELECT DISTINCT channel_id, TIMESTAMP '2024-01-20' AS fit_end FROM e), r AS (SELECT f.channel_id, e.* EXCLUDE (channel_id) FROM f LEFT JOIN e ON e.channel_id = f.channel_id AND e.ts > fit_end - INTERVAL 168 HOUR AND e.ts < fit_end), m AS (SELECT channel_id, median(value) AS md FROM r GROUP BY 1), d AS (SELECT channel_id, state, row_number() OVER (PARTITION BY channel_id ORDER BY count(*) DESC, state) AS k FROM r WHERE state IS NOT NULL GROUP BY 1, 2) SELECT r.channel_id, count(ts) AS n, round(any_value(md), 6) AS median, round(median(abs(value - md)), 6) AS mad, any_value(d.state) AS dominant, CASE WHEN count(ts) >= 10 AND date_diff('microsecond', min(ts), max(ts)) >= 432000000000 THEN 'eligible' ELSE 'unknown' END AS status FROM r JOIN m ON r.channel_id = m.channel_id LEFT JOIN d ON d.channel_id = r.channel_id AND d.k = 1 GROUP BY 1")
def e04_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = journal(spark, sf_dir)
    fits = ev.select("channel_id").distinct().withColumn("fit_end", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    got = features.baseline(ev, fits, 168, 10, 120)
    return got.select("channel_id", F.col("baseline_event_count").alias("n"), F.round("baseline_numeric_median", 6).alias("median"), F.round("baseline_numeric_mad", 6).alias("mad"), F.col("baseline_dominant_state").alias("dominant"), F.col("baseline_status").alias("status"))


@query("WITH e AS (SELECT * FROM {ev}) SELECT row_id, CASE WHEN min(state) OVER w = max(state) OVER w THEN min(state) OVER w ELSE 'conflict' END AS only_state FROM e WINDOW w AS (PARTITION BY channel_id ORDER BY ts)")
def e07_uniqueness_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("channel_id").orderBy("ts")
    return journal(spark, sf_dir).select("row_id", F.when(F.min("state").over(w) == F.max("state").over(w), F.min("state").over(w)).otherwise("conflict").alias("only_state"))


_kinds = {"normal_message": "state = 'signup'", "registered_fault_text": "state = 'error'", "technical_message": "state IN ('error', 'purchase')", "environmental_alarm": "state = 'click'", "unknown_state": "state = 'view'"}


@query(f"WITH ev AS (SELECT * FROM {{ev}}), {DUCK_GRID} SELECT g.channel_id, g.t, " + ", ".join(f"count(e.ts) FILTER (WHERE {p} AND e.ts > g.t - INTERVAL {h} HOUR) AS {n}_{h}h" for n, p in _kinds.items() for h in (24, 168)) + " FROM grid g LEFT JOIN ev e ON g.channel_id = e.channel_id AND e.ts <= g.t AND e.ts > g.t - INTERVAL 168 HOUR GROUP BY 1, 2")
def e08_semantic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.hourly_counts(grid(spark, sf_dir), journal(spark, sf_dir), {n: F.expr(p).cast("long") for n, p in _kinds.items()}, [24, 168])


@query(f"WITH ev AS (SELECT * FROM {{ev}}), {DUCK_GRID}, c AS (SELECT g.channel_id, g.t, count(e.ts) FILTER (WHERE e.ts > g.t - INTERVAL 24 HOUR) AS a, count(e.ts) AS b FROM grid g LEFT JOIN ev e ON g.channel_id = e.channel_id AND e.ts <= g.t AND e.ts > g.t - INTERVAL 168 HOUR GROUP BY 1, 2) SELECT channel_id, t, round((a - (b - a) * 24.0 / 144) / sqrt((b - a) * 24.0 / 144 + 1), 6) AS contrast, round(ln(1 + a), 9) AS log1p__a, round(ln(1 + a / 24.0) - ln(1 + (b - a) / 144.0), 9) AS rate FROM c")
def e12_burst_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = features.hourly_counts(grid(spark, sf_dir), journal(spark, sf_dir), {"n": F.lit(1)}, [24, 168])
    a, b = F.col("n_24h"), F.col("n_168h")
    return c.select("channel_id", "t", F.round(features.burst_contrast(a, b, 24, 168), 6).alias("contrast"), F.round(F.log1p(a), 9).alias("log1p__a"), F.round(F.log1p(a / 24) - F.log1p((b - a) / 144), 9).alias("rate"))


#: What is counted in every window, and what the age of the latest is taken of.
FAMILIES = {"event_count": "true", "alarm_count": "alarm", "normal_count": "state = 'signup'", "technical_count": "state IN ('error', 'purchase')", "neutral_count": "state = 'click'", "high_count": "value > 50"}
AGES = {"last_event_age_seconds": "true", "last_alarm_age_seconds": "alarm"}
DUCK_WIDE = (
    f"ev AS (SELECT * FROM {{ev}}), {DUCK_GRID}, counts AS (SELECT g.channel_id, g.t, "
    + ", ".join(f"count(e.ts) FILTER (WHERE {p} AND e.ts > g.t - INTERVAL {h} HOUR) AS {n}_{h}h" for n, p in FAMILIES.items() for h in features.WINDOWS)
    + " FROM grid g LEFT JOIN ev e ON g.channel_id = e.channel_id AND e.ts <= g.t AND e.ts > g.t - INTERVAL 168 HOUR GROUP BY 1, 2), ages AS (SELECT g.channel_id, g.t, "
    + ", ".join(f"date_diff('microsecond', max(e.ts) FILTER (WHERE {p}), g.t) / 1e6 AS {n}" for n, p in AGES.items())
    + " FROM grid g LEFT JOIN ev e ON g.channel_id = e.channel_id AND e.ts <= g.t GROUP BY 1, 2), wide AS (SELECT * FROM counts JOIN ages USING (channel_id, t))"
)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every count in every window and the ages, at every hour."""
    ev = journal(spark, sf_dir)
    rows = features.hourly_counts(grid(spark, sf_dir), ev, {n: F.expr(p).cast("long") for n, p in FAMILIES.items()})
    for n, p in AGES.items():
        rows = asof.asof_last(rows, ev.where(p).groupBy("channel_id", "ts").agg(F.lit(1).alias("one")), ["channel_id"], "t", "ts", n)
        rows = rows.withColumn(n, timeops.seconds_between(F.col(f"{n}.ts"), F.col("t")))
    return rows


def _duck_engineered() -> dict[str, str]:
    out, pairs = {}, list(zip(features.WINDOWS, features.WINDOWS[1:], strict=False))
    for f in FAMILIES:
        out |= {f"log1p__{f}_{h}h": f"ln(1 + {f}_{h}h)" for h in features.WINDOWS}
        out |= {f"disjoint_log_rate__{f}_{a}v{z}h": f"ln(1 + {f}_{a}h / {a}.0) - ln(1 + ({f}_{z}h - {f}_{a}h) / {z - a}.0)" for a, z in pairs}
        out |= {f"recent_share__{f}_{a}v{z}h": f"{f}_{a}h / ({f}_{z}h + 1.0)" for a, z in pairs}
        if f != "event_count":
            out |= {f"per_event__{f}_{h}h": f"{f}_{h}h / (event_count_{h}h + 1.0)" for h in features.WINDOWS}
        out |= {f"fresh_logcount__{f}_168h": f"coalesce(ln(1 + {f}_168h) * exp(-last_event_age_seconds / 86400), -1)"}
    for c in AGES:
        out |= {f"log1p_hours__{c}": f"coalesce(ln(1 + {c} / 3600), -1)", f"freshness24__{c}": f"coalesce(exp(-{c} / 86400), -1)", f"freshness168__{c}": f"coalesce(exp(-{c} / 604800), -1)"}
    return out


@query(f"WITH {DUCK_WIDE} SELECT channel_id, t, {', '.join(f'round({x}, 9) AS {n}' for n, x in _duck_engineered().items())} FROM wide")
def e15_engineered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All engineered columns of six families and two ages; the transform takes any number of either."""
    got = features.engineered(wide(spark, sf_dir), list(FAMILIES), list(AGES))
    return got.select("channel_id", "t", *[F.round(n, 9).alias(n) for n in _duck_engineered()])


_MATRIX = [*[f"{n}_{h}h" for n in list(FAMILIES)[:5] for h in features.WINDOWS], "last_alarm_age_seconds"]


@query(f"WITH {DUCK_WIDE} SELECT channel_id, t, {', '.join(f'round(ln(1 + coalesce({c}, 0)), 9) AS log1p__{c}, CAST({c} IS NULL AS INT) AS missing__{c}' for c in _MATRIX)} FROM wide")
def e13_model_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 42 columns of the model: 21 logarithms and their missing masks."""
    got = features.model_matrix(wide(spark, sf_dir), _MATRIX)
    return got.select("channel_id", "t", *[F.round(f"log1p__{c}", 9).alias(f"log1p__{c}") for c in _MATRIX], *[f"missing__{c}" for c in _MATRIX])


@query("SELECT e.row_id, round((value - q[1]) / CASE WHEN q[3] = q[2] THEN 1 ELSE q[3] - q[2] END, 6) AS scaled FROM {ev} e JOIN (SELECT state, quantile_cont(value, [0.5, 0.1, 0.9]) AS q FROM {ev} GROUP BY 1) s ON e.state = s.state")
def e14_robust_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.robust_scaled(journal(spark, sf_dir), ["state"], ["value"]).select("row_id", F.round("scaled_value", 6).alias("scaled"))


@query("WITH i AS (SELECT o_custkey AS k, o_orderdate AS s, o_orderdate + INTERVAL 90 DAY AS e FROM orders), f AS (SELECT *, s > max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fresh FROM i), g AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f), m AS (SELECT k, island, min(s) AS s, max(e) AS e FROM g GROUP BY 1, 2) SELECT k, CAST(sum(date_diff('second', s, e)) AS DOUBLE) AS seconds FROM m GROUP BY 1")
def g28_interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.plans.registry import table

    spans = table(spark, sf_dir, "orders").selectExpr("o_custkey AS k", "o_orderdate AS s", "o_orderdate + INTERVAL '90' DAY AS e")
    return intervals.union_seconds(spans, ["k"], "s", "e")


@query("WITH n AS (SELECT channel_id, CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS s, date_trunc('hour', ts) + INTERVAL 25 HOUR AS e FROM {ev} WHERE state = 'signup'), f AS (SELECT *, s > max(e) OVER (PARTITION BY channel_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 1 HOUR AS fresh FROM n), g AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY channel_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT channel_id, min(s) AS s, max(e) AS e, count(*) AS members FROM g GROUP BY channel_id, island")
def w18_prediction_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = journal(spark, sf_dir).where("state = 'signup'").select("channel_id", timeops.ceil_hour(F.col("ts")).alias("s"), timeops.hours_later(timeops.floor_hour(F.col("ts")), 25).alias("e"))
    return intervals.merged(normal, ["channel_id"], "s", "e", 3600)


@query("SELECT channel_id, unnest(generate_series(s, s + INTERVAL 4 HOUR, INTERVAL 1 HOUR)) AS t FROM (SELECT channel_id, min(CAST(date_trunc('hour', ts) AS TIMESTAMP)) AS s FROM {ev} GROUP BY 1)")
def w19_interval_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = journal(spark, sf_dir).groupBy("channel_id").agg(F.min(timeops.floor_hour(F.col("ts"))).alias("s")).withColumn("e", timeops.hours_later(F.col("s"), 5))
    return intervals.hours_inside(first, "s", "e", "t").select("channel_id", "t")


@query("SELECT row_id, CASE WHEN ts < TIMESTAMP '2024-01-12' THEN 'train' WHEN ts < TIMESTAMP '2024-01-24' THEN 'test' ELSE 'none' END AS split, CASE WHEN ts >= TIMESTAMP '2024-01-24' THEN 'outside_splits' WHEN ts + INTERVAL 24 HOUR < CASE WHEN ts < TIMESTAMP '2024-01-12' THEN TIMESTAMP '2024-01-12' ELSE TIMESTAMP '2024-01-24' END THEN 'assigned' ELSE 'purged_boundary' END AS split_status FROM {ev}")
def x10_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = timeops.split_of(F.col("ts"), [("train", "2024-01-01 00:00:00", "2024-01-12 00:00:00"), ("test", "2024-01-12 00:00:00", "2024-01-24 00:00:00")], 24)
    return journal(spark, sf_dir).select("row_id", F.coalesce(s["split"], F.lit("none")).alias("split"), s["split_status"].alias("split_status"))


@query("SELECT row_id, CAST(CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 0 WHEN ts >= TIMESTAMP '2024-01-15' THEN 1 ELSE -1 END AS INT) AS segment FROM {ev}")
def f06_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = timeops.segment_of(F.col("ts"), [("2024-01-01 00:00:00", "2024-01-10 00:00:00"), ("2024-01-15 00:00:00", "2024-02-01 00:00:00")])
    return journal(spark, sf_dir).select("row_id", F.coalesce(s, F.lit(-1)).alias("segment"))
