"""Further operators: availability, episode history, policies, threshold choice, stability, drill-downs, simulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import parse, rules, simulation, timeops
from tidelog.operators import alerts, asof, detectors, episodes, features
from tidelog.plans import detection, features as feature_plans, scoring
from tidelog.plans.registry import journal, query, run_sql, sql_query, table
from tidelog.sources import readers, sinks

sql_query("z21_stability_by_month", "SELECT month(ts) AS m, state, count(*) AS n, count(DISTINCT channel_id) AS channels, round(CAST(count(*) AS DOUBLE) / count(DISTINCT channel_id), 6) AS per_channel FROM {ev} GROUP BY month(ts), state", "SELECT CAST(month(ts) AS INT) AS m, state, count(*) AS n, count(DISTINCT channel_id) AS channels, round(CAST(count(*) AS DOUBLE) / count(DISTINCT channel_id), 6) AS per_channel FROM {ev} GROUP BY month(ts), state")
sql_query("x23_key_boundaries", "SELECT count(*) AS groups FROM (SELECT user_id, event_type, props FROM {events} GROUP BY user_id, event_type, props)")
sql_query("e22_pack_join", "WITH a AS (SELECT event_id, value FROM {events}), b AS (SELECT event_id, event_type FROM {events}) SELECT a.event_id, a.value, b.event_type FROM a JOIN b ON a.event_id = b.event_id")


@query("SELECT row_id, channel_id FROM {ev} WHERE channel_id = '7' AND ts >= TIMESTAMP '2024-01-05' AND state IN ('error', 'view')")
def z27_bound_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT event_id AS row_id, CAST(user_id AS STRING) AS channel_id FROM {events} WHERE CAST(user_id AS STRING) = :channel AND ts >= CAST(:start AS TIMESTAMP_NTZ) AND array_contains(:states, event_type)"
    return spark.sql(text, args={"channel": "7", "start": "2024-01-05 00:00:00", "states": F.array(F.lit("error"), F.lit("view"))}, events=table(spark, sf_dir, "events"))


@query("SELECT CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, count(*) AS n FROM {ev} GROUP BY 1, 2")
def z29_partition_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.work_path(spark, "hive")
    sinks.write_months(journal(spark, sf_dir), path, "ts", ["channel_id", "ts", "row_id"], 2)
    return spark.read.parquet(path).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type, value FROM events")
def s06_stated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.parquet_files(spark, [f"{sf_dir}/events.parquet"], "event_id long, event_type string, value double")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, nullif(trim(c_mktsegment), 'BUILDING') AS kind FROM customer")
def s04_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.work_path(spark, "dictionary")
    table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS STRING) AS id", "CASE WHEN c_mktsegment = 'BUILDING' THEN ' ' ELSE concat(c_mktsegment, ' ') END AS kind").write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.dictionary(spark, path, ["id", "kind"], "id")


@query("SELECT c_mktsegment AS kind, array_to_string(list_transform(list_sort(list(c_custkey)), lambda x: CAST(x AS VARCHAR)), ',') AS lines FROM customer GROUP BY 1")
def s05_state_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_mktsegment AS kind", "c_custkey AS source_row")
    return readers.state_dictionary(rows, ["kind"]).select("kind", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query("SELECT row_id, CASE row_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'true' ELSE 'invalid_alarm' END AS alarm FROM {ev}")
def x01_parse_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("element_at(array(' T', 'FALSE', '1', 'да'), CAST(row_id % 4 AS INT) + 1)")
    return journal(spark, sf_dir).select("row_id", parse.parse_alarm(text).alias("p")).select("row_id", F.coalesce(F.col("p.value").cast("string"), "p.flag").alias("alarm"))


@query("SELECT row_id, CASE WHEN row_id % 3 = 0 THEN ts - INTERVAL (microsecond(ts) % 1000000) MICROSECOND END AS value, CASE row_id % 3 WHEN 1 THEN 'timezone_present' WHEN 2 THEN 'invalid_timestamp' ELSE '' END AS flag FROM {ev}")
def x02_parse_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    date, time = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    odd = F.when(F.col("row_id") % 3 == 1, F.concat(time, F.lit("+03:00"))).when(F.col("row_id") % 3 == 2, F.lit("24:61")).otherwise(time)
    return journal(spark, sf_dir).select("row_id", parse.parse_local_timestamp(date, odd).alias("p")).select("row_id", F.col("p.value").alias("value"), F.coalesce("p.flag", F.lit("")).alias("flag"))


@query("SELECT row_id, CASE state WHEN 'error' THEN 'fault' WHEN 'signup' THEN 'normal' WHEN 'click' THEN 'neutral' ELSE 'uncertain' END AS effect FROM {ev}")
def x07_registered_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal(spark, sf_dir).select("row_id", rules.effect(F.col("state")).alias("effect"))


@query("WITH e AS (SELECT * FROM {ev}), n AS (SELECT channel_id, ts FROM e WHERE state = 'signup') SELECT e.row_id, coalesce(e.ts > n.ts AND e.ts <= n.ts + INTERVAL 24 HOUR, false) AS strict, coalesce(e.ts <= n.ts + INTERVAL 24 HOUR, false) AS closed FROM e ASOF LEFT JOIN n ON e.channel_id = n.channel_id AND e.ts >= n.ts")
def x09_recent_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = journal(spark, sf_dir)
    got = asof.asof_last(ev, ev.where("state = 'signup'").select("channel_id", F.col("ts").alias("n")), ["channel_id"], "ts", "n", "last")
    both = [rules.recent_normal(F.col("last.n"), F.col("ts"), F.lit(True), 24, s) for s in (True, False)]
    return got.select("row_id", both[0].alias("strict"), both[1].alias("closed"))


_duck_completed = f"WITH RECURSIVE {detection.DUCK_COMPLETED}, c AS (SELECT channel_id, start_at AS s, end_at AS z FROM completed), ev AS (SELECT * FROM {{ev}}), {feature_plans.DUCK_GRID}"


@query(_duck_completed + " SELECT g.channel_id, g.t, count(c.z) FILTER (WHERE c.z > g.t - INTERVAL 168 HOUR) AS n, round(avg(date_diff('microsecond', s, z)) FILTER (WHERE c.z > g.t - INTERVAL 168 HOUR) / 1e6, 3) AS mean_seconds, round(date_diff('microsecond', max(z), g.t) / 1e6, 3) AS age_seconds FROM grid g LEFT JOIN c ON c.channel_id = g.channel_id AND c.z <= g.t GROUP BY 1, 2")
def e09_episode_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = detection.z12_completed_episodes(spark, sf_dir)
    got = features.completed_history(feature_plans.grid(spark, sf_dir), done)
    return got.select("channel_id", "t", F.col("completed_episode_count_168h").alias("n"), F.round("mean_duration_seconds", 3).alias("mean_seconds"), F.round("last_completed_episode_end_age_seconds", 3).alias("age_seconds"))


@query(_duck_completed + ", f AS (SELECT g.channel_id, g.t, count(e.ts) FILTER (WHERE e.alarm AND e.ts > g.t - INTERVAL 24 HOUR) AS f24, count(e.ts) FILTER (WHERE e.alarm) AS f168, count(e.ts) FILTER (WHERE e.state IN ('error', 'purchase') AND e.ts > g.t - INTERVAL 24 HOUR) AS t24 FROM grid g LEFT JOIN ev e ON g.channel_id = e.channel_id AND e.ts <= g.t AND e.ts > g.t - INTERVAL 168 HOUR GROUP BY 1, 2), k8 AS (SELECT g.channel_id, g.t, count(c.z) AS c168 FROM grid g LEFT JOIN c ON c.channel_id = g.channel_id AND c.z <= g.t AND c.z > g.t - INTERVAL 168 HOUR GROUP BY 1, 2) SELECT f.channel_id, f.t, f24, f168, c168, t24 FROM f JOIN k8 ON f.channel_id = k8.channel_id AND f.t = k8.t")
def e11_rule_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = features.hourly_counts(feature_plans.grid(spark, sf_dir), journal(spark, sf_dir), {"f": F.col("alarm").cast("long"), "x": F.col("state").isin("error", "purchase").cast("long")}, [24, 168])
    both = asof.trailing_sums(counts, detection.z12_completed_episodes(spark, sf_dir), ["channel_id"], "t", "end_at", {"c": F.lit(1)}, [168])
    return both.select("channel_id", "t", F.col("f_24h").alias("f24"), F.col("f_168h").alias("f168"), F.col("c_168h").alias("c168"), F.col("x_24h").alias("t24"))


@query(f"WITH ev AS (SELECT * FROM {{ev}}), {feature_plans.DUCK_GRID}, c AS (SELECT g.channel_id, g.t, count(e.ts) AS n, min(e.ts) AS first_at FROM grid g LEFT JOIN ev e ON g.channel_id = e.channel_id AND e.ts <= g.t GROUP BY 1, 2) SELECT channel_id, t, concat_ws(',', CASE WHEN n = 0 THEN 'no_observations_yet' END, CASE WHEN first_at IS NULL OR first_at > t - INTERVAL 168 HOUR OR n < 2 THEN 'insufficient_history' END, 'cadence_unknown') AS reasons FROM c")
def e06_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = journal(spark, sf_dir)
    w = Window.partitionBy("channel_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    so_far = ev.select("channel_id", "ts", F.count(F.lit(1)).over(w).alias("n"), F.min("ts").over(w).alias("first_at"))
    p = asof.asof_last(feature_plans.grid(spark, sf_dir), so_far, ["channel_id"], "t", "ts", "past")
    n = F.coalesce("past.n", F.lit(0))
    rows = p.select("channel_id", "t", n.alias("past_count"), n.alias("usable_count"), F.col("past.first_at").alias("first_usable_at"), n.alias("usable_times"), F.lit(1).alias("types"), F.lit(1).alias("objects"), F.lit("eligible").alias("baseline_status"), F.array().cast("array<string>").alias("baseline_reasons"), F.lit(True).alias("windows_eligible"), F.lit(False).alias("excluded_any"))
    return features.availability(rows, False).select("channel_id", "t", F.array_join("availability_reasons", ",").alias("reasons"))


@query(f"WITH ev AS (SELECT * FROM {{ev}}), {feature_plans.DUCK_GRID} SELECT g.channel_id, g.t, count(e.ts) FILTER (WHERE e.row_id % 11 <> 0) AS batch_24h, count(e.ts) AS live_24h FROM grid g LEFT JOIN ev e ON g.channel_id = e.channel_id AND e.ts <= g.t AND e.ts > g.t - INTERVAL 24 HOUR GROUP BY 1, 2")
def e23_live_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serving counts every row; batch leaves out what quality flags exclude."""
    values = {"batch": (F.col("row_id") % 11 != 0).cast("long"), "live": F.lit(1)}
    return features.hourly_counts(feature_plans.grid(spark, sf_dir), journal(spark, sf_dir), values, [24])


_TYPES = list(rules.TYPE_MODES)
_DUCK_MODES = ", ".join(f"({i}, '{t}', '{n}', '{d}', '{c}')" for i, (t, (n, d, c)) in enumerate(rules.TYPE_MODES.items()))


@query(f"SELECT row_id, t.kind AS sensor_type, numeric_mode, discrete_mode, context_mode, CASE WHEN numeric_mode = 'primary' THEN 'numeric' WHEN discrete_mode IN ('primary', 'conditional') THEN 'discrete' END AS primary_mode, coalesce(discrete_mode = 'conditional', false) AS needs_review FROM {{ev}} e LEFT JOIN (VALUES {_DUCK_MODES}) t(i, kind, numeric_mode, discrete_mode, context_mode) ON row_id % {len(_TYPES) + 1} = t.i")
def k14_type_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy of every sensor type; one row in twenty has a type without."""
    kinds = F.get(F.array(*map(F.lit, _TYPES)), (F.col("row_id") % (len(_TYPES) + 1)).cast("int"))
    return rules.dispatched(journal(spark, sf_dir).select("row_id", kinds.alias("sensor_type")))


@query()
def k15_catalog_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detect, consolidate and match against the truth of a synthetic suite."""
    events, truth = simulation.suite(spark, 260919)
    shifts = detectors.level_shifts(events).select("channel_id", "start_at", "confirmed_at", "end_at", F.lit("numeric_level_shift").alias("kind"))
    patterns = detectors.discrete_patterns(events).select("channel_id", "start_at", "confirmed_at", "end_at", "kind")
    found = shifts.unionByName(patterns).withColumns({"score": F.lit(None).cast("double"), "evidence": F.array("kind"), "recovery_at": F.lit(None).cast("timestamp_ntz")})
    merged = episodes.consolidate(found, ["channel_id", "kind"])
    warnings = merged.select("channel_id", F.concat_ws(":", "channel_id", "kind", "start_at").alias("warning_id"), F.col("confirmed_at").alias("at"))
    truths = truth.where("NOT is_control").select("channel_id", F.col("scenario_id").alias("truth_id"), "start_at", timeops.seconds_later(F.col("end_at"), 600).alias("until"))
    return alerts.match_episodes(truths, warnings, ["channel_id"])


@query("WITH RECURSIVE ev AS (SELECT * FROM {ev}), r AS (SELECT DISTINCT channel_id, ts, value FROM ev), g AS (SELECT *, date_diff('microsecond', lag(ts) OVER (PARTITION BY channel_id ORDER BY ts), ts) / 3.6e9 AS gap FROM r), n AS (SELECT channel_id, ts, row_number() OVER (PARTITION BY channel_id ORDER BY ts) AS i FROM g WHERE value > 3 AND value <= 20 AND gap <= 48), c AS (SELECT channel_id, ts, ts AS last, i, true AS emitted FROM n WHERE i = 1 UNION ALL SELECT n.channel_id, n.ts, CASE WHEN n.ts >= c.last + INTERVAL 24 HOUR THEN n.ts ELSE c.last END, n.i, n.ts >= c.last + INTERVAL 24 HOUR FROM c JOIN n ON n.channel_id = c.channel_id AND n.i = c.i + 1), w AS (SELECT channel_id, ts FROM c WHERE emitted), f AS (SELECT channel_id, ts AS critical_at FROM (SELECT channel_id, ts, lag(ts) OVER (PARTITION BY channel_id ORDER BY ts) AS p FROM ev WHERE alarm) WHERE p IS NULL OR ts > p + INTERVAL 24 HOUR) SELECT f.channel_id, critical_at, CASE WHEN w.ts >= critical_at - INTERVAL 48 HOUR THEN w.ts END AS warning_at FROM f ASOF LEFT JOIN w ON f.channel_id = w.channel_id AND f.critical_at > w.ts")
def k16_low_value_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low readings as warnings, errors a day apart as episodes, and the last warning in the two days before each."""
    ev = journal(spark, sf_dir)
    warned = alerts.low_value_watch(ev.select("channel_id", "ts", "value"), 3, 20, 48)
    w = Window.partitionBy("channel_id").orderBy("ts")
    first = ev.where("alarm").withColumn("p", F.lag("ts").over(w)).where(F.col("p").isNull() | (F.col("ts") > timeops.hours_later(F.col("p"), 24))).select("channel_id", F.col("ts").alias("critical_at"))
    got = asof.asof_last(first, warned.select("channel_id", F.col("ts").alias("at")), ["channel_id"], "critical_at", "at", "w", strict=True)
    recent = F.col("w.at") >= timeops.hours_later(F.col("critical_at"), -48)
    return got.select("channel_id", "critical_at", F.when(recent, F.col("w.at")).alias("warning_at"))


@query(f"WITH RECURSIVE {scoring.DUCK_POINTS}, t AS (SELECT rule_score AS s, sum(target) AS p, count(*) AS n FROM z GROUP BY 1), c AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS seen, sum(p) OVER () AS total FROM t), g AS (SELECT s, tp / seen AS pr, tp / total AS re FROM c) SELECT arg_max(s, (CASE WHEN pr > 0.3 AND re > 0.5 THEN 1 ELSE 0 END, CASE WHEN pr + re > 0 THEN round(2 * pr * re / (pr + re), 9) ELSE 0 END, s)) AS threshold FROM g")
def a06_goal_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = alerts.score_curve(scoring.labelled(spark, sf_dir), "rule_score", "target")
    g = curve.select("s", (F.col("tp") / F.col("seen")).alias("pr"), (F.col("tp") / F.col("total")).alias("re"))
    goal, f1 = F.when((F.col("pr") > 0.3) & (F.col("re") > 0.5), 1).otherwise(0), F.when(F.col("pr") + F.col("re") > 0, F.round(2 * F.col("pr") * F.col("re") / (F.col("pr") + F.col("re")), 9)).otherwise(0.0)
    return g.agg(F.max_by("s", F.struct(goal, f1, "s")).alias("threshold"))


@query("WITH RECURSIVE e AS (SELECT channel_id, ts, row_number() OVER (PARTITION BY channel_id ORDER BY ts) AS i FROM {ev} WHERE alarm), w AS (SELECT channel_id, ts, ts AS last, i FROM e WHERE i = 1 UNION ALL SELECT e.channel_id, e.ts, CASE WHEN e.ts >= w.last + INTERVAL 24 HOUR THEN e.ts ELSE w.last END, e.i FROM w JOIN e ON e.channel_id = w.channel_id AND e.i = w.i + 1) SELECT channel_id, ts, last AS blocker_at FROM w WHERE ts <> last")
def a13_cooldown_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.blockers(journal(spark, sf_dir).where("alarm").select("channel_id", "ts"), ["channel_id"], "ts", 24)


_DUCK_RESET = f"""{scoring.DUCK_RULE}, dn AS (SELECT s.channel_id, s.t AS pt, rule_score >= 7.1 AS above, coalesce(NOT n.active AND NOT n.uncertain, false) AS healthy FROM s ASOF LEFT JOIN x_inst n ON s.channel_id = n.channel_id AND s.t >= n.ts),
u AS (SELECT channel_id, pt, 2 AS k, CAST(NULL AS TIMESTAMP) AS onset, above, healthy FROM dn UNION ALL SELECT channel_id, end_at, 1, start_at, false, false FROM completed UNION ALL SELECT channel_id, ts, 0, NULL, false, false FROM x_ev WHERE effect = 'uncertain'),
o AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY pt, k) AS i FROM u),
y AS (SELECT DISTINCT channel_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS TIMESTAMP) AS pt, 0 AS k, CAST(NULL AS TIMESTAMP) AS last, false AS recovered, false AS warning, '' AS reason FROM o
UNION ALL SELECT channel_id, i, pt, k, CASE WHEN fire THEN pt ELSE last END, CASE k WHEN 1 THEN coalesce(last < onset AND onset <= last + INTERVAL 24 HOUR AND onset < pt AND pt < last + INTERVAL 24 HOUR, false) WHEN 0 THEN false ELSE recovered AND NOT fire END, fire, CASE WHEN NOT above THEN 'below_threshold' WHEN NOT fire THEN 'suppressed_24h' WHEN quiet THEN 'recovered_episode_reset' ELSE 'standard_24h_warning' END
FROM (SELECT *, k = 2 AND above AND (NOT quiet OR recovered AND healthy) AS fire FROM (SELECT o.*, y.last, y.recovered, coalesce(o.pt < y.last + INTERVAL 24 HOUR, false) AS quiet FROM y JOIN o ON o.channel_id = y.channel_id AND o.i = y.i + 1)))"""


@query(f"WITH RECURSIVE {_DUCK_RESET} SELECT channel_id, pt AS \"at\", warning, reason FROM y WHERE k = 2")
def a14_recovery_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = detection.effects(spark, sf_dir)
    now = asof.asof_last(scoring.rule_rows(spark, sf_dir).withColumnRenamed("t", "at"), episodes.state_timeline(ev).select("channel_id", "ts", "normal_at", "active", "uncertain"), ["channel_id"], "at", "ts", "now")
    healthy = F.coalesce(~F.col("now.active") & ~F.col("now.uncertain"), F.lit(False))
    decisions = now.select("channel_id", "at", F.lit(True).alias("eligible"), F.col("alert").alias("above"), healthy.alias("healthy"))
    done = detection.z12_completed_episodes(spark, sf_dir).select("channel_id", F.col("start_at").alias("onset"), F.col("end_at").alias("at"))
    unclear = ev.where("effect = 'uncertain'").select("channel_id", F.col("ts").alias("at"))
    return alerts.recovery_reset(decisions, done, unclear, True)


@query(f"WITH RECURSIVE {scoring.DUCK_RULE} SELECT substring(channel_id, 1, 1) AS kind, 'registered_fault_text_count_24h' AS term, round(median(2.0 * f24), 6) AS value FROM s GROUP BY 1 UNION ALL SELECT substring(channel_id, 1, 1), 'registered_fault_text_count_168h', round(median(0.5 * f168), 6) FROM s GROUP BY 1 UNION ALL SELECT substring(channel_id, 1, 1), 'completed_episode_count_168h', round(median(1.0 * c168), 6) FROM s GROUP BY 1 UNION ALL SELECT substring(channel_id, 1, 1), 'technical_message_count_24h', round(median(0.1 * t24), 6) FROM s GROUP BY 1")
def z19_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = alerts.contributions(scoring.rule_rows(spark, sf_dir).withColumn("kind", F.substring("channel_id", 1, 1)), ["kind"])
    return got.select("kind", "term", F.round("median_contribution", 6).alias("value"))


@query(f"WITH RECURSIVE {scoring.DUCK_RULE} SELECT channel_id, t, CASE WHEN f168 = 0 THEN 'insufficient_history' WHEN rule_score >= 7.1 THEN 'warning' ELSE 'scored' END AS prediction_status FROM s")
def a18_forecast_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("registered_fault_text_count_168h") == 0, "insufficient_history").when(F.col("alert"), "warning").otherwise("scored")
    return scoring.rule_rows(spark, sf_dir).select("channel_id", "t", status.alias("prediction_status"))


_DUCK_KINDS = "(SELECT *, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS kind FROM {ev})"


@query(scoring.duck_matching("channel_id, kind", f"SELECT channel_id, kind, CAST(row_id AS VARCHAR) AS id, ts AS s, ts + INTERVAL 24 HOUR AS u FROM {_DUCK_KINDS} WHERE alarm", f"SELECT channel_id, kind, CAST(row_id AS VARCHAR) AS id, ts AS wt FROM {_DUCK_KINDS} WHERE state = 'purchase'") + " SELECT kind, count(delay_seconds) AS tp, count(*) FILTER (WHERE truth_id IS NULL) AS fp, count(*) FILTER (WHERE warning_id IS NULL) AS fn FROM matches GROUP BY 1")
def a10_anomaly_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching within channel and kind."""
    ev = journal(spark, sf_dir).withColumn("kind", F.when(F.col("value") > 50, "high").otherwise("low"))
    truths = ev.where("alarm").select("channel_id", "kind", F.col("row_id").cast("string").alias("truth_id"), F.col("ts").alias("start_at"), timeops.hours_later(F.col("ts"), 24).alias("until"))
    warnings = ev.where("state = 'purchase'").select("channel_id", "kind", F.col("row_id").cast("string").alias("warning_id"), F.col("ts").alias("at"))
    return alerts.match_episodes(truths, warnings, ["channel_id", "kind"]).groupBy("kind").agg(F.count(F.when(F.col("delay_seconds").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("truth_id").isNull(), 1)).alias("fp"), F.count(F.when(F.col("warning_id").isNull(), 1)).alias("fn"))


@query()
def a23_synthetic_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, truth = simulation.suite(spark, 260919)
    return events.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).join(truth.select("scenario_id", "is_control"), "scenario_id")


@query("WITH h AS (SELECT channel_id, CAST(ts AS DATE) AS d, state FROM {ev}), r AS (SELECT channel_id, d, list_sort(list_distinct(list(state))) AS s FROM h GROUP BY 1, 2) SELECT channel_id, array_to_string(list_sort(list_distinct(flatten(list(s)))), ',') AS any_day, (SELECT coalesce(string_agg(x, ',' ORDER BY x), '') FROM (SELECT u AS x FROM (SELECT unnest(s) AS u, channel_id AS c FROM r) q WHERE q.c = r.channel_id GROUP BY u HAVING count(*) = (SELECT count(*) FROM r r2 WHERE r2.channel_id = r.channel_id))) AS every_day FROM r GROUP BY channel_id")
def z18_reason_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons met on any day of a channel, and those met on every day."""
    days = journal(spark, sf_dir).select("channel_id", F.to_date("ts").alias("d"), "state").distinct()
    total = days.groupBy("channel_id").agg(F.countDistinct("d").alias("days"))
    each = days.groupBy("channel_id", "state").agg(F.count(F.lit(1)).alias("n")).join(total, "channel_id")
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    return each.groupBy("channel_id").agg(joined("state").alias("any_day"), joined(F.when(F.col("n") == F.col("days"), F.col("state"))).alias("every_day"))


@query("WITH o AS (SELECT row_id, state, CAST(hour(ts) AS VARCHAR) AS h, sha256(CAST(row_id AS VARCHAR)) AS k FROM {ev}), a AS (SELECT row_id, k, unnest(['s' || state, 'h' || h]) AS v FROM o) SELECT DISTINCT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY v ORDER BY k) AS r FROM a) WHERE r = 1")
def z16_attribute_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are the first, in the order of their hash, to show some value: what a greedy walk keeps."""
    rows = journal(spark, sf_dir).select("row_id", F.sha2(F.col("row_id").cast("string"), 256).alias("k"), F.explode(F.array(F.concat(F.lit("s"), "state"), F.concat(F.lit("h"), F.hour("ts").cast("string")))).alias("v"))
    return rows.groupBy("v").agg(F.min_by("row_id", "k").alias("row_id")).select("row_id").distinct()


@query(f"WITH {feature_plans.DUCK_PAIRS}, x AS (SELECT *, CASE WHEN row_id IS NOT NULL AND row_id % 11 = 0 THEN true ELSE false END AS excluded FROM (SELECT p.*, e.row_id FROM pairs p LEFT JOIN ev e ON p.channel_id = e.channel_id AND p.ts = e.ts)) SELECT channel_id, t, count(ts) AS event_count_24h, count(*) FILTER (WHERE alarm) AS alarm_count_24h, count(*) FILTER (WHERE excluded) AS excluded_quality_count_24h, count(value) FILTER (WHERE NOT excluded) AS numeric_count_24h, round(median(value) FILTER (WHERE NOT excluded), 6) AS numeric_median_24h, round(max(value) FILTER (WHERE NOT excluded) - min(value) FILTER (WHERE NOT excluded), 6) AS numeric_range_24h FROM x GROUP BY 1, 2")
def e01_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = journal(spark, sf_dir).withColumn("excluded", F.col("row_id") % 11 == 0)
    got = features.snapshot(feature_plans.grid(spark, sf_dir), ev, [6, 24])
    return got.select("channel_id", "t", "event_count_24h", "alarm_count_24h", "excluded_quality_count_24h", "numeric_count_24h", F.round("numeric_median_24h", 6).alias("numeric_median_24h"), F.round("numeric_range_24h", 6).alias("numeric_range_24h"))


@query(f"WITH ev AS (SELECT * FROM {{ev}}), {feature_plans.DUCK_GRID} SELECT g.channel_id, g.t, count(e.ts) AS n, round(median(e.value), 6) AS median FROM grid g LEFT JOIN ev e ON g.channel_id = e.channel_id AND e.ts > date_trunc('day', g.t) - INTERVAL 192 HOUR AND e.ts < date_trunc('day', g.t) - INTERVAL 24 HOUR GROUP BY 1, 2")
def e05_frozen_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = features.frozen_baseline(feature_plans.grid(spark, sf_dir), journal(spark, sf_dir), 24, 168, 10, 120)
    return got.select("channel_id", "t", F.col("baseline_event_count").alias("n"), F.round("baseline_numeric_median", 6).alias("median"))


_VARIANTS = {"baseline": 4.0, "lower": 2.5, "higher": 6.0}
_DUCK_VARIANTS = f"""{scoring.DUCK_POINTS}, th AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {t})" for n, t in _VARIANTS.items())}) v(variant, th)),
q AS (SELECT variant, z.*, row_number() OVER (PARTITION BY variant, channel_id ORDER BY t) AS i FROM z, th WHERE rule_score >= th),
c AS (SELECT variant, channel_id, t, target, episode, i, t AS last, true AS emitted FROM q WHERE i = 1
UNION ALL SELECT q.variant, q.channel_id, q.t, q.target, q.episode, q.i, CASE WHEN q.t >= c.last + INTERVAL 24 HOUR THEN q.t ELSE c.last END, q.t >= c.last + INTERVAL 24 HOUR FROM c JOIN q ON q.variant = c.variant AND q.channel_id = c.channel_id AND q.i = c.i + 1),
o AS (SELECT variant, target = 1 AND row_number() OVER (PARTITION BY variant, episode ORDER BY channel_id, t) = 1 AS hit FROM c WHERE emitted),
v AS (SELECT variant, count(*) AS warnings, count(*) FILTER (WHERE hit) AS matched FROM o GROUP BY 1), d AS (SELECT count(DISTINCT (channel_id, CAST(t AS DATE))) AS days, count(DISTINCT episode) AS truth FROM z),
m AS (SELECT th.variant, coalesce(warnings, 0) AS warnings, coalesce(matched, 0) AS matched, CASE WHEN warnings > 0 THEN matched / warnings ELSE 0 END AS precision, coalesce(matched, 0) / truth AS recall, (coalesce(warnings, 0) - coalesce(matched, 0)) * 1000 / days AS per FROM th LEFT JOIN v ON th.variant = v.variant, d),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)""".replace("\nf AS (SELECT *, CASE WHEN precision", "\nff AS (SELECT *, CASE WHEN precision")


@query(f"WITH RECURSIVE {_DUCK_VARIANTS} SELECT ff.variant, ff.warnings, ff.matched, round(ff.f1, 9) AS f1, round(ff.recall - b.recall, 9) AS delta_recall, round(ff.f1 - b.f1, 9) AS delta_f1, round(ff.per - b.per, 6) AS delta_unmatched_per_1000 FROM ff, (SELECT * FROM ff WHERE variant = 'baseline') b")
def a09_variant_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule at three thresholds over the same truth, and what each differs from the baseline by."""
    rows = scoring.labelled(spark, sf_dir)
    each = F.explode(F.map_from_arrays(F.array(*map(F.lit, _VARIANTS)), F.array(*map(F.lit, _VARIANTS.values()))))
    spread = rows.select("*", each.alias("variant", "threshold"))
    emitted = alerts.cooldown(spread.where("rule_score >= threshold"), ["variant", "channel_id"], "prediction_time").where("emitted")
    first = F.row_number().over(Window.partitionBy("variant", "target_episode_id").orderBy("channel_id", "prediction_time")) == 1
    outcomes = emitted.withColumns({"outcome": F.when((F.col("target") == 1) & first, "matched_episode").otherwise("other"), "lead_hours": F.lit(None).cast("double")})
    got = alerts.compared(alerts.alert_summary(spread, outcomes, ["variant"]), "baseline")
    return got.select("variant", "warnings", "matched", F.round("f1", 9).alias("f1"), F.round("delta_recall", 9).alias("delta_recall"), F.round("delta_f1", 9).alias("delta_f1"), F.round("delta_unmatched_per_1000", 6).alias("delta_unmatched_per_1000"))


@query()
def e14_context_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled counts of every channel at its last hour in four clusters, by Spark's own seeded k-means, with the distance to the centre as a contrast."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import RobustScaler, VectorAssembler

    wide = feature_plans.wide(spark, sf_dir)
    names = [f"{n}_{h}h" for n in feature_plans.FAMILIES for h in (24, 168)]
    last = wide.groupBy("channel_id").agg(F.max_by(F.struct(*names), "t").alias("r")).select("channel_id", "r.*")
    matrix = VectorAssembler(inputCols=names, outputCol="raw").transform(last)
    scaled = RobustScaler(inputCol="raw", outputCol="x", lower=0.1, upper=0.9, withCentering=True, relativeError=0.0).fit(matrix).transform(matrix)
    fitted = KMeans(featuresCol="x", predictionCol="cluster", k=4, seed=7).fit(scaled)
    from pyspark.ml.functions import vector_to_array

    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in fitted.clusterCenters()])
    own = F.get(centres, F.col("cluster"))
    distance = F.sqrt(F.aggregate(F.zip_with(vector_to_array("x"), own, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return fitted.transform(scaled).select("channel_id", "cluster", F.round(distance, 9).alias("distance"))


@query()
def a16_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient boosted trees on the first three quarters of the hours, and their score of every point of the rest."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = scoring.rule_rows(spark, sf_dir).join(scoring.labelled(spark, sf_dir).select("channel_id", F.col("prediction_time").alias("t"), "target"), ["channel_id", "t"])
    matrix = VectorAssembler(inputCols=list(alerts.TERMS), outputCol="x").transform(rows)
    hours = features.hours_of(journal(spark, sf_dir))
    cut = F.expr(f"timestampadd(SECOND, CAST(timestampdiff(SECOND, TIMESTAMP_NTZ '{hours[0]}', TIMESTAMP_NTZ '{hours[1]}') * 0.75 AS INT), TIMESTAMP_NTZ '{hours[0]}')")
    fitted = GBTClassifier(featuresCol="x", labelCol="target", maxIter=10, maxDepth=3, seed=7).fit(matrix.where(F.col("t") < cut))
    scored = fitted.transform(matrix.where(F.col("t") >= cut))
    return scored.select("channel_id", "t", "target", F.round(vector_to_array("probability")[1], 9).alias("score"))
