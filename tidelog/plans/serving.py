"""Serving views, admission, observability, smoke features, sources and sinks: queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import rules, timeops
from tidelog.operators import admission, asof, episodes, observability, serving, smoke
from tidelog.plans import detection, features as feature_plans, scoring
from tidelog.plans.registry import journal, query, table
from tidelog.sources import readers, sinks


def _with_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal(spark, sf_dir).withColumn("effect", rules.effect(F.col("state")))


@query("WITH e AS (SELECT channel_id, arg_max(CASE state WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'healthy' ELSE 'unknown' END, ts) AS s FROM {ev} WHERE state <> 'click' GROUP BY 1) SELECT DISTINCT v.channel_id, coalesce(e.s, 'observed') AS operational_state FROM {ev} v LEFT JOIN e ON v.channel_id = e.channel_id")
def a20_operational_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.operational_state(_with_effect(spark, sf_dir))


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    sensors = table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS STRING) AS channel_id", "c_name AS name", "c_mktsegment AS kind")
    scored = scoring.rule_rows(spark, sf_dir).select("channel_id", "t", F.lit("scored").alias("status"), F.col("rule_score").alias("score"), F.col("alert").alias("warning"))
    spans = episodes.registered_episodes(detection.effects(spark, sf_dir)).select("channel_id", "start_at", "end_at")
    return serving.sensor_view(sensors, _with_effect(spark, sf_dir), scored, spans)


_DUCK_VIEW = scoring.DUCK_RULE + """, e2 AS (SELECT channel_id, arg_max(state, ts) FILTER (WHERE state <> 'click') AS st FROM ev GROUP BY 1),
l AS (SELECT channel_id, arg_max(rule_score, t) AS score, arg_max(rule_score >= 7.1, t) AS warning FROM s GROUP BY 1),
ids AS (SELECT CAST(c_custkey AS VARCHAR) AS channel_id FROM customer UNION SELECT channel_id FROM ev),"""


_DUCK_BUCKETS = _DUCK_VIEW + """
o AS (SELECT channel_id, arg_max(end_at IS NULL, start_at) AS is_open FROM episodes GROUP BY 1),
v AS (SELECT ids.channel_id, l.score, l.warning, CASE e2.st WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'healthy' WHEN 'view' THEN 'unknown' WHEN 'purchase' THEN 'unknown' ELSE 'observed' END AS operational_state,
CASE WHEN e2.st = 'error' OR o.is_open THEN 'failed' WHEN l.warning THEN 'warning' WHEN l.score IS NOT NULL THEN 'healthy' ELSE 'unavailable' END AS bucket
FROM ids LEFT JOIN e2 ON ids.channel_id = e2.channel_id LEFT JOIN l ON ids.channel_id = l.channel_id LEFT JOIN o ON ids.channel_id = o.channel_id)"""


@query("WITH RECURSIVE " + _DUCK_BUCKETS + " SELECT channel_id, operational_state, bucket FROM v")
def a19_sensor_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir).select("channel_id", "operational_state", "bucket")


@query("WITH RECURSIVE " + _DUCK_BUCKETS + " SELECT channel_id, operational_state, bucket, score FROM v JOIN customer ON channel_id = CAST(c_custkey AS VARCHAR) WHERE contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build')")
def j17_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = serving.search(_view(spark, sf_dir), "build", [F.col("sensor.name"), F.col("sensor.kind")])
    return serving.dashboard_order(view).select("channel_id", "operational_state", "bucket", F.col("forecast.score").alias("score"))


@query("SELECT row_id, channel_id, ts FROM {ev} WHERE channel_id IN ('3', '14', '15') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def s08_filtered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.history(journal(spark, sf_dir), ["3", "14", "15"], "2024-01-05 00:00:00", "2024-01-20 00:00:00").select("row_id", "channel_id", "ts")


@query("WITH b AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS updated, 0 AS i FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, upper(c_name), CASE WHEN c_custkey % 3 = 0 THEN c_acctbal - 1 WHEN c_custkey % 3 = 1 THEN c_acctbal END, 1 FROM customer WHERE c_custkey % 4 <> 1) SELECT k, name FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY updated DESC NULLS LAST, i DESC) AS r FROM b) WHERE r = 1")
def s16_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    stored = c.where("c_custkey % 2 = 0").selectExpr("c_custkey AS k", "c_name AS name", "c_acctbal AS updated")
    new = c.where("c_custkey % 4 <> 1").selectExpr("c_custkey AS k", "upper(c_name) AS name", "CASE WHEN c_custkey % 3 = 0 THEN c_acctbal - 1 WHEN c_custkey % 3 = 1 THEN c_acctbal END AS updated")
    return serving.upsert(stored, new, "k", "updated").select("k", "name")


@query("SELECT row_id, channel_id, state, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month FROM {ev}")
def s13_monthly_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.work_path(spark, "monthly")
    sinks.write_months(journal(spark, sf_dir), path, "ts", ["channel_id", "ts", "row_id"])
    return spark.read.parquet(path).select("row_id", "channel_id", "state", "year", "month")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, props FROM events")
def s01_strict_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.work_path(spark, "csv")
    table(spark, sf_dir, "events").select(F.col("event_id").cast("string"), "event_type", "props").write.option("header", True).option("escape", '"').csv(path)
    return readers.strict_csv(spark, path, ["event_id", "event_type", "props"]).select("event_id", "event_type", "props")


@query("SELECT event_id, event_type FROM events")
def s12_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.work_path(spark, "jsonl")
    table(spark, sf_dir, "events").select("event_id", "event_type").write.json(path)
    return spark.read.schema("event_id long, event_type string").json(path)


@query("SELECT event_id, user_id, value FROM events WHERE event_type IN ('error', 'signup')")
def s21_filtered_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    both = e.unionByName(e.where("event_id % 3 = 0"))
    return both.where(F.col("event_type").isin("error", "signup")).dropDuplicates(["user_id", "ts", "event_type", "value"]).select("event_id", "user_id", "value")


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN row_id % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS again FROM {ev}")
def s20_idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appending a part twice adds it once."""
    path = sinks.work_path(spark, "parts")
    ev = journal(spark, sf_dir)
    for _ in range(2):
        sinks.append_once(ev.where("row_id % 10 <> 0"), path, "first")
    sinks.append_once(ev.where("row_id % 10 = 0"), path, "second")
    return sinks.read_parts(spark, path).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("row_id") % 10 == 0, 1)).alias("again"))


@query(f"WITH {feature_plans.DUCK_PAIRS}, c AS (SELECT channel_id, t, count(DISTINCT ts) AS n, max(ts) AS last FROM pairs GROUP BY 1, 2), g AS (SELECT channel_id, t, ts, lag(ts) OVER (PARTITION BY channel_id, t ORDER BY ts) AS p FROM pairs WHERE ts IS NOT NULL), m AS (SELECT channel_id, t, greatest(max(date_diff('microsecond', p, ts)), date_diff('microsecond', t - INTERVAL 24 HOUR, min(ts)), date_diff('microsecond', max(ts), t)) / 1e6 AS gap FROM g GROUP BY 1, 2) SELECT c.channel_id, c.t, concat_ws(',', CASE WHEN n = 0 THEN 'no_usable_observations' END, CASE WHEN n < 3 THEN 'insufficient_window_events' END, CASE WHEN least(1.0, n / 4.0) < 0.8 THEN 'coverage_below_threshold' END, CASE WHEN coalesce(gap, 86400) > 64800 THEN 'gap_above_threshold' END) AS reasons, CAST(least(1.0, n / 4.0) AS DOUBLE) AS coverage FROM c LEFT JOIN m ON c.channel_id = m.channel_id AND c.t = m.t")
def d08_observability(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = observability.window_audit(feature_plans.grid(spark, sf_dir), journal(spark, sf_dir).withColumn("excluded", F.lit(False)), 24, 6 * 3600)
    return got.select("channel_id", "t", F.array_join("reasons", ",").alias("reasons"), "coverage")


@query(f"WITH ev AS (SELECT *, CASE WHEN value > 90 THEN 'high' WHEN value < 5 THEN 'low' ELSE 'ordinary' END AS category FROM {{ev}}), {feature_plans.DUCK_GRID} SELECT g.channel_id, g.t, " + ", ".join(f"count(e.ts) FILTER (WHERE category = '{c}' AND e.ts > g.t - INTERVAL {h} HOUR) AS qa_{c}_count_{h}h" for c in ("high", "low") for h in (24, 168)) + " FROM grid g LEFT JOIN ev e ON g.channel_id = e.channel_id AND e.ts <= g.t AND e.ts > g.t - INTERVAL 168 HOUR GROUP BY 1, 2")
def d07_quality_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = journal(spark, sf_dir).withColumn("category", F.when(F.col("value") > 90, "high").when(F.col("value") < 5, "low").otherwise("ordinary"))
    return observability.quality_windows(feature_plans.grid(spark, sf_dir), rows, ["high", "low"], [24, 168])


@query("WITH e AS (SELECT channel_id, ts, state, CASE WHEN state IN ('error', 'view') THEN NULL ELSE value END AS value FROM {ev} WHERE ts < TIMESTAMP '2024-01-20'), m AS (SELECT channel_id, median(value) AS md FROM e GROUP BY 1), d AS (SELECT channel_id, state, row_number() OVER (PARTITION BY channel_id ORDER BY count(*) DESC, min(ts)) AS k FROM e WHERE value IS NULL GROUP BY 1, 2) SELECT e.channel_id, count(*) AS event_count, count(value) AS numeric_count, round(any_value(md), 6) AS median, round(median(abs(value - md)), 6) AS mad, any_value(d.state) AS dominant_state FROM e JOIN m ON e.channel_id = m.channel_id LEFT JOIN d ON d.channel_id = e.channel_id AND k = 1 GROUP BY 1")
def d09_behaviour_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = journal(spark, sf_dir).withColumn("value", F.when(~F.col("state").isin("error", "view"), F.col("value")))
    got = observability.profiles(ev, "2024-01-20 00:00:00")
    return got.select("channel_id", "event_count", "numeric_count", F.round("numeric_median", 6).alias("median"), F.round("numeric_mad", 6).alias("mad"), "dominant_state")


@query("WITH e AS (SELECT *, row_id % 7 AS source FROM {ev}), s AS (SELECT channel_id FROM e GROUP BY 1 HAVING count(DISTINCT state) = 1), b AS (SELECT ts < lag(ts) OVER (PARTITION BY source ORDER BY row_id) AS back FROM e) SELECT unnest(['rows', 'missing_value', 'alarms', 'time_reversals', 'repeated_ids', 'channels', 'days', 'one_value_channels']) AS measure, unnest([(SELECT count(*) FROM e), 0, (SELECT count(*) FROM e WHERE alarm), (SELECT count(*) FROM b WHERE back), 0, (SELECT count(DISTINCT channel_id) FROM e), (SELECT count(DISTINCT CAST(ts AS DATE)) FROM e), (SELECT count(*) FROM s)]) AS value")
def d10_raw_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observability.raw_profile(journal(spark, sf_dir).withColumn("source", F.col("row_id") % 7))


@query("WITH h AS (SELECT CAST(month(ts) AS VARCHAR) AS kind, state AS text, alarm, count(*) AS n FROM {ev} GROUP BY 1, 2, 3) SELECT CASE WHEN text = 'view' THEN 'unmapped_state' WHEN text = 'click' THEN 'conflicting' WHEN text = 'purchase' THEN 'multiple' ELSE 'exact' END AS status, CASE WHEN text IN ('view', 'click') THEN 'undetermined' WHEN text = 'signup' THEN 'disagree' ELSE 'agree' END AS agreement, CAST(sum(n) AS BIGINT) AS rows FROM h GROUP BY 1, 2")
def d11_state_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = journal(spark, sf_dir).groupBy(F.month("ts").cast("string").alias("kind"), F.col("state").alias("text"), "alarm").agg(F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame([("1", "error", True), ("1", "signup", True), ("1", "click", True), ("1", "click", False), ("1", "purchase", False), ("1", "purchase", False)], "kind string, text string, alarm boolean")
    return observability.state_mapping(histogram, known)


_DUCK_LINE = """e AS (SELECT channel_id, ts, state, alarm FROM {ev}), x AS (SELECT *, state IN ('error', 'signup', 'purchase', 'click') AS known, state IN ('signup', 'purchase', 'click') AS healthy, date_diff('microsecond', lag(ts) OVER w, ts) / 3.6e9 AS gap FROM e WINDOW w AS (PARTITION BY channel_id ORDER BY ts)),
b AS (SELECT *, coalesce(gap > 24, true) OR NOT known OR NOT coalesce(lag(known) OVER w, false) AS broken FROM x WINDOW w AS (PARTITION BY channel_id ORDER BY ts)),
line AS (SELECT *, sum(CAST(broken AS INT)) OVER w AS segment, state = 'error' AND coalesce(lag(healthy) OVER w, false) AND NOT broken AS onset FROM b WINDOW w AS (PARTITION BY channel_id ORDER BY ts))"""


def _line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoke.timeline(smoke.canonical(journal(spark, sf_dir)), "error", ["signup", "purchase", "click"])


@query(f"WITH {_DUCK_LINE} SELECT channel_id, ts, CAST(segment AS BIGINT) AS segment, onset FROM line")
def e16_smoke_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line(spark, sf_dir).select("channel_id", "ts", "segment", "onset")


@query(f"WITH {_DUCK_LINE}, ev AS (SELECT * FROM {{ev}}), {feature_plans.DUCK_GRID}, n AS (SELECT g.channel_id, g.t, l.ts, l.healthy, l.state FROM grid g ASOF JOIN line l ON g.channel_id = l.channel_id AND g.t >= l.ts), f AS (SELECT channel_id, min(ts) AS first_at FROM e GROUP BY 1), k AS (SELECT n.* FROM n JOIN f ON n.channel_id = f.channel_id WHERE healthy AND n.t <= n.ts + INTERVAL 24 HOUR AND n.t >= first_at + INTERVAL 24 HOUR) SELECT k.channel_id, k.t, any_value(k.state) AS current_state, round(any_value(date_diff('microsecond', k.ts, k.t)) / 3.6e9, 6) AS hours_since_event, count(l.ts) FILTER (WHERE l.ts > k.t - INTERVAL 24 HOUR) AS events_24h, count(l.ts) FILTER (WHERE l.onset) AS onsets_168h, count(l.ts) FILTER (WHERE NOT l.known) AS unknown_168h FROM k LEFT JOIN line l ON l.channel_id = k.channel_id AND l.ts <= k.t AND l.ts > k.t - INTERVAL 168 HOUR GROUP BY 1, 2")
def e17_smoke_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = smoke.features_at(feature_plans.grid(spark, sf_dir), _line(spark, sf_dir))
    return got.select("channel_id", "t", "current_state", F.round("hours_since_event", 6).alias("hours_since_event"), "events_24h", "onsets_168h", "unknown_168h")


@query(f"WITH {_DUCK_LINE}, ev AS (SELECT * FROM {{ev}}), {feature_plans.DUCK_GRID}, u AS (SELECT *, max(ts) OVER (PARTITION BY channel_id, segment) AS until FROM line), n AS (SELECT g.channel_id, g.t, l.ts, l.healthy, l.segment, l.until FROM grid g ASOF LEFT JOIN u l ON g.channel_id = l.channel_id AND g.t >= l.ts), o AS (SELECT n.channel_id, n.t, arg_min(l.segment, l.ts) AS next_segment, min(l.ts) AS next_at FROM n JOIN line l ON l.channel_id = n.channel_id AND l.onset AND l.ts > n.t GROUP BY 1, 2) SELECT n.channel_id, n.t, CAST(CASE WHEN coalesce(healthy AND n.t <= n.ts + INTERVAL 24 HOUR AND n.t + INTERVAL 24 HOUR <= until, false) THEN CASE WHEN next_segment = segment AND next_at <= n.t + INTERVAL 24 HOUR THEN 1 ELSE 0 END ELSE -1 END AS INT) AS label FROM n LEFT JOIN o ON n.channel_id = o.channel_id AND n.t = o.t")
def e18_smoke_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoke.labels_at(feature_plans.grid(spark, sf_dir), _line(spark, sf_dir)).select("channel_id", "t", "label")


@query(f"WITH {_DUCK_LINE}, n AS (SELECT channel_id, arg_max(state, ts) AS last_state, max(ts) AS ts, min(ts) AS first_at FROM line WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1) SELECT channel_id, last_state, CASE WHEN last_state = 'error' THEN 'already_faulty' WHEN last_state = 'view' THEN 'unknown_state' WHEN ts < TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR THEN 'stale_observation' WHEN first_at > TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR THEN 'insufficient_history' ELSE 'scored' END AS status FROM n")
def a17_serving_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoke.status_at(journal(spark, sf_dir).select("channel_id").distinct(), _line(spark, sf_dir), "2024-01-20 00:00:00").select("channel_id", "last_state", "status")


def _admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission at every hour; every eleventh row is excluded by its quality."""
    ev = detection.effects(spark, sf_dir)
    at = episodes.collapse(ev).select("channel_id", "segment", "ts", F.col("conflict").alias("ambiguous"))
    rows = ev.join(at, ["channel_id", "segment", "ts"]).withColumn("excluded", F.col("row_id") % 11 == 0)
    points = detection._points(spark, sf_dir).select("channel_id", "segment", "t")
    return admission.sparse_admission(points, rows, episodes.state_timeline(ev), ["smoke", "heat"])


#: The same by joins over all that came before each point.
_DUCK_ADMISSION = f"""{detection.DUCK_WALK}, {feature_plans.DUCK_GRID},
seg AS (SELECT *, CAST(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS INT) AS segment FROM x_ev),
obs AS (SELECT s.channel_id, s.segment, s.ts, min(sensor_type) AS lo, max(sensor_type) AS hi, bool_or(sensor_type IS NULL) AS untyped, bool_or(row_id % 11 <> 0) AS usable, count(*) FILTER (WHERE row_id % 11 = 0) AS out_n, count(*) FILTER (WHERE k.kind = 'conflict') AS odd_n, count(*) FILTER (WHERE row_id % 33 = 0) AS hard_n FROM seg s JOIN x_in k ON s.channel_id = k.channel_id AND s.segment = k.segment AND s.ts = k.ts GROUP BY 1, 2, 3),
pt AS (SELECT channel_id, t, CAST(CASE WHEN t < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS INT) AS segment FROM grid),
past AS (SELECT pt.channel_id, pt.segment, pt.t, count(o.ts) AS n, min(lo) AS lo, max(hi) AS hi, min(o.ts) FILTER (WHERE usable) AS first_usable, list_sort(list(o.ts) FILTER (WHERE usable))[2] AS second_usable, max(o.ts) FILTER (WHERE lo IS NOT NULL) AS typed_at, max(o.ts) FILTER (WHERE untyped) AS untyped_at, max(o.ts) FILTER (WHERE out_n > 0) AS out_at, max(o.ts) FILTER (WHERE odd_n > 0) AS odd_at, max(o.ts) FILTER (WHERE hard_n > 0) AS hard_at, coalesce(sum(out_n) FILTER (WHERE o.ts > pt.t - INTERVAL 24 HOUR), 0) AS out24, coalesce(sum(odd_n) FILTER (WHERE o.ts > pt.t - INTERVAL 24 HOUR), 0) AS odd24 FROM pt LEFT JOIN obs o ON pt.channel_id = o.channel_id AND pt.segment = o.segment AND o.ts <= pt.t GROUP BY 1, 2, 3),
st AS (SELECT *, max(CASE WHEN kind = 'normal' THEN ts END) OVER (PARTITION BY channel_id, segment, run ORDER BY i) AS cleared_at FROM x_walk WHERE i > 0),
j AS (SELECT past.*, CASE WHEN lo = hi THEN lo END AS sensor_type, st.ts AS state_at, st.normal_at, coalesce(st.active, false) AS active, coalesce(st.uncertain, false) AS uncertain, st.cleared_at, n > 0 AND first_usable IS NULL AS all_out FROM past ASOF LEFT JOIN st ON past.channel_id = st.channel_id AND past.segment = st.segment AND past.t >= st.ts),
r AS (SELECT *, CASE WHEN n = 0 THEN ['no_observations_in_current_archive_segment'] ELSE list_sort(list_filter([CASE WHEN all_out THEN 'all_causal_observations_excluded' END, CASE WHEN NOT all_out AND sensor_type IS NULL THEN 'sensor_type_unknown_or_conflicting' END, CASE WHEN NOT all_out AND (first_usable > t - INTERVAL 7 DAY OR second_usable IS NULL) THEN 'insufficient_history' END, CASE WHEN NOT all_out AND out24 > 0 THEN 'quality_exclusions_24h' END, CASE WHEN NOT all_out AND odd24 > 0 THEN 'same_time_state_ambiguity' END,
CASE WHEN sensor_type IS NULL THEN 'unknown_or_conflicting_sensor_type' END, CASE WHEN active THEN 'registered_episode_active_at_t' END, CASE WHEN uncertain THEN 'uncertain_past_registered_state' END, CASE WHEN untyped_at IS NOT NULL AND (cleared_at IS NULL OR untyped_at > cleared_at) THEN 'unknown_type_observed_since_explicit_normal' END, CASE WHEN normal_at IS NULL OR normal_at < t - INTERVAL 168 HOUR THEN 'no_recent_explicit_normal_at_t' END], lambda x: x IS NOT NULL)) END AS reasons FROM j),
adm AS (SELECT *, CASE WHEN n > 0 AND (all_out OR active) THEN 'excluded' WHEN len(reasons) > 0 THEN 'unknown' ELSE 'eligible' END AS status, greatest(typed_at, state_at, untyped_at, out_at, odd_at, first_usable, second_usable) AS evidence_through FROM r)"""


@query(f"WITH RECURSIVE {_DUCK_ADMISSION} SELECT channel_id, t, status AS admission_status, array_to_string(reasons, ',') AS reasons, evidence_through FROM adm")
def e19_sparse_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _admission(spark, sf_dir).select("channel_id", "t", "admission_status", F.array_join("admission_reasons", ",").alias("reasons"), "evidence_through")


@query(f"WITH RECURSIVE {_DUCK_ADMISSION}, q AS (SELECT *, CASE WHEN out24 > 0 THEN list_sort(list_append(reasons, 'qa_unusable_measurement_24h')) ELSE reasons END AS left_over FROM adm) SELECT channel_id, t, CASE WHEN status = 'excluded' THEN 'excluded' WHEN len(left_over) > 0 THEN 'unknown' ELSE 'eligible' END AS candidate_status, array_to_string(left_over, ',') AS reasons FROM q")
def e20_relaxed_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = admission.relaxed(_admission(spark, sf_dir).withColumn("blocking_qa_count_24h", F.col("excluded_quality_count_24h")))
    return got.select("channel_id", "t", "candidate_status", F.array_join("candidate_reasons", ",").alias("reasons"))


@query(f"""WITH RECURSIVE {_DUCK_ADMISSION}, g AS (SELECT *, status <> 'excluded' AND sensor_type IS NOT NULL AND coalesce(normal_at >= t - INTERVAL 168 HOUR, false) AND odd24 = 0 AS guard FROM adm),
a AS (SELECT *, guard AND second_usable IS NOT NULL AS cold, guard AND out24 > 0 AND coalesce(odd_at > t - INTERVAL 24 HOUR AND odd_at < normal_at, false) AND coalesce(hard_at <= t - INTERVAL 24 HOUR, true) AS settled FROM g),
f AS (SELECT *, list_filter(reasons, lambda x: NOT (x = 'insufficient_history' AND cold) AND NOT (x = 'quality_exclusions_24h' AND settled)) AS left_over FROM a)
SELECT channel_id, t, CASE WHEN status = 'excluded' THEN 'excluded' WHEN len(left_over) > 0 THEN 'unknown' ELSE 'eligible' END AS research_status, array_to_string(left_over, ',') AS reasons FROM f""")
def e21_coverage_reentry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both policies together; rows of every 33rd number are of hard quality."""
    hard = detection.effects(spark, sf_dir).where("row_id % 33 = 0").select("channel_id", "segment", "ts")
    rows = asof.asof_last(_admission(spark, sf_dir), hard, ["channel_id", "segment"], "t", "ts", "hard").withColumns({"blocking_qa_count_24h": F.lit(0), "last_hard_quality_at": F.col("hard.ts")})
    return admission.reentry(rows, "combined", ["smoke", "heat"]).select("channel_id", "t", "research_status", F.array_join("research_reasons", ",").alias("reasons"))
