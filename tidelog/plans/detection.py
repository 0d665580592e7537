"""Detection, episode and label queries on the driver's journal: error is a fault, signup a normal, view and purchase unclear, click neutral; points are hourly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import rules, timeops
from tidelog.operators import asof, detectors, episodes, observability
from tidelog.operators.features import hours_of
from tidelog.plans import features
from tidelog.plans.registry import EVENTS, journal, query, run_sql, table

SEGMENTS = [("2024-01-01 00:00:00", "2024-01-16 00:00:00"), ("2024-01-16 00:00:00", "2024-02-01 00:00:00")]


def sensor_type(at: str) -> Column:
    """Every third channel gets a sensor of another type on the 9th."""
    return F.when((F.col("channel_id").cast("int") % 3 == 0) & (F.col(at) >= F.lit("2024-01-09").cast("timestamp_ntz")), "heat").otherwise("smoke")


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third hour's events share an instant, so that conflicts occur; every 17th row tells no sensor type, so its text is unclear."""
    coarse = F.when(F.hour("ts") % 3 == 0, timeops.floor_hour(F.col("ts"))).otherwise(F.col("ts"))
    kind = F.when(F.col("row_id") % 17 != 0, sensor_type("ts"))
    ev = journal(spark, sf_dir).withColumn("ts", coarse).withColumn("sensor_type", kind)
    effect = F.when(F.col("sensor_type").isNull(), "uncertain").otherwise(rules.effect(F.col("state")))
    return ev.select("row_id", "channel_id", "ts", "state", "sensor_type", effect.alias("effect"), timeops.segment_of(F.col("ts"), SEGMENTS).alias("segment"))


_DUCK_TYPE = "CASE WHEN CAST(channel_id AS INT) % 3 = 0 AND {} >= TIMESTAMP '2024-01-09' THEN 'heat' ELSE 'smoke' END"
DUCK_STATE = f"""x_raw AS (SELECT row_id, channel_id, CASE WHEN hour(ts) % 3 = 0 THEN CAST(date_trunc('hour', ts) AS TIMESTAMP) ELSE ts END AS ts, state FROM {{ev}}),
x_typed AS (SELECT *, CASE WHEN row_id % 17 <> 0 THEN {_DUCK_TYPE.format('ts')} END AS sensor_type FROM x_raw),
x_ev AS (SELECT *, CASE WHEN sensor_type IS NULL THEN 'uncertain' WHEN state = 'error' THEN 'fault' WHEN state = 'signup' THEN 'normal' WHEN state = 'click' THEN 'neutral' ELSE 'uncertain' END AS effect FROM x_typed),
x_types AS (SELECT channel_id, ts, list_distinct(list(coalesce(sensor_type, '?'))) AS types, list_distinct(list(sensor_type) FILTER (WHERE effect = 'fault')) AS fault_types FROM x_ev GROUP BY 1, 2),
x_at AS (SELECT channel_id, CAST(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS INT) AS segment, ts, count(DISTINCT state) > 1 OR any_value(len(types)) > 1 AS conflict, count(*) FILTER (WHERE effect = 'fault') AS faults, bool_and(effect = 'normal') AS all_normal, bool_or(effect = 'uncertain') AS unclear, any_value(CASE WHEN len(types) = 1 THEN nullif(types[1], '?') WHEN len(fault_types) = 1 THEN fault_types[1] END) AS own_type FROM x_ev JOIN x_types USING (channel_id, ts) GROUP BY 1, 2, 3),
x_in AS (SELECT *, CASE WHEN conflict THEN 'conflict' WHEN faults > 0 THEN 'fault' WHEN all_normal THEN 'normal' WHEN unclear THEN 'uncertain' ELSE 'neutral' END AS kind, row_number() OVER (PARTITION BY channel_id, segment ORDER BY ts) AS i FROM x_at)"""
#: The state machine itself, a row at a time, as an independent form of the windows: the registered state (normal_at,
#: active, uncertain), and the catalogue's memory (is_open, starts, onset, c_normal, c_unclear), which a fault clears otherwise.
DUCK_WALK = f"""{DUCK_STATE},
x_walk AS (SELECT DISTINCT channel_id, segment, CAST(0 AS BIGINT) AS i, CAST(NULL AS TIMESTAMP) AS ts, '' AS kind, CAST(0 AS BIGINT) AS faults, CAST(NULL AS VARCHAR) AS type, 0 AS run, CAST(NULL AS TIMESTAMP) AS normal_at, false AS active, false AS uncertain, false AS changed, false AS is_open, false AS starts, '' AS onset, CAST(NULL AS TIMESTAMP) AS c_normal, false AS c_unclear FROM x_in
UNION ALL SELECT channel_id, segment, i, ts, kind, faults, type, run,
CASE WHEN kind = 'normal' THEN ts WHEN kind = 'neutral' THEN normal_at END,
CASE WHEN kind = 'normal' THEN false WHEN faults > 0 THEN true ELSE active END,
CASE WHEN kind IN ('normal', 'fault') THEN false WHEN kind IN ('conflict', 'uncertain') THEN true ELSE uncertain END,
changed,
CASE WHEN faults > 0 THEN true WHEN kind = 'normal' THEN false ELSE is_open END,
faults > 0 AND NOT is_open,
CASE WHEN kind = 'conflict' THEN 'conflicted_same_timestamp' WHEN c_unclear THEN 'uncertain_prior_state' WHEN c_normal IS NULL THEN 'left_censored' WHEN ts <= c_normal + INTERVAL 168 HOUR THEN 'candidate_new_onset' ELSE 'stale_normal' END,
CASE WHEN kind = 'normal' THEN ts WHEN kind = 'neutral' THEN c_normal END,
CASE kind WHEN 'normal' THEN false WHEN 'conflict' THEN true WHEN 'uncertain' THEN true ELSE c_unclear END
FROM (SELECT q.* EXCLUDE (normal_at, active, uncertain, is_open, c_normal, c_unclear, run), CASE WHEN fresh THEN run + 1 ELSE run END AS run, i > 1 AND fresh AS changed, CASE WHEN NOT fresh THEN normal_at END AS normal_at, active AND NOT fresh AS active, uncertain AND NOT fresh AS uncertain, is_open AND NOT fresh AS is_open, CASE WHEN NOT fresh THEN c_normal END AS c_normal, c_unclear AND NOT fresh AS c_unclear
FROM (SELECT k.channel_id, k.segment, k.i, k.ts, k.kind, k.faults, coalesce(k.own_type, w.type) AS type, coalesce(k.own_type, w.type) IS DISTINCT FROM w.type AS fresh, w.run, w.normal_at, w.active, w.uncertain, w.is_open, w.c_normal, w.c_unclear FROM x_walk w JOIN x_in k ON k.channel_id = w.channel_id AND k.segment = w.segment AND k.i = w.i + 1) q) r)"""
#: Instants of episodes: number counts the starts of a run.
DUCK_EPISODES = f"""{DUCK_WALK},
x_inst AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY channel_id, segment, run ORDER BY i) AS number, max((segment, run)) OVER (PARTITION BY channel_id) AS last_run FROM x_walk WHERE i > 0),
x_eps AS (SELECT channel_id, segment, min(type) FILTER (WHERE starts) AS sensor_type, min(ts) FILTER (WHERE starts) AS start_at, min(ts) FILTER (WHERE kind = 'normal') AS end_at, min(onset) FILTER (WHERE starts) AS onset_status, CAST(sum(CASE WHEN is_open THEN faults ELSE 0 END) AS BIGINT) AS fault_count, bool_or(kind IN ('conflict', 'uncertain') AND is_open) AS spoilt, any_value(last_run > (segment, run)) AS goes_on FROM x_inst WHERE number > 0 GROUP BY channel_id, segment, run, number),
episodes AS (SELECT *, CASE WHEN end_at IS NOT NULL THEN CASE WHEN spoilt THEN 'exact_norma_after_uncertainty' ELSE 'exact_norma' END WHEN goes_on THEN 'open_type_or_archive_boundary' ELSE 'open_unknown' END AS end_status FROM x_eps)"""


@query(f"WITH RECURSIVE {DUCK_WALK} SELECT channel_id, segment, ts, kind, type AS sensor_type, normal_at, active, uncertain, kind IN ('fault', 'uncertain', 'conflict') OR changed AS adverse FROM x_walk WHERE i > 0")
def k11_state_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.state_timeline(effects(spark, sf_dir)).select("channel_id", "segment", "ts", "kind", "sensor_type", "normal_at", "active", "uncertain", "adverse")


@query(f"WITH RECURSIVE {DUCK_EPISODES} SELECT channel_id, segment, sensor_type, start_at, end_at, onset_status, end_status, fault_count FROM episodes")
def k10_registered_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.registered_episodes(effects(spark, sf_dir)).select("channel_id", "segment", "sensor_type", "start_at", "end_at", "onset_status", "end_status", "fault_count")


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes with a confident onset and a clear end, nothing unclear between."""
    return episodes.registered_episodes(effects(spark, sf_dir)).where("onset_status = 'candidate_new_onset' AND end_status = 'exact_norma'").select("channel_id", "start_at", "end_at")


DUCK_COMPLETED = f"{DUCK_EPISODES}, completed AS (SELECT channel_id, start_at, end_at FROM episodes WHERE onset_status = 'candidate_new_onset' AND end_status = 'exact_norma')"


@query(f"WITH RECURSIVE {DUCK_COMPLETED} SELECT * FROM completed")
def z12_completed_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completed(spark, sf_dir)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = features.grid(spark, sf_dir)
    segment = timeops.segment_of(F.col("t"), SEGMENTS)
    return p.select("channel_id", "t", sensor_type("t").alias("sensor_type"), segment.alias("segment"), F.when(segment == 0, F.lit(SEGMENTS[0][1])).otherwise(F.lit(SEGMENTS[1][1])).cast("timestamp_ntz").alias("segment_end"))


_UNTIL = "(SELECT CAST(date_trunc('hour', max(ts) + INTERVAL '59 minutes 59.999999 seconds') AS TIMESTAMP) FROM {ev})"


@query(f"""WITH RECURSIVE {DUCK_EPISODES}, {features.DUCK_GRID},
pt AS (SELECT channel_id, t, {_DUCK_TYPE.format('t')} AS sensor_type, CAST(CASE WHEN t < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS INT) AS segment, CASE WHEN t < TIMESTAMP '2024-01-16' THEN TIMESTAMP '2024-01-16' ELSE TIMESTAMP '2024-02-01' END AS segment_end FROM grid),
now AS (SELECT pt.*, n.ts AS seen, n.type, normal_at, active, uncertain FROM pt ASOF LEFT JOIN x_inst n ON pt.channel_id = n.channel_id AND pt.segment = n.segment AND pt.t >= n.ts),
prior AS (SELECT now.*, x.start_at AS p_start, x.end_at AS p_end, x.end_status AS p_status, x.sensor_type AS p_type FROM now ASOF LEFT JOIN episodes x ON now.channel_id = x.channel_id AND now.segment = x.segment AND now.t >= x.start_at),
adv AS (SELECT prior.*, b.ts AS adverse_at FROM prior ASOF LEFT JOIN (SELECT channel_id, segment, ts FROM x_inst WHERE kind IN ('fault', 'uncertain', 'conflict') OR changed) b ON prior.channel_id = b.channel_id AND prior.segment = b.segment AND prior.t < b.ts),
o AS (SELECT adv.*, c.start_at AS onset_at FROM adv ASOF LEFT JOIN (SELECT * FROM episodes WHERE onset_status = 'candidate_new_onset') c ON adv.channel_id = c.channel_id AND adv.segment = c.segment AND adv.sensor_type = c.sensor_type AND adv.t < c.start_at)
SELECT channel_id, t, CASE WHEN p_start IS NOT NULL AND p_type = sensor_type AND (p_end IS NULL OR p_end > t) THEN CASE WHEN p_status = 'open_type_or_archive_boundary' THEN 'unresolved_type_or_archive_boundary' ELSE 'registered_episode_active_at_t' END
WHEN seen IS NULL OR type IS DISTINCT FROM sensor_type THEN 'no_verified_same_type_history' WHEN active THEN 'registered_episode_active_at_t' WHEN uncertain THEN 'uncertain_state_at_t' WHEN normal_at IS NULL OR t > normal_at + INTERVAL 168 HOUR THEN 'no_recent_explicit_normal_at_t'
WHEN onset_at <= t + INTERVAL 24 HOUR AND onset_at < {_UNTIL} AND adverse_at >= onset_at THEN 'new_confident_registered_onset' WHEN adverse_at <= t + INTERVAL 24 HOUR THEN 'future_state_or_onset_uncertain' WHEN t + INTERVAL 24 HOUR >= {_UNTIL} THEN 'future_events_not_loaded' WHEN t + INTERVAL 24 HOUR >= segment_end THEN 'future_archive_window_incomplete' ELSE 'no_registered_onset_in_assumed_complete_archive' END AS reason
FROM o""")
def k12_registered_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, hours = effects(spark, sf_dir), hours_of(journal(spark, sf_dir))
    return episodes.registered_labels(_points(spark, sf_dir), ev, episodes.registered_episodes(ev), hours[1] if hours else "1970-01-01").select("channel_id", "t", "reason")


@query("WITH RECURSIVE e AS (SELECT channel_id, ts, row_number() OVER (PARTITION BY channel_id ORDER BY ts) AS i FROM {ev} WHERE alarm), w AS (SELECT channel_id, ts, ts AS last, i, true AS emitted FROM e WHERE i = 1 UNION ALL SELECT e.channel_id, e.ts, CASE WHEN e.ts >= w.last + INTERVAL 24 HOUR THEN e.ts ELSE w.last END, e.i, e.ts >= w.last + INTERVAL 24 HOUR FROM w JOIN e ON e.channel_id = w.channel_id AND e.i = w.i + 1) SELECT channel_id, ts, emitted FROM w")
def w21_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.operators import alerts

    return alerts.cooldown(journal(spark, sf_dir).where("alarm").select("channel_id", "ts"), ["channel_id"], "ts", 24)


DUCK_SHIFT = """e AS (SELECT channel_id, row_id, ts, CASE WHEN state <> 'view' THEN value END AS value, state = 'click' AND value > 90 AS blocked FROM {ev}),
n AS (SELECT *, count(value) OVER (PARTITION BY channel_id ORDER BY ts, row_id) AS k FROM e),
b AS (SELECT channel_id, value, ts, blocked FROM n WHERE k <= 12 AND value IS NOT NULL),
s AS (SELECT channel_id, median(value) AS med, max(ts) AS last, bool_or(blocked) AS bad, count(*) AS c FROM b GROUP BY 1),
l AS (SELECT s.channel_id, any_value(med) AS med, any_value(last) AS last, median(abs(b.value - med)) AS mad FROM b JOIN s ON b.channel_id = s.channel_id WHERE NOT bad AND c = 12 GROUP BY 1),
c AS (SELECT e.channel_id, e.ts, e.row_id, e.blocked, CASE WHEN e.blocked OR e.value IS NULL THEN 0 WHEN e.value - med > CASE WHEN mad = 0 THEN 0.5 ELSE mad * 0.9 END THEN 1 WHEN e.value - med < -CASE WHEN mad = 0 THEN 0.5 ELSE mad * 0.9 END THEN -1 ELSE 0 END AS code FROM e JOIN l ON e.channel_id = l.channel_id AND e.ts > l.last)"""


@query(f"WITH {DUCK_SHIFT}, r AS (SELECT *, lag(code) OVER w AS p, lag(code, 2) OVER w AS q, lag(ts, 2) OVER w AS began, row_number() OVER w AS i FROM c WINDOW w AS (PARTITION BY channel_id ORDER BY ts, row_id)), h AS (SELECT channel_id, min(i) AS hit FROM r WHERE code <> 0 AND code = p AND code = q GROUP BY 1), x AS (SELECT channel_id, min(i) AS stop FROM r WHERE blocked GROUP BY 1), d AS (SELECT DISTINCT channel_id FROM c) SELECT d.channel_id, CASE WHEN stop IS NOT NULL AND (hit IS NULL OR stop < hit) THEN 'unknown' WHEN hit IS NOT NULL THEN 'candidate' ELSE 'no_candidate' END AS decision, CASE WHEN hit IS NOT NULL AND (stop IS NULL OR hit < stop) THEN r.began END AS start_at, CASE WHEN hit IS NOT NULL AND (stop IS NULL OR hit < stop) THEN r.ts END AS confirmed_at FROM d LEFT JOIN h ON d.channel_id = h.channel_id LEFT JOIN x ON d.channel_id = x.channel_id LEFT JOIN r ON r.channel_id = d.channel_id AND r.i = h.hit")
def k01_first_level_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = journal(spark, sf_dir).select("channel_id", "row_id", "ts", F.when(F.col("state") != "view", F.col("value")).alias("value"), ((F.col("state") == "click") & (F.col("value") > 90)).alias("blocked"))
    return detectors.first_level_shift(ev, 3, multiplier=0.9).select("channel_id", "decision", "start_at", "confirmed_at")


#: A row at a time, for three in a row: a and b are the times of the last two of the run; ends: the shift ended here.
_DUCK_SHIFTS = DUCK_SHIFT.replace("state = 'click' AND value > 90 AS blocked", "false AS blocked").replace("e.blocked, CASE WHEN e.blocked OR e.value IS NULL THEN 0", "med, mad, CASE WHEN mad = 0 THEN 0.5 ELSE mad * 0.9 END AS threshold, CASE WHEN e.value IS NULL THEN NULL") + """,
r AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY ts, row_id) AS i, count(*) OVER (PARTITION BY channel_id) AS total FROM c),
w AS (SELECT DISTINCT channel_id, CAST(0 AS BIGINT) AS i, total, med, mad, threshold, 0 AS dir, 0 AS run, CAST(NULL AS TIMESTAMP) AS a, CAST(NULL AS TIMESTAMP) AS b, false AS inside, CAST(NULL AS TIMESTAMP) AS start_at, CAST(NULL AS TIMESTAMP) AS confirmed_at, 0 AS direction, false AS ends, CAST(NULL AS TIMESTAMP) AS end_at, CAST(NULL AS TIMESTAMP) AS o_start, CAST(NULL AS TIMESTAMP) AS o_confirmed, 0 AS o_direction FROM r
UNION ALL SELECT channel_id, i, total, med, mad, threshold, coalesce(code, 0), CASE WHEN coalesce(code, 0) = 0 THEN 0 WHEN code = dir THEN run + 1 ELSE 1 END, CASE WHEN code = dir THEN b END, ts, CASE WHEN opens THEN true WHEN ends THEN false ELSE inside END, CASE WHEN opens THEN a ELSE start_at END, CASE WHEN opens THEN ts ELSE confirmed_at END, CASE WHEN opens THEN code ELSE direction END, ends, ts, start_at, confirmed_at, direction
FROM (SELECT *, coalesce((NOT inside OR ends) AND code <> 0 AND code = dir AND run >= 2, false) AS opens FROM (SELECT r.channel_id, r.i, r.total, r.med, r.mad, r.threshold, r.ts, r.code, w.dir, w.run, w.a, w.b, w.inside, w.start_at, w.confirmed_at, w.direction, coalesce(w.inside AND r.code <> w.direction, false) AS ends FROM w JOIN r ON r.channel_id = w.channel_id AND r.i = w.i + 1)))"""


@query(f"WITH RECURSIVE {_DUCK_SHIFTS}, o AS (SELECT channel_id, o_start AS start_at, o_confirmed AS confirmed_at, end_at, o_direction AS direction, med, mad, threshold FROM w WHERE ends UNION ALL SELECT channel_id, start_at, confirmed_at, NULL, direction, med, mad, threshold FROM w WHERE inside AND i = total) SELECT channel_id, start_at, confirmed_at, end_at, CAST(direction AS INT) AS direction, round(med, 9) AS baseline_median, round(mad, 9) AS baseline_mad, round(threshold, 9) AS threshold FROM o")
def k02_level_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = journal(spark, sf_dir).select("channel_id", "row_id", "ts", F.when(F.col("state") != "view", F.col("value")).alias("value"), F.lit(False).alias("blocked"))
    got = detectors.level_shifts(ev, 3, multiplier=0.9)
    return got.select("channel_id", "start_at", "confirmed_at", "end_at", "direction", *[F.round(c, 9).alias(c) for c in ("baseline_median", "baseline_mad", "threshold")])


@query()
def k03_discrete_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = journal(spark, sf_dir).select("channel_id", "row_id", "ts", "state", F.lit(False).alias("blocked"))
    return detectors.discrete_patterns(ev, repeat_minutes=60 * 48, switch_minutes=60 * 12)


@query("WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS channel_id, c_nationkey AS obj FROM customer), e AS (SELECT channel_id, ts FROM {ev} WHERE alarm), a AS (SELECT e.channel_id, e.ts, obj FROM e JOIN c ON e.channel_id = c.channel_id), m AS (SELECT DISTINCT a.channel_id, a.ts FROM a JOIN a b ON a.obj = b.obj AND a.channel_id <> b.channel_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 2 HOUR), r AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY ts) AS i FROM m) SELECT channel_id, min(ts) AS start_at, max(ts) AS confirmed_at FROM r WHERE i <= 2 GROUP BY 1 HAVING count(*) = 2")
def k05_context_coincidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    objects = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("channel_id"), F.col("c_nationkey").alias("obj"))
    e = journal(spark, sf_dir).where("alarm").join(objects, "channel_id").select("channel_id", "ts", "obj")
    hits = asof.window_rows(e.withColumnRenamed("ts", "t"), e, ["obj"], "t", "ts", 3, 3).where("f_channel_id <> channel_id AND f_ts >= t - INTERVAL '2' HOUR").select("channel_id", "t").distinct()
    ranked = hits.withColumn("i", F.row_number().over(Window.partitionBy("channel_id").orderBy("t"))).where("i <= 2")
    return ranked.groupBy("channel_id").agg(F.min("t").alias("start_at"), F.max("t").alias("confirmed_at"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


@query("WITH e AS (SELECT DISTINCT c_nationkey AS object_id, state, channel_id, ts FROM {ev} JOIN customer ON channel_id = CAST(c_custkey AS VARCHAR)), n AS (SELECT a.object_id, a.state, a.ts, count(DISTINCT b.channel_id) AS n, min(b.ts) AS s FROM e a JOIN e b ON a.object_id = b.object_id AND a.state = b.state AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 1 HOUR GROUP BY 1, 2, 3) SELECT object_id, state, min(ts) AS confirmed_at, arg_min(s, ts) AS start_at FROM n WHERE n >= 2 GROUP BY 1, 2")
def k06_shared_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("channel_id"), F.col("c_nationkey").alias("object_id"))
    return detectors.shared_states(journal(spark, sf_dir).join(objects, "channel_id"), 3600, 2).select("object_id", "state", "confirmed_at", "start_at")


#: One row a detection: what is open after it, and what it closed (o_...); quiet: it came too soon after one that ended.
_DUCK_CONSOLIDATE = """ev AS (SELECT * FROM {ev}), n AS (SELECT channel_id, max(ts) AS recovery_at FROM ev WHERE state = 'signup' GROUP BY 1),
d AS (SELECT ev.channel_id, ts, value / 100 AS score, CAST(row_id AS VARCHAR) AS id, recovery_at, row_number() OVER (PARTITION BY ev.channel_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY ev.channel_id) AS total FROM ev LEFT JOIN n ON ev.channel_id = n.channel_id WHERE alarm),
w AS (SELECT channel_id, i, total, recovery_at, ts AS s, ts AS c, ts + INTERVAL 5 MINUTE AS e, score, CAST(1 AS BIGINT) AS merged, [id] AS ids, CAST(NULL AS TIMESTAMP) AS ended, false AS closes, CAST(NULL AS TIMESTAMP) AS o_s, CAST(NULL AS TIMESTAMP) AS o_c, CAST(NULL AS TIMESTAMP) AS o_e, CAST(NULL AS DOUBLE) AS o_score, CAST(0 AS BIGINT) AS o_merged, CAST([] AS VARCHAR[]) AS o_ids FROM d WHERE i = 1
UNION ALL SELECT channel_id, i, total, recovery_at, CASE WHEN joins THEN s ELSE ts END, CASE WHEN joins THEN c ELSE ts END, CASE WHEN joins THEN greatest(e, ts + INTERVAL 5 MINUTE) ELSE ts + INTERVAL 5 MINUTE END, CASE WHEN joins THEN greatest(score, new_score) ELSE new_score END, CASE WHEN joins THEN merged + 1 ELSE 1 END, CASE WHEN joins THEN list_append(ids, id) ELSE [id] END,
CASE WHEN NOT joins AND NOT quiet THEN until ELSE ended END, NOT joins AND NOT quiet, s, c, until, score, merged, CASE WHEN recovers THEN list_append(ids, 'recovery_observed') ELSE ids END
FROM (SELECT w.* EXCLUDE (i, closes, o_s, o_c, o_e, o_score, o_merged, o_ids), d.i, d.ts, d.score AS new_score, d.id, d.ts - w.e <= INTERVAL 6 HOUR AS joins, coalesce(w.recovery_at >= w.c, false) AS recovers, CASE WHEN w.recovery_at >= w.c THEN w.recovery_at ELSE w.e END AS until, coalesce(w.s <= w.ended + INTERVAL 3 HOUR, false) AS quiet FROM w JOIN d ON d.channel_id = w.channel_id AND d.i = w.i + 1))"""


@query(f"WITH RECURSIVE {_DUCK_CONSOLIDATE} SELECT channel_id, o_s AS start_at, o_c AS confirmed_at, o_e AS end_at, o_score AS score, o_merged AS merged, array_to_string(o_ids, ',') AS evidence FROM w WHERE closes UNION ALL SELECT channel_id, s, c, CASE WHEN recovery_at >= c THEN recovery_at ELSE e END, score, merged, array_to_string(CASE WHEN recovery_at >= c THEN list_append(ids, 'recovery_observed') ELSE ids END, ',') FROM w WHERE i = total AND NOT coalesce(s <= ended + INTERVAL 3 HOUR, false)")
def k07_consolidated_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = journal(spark, sf_dir).where("alarm")
    recovery = journal(spark, sf_dir).where("state = 'signup'").groupBy("channel_id").agg(F.max("ts").alias("recovery_at"))
    d = ev.select("channel_id", F.col("ts").alias("start_at"), F.col("ts").alias("confirmed_at"), (F.col("ts") + F.expr("INTERVAL '5' MINUTE")).alias("end_at"), (F.col("value") / 100).alias("score"), F.array(F.col("row_id").cast("string")).alias("evidence"))
    got = episodes.consolidate(d.join(recovery, "channel_id", "left"), ["channel_id"], 60 * 6, 60 * 3)
    return got.withColumn("evidence", F.array_join("evidence", ","))


#: A row at a time, for two in a row: h is a high score that waits for another, l a low one; ends: the episode ended here.
_DUCK_HYSTERESIS = """r AS (SELECT channel_id, ts, state <> 'view' AS ok, value / 100 AS s, row_number() OVER (PARTITION BY channel_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY channel_id) AS total FROM {ev}),
w AS (SELECT DISTINCT channel_id, CAST(0 AS BIGINT) AS i, total, CAST(NULL AS TIMESTAMP) AS seen, CAST(NULL AS TIMESTAMP) AS h, CAST(NULL AS DOUBLE) AS hs, CAST(NULL AS TIMESTAMP) AS l, false AS inside, CAST(NULL AS TIMESTAMP) AS start_at, CAST(NULL AS TIMESTAMP) AS confirmed_at, CAST(NULL AS DOUBLE) AS peak, CAST(NULL AS TIMESTAMP) AS peak_at, CAST(0 AS BIGINT) AS n, false AS ends, CAST(NULL AS TIMESTAMP) AS low_at FROM r
UNION ALL SELECT channel_id, i, total, ts, CASE WHEN ok AND NOT inside AND NOT confirms AND s >= 0.45 THEN ts END, CASE WHEN ok AND NOT inside AND NOT confirms AND s >= 0.45 THEN s END, CASE WHEN ok AND inside AND NOT ends AND s <= 0.4 THEN ts END, CASE WHEN confirms THEN true WHEN ends THEN false ELSE inside END,
CASE WHEN confirms THEN h ELSE start_at END, CASE WHEN confirms THEN ts ELSE confirmed_at END, CASE WHEN confirms THEN greatest(hs, s) WHEN ok AND inside THEN greatest(peak, s) ELSE peak END, CASE WHEN confirms THEN CASE WHEN hs >= s THEN h ELSE ts END WHEN ok AND inside AND s > peak THEN ts ELSE peak_at END, CASE WHEN confirms THEN 2 WHEN ok AND inside THEN n + 1 ELSE n END, ends, l
FROM (SELECT *, ok AND NOT inside AND s >= 0.45 AND h IS NOT NULL AS confirms, ok AND inside AND s <= 0.4 AND l IS NOT NULL AS ends FROM (SELECT r.channel_id, r.i, r.total, r.ts, coalesce(r.ok AND r.s IS NOT NULL, false) AS ok, r.s, CASE WHEN r.ts - w.seen > INTERVAL 24 HOUR THEN NULL ELSE w.h END AS h, w.hs, CASE WHEN r.ts - w.seen > INTERVAL 24 HOUR THEN NULL ELSE w.l END AS l, w.inside, w.start_at, w.confirmed_at, w.peak, w.peak_at, w.n FROM w JOIN r ON r.channel_id = w.channel_id AND r.i = w.i + 1)))"""


@query(f"WITH RECURSIVE {_DUCK_HYSTERESIS} SELECT channel_id, start_at, confirmed_at, CASE WHEN ends THEN seen END AS end_at, CASE WHEN ends THEN low_at END AS recovery_started_at, peak AS peak_score, peak_at, n AS observations FROM w WHERE ends OR inside AND i = total")
def k08_score_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = journal(spark, sf_dir)
    scores = ev.select("channel_id", "ts", F.when(F.col("state") == "view", "unknown").otherwise("eligible").alias("status"), (F.col("value") / 100).alias("score"))
    return episodes.score_episodes(scores, ["channel_id"], 0.45, 0.4, 2, 2, 24)


@query("WITH RECURSIVE e AS (SELECT substring(channel_id, 1, 1) AS episode_id, ts, row_id, row_number() OVER (PARTITION BY substring(channel_id, 1, 1) ORDER BY ts, row_id) AS i FROM {ev} WHERE alarm), w AS (SELECT episode_id, row_id, ts AS last, i, true AS emitted FROM e WHERE i = 1 UNION ALL SELECT e.episode_id, e.row_id, CASE WHEN e.ts > w.last + INTERVAL 1 HOUR THEN e.ts ELSE w.last END, e.i, e.ts > w.last + INTERVAL 1 HOUR FROM w JOIN e ON e.episode_id = w.episode_id AND e.i = w.i + 1) SELECT episode_id, row_id FROM w WHERE emitted")
def k09_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.operators import alerts

    rows = journal(spark, sf_dir).where("alarm").select(F.substring("channel_id", 1, 1).alias("episode_id"), "row_id", "ts")
    return alerts.cooldown(rows, ["episode_id"], "ts", 1, closed=True).where("emitted").select("episode_id", "row_id")


@query("WITH e AS (SELECT * FROM {ev}), p AS (SELECT channel_id, t FROM (SELECT DISTINCT channel_id FROM e), " + features.DUCK_HOURS + "), x AS (SELECT channel_id, ts AS s, ts + INTERVAL 3 HOUR AS z, value > 40 AS confirmed FROM e WHERE alarm), o AS (SELECT channel_id, min(ts) AS s, max(ts) AS z FROM e GROUP BY 1), j AS (SELECT p.channel_id, p.t, any_value(o.s <= p.t AND o.z >= p.t + INTERVAL 24 HOUR) AS seen, bool_or(x.s <= p.t) AS ongoing, bool_or(x.s > p.t AND confirmed) AS onset, bool_or(x.s > p.t AND NOT confirmed) AS odd FROM p JOIN o ON p.channel_id = o.channel_id LEFT JOIN x ON x.channel_id = p.channel_id AND x.s <= p.t + INTERVAL 24 HOUR AND x.z > p.t GROUP BY 1, 2) SELECT channel_id, t, CAST(CASE WHEN NOT seen OR coalesce(ongoing, false) THEN -1 WHEN onset THEN 1 WHEN odd THEN -1 ELSE 0 END AS INT) AS label FROM j")
def k13_onset_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = journal(spark, sf_dir)
    points = features.grid(spark, sf_dir)
    found = ev.where("alarm").select("channel_id", F.col("ts").alias("start_at"), timeops.hours_later(F.col("ts"), 3).alias("end_at"), (F.col("value") > 40).alias("confirmed"))
    observed = ev.groupBy("channel_id").agg(F.min("ts").alias("start_at"), F.max("ts").alias("end_at")).withColumn("status", F.lit("include"))
    return episodes.onset_labels(points, found, observed, 24)


#: Messages in instants of six hours, so that groups occur; numbers and texts by the row.
_MESSAGES = """SELECT channel_id, {six} AS ts, CASE WHEN row_id % 23 = 0 THEN NULL WHEN CAST(channel_id AS INT) % 2 = 0 THEN 'heat' ELSE 'gas' END AS sensor_type,
CASE WHEN state IN ('view', 'purchase') THEN CAST(floor(value / 50) AS DOUBLE) * 30 + 10 END AS value_numeric, CASE WHEN state = 'view' OR state = 'purchase' THEN NULL WHEN state = 'signup' THEN 'fine' WHEN state = 'click' THEN 'in range' ELSE 'broken' END AS value_state,
row_id % 9 = 0 AS alarm, CASE WHEN state IN ('view', 'purchase') THEN concat(CAST(floor(value / 50) AS INT), '') ELSE state END AS value_raw, row_id % 31 = 0 AS odd, CASE WHEN row_id % 19 = 0 THEN 'code' ELSE 'ordinary' END AS qa,
CASE WHEN row_id % 23 = 0 THEN 'uncertain' WHEN state = 'error' THEN 'fault' WHEN state = 'signup' THEN 'normal' ELSE 'neutral' END AS effect FROM {{ev}}"""


@query("WITH m AS (" + _MESSAGES.replace("{six}", "time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')").replace("{{ev}}", "{ev}") + """),
g AS (SELECT channel_id, ts, count(*) AS n, list_distinct(list(coalesce(sensor_type, '?'))) AS kinds, list_distinct(list(value_numeric)) AS numbers, list_distinct(list(value_state)) AS texts, list_distinct(list(alarm)) AS alarms, count(DISTINCT (value_raw, alarm)) AS variants, bool_or(odd) AS odd, bool_or(qa = 'code') AS blocked, bool_or(effect = 'fault') AND bool_or(effect = 'normal') AS contradiction FROM m GROUP BY 1, 2)
SELECT channel_id, ts, n, CASE WHEN len(kinds) <> 1 OR kinds[1] = '?' THEN 'unknown_or_conflicting_type' WHEN contradiction THEN 'registered_fault_and_normal_same_second' WHEN odd THEN 'nonfinite_or_invalid_time' WHEN blocked THEN 'qa_technical_artifact_or_code' WHEN len(numbers) > 1 THEN 'multiple_numeric_values_unordered' WHEN variants <= 1 THEN 'single_variant_visible_in_full_archive'
WHEN len(texts) = 0 AND len(numbers) = 1 AND len(alarms) = 1 THEN 'equivalent_numeric_format_candidate' WHEN len(numbers) = 1 AND len(texts) > 0 AND alarms = [false] THEN CASE WHEN kinds[1] = 'heat' AND list_has_all(['fine', 'in range'], texts) AND list_contains(texts, 'in range') THEN CASE WHEN numbers[1] BETWEEN 3 AND 30 THEN 'temperature_range_companion_candidate' ELSE 'numeric_temperature_range_disagreement' END WHEN texts = ['fine'] THEN 'numeric_norma_companion_candidate' ELSE 'numeric_and_text_unresolved' END
WHEN len(numbers) = 0 AND len(texts) = 1 AND len(alarms) > 1 THEN 'same_text_alarm_disagreement' WHEN len(texts) > 1 THEN 'multiple_text_states_unordered' ELSE 'other_variant_disagreement' END AS pair_category, contradiction, len(numbers) > 1 AS multiple_numeric_values, len(alarms) > 1 AS alarm_difference FROM g""")
def k17_same_time_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of messages at one instant by what they are to each other."""
    six = "CAST(date_trunc('DAY', ts) AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST(floor(hour(ts) / 6) AS INT) * 6)"
    messages = run_sql(spark, sf_dir, _MESSAGES.replace("{six}", six).replace("{{ev}}", f"({EVENTS})"))
    flagged = messages.withColumn("flags", F.when(F.col("odd"), F.array(F.lit("nonfinite_numeric"))).otherwise(F.array().cast("array<string>")))
    return observability.same_time_groups(flagged, ["code"], "in range", "fine", ["heat"], ["heat", "gas"], ["heat", "gas"], 3, 30)
