"""Scoring, alerting and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import timeops
from tidelog.operators import alerts, asof, features
from tidelog.plans import detection
from tidelog.plans import features as feature_plans
from tidelog.plans.registry import journal, query, table

#: Inputs of the rule at every hour: faults, technical messages, and registered episodes that were completed.
DUCK_RULE = (
    detection.DUCK_COMPLETED
    + f""", ev AS (SELECT * FROM {{ev}}), {feature_plans.DUCK_GRID},
f AS (SELECT g.channel_id, g.t, count(e.ts) FILTER (WHERE e.alarm AND e.ts > g.t - INTERVAL 24 HOUR) AS f24, count(e.ts) FILTER (WHERE e.alarm) AS f168, count(e.ts) FILTER (WHERE e.state IN ('error', 'purchase') AND e.ts > g.t - INTERVAL 24 HOUR) AS t24 FROM grid g LEFT JOIN ev e ON g.channel_id = e.channel_id AND e.ts <= g.t AND e.ts > g.t - INTERVAL 168 HOUR GROUP BY 1, 2),
h AS (SELECT g.channel_id, g.t, count(e.end_at) AS c168 FROM grid g LEFT JOIN completed e ON g.channel_id = e.channel_id AND e.end_at <= g.t AND e.end_at > g.t - INTERVAL 168 HOUR GROUP BY 1, 2),
s AS (SELECT f.*, c168, round(2.0 * f24 + 0.5 * f168 + 1.0 * c168 + 0.1 * t24, 6) AS rule_score FROM f JOIN h USING (channel_id, t))"""
)


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four inputs of the frozen rule at every hour, and its score."""
    ev = journal(spark, sf_dir)
    one = F.lit(1).cast("long")
    facts = ev.select("channel_id", "ts", F.col("alarm").cast("long").alias("f"), F.col("state").isin("error", "purchase").cast("long").alias("x"), F.lit(0).cast("long").alias("c"))
    facts = facts.unionByName(detection.completed(spark, sf_dir).select("channel_id", F.col("end_at").alias("ts"), (one - 1).alias("f"), (one - 1).alias("x"), one.alias("c")))
    counts = features.hourly_counts(feature_plans.grid(spark, sf_dir), facts, {c: F.col(c) for c in ("f", "x", "c")}, [24, 168])
    named = counts.select("channel_id", "t", F.col("f_24h").alias("registered_fault_text_count_24h"), F.col("f_168h").alias("registered_fault_text_count_168h"), F.col("c_168h").alias("completed_episode_count_168h"), F.col("x_24h").alias("technical_message_count_24h"), F.lit("eligible").alias("status"))
    return alerts.rule_score(named, "status").withColumn("rule_score", F.round("rule_score", 6))


@query(f"WITH RECURSIVE {DUCK_RULE} SELECT channel_id, t, rule_score, rule_score >= 7.1 AS alert FROM s")
def a01_rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_rows(spark, sf_dir).select("channel_id", "t", "rule_score", "alert")


@query(f"WITH RECURSIVE {DUCK_RULE}, r AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY t DESC) AS i FROM s) SELECT r.channel_id, c_name, n_name, t, rule_score, rule_score >= 7.1 AS alert FROM r LEFT JOIN customer ON r.channel_id = CAST(c_custkey AS VARCHAR) LEFT JOIN nation ON c_nationkey = n_nationkey WHERE i = 1")
def flagship_latest_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of each channel at its latest hour, with its place in the dictionary."""
    latest = rule_rows(spark, sf_dir).groupBy("channel_id").agg(F.max_by(F.struct("t", "rule_score", "alert"), "t").alias("r")).select("channel_id", "r.*")
    objects = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").cast("string").alias("c_id"), "c_name", "n_name")
    return latest.join(objects, F.col("channel_id") == F.col("c_id"), "left").select("channel_id", "c_name", "n_name", "t", "rule_score", "alert")


@query(f"WITH RECURSIVE {DUCK_RULE}, d AS (SELECT channel_id, t, rule_score, CASE WHEN f168 % 5 = 0 THEN 'future_evidence' WHEN (f24 + f168) % 7 = 0 THEN 'missing_or_invalid_rule_count' END AS reason FROM s) SELECT channel_id, t, coalesce(reason, '') AS reason, CASE WHEN reason IS NULL THEN rule_score END AS rule_score FROM d")
def a02_shadow_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n24, n168 = F.col("registered_fault_text_count_24h"), F.col("registered_fault_text_count_168h")
    rows = rule_rows(spark, sf_dir).drop("rule_score", "alert").withColumns({"prediction_time": F.col("t"), "admission_status": F.lit("eligible"), "admission_reason": F.lit(None).cast("string"), "history_through": F.when(n168 % 5 == 0, timeops.hours_later(F.col("t"), 1)).otherwise(F.col("t")), "admission_through": F.col("t"), "technical_message_count_24h": F.when((n24 + n168) % 7 == 0, F.lit(None)).otherwise(F.col("technical_message_count_24h"))})
    got = alerts.shadow_decisions(rows)
    return got.select("channel_id", "t", F.coalesce("unavailable_reason", F.lit("")).alias("reason"), F.round("rule_score", 6).alias("rule_score"))


@query(f"WITH RECURSIVE {DUCK_RULE} SELECT substring(channel_id, 1, 1) AS sensor_type, count(*) AS decisions, count(*) FILTER (WHERE rule_score >= 7.1) AS crossed, count(DISTINCT (channel_id, CAST(t AS DATE))) AS channel_days, round(count(*) FILTER (WHERE rule_score >= 7.1) * 1000 / count(DISTINCT (channel_id, CAST(t AS DATE))), 6) AS per_1000 FROM s GROUP BY 1")
def a03_shadow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, crossed = F.countDistinct(F.struct("channel_id", F.to_date("t"))), F.count(F.when(F.col("alert"), 1))
    return rule_rows(spark, sf_dir).groupBy(F.substring("channel_id", 1, 1).alias("sensor_type")).agg(F.count(F.lit(1)).alias("decisions"), crossed.alias("crossed"), days.alias("channel_days"), F.round(crossed * 1000 / days, 6).alias("per_1000"))


#: Points with the next alarm within a day as their target.
DUCK_POINTS = f"{DUCK_RULE}, a AS (SELECT row_id, channel_id, ts FROM ev WHERE alarm), y AS (SELECT s.channel_id, s.t, s.rule_score, min(a.ts) AS onset FROM s LEFT JOIN a ON a.channel_id = s.channel_id AND a.ts > s.t AND a.ts <= s.t + INTERVAL 24 HOUR GROUP BY 1, 2, 3), z AS (SELECT y.*, CAST(onset IS NOT NULL AS INT) AS target, a.row_id AS episode FROM y LEFT JOIN a ON a.channel_id = y.channel_id AND a.ts = y.onset)"
DUCK_ALERTS = f"{DUCK_POINTS}, q AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY t) AS i FROM z WHERE rule_score >= 7.1), c AS (SELECT *, t AS last, true AS emitted FROM q WHERE i = 1 UNION ALL SELECT q.*, CASE WHEN q.t >= c.last + INTERVAL 24 HOUR THEN q.t ELSE c.last END, q.t >= c.last + INTERVAL 24 HOUR FROM c JOIN q ON q.channel_id = c.channel_id AND q.i = c.i + 1), o AS (SELECT *, CASE WHEN target = 0 THEN 'no_target_in_horizon' WHEN row_number() OVER (PARTITION BY episode ORDER BY channel_id, t) = 1 THEN 'matched_episode' ELSE 'duplicate_episode_warning' END AS outcome, CASE WHEN target = 1 THEN date_diff('microsecond', t, onset) / 3.6e9 END AS lead FROM c WHERE emitted)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = journal(spark, sf_dir)
    rows = asof.asof_last(rule_rows(spark, sf_dir).select("channel_id", F.col("t").alias("prediction_time"), "rule_score"), ev.where("alarm").select("channel_id", "ts", "row_id"), ["channel_id"], "prediction_time", "ts", "next", strict=True, forward=True)
    soon = F.coalesce(F.col("next.ts") <= timeops.hours_later(F.col("prediction_time"), 24), F.lit(False))
    return rows.select("channel_id", "prediction_time", "rule_score", soon.cast("int").alias("target"), F.when(soon, F.col("next.row_id")).alias("target_episode_id"), F.when(soon, F.col("next.ts")).alias("label_available_at"))


@query(f"WITH RECURSIVE {DUCK_ALERTS} SELECT channel_id, t AS prediction_time, outcome, round(lead, 6) AS lead_hours FROM o")
def a04_alert_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_outcomes(labelled(spark, sf_dir), "rule_score", 7.1).select("channel_id", "prediction_time", "outcome", F.round("lead_hours", 6).alias("lead_hours"))


@query(f"WITH RECURSIVE {DUCK_ALERTS}, m AS (SELECT count(*) AS warnings, count(*) FILTER (WHERE outcome = 'matched_episode') AS matched, round(median(lead) FILTER (WHERE outcome = 'matched_episode'), 6) AS median_lead_hours FROM o), t AS (SELECT count(DISTINCT episode) AS truth, count(DISTINCT (channel_id, CAST(t AS DATE))) AS channel_days FROM z) SELECT truth, channel_days, warnings, matched, round(matched / warnings, 6) AS precision, round(matched / truth, 6) AS recall, median_lead_hours FROM m, t")
def a04_alert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    got = alerts.alert_summary(rows, alerts.alert_outcomes(rows, "rule_score", 7.1))
    return got.select("truth", "channel_days", "warnings", "matched", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "median_lead_hours")])


DUCK_BUDGET = f"""{DUCK_POINTS}, th AS (SELECT unnest([4.0, 6.6, 7.1, 8.0, 10.0, 12.0]) AS th),
q AS (SELECT th, z.*, row_number() OVER (PARTITION BY th, channel_id ORDER BY t) AS i FROM z, th WHERE rule_score >= th),
c AS (SELECT th, channel_id, t, target, episode, i, t AS last, true AS emitted FROM q WHERE i = 1
UNION ALL SELECT q.th, q.channel_id, q.t, q.target, q.episode, q.i, CASE WHEN q.t >= c.last + INTERVAL 24 HOUR THEN q.t ELSE c.last END, q.t >= c.last + INTERVAL 24 HOUR FROM c JOIN q ON q.th = c.th AND q.channel_id = c.channel_id AND q.i = c.i + 1),
o AS (SELECT th, target = 1 AND row_number() OVER (PARTITION BY th, episode ORDER BY channel_id, t) = 1 AS hit FROM c WHERE emitted),
v AS (SELECT th, count(*) AS warnings, count(*) FILTER (WHERE hit) AS matched FROM o GROUP BY 1), d AS (SELECT count(DISTINCT (channel_id, CAST(t AS DATE))) AS days FROM z),
b AS (SELECT arg_max((th, warnings, matched), (matched, matched - warnings, th)) AS x FROM v, d WHERE (warnings - matched) * 1000 / days <= 200)"""


@query(f"WITH RECURSIVE {DUCK_BUDGET} SELECT CAST(x[1] AS DOUBLE) AS threshold, x[2] AS warnings, x[3] AS matched FROM b")
def a05_threshold_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    days = rows.select("channel_id", F.to_date("prediction_time")).distinct().count()
    curve = alerts.threshold_curve(rows, "rule_score", [4.0, 6.6, 7.1, 8.0, 10.0, 12.0])
    return alerts.within_budget(curve, days, 200.0)


@query(f"WITH RECURSIVE {DUCK_POINTS}, t AS (SELECT rule_score AS s, sum(target) AS p, count(*) AS n FROM z GROUP BY 1), c AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS seen FROM t) SELECT round(sum(p * tp / seen) / sum(p), 6) AS average_precision, round(sum((n - p) * (tp - p / 2.0)) / (sum(p) * sum(n - p)), 6) AS roc_auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS rows FROM c")
def g30_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = alerts.ranking_metrics(labelled(spark, sf_dir), "rule_score", "target")
    return got.select(F.round("average_precision", 6).alias("average_precision"), F.round("roc_auc", 6).alias("roc_auc"), "positives", "rows")


@query(f"WITH RECURSIVE {DUCK_POINTS}, t AS (SELECT rule_score AS s, sum(target) AS p, count(*) AS n FROM z GROUP BY 1), c AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS seen, sum(p) OVER () AS total FROM t) SELECT arg_max(s, (tp / total, tp / seen, s)) AS threshold FROM c WHERE tp / seen >= 0.4")
def a07_precision_constrained_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = alerts.score_curve(labelled(spark, sf_dir), "rule_score", "target")
    return curve.where(F.col("tp") / F.col("seen") >= 0.4).agg(F.max_by("s", F.struct("tp", F.col("tp") / F.col("seen"), "s")).alias("threshold"))


def duck_matching(scope: str, truths: str, warnings: str) -> str:
    """Greedy matching as one step a truth; truths: scope, id, s, u; warnings: scope, id, wt. No truth may end before one that began earlier."""
    same = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in scope.split(", "))
    return f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY s, u, id) AS i FROM ({truths})), w AS (SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY wt, id) AS j FROM ({warnings})),
lo AS (SELECT t.*, x.lo FROM t LEFT JOIN (SELECT {', '.join(f't.{c}' for c in scope.split(', '))}, t.i, min(j) AS lo FROM t JOIN w ON {same('t', 'w')} AND w.wt >= t.s GROUP BY ALL) x ON {same('t', 'x')} AND t.i = x.i),
r AS (SELECT DISTINCT {scope}, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS last, CAST(NULL AS VARCHAR) AS truth_id, CAST(NULL AS VARCHAR) AS warning_id, CAST(NULL AS DOUBLE) AS delay_seconds FROM t
UNION ALL SELECT {', '.join(f't.{c}' for c in scope.split(', '))}, t.i, CASE WHEN w.wt <= t.u THEN w.j ELSE r.last END, t.id, CASE WHEN w.wt <= t.u THEN w.id END, CASE WHEN w.wt <= t.u THEN date_diff('microsecond', t.s, w.wt) / 1e6 END
FROM r JOIN lo t ON {same('r', 't')} AND t.i = r.i + 1 LEFT JOIN w ON {same('t', 'w')} AND t.lo IS NOT NULL AND w.j = greatest(t.lo, r.last + 1)),
matches AS (SELECT {scope}, truth_id, warning_id, delay_seconds FROM r WHERE i > 0 UNION ALL SELECT {', '.join(f'w.{c}' for c in scope.split(', '))}, NULL, w.id, NULL FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE {same('r', 'w')} AND r.warning_id = w.id))"""


@query(duck_matching("channel_id", "SELECT channel_id, CAST(row_id AS VARCHAR) AS id, ts AS s, ts + INTERVAL 12 HOUR AS u FROM {ev} WHERE alarm", "SELECT channel_id, CAST(row_id AS VARCHAR) AS id, ts AS wt FROM {ev} WHERE state = 'purchase'") + " SELECT * FROM matches")
def a08_greedy_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = journal(spark, sf_dir)
    truths = ev.where("alarm").select("channel_id", F.col("row_id").cast("string").alias("truth_id"), F.col("ts").alias("start_at"), timeops.hours_later(F.col("ts"), 12).alias("until"))
    warnings = ev.where("state = 'purchase'").select("channel_id", F.col("row_id").cast("string").alias("warning_id"), F.col("ts").alias("at"))
    return alerts.match_episodes(truths, warnings, ["channel_id"])


@query("WITH RECURSIVE e AS (SELECT channel_id, ts, row_number() OVER (PARTITION BY channel_id ORDER BY ts) AS i FROM {ev}), w AS (SELECT channel_id, ts AS last, i, 1 AS n FROM e WHERE i = 1 UNION ALL SELECT e.channel_id, CASE WHEN e.ts >= w.last + INTERVAL 24 HOUR THEN e.ts ELSE w.last END, e.i, CASE WHEN e.ts >= w.last + INTERVAL 24 HOUR THEN n + 1 ELSE n END FROM w JOIN e ON e.channel_id = w.channel_id AND e.i = w.i + 1) SELECT channel_id, CAST(max(n) AS BIGINT) AS capacity FROM w GROUP BY 1")
def a11_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = alerts.cooldown(journal(spark, sf_dir).select("channel_id", "ts"), ["channel_id"], "ts", 24)
    return got.groupBy("channel_id").agg(F.count(F.when(F.col("emitted"), 1)).alias("capacity"))


@query(f"WITH RECURSIVE {DUCK_ALERTS}, m AS (SELECT DISTINCT episode FROM o WHERE outcome = 'matched_episode') SELECT z.episode, CASE WHEN m.episode IS NOT NULL THEN 'matched' WHEN max(rule_score) < 7.1 THEN 'below_threshold' ELSE 'cooldown' END AS class FROM z LEFT JOIN m ON z.episode = m.episode WHERE z.episode IS NOT NULL GROUP BY z.episode, m.episode")
def a12_episode_error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    matched = alerts.alert_outcomes(rows, "rule_score", 7.1).where("outcome = 'matched_episode'").select(F.col("target_episode_id").alias("m")).distinct()
    best = rows.where("target_episode_id IS NOT NULL").groupBy(F.col("target_episode_id").alias("episode")).agg(F.max("rule_score").alias("best"))
    return best.join(matched, F.col("episode") == F.col("m"), "left").select("episode", F.when(F.col("m").isNotNull(), "matched").when(F.col("best") < 7.1, "below_threshold").otherwise("cooldown").alias("class"))


@query(f"WITH RECURSIVE {DUCK_POINTS} SELECT channel_id, t AS prediction_time, round(CASE WHEN target = 1 THEN 1.0 / count(*) OVER (PARTITION BY episode) ELSE 1 END, 6) AS weight FROM z")
def a15_episode_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = alerts.episode_weights(labelled(spark, sf_dir), "target_episode_id", "target")
    return got.select("channel_id", "prediction_time", F.round("weight", 6).alias("weight"))


@query("SELECT row_id, CASE WHEN state = 'error' THEN 'already_faulty' WHEN state = 'view' THEN 'unknown_state' WHEN value < 20 THEN 'stale' ELSE 'scored' END AS status FROM {ev}")
def a21_status_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = F.array(F.concat(F.lit("state_is_"), "state"), F.when(F.col("value") < 20, "value_is_low").otherwise("value_is_high"))
    status = alerts.status_by_reason(reasons, [("is_error", "already_faulty"), ("is_view", "unknown_state"), ("is_low", "stale")], "scored")
    return journal(spark, sf_dir).select("row_id", status.alias("status"))


@query()
def a16_linear_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a logistic regression of the rule's inputs, by Spark ML: a substitute for the trained models, not equal to them bit by bit."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = rule_rows(spark, sf_dir).hint("merge").join(labelled(spark, sf_dir).select("channel_id", F.col("prediction_time").alias("t"), "target"), ["channel_id", "t"])  # a grid looks small to Spark, and is not
    matrix = VectorAssembler(inputCols=list(alerts.TERMS), outputCol="x").transform(rows)
    fitted = LogisticRegression(featuresCol="x", labelCol="target", maxIter=50, regParam=0.01).fit(matrix)
    return spark.createDataFrame([(n, float(w)) for n, w in zip(alerts.TERMS, fitted.coefficients.toArray(), strict=True)], "term string, weight double")
