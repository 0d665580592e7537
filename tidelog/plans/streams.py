"""Streaming queries, and what batch says of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import rules
from tidelog.operators import features
from tidelog.plans.features import DUCK_HOURS
from tidelog.plans.registry import journal, query, sql_query
from tidelog.sources import sinks
from tidelog.streaming import shadow


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal with a tick for every channel and hour."""
    ev = journal(spark, sf_dir).withColumns({"effect": rules.effect(F.col("state")), "technical": F.col("state").isin("error", "purchase")})
    hours = features.hours_of(ev)
    return shadow.with_ticks(ev, *hours, 1) if hours else shadow.with_ticks(ev.limit(0), "1970-01-01", "1970-01-01", 1)


_SCORED = f"""ev AS (SELECT * FROM {{ev}}), p AS (SELECT channel_id, t FROM (SELECT DISTINCT channel_id FROM ev), {DUCK_HOURS}),
k AS (SELECT channel_id, ts, CASE state WHEN 'error' THEN 'fault' WHEN 'signup' THEN 'normal' WHEN 'click' THEN 'neutral' ELSE 'uncertain' END AS kind FROM ev),
n AS (SELECT *, max(CASE WHEN kind = 'normal' THEN ts END) OVER w AS n, max(CASE WHEN kind IN ('fault', 'uncertain') THEN ts END) OVER w AS bad FROM k WINDOW w AS (PARTITION BY channel_id ORDER BY ts)),
l AS (SELECT p.channel_id, p.t, n.n AS normal_at, n.bad FROM p ASOF LEFT JOIN n ON p.channel_id = n.channel_id AND p.t >= n.ts)
SELECT channel_id, t, CASE WHEN normal_at IS NOT NULL AND (bad IS NULL OR bad < normal_at) AND t <= normal_at + INTERVAL 168 HOUR THEN true ELSE false END AS eligible FROM l"""


@query("WITH " + _SCORED)
def t02_batch_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shadow.replay(inputs(spark, sf_dir)).where("kind = 'decision'")
    return got.select("channel_id", F.col("at").alias("t"), (F.col("admission_status") == "eligible").alias("eligible"))


@query("WITH " + _SCORED)
def t01_stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal in three files, a micro-batch each, through the stateful stream."""
    base = sinks.work_path(spark, "stream")
    rows = inputs(spark, sf_dir)
    a, z = rows.agg(F.expr("approx_percentile(unix_micros(CAST(ts AS TIMESTAMP)), array(0.33, 0.67))").alias("q")).first().q or (0, 0)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    third = F.when(micros < a, 0).when(micros < z, 1).otherwise(2)
    for i in range(3):
        rows.where(third == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    shadow.run_available(shadow.decisions(stream), f"{base}/out", f"{base}/checkpoint")
    got = spark.read.parquet(f"{base}/out").where("kind = 'decision'")
    return got.select("channel_id", F.col("at").alias("t"), (F.col("admission_status") == "eligible").alias("eligible"))


sql_query("t07_tumbling_windows", "SELECT date_trunc('DAY', ts) AS day, state, count(*) AS n FROM {ev} GROUP BY date_trunc('DAY', ts), state", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, state, count(*) AS n FROM {ev} GROUP BY 1, 2")
