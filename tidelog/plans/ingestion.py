"""Ingestion, quality and observability over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import parse, rules
from tidelog.operators import ingest, intervals
from tidelog.plans.registry import journal, query, run_sql, table
from tidelog.sources import sinks

#: Raw strings as a journal file would hold them, with a quarter of the rows repeated and some spoilt.
RAW_SQL = """
SELECT event_id AS row_id, 'a.csv' AS source, event_id AS source_row, CAST(event_id AS VARCHAR(20)) AS event_id_raw,
  CASE WHEN event_id % 97 = 0 THEN ' ' ELSE CAST(user_id AS VARCHAR(20)) END AS channel_id_raw,
  {date} AS date_raw, CASE WHEN event_id % 89 = 0 THEN '25:00:00' WHEN event_id % 83 = 0 THEN concat({time}, '+03:00') ELSE {time} END AS time_raw,
  CASE WHEN event_id % 79 = 0 THEN 'maybe' WHEN event_type = 'error' THEN ' TRUE ' WHEN event_id % 2 = 0 THEN 'f' ELSE '0' END AS alarm_raw,
  CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 73 = 0 THEN 'nan' ELSE replace(CAST(CAST(floor(value) AS INT) AS VARCHAR(20)), '.', ',') END AS value_raw
FROM EVENTS"""
_spark_raw = RAW_SQL.replace("{date}", "date_format(ts, 'yyyy-MM-dd')").replace("{time}", "date_format(ts, 'HH:00:00')").replace("EVENTS", "{events}")
_duck_raw = RAW_SQL.replace("{date}", "strftime(ts, '%Y-%m-%d')").replace("{time}", "strftime(ts, '%H:00:00')").replace("EVENTS", "{events}")
_all = "SELECT * FROM ({raw}) UNION ALL SELECT row_id + 10000000, 'b.csv', source_row, event_id_raw, channel_id_raw, date_raw, time_raw, alarm_raw, value_raw FROM ({raw}) WHERE row_id % 4 = 0"
HEADER = ["id", "channel", "date", "time", "alarm", "value"]


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, _all.replace("{raw}", _spark_raw))


DUCK_ROWS = f"""raw AS ({_all.replace("{raw}", _duck_raw)}),
parsed AS (SELECT *, nullif(trim(channel_id_raw), '') AS channel_id,
  CASE WHEN time_raw NOT LIKE '%+%' THEN try_cast(concat(date_raw, ' ', time_raw) AS TIMESTAMP) END AS timestamp,
  CASE lower(trim(alarm_raw)) WHEN 'true' THEN true WHEN 'f' THEN false WHEN '0' THEN false END AS alarm,
  CASE WHEN value_raw <> 'nan' THEN try_cast(value_raw AS DOUBLE) END AS value_numeric FROM raw),
classified AS (SELECT *, CASE WHEN row_id <> min(row_id) OVER (PARTITION BY event_id_raw, channel_id_raw, date_raw, time_raw, alarm_raw, value_raw) THEN 'exact_duplicate'
  WHEN channel_id IS NULL OR timestamp IS NULL OR alarm IS NULL THEN 'quarantine' ELSE 'accepted' END AS disposition FROM parsed)"""
DUCK_CLEAN = f"""{DUCK_ROWS},
accepted AS (SELECT * FROM classified WHERE disposition = 'accepted'),
conflicts AS (SELECT channel_id, timestamp FROM accepted GROUP BY 1, 2 HAVING count(DISTINCT (value_raw, alarm)) > 1),
channels AS (SELECT CAST(c_custkey AS VARCHAR) AS channel_id, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 99 ELSE c_nationkey END AS object_id FROM customer WHERE c_mktsegment <> 'BUILDING'),
clean AS (SELECT a.*, CASE WHEN c.channel_id IS NULL THEN 'unknown_channel' WHEN c.object_id IS NULL THEN 'object_id_missing' WHEN n.n_nationkey IS NULL THEN 'object_not_found' ELSE 'linked' END AS join_status,
  c.channel_id IS NULL AS unknown_channel, x.channel_id IS NOT NULL AS in_conflict
  FROM accepted a LEFT JOIN channels c ON a.channel_id = c.channel_id LEFT JOIN nation n ON c.object_id = n.n_nationkey LEFT JOIN conflicts x ON a.channel_id = x.channel_id AND a.timestamp = x.timestamp)"""


def classified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.classify(ingest.normalize(raw_rows(spark, sf_dir), HEADER))


def clean_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = sinks.stored(classified_rows(spark, sf_dir), "classified")
    accepted = rows.where("disposition = 'accepted'")
    channels = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").selectExpr("CAST(c_custkey AS STRING) AS channel_id", "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 99 ELSE c_nationkey END AS object_id")
    objects = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS object_id", "n_name AS object_name")
    return rows, ingest.enrich(accepted, channels, objects, ingest.conflicts(accepted))


@query(f"WITH {DUCK_ROWS} SELECT row_id, channel_id, timestamp, coalesce(CAST(alarm AS VARCHAR), '?') AS alarm, value_numeric, CASE WHEN value_numeric IS NULL THEN value_raw END AS value_state, concat_ws(',', CASE WHEN time_raw LIKE '%+%' THEN 'timezone_present' WHEN timestamp IS NULL THEN 'invalid_timestamp' END, CASE WHEN alarm IS NULL THEN 'invalid_alarm' END, CASE WHEN value_raw = 'nan' THEN 'nonfinite_numeric' END, CASE WHEN channel_id IS NULL THEN 'empty_channel_id' END) AS flags FROM parsed")
def x04_normalize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.normalize(raw_rows(spark, sf_dir), HEADER)
    return rows.select("row_id", "channel_id", "timestamp", F.coalesce(F.col("alarm").cast("string"), F.lit("?")).alias("alarm"), "value_numeric", "value_state", F.array_join("quality_flags", ",").alias("flags"))


@query(f"WITH {DUCK_ROWS} SELECT row_id, disposition FROM classified")
def d01_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified_rows(spark, sf_dir).select("row_id", "disposition")


@query(f"WITH {DUCK_CLEAN} SELECT channel_id, timestamp FROM conflicts")
def d02_channel_time_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.conflicts(classified_rows(spark, sf_dir).where("disposition = 'accepted'"))


@query(f"WITH {DUCK_CLEAN} SELECT row_id, join_status, concat_ws(',', CASE WHEN value_raw = 'nan' THEN 'nonfinite_numeric' END, CASE WHEN unknown_channel THEN 'unknown_channel' END, CASE WHEN in_conflict THEN 'channel_time_conflict' END) AS flags FROM clean")
def d03_clean_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_rows(spark, sf_dir)[1].select("row_id", "join_status", F.array_join("quality_flags", ",").alias("flags"))


@query(f"""WITH {DUCK_CLEAN} SELECT 'disposition:' || disposition AS check, count(*) AS value FROM classified GROUP BY 1 UNION ALL SELECT 'join:' || join_status, count(*) FROM clean GROUP BY 1
UNION ALL SELECT 'flag:' || f, count(*) FROM (SELECT unnest([CASE WHEN value_raw = 'nan' THEN 'nonfinite_numeric' END, CASE WHEN unknown_channel THEN 'unknown_channel' END, CASE WHEN in_conflict THEN 'channel_time_conflict' END]) AS f FROM clean) WHERE f IS NOT NULL GROUP BY 1
UNION ALL SELECT 'clean_rows', count(*) FROM clean UNION ALL SELECT 'repeated_provenance', count(*) - count(DISTINCT (source, source_row)) FROM clean UNION ALL SELECT 'bad_value_representation', 0""")
def d05_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.quality_report(*clean_rows(spark, sf_dir))


@query("WITH r AS (SELECT row_id, channel_id, date_trunc('hour', ts) AS at_hour, state, alarm FROM {ev}), v AS (SELECT channel_id, at_hour FROM r GROUP BY 1, 2 HAVING count(DISTINCT (state, alarm)) > 1) SELECT r.row_id, v.at_hour IS NOT NULL AS conflict FROM r LEFT JOIN v ON r.channel_id = v.channel_id AND r.at_hour = v.at_hour")
def d06_variant_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = journal(spark, sf_dir).withColumn("at", F.date_trunc("HOUR", "ts").cast("timestamp_ntz"))
    bad = ingest.conflicts(rows, "at", ("state", "alarm")).withColumn("hit", F.lit(True))
    return rows.join(bad, ["channel_id", "at"], "left").select("row_id", F.coalesce("hit", F.lit(False)).alias("conflict"))


@query("SELECT CAST(date_trunc('month', m) AS TIMESTAMP) AS month FROM (SELECT unnest(generate_series(TIMESTAMP '2023-11-01', TIMESTAMP '2024-03-01', INTERVAL 1 MONTH)) AS m) WHERE m NOT IN (SELECT DISTINCT date_trunc('month', ts) FROM {ev})")
def d12_missing_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = spark.range(1).select(F.explode(F.expr("sequence(TIMESTAMP_NTZ '2023-11-01 00:00:00', TIMESTAMP_NTZ '2024-03-01 00:00:00', INTERVAL 1 MONTH)")).alias("month"))
    return months.join(journal(spark, sf_dir).select(F.date_trunc("MONTH", "ts").cast("timestamp_ntz").alias("month")).distinct(), "month", "left_anti")


@query("WITH c AS (SELECT row_id, unnest(list_concat(['state:' || state], CASE WHEN alarm THEN ['alarm'] ELSE CAST([] AS VARCHAR[]) END)) AS category, substring(md5(channel_id), 1, 1) AS bucket FROM {ev}) SELECT category, bucket, arg_min(row_id, md5(CAST(row_id AS VARCHAR))) AS row_id FROM c GROUP BY 1, 2")
def d13_coverage_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = journal(spark, sf_dir)
    categories = F.concat(F.array(F.concat(F.lit("state:"), "state")), F.when(F.col("alarm"), F.array(F.lit("alarm"))).otherwise(F.array().cast("array<string>")))
    return rows.select("row_id", F.explode(categories).alias("category"), F.substring(F.md5("channel_id"), 1, 1).alias("bucket")).groupBy("category", "bucket").agg(F.min_by("row_id", F.md5(F.col("row_id").cast("string"))).alias("row_id"))


@query("SELECT * FROM (SELECT 'repeated_keys' AS violation, (SELECT count(*) FROM (SELECT channel_id, ts FROM {ev} GROUP BY 1, 2 HAVING count(*) > 1)) AS value UNION ALL SELECT 'not_finite:value', (SELECT count(*) FROM {ev} WHERE NOT isfinite(value)) UNION ALL SELECT 'shrinks:a>b', (SELECT count(*) FROM {ev} WHERE value > value * 0.99 + 1))")
def d14_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = journal(spark, sf_dir).withColumns({"a": F.col("value"), "b": F.col("value") * 0.99 + 1})
    return ingest.violations(rows, ["channel_id", "ts"], ["value"], [["a", "b"]])


@query("SELECT row_id, CASE WHEN state = 'purchase' AND value > 90 THEN 'gas_above_physical_percent' WHEN state = 'purchase' AND value >= 50 THEN 'gas_alarm_level_candidate' WHEN state = 'click' AND value IN (25.0, 26.0) THEN 'temperature_service_code_candidate' ELSE 'ordinary_numeric' END AS category FROM {ev}")
def x08_value_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("state") == "purchase", rules.GAS).when(F.col("state") == "click", rules.TEMPERATURE)
    quality = rules.assess_value(kind, F.col("state"), F.col("value"), [25.0, 26.0], ["1970-01-01"], 50.0, 90.0)
    return journal(spark, sf_dir).select("row_id", quality["category"].alias("category"))


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'registered' WHEN 1 THEN 'normal' WHEN 2 THEN 'unverified_sensor_type' WHEN 3 THEN 'observed_clear_state' WHEN 4 THEN 'explicit_battery_fault_text' ELSE 'unmapped_state' END AS reason, CASE c_custkey % 6 WHEN 0 THEN 'fault' WHEN 1 THEN 'normal' WHEN 3 THEN 'neutral' ELSE 'uncertain' END AS effect FROM customer")
def x06_classify_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, state = (F.expr(f"element_at(array({', '.join(repr(x) for x in names)}), CAST(c_custkey % 6 AS INT) + 1)") for names in ((rules.DOOR, rules.SMOKE, "?", rules.SMOKE, "Состояние вентилятора", rules.GAS), (rules.FAULT, rules.NORMAL, rules.FAULT, "Дыма нет", "Батарея разряжена", "нечто")))
    events = table(spark, sf_dir, "customer").select("c_custkey", kind.alias("sensor_type"), state.alias("value_state"))
    known = rules.dictionary(spark, [("Состояние вентилятора", "Батарея разряжена", "technical_fault", "explicit_battery_fault_text")])
    got = rules.classify_messages(events, known)
    reason = F.when(F.col("message.target"), "registered").when(F.col("message.reason") == "exact_normal_text", "normal").otherwise(F.col("message.reason"))
    return got.select("c_custkey", reason.alias("reason"), rules.registered_effect(F.col("message"), F.col("value_state")).alias("effect"))


@query("WITH t AS (SELECT channel_id, ts, lag(ts) OVER (PARTITION BY channel_id ORDER BY ts) AS p FROM {ev}), g AS (SELECT *, sum(CASE WHEN ts > p + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY channel_id ORDER BY ts) AS r FROM t) SELECT channel_id, min(ts) AS start_at, max(ts) AS end_at, count(*) AS observations FROM g GROUP BY channel_id, r")
def w17_observed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.observed_runs(journal(spark, sf_dir), ["channel_id"], "ts", 12 * 3600)


@query("SELECT row_id, CASE WHEN v = 'nan' THEN 'nonfinite_numeric' END AS flag, round(CASE WHEN v <> 'nan' THEN try_cast(replace(v, ',', '.') AS DOUBLE) END, 6) AS number FROM (SELECT row_id, CASE row_id % 5 WHEN 0 THEN '12,5' WHEN 1 THEN 'nan' WHEN 2 THEN 'text' WHEN 3 THEN '-3' ELSE '1e2' END AS v FROM {ev})")
def x03_parse_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = journal(spark, sf_dir).withColumn("v", F.expr("CASE row_id % 5 WHEN 0 THEN ' 12,5 ' WHEN 1 THEN 'NaN' WHEN 2 THEN 'text' WHEN 3 THEN '-3' ELSE '1e2' END"))
    return rows.withColumn("p", parse.parse_numeric(F.col("v"))).select("row_id", F.col("p.flag").alias("flag"), F.round("p.value", 6).alias("number"))
