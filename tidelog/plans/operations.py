"""Scans, sinks, guards and streams of the journal as queries: each writes or reads through its operator, and gives what came of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import timeops
from tidelog.operators import admission, features, ingest, serving
from tidelog.plans.registry import journal, query, table
from tidelog.sources import readers, sinks
from tidelog.streaming import shadow


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region ORDER BY region.r_regionkey LIMIT 3")
def s03_bounded_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a source, as an operator that looks at a new file reads it."""
    path = sinks.work_path(spark, "source")
    table(spark, sf_dir, "region").select("r_regionkey", "r_name").coalesce(1).sortWithinPartitions("r_regionkey").write.option("header", True).csv(path)
    return readers.source_rows(spark, path, ["r_regionkey", "r_name"], path, 3).select("r_regionkey", "r_name")


@query("SELECT row_id, value, CASE WHEN row_id % 2 = 0 THEN state END AS state FROM {ev}")
def s07_stated_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of different columns by one schema."""
    path, ev = sinks.work_path(spark, "files"), journal(spark, sf_dir)
    ev.where("row_id % 2 = 0").select("row_id", "value", "state").write.parquet(f"{path}/a")
    ev.where("row_id % 2 = 1").select("row_id", "value").write.parquet(f"{path}/b")
    return readers.parquet_files(spark, [f"{path}/a", f"{path}/b"], "row_id long, value double, state string")


@query("SELECT row_id, state FROM {ev}")
def s09_append_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run in three parts, read again and added to a store twice."""
    path, ev = sinks.work_path(spark, "run"), journal(spark, sf_dir).select("row_id", "state")
    for i in range(3):
        sinks.append_once(ev.where(F.col("row_id") % 3 == i), f"{path}/run", str(i))
    for _ in range(2):
        sinks.append_run(spark, f"{path}/run", f"{path}/store", "run")
    return sinks.read_parts(spark, f"{path}/store").select("row_id", "state")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def s10_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.work_path(spark, "upload")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.option("header", True).csv(path)
    return readers.upload(spark, path)


@query("SELECT * FROM (VALUES ('episodes', 'episodes'), ('forecasts', 'forecasts'), ('journal', 'events'), ('sensors', 'sensors'), ('region', 'none')) t(source, kind)")
def s11_detected_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = journal(spark, sf_dir).withColumnRenamed("ts", "timestamp").columns
    columns = {"episodes": ["episode_id", "channel_id", "start_at", "timestamp"], "forecasts": ["channel_id", "prediction_time"], "journal": renamed, "sensors": ["channel_id", "name"], "region": table(spark, sf_dir, "region").columns}
    return spark.createDataFrame([(n, readers.detect_kind(c) or "none") for n, c in columns.items()], "source string, kind string")


@query("SELECT part, count(*) AS n FROM (SELECT CASE WHEN row_id % 4 = 0 THEN 'a' ELSE 'b' END AS part FROM {ev}) GROUP BY 1")
def s15_append_only_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part that is complete stays as it is, whatever comes under its name."""
    path, ev = sinks.work_path(spark, "parts"), journal(spark, sf_dir).select("row_id")
    sinks.append_once(ev.where("row_id % 4 = 0"), path, "a")
    sinks.append_once(ev.where("row_id % 4 <> 0"), path, "b")
    sinks.append_once(ev, path, "a")
    return sinks.read_parts(spark, path).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'alarms' AS name, count(*) FILTER (WHERE alarm) AS n FROM {ev} UNION ALL SELECT 'all', count(*) FROM {ev}")
def s17_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attempt that wrote one of two tables, taken up by the next."""
    path, ev = sinks.work_path(spark, "published"), journal(spark, sf_dir).select("row_id", "alarm")
    sinks.append_once(ev, f"{path}.inprogress/all", "all")
    manifest = sinks.publish({"all": ev, "alarms": ev.where("alarm")}, path, {"version": 1})
    return spark.createDataFrame(list(manifest["rows"].items()), "name string, n long")


@query("SELECT max(row_id) AS last_row, count(*) AS n FROM {ev}")
def s18_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sinks.work_path(spark, 'checkpoint')}.json"
    done = journal(spark, sf_dir).agg(F.max("row_id").alias("last_row"), F.count(F.lit(1)).alias("n")).first().asDict()
    sinks.save_json(spark, path, {"last_row": 0, "n": 0})
    sinks.save_json(spark, path, done)
    return spark.createDataFrame([sinks.load_json(spark, path)], "last_row long, n long")


@query("SELECT row_id, value, 'run-1' AS run, 'v2' AS rules FROM {ev}")
def s19_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.with_provenance(journal(spark, sf_dir).select("row_id", "value"), {"run": "run-1", "rules": "v2"})


@query("SELECT row_id, state, CASE WHEN row_id % 3 <> 0 THEN value END AS value FROM {ev}")
def s22_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = journal(spark, sf_dir)
    texts = ev.select(F.to_json(F.struct("row_id", "state", F.when(F.col("row_id") % 3 != 0, F.col("value")).alias("value"))).alias("body"))
    return sinks.json_rows(texts, "body", "row_id long, state string, value double")


@query("SELECT * FROM (VALUES ('row_id', true), ('channel_id', true), ('ts', true), ('value', true), ('state', true), ('alarm', true), ('label', false), ('target_24h', false), ('future_alarm', false)) t(name, allowed)")
def f09_forbidden_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*journal(spark, sf_dir).columns, "label", "target_24h", "future_alarm"]
    return spark.createDataFrame(features.allowed(names), "name string, allowed boolean")


@query("SELECT f.row_id, f.value, f.state, f.value > 50 AS target_high FROM {ev} f")
def f10_allowlist_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and diagnostics of the same keys, apart and joined again."""
    rows = journal(spark, sf_dir).select("row_id", "value", "state", (F.col("value") > 50).alias("target_high"))
    inputs, diagnostics = features.project(rows, ["row_id"], ["value", "state"])
    return inputs.join(diagnostics, "row_id")


HEADER = ["EventId", "Channel", "Date", "Time", "Alarm", "Value"]


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal as raw strings; every 50th row repeats the header, and every 7th the row before it but for its number."""
    ev = journal(spark, sf_dir)
    of = F.when(F.col("row_id") % 7 == 0, F.col("row_id") - 1).otherwise(F.col("row_id"))
    made = [of.cast("string"), F.concat(F.lit("c"), (of % 40).cast("string")), F.lit("2024-01-02"), F.lit("03:04:05"), F.lit("0"), (of % 90).cast("string")]
    return ev.select("row_id", F.lit("s").alias("source"), F.col("row_id").alias("source_row"), *[F.when(F.col("row_id") % 50 == 0, n).otherwise(x).alias(c) for c, n, x in zip(ingest.RAW, map(F.lit, HEADER), made, strict=True)])


@query("SELECT row_id, row_id % 50 = 0 AS repeated_header FROM {ev}")
def x05_repeated_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.normalize(_raw(spark, sf_dir), HEADER).select("row_id", "repeated_header")


@query("WITH r AS (SELECT row_id, CASE WHEN row_id % 50 = 0 THEN -1 WHEN row_id % 7 = 0 THEN row_id - 1 ELSE row_id END AS k FROM {ev}) SELECT row_id, CASE WHEN k = -1 THEN 'repeated_header' WHEN row_id <> min(row_id) OVER (PARTITION BY k) THEN 'exact_duplicate' ELSE 'accepted' END AS disposition, false AS differs FROM r")
def d04_classified_by_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispositions made part by part, and whether those of the whole differ."""
    rows = ingest.normalize(_raw(spark, sf_dir), HEADER)
    parts, whole = ingest.classify_parts(rows, 3), ingest.classify(rows)
    both = parts.select("row_id", "disposition").join(whole.select("row_id", F.col("disposition").alias("other")), "row_id")
    return both.select("row_id", "disposition", (F.col("disposition") != F.col("other")).alias("differs"))


@query("SELECT row_id, CASE WHEN row_id % 13 = 0 THEN 'excluded' WHEN row_id % 5 = 0 OR row_id % 3 = 0 OR row_id % 7 = 0 OR row_id % 2 = 1 OR row_id % 11 = 0 THEN 'unknown' ELSE 'eligible' END AS status, CASE WHEN row_id % 13 = 0 THEN 'all_causal_observations_excluded' ELSE concat_ws(',', CASE WHEN row_id % 5 = 0 THEN 'sensor_type_unknown_or_conflicting' END, CASE WHEN row_id % 3 = 0 THEN 'baseline_unusable' END, CASE WHEN row_id % 7 = 0 THEN 'insufficient_history' END, CASE WHEN row_id % 2 = 1 THEN 'quality_exclusions_24h' END, CASE WHEN row_id % 11 = 0 THEN 'numeric_history_missing' END) END AS reasons FROM {ev}")
def e10_branch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("row_id")
    rows = journal(spark, sf_dir).select(
        "row_id", F.when(i % 5 != 0, "smoke").alias("sensor_type"), F.when(i % 3 == 0, "unknown").otherwise("eligible").alias("baseline_status"), F.when(i % 7 == 0, F.array(F.lit("insufficient_history"))).otherwise(F.array().cast("array<string>")).alias("availability_reasons"),
        (i % 2).alias("excluded_quality_count_24h"), (i % 11).alias("baseline_numeric_count"), F.lit(1).alias("numeric_count_24h"), F.lit(1.0).alias("baseline_numeric_median"), F.lit(1.0).alias("baseline_numeric_mad"), F.lit(1.0).alias("numeric_median_24h"),
        F.when(i % 13 == 0, "excluded").otherwise("eligible").alias("availability_status"),
    )
    return admission.branch_status(rows, False).select("row_id", F.col("branch_status").alias("status"), F.array_join("branch_reasons", ",").alias("reasons"))


@query("SELECT true AS stage_complete, CASE WHEN count(*) FILTER (WHERE alarm) > 0 THEN true ELSE false END AS research_forecast_ready, false AS operational_claim_ready, 'missing:external_validation_available' AS blockers FROM {ev}")
def a22_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = journal(spark, sf_dir)
    got = serving.readiness({"rows": not ev.isEmpty()}, {"alarms": not ev.where("alarm").isEmpty()}, False)
    return spark.createDataFrame([(got["stage_complete"], got["research_forecast_ready"], got["operational_claim_ready"], ",".join(got["blockers"]))], "stage_complete boolean, research_forecast_ready boolean, operational_claim_ready boolean, blockers string")


def _streamed(spark: SparkSession, sf_dir: str, work) -> DataFrame:
    """work over the journal as a stream of files, by time, and a last row that the watermark follows."""
    base, ev = sinks.work_path(spark, "stream"), journal(spark, sf_dir).select("channel_id", "state", "ts")
    ev.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(f"{base}/in")
    ev.agg(F.max("ts").alias("ts")).select(F.lit("end").alias("channel_id"), F.lit("end").alias("state"), timeops.hours_later(F.col("ts"), 24 * 60).alias("ts")).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(ev.schema).parquet(f"{base}/in")
    shadow.run_available(work(stream), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").drop("part")


@query("WITH k AS (SELECT unnest(generate_series(0, 3)) AS k) SELECT state, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR AS start_at, count(*) AS n FROM {ev}, k GROUP BY 1, 2")
def t08_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that begin every six hours, over a stream."""
    return _streamed(spark, sf_dir, lambda s: shadow.sliding_counts(s, ["state"], "24 hours", "6 hours", "40 days"))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY channel_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM {ev}), s AS (SELECT *, sum(fresh) OVER (PARTITION BY channel_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM g) SELECT channel_id, min(ts) AS start_at, max(ts) + INTERVAL 12 HOUR AS end_at, count(*) AS n FROM s GROUP BY channel_id, island")
def t09_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a channel without twelve silent hours, over a stream."""
    return _streamed(spark, sf_dir, lambda s: shadow.sessions(s, ["channel_id"], "12 hours", "40 days"))


@query()
def t10_replay_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows replayed, micro-batches, and their seconds by percentile: measured, so not the same twice."""
    from tidelog.plans import streams

    base, rows = sinks.work_path(spark, "latency"), streams.inputs(spark, sf_dir)
    rows.repartitionByRange(6, "ts").sortWithinPartitions("ts").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    got = shadow.latency(shadow.run_available(shadow.decisions(stream), f"{base}/out", f"{base}/checkpoint"))
    return spark.createDataFrame([tuple(float(v) for v in got.values())], ", ".join(f"{k} double" for k in got))
