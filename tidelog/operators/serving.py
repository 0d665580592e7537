"""Latest-state views of channels for lists, search and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = {"fault": "failed", "normal": "healthy", "uncertain": "unknown"}


def operational_state(events: DataFrame) -> DataFrame:
    """channel_id, operational_state: what the latest effect that is not neutral says; observed where there is none."""
    last = events.groupBy("channel_id").agg(F.max_by(F.when(F.col("effect") != "neutral", F.col("effect")), F.when(F.col("effect") != "neutral", F.struct("ts", "row_id"))).alias("e"))
    out = F.lit("observed")
    for effect, name in STATES.items():
        out = F.when(F.col("e") == effect, name).otherwise(out)
    return last.select("channel_id", out.alias("operational_state"))


def sensor_view(sensors: DataFrame, events: DataFrame, forecasts: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row for every channel that any source knows: its dictionary entry, latest event, forecast and episode, and one exclusive bucket.

    failed before warning before healthy; unavailable where no forecast was scored. Ties of time go to the greater row.
    """
    def newest(df: DataFrame, at: str, names: list[str], prefix: str) -> DataFrame:
        return df.groupBy("channel_id").agg(F.max_by(F.struct(*names), F.struct(at, *[n for n in names if n != at])).alias(prefix))

    parts = [sensors.groupBy("channel_id").agg(F.max(F.struct(*[c for c in sensors.columns if c != "channel_id"])).alias("sensor"))]
    parts += [newest(events, "ts", ["ts", "row_id", "state", "alarm"], "event"), newest(forecasts, "t", ["t", "status", "score", "warning"], "forecast"), newest(episodes, "start_at", ["start_at", "end_at"], "episode")]
    view = parts[0]
    for p in parts[1:]:
        view = view.join(p, "channel_id", "full_outer")
    view = view.join(operational_state(events), "channel_id", "left")
    state = F.coalesce("operational_state", F.lit("observed"))
    open_episode = F.col("episode").isNotNull() & F.col("episode.end_at").isNull()
    bucket = F.when((state == "failed") | open_episode, "failed").when(F.coalesce("forecast.warning", F.lit(False)), "warning").when(F.coalesce(F.col("forecast.status") == "scored", F.lit(False)), "healthy").otherwise("unavailable")
    return view.select("channel_id", "sensor", "event", "forecast", "episode", state.alias("operational_state"), bucket.alias("bucket"))


def search(view: DataFrame, text: str, fields: list[Column]) -> DataFrame:
    """Rows where any field holds the text in any case; an empty text finds all."""
    if not text.strip():
        return view
    hit = F.lit(False)
    for f in fields:
        hit |= F.coalesce(F.contains(F.lower(f.cast("string")), F.lit(text.strip().lower())), F.lit(False))
    return view.where(hit)


def dashboard_order(view: DataFrame) -> DataFrame:
    """Warnings first, then scored ones, then by score (none or zero counts as -1), then id, all downwards."""
    score = F.coalesce(F.nullif("forecast.score", F.lit(0.0)), F.lit(-1.0))
    return view.orderBy(F.desc(F.coalesce("forecast.warning", F.lit(False))), F.desc(F.coalesce(F.col("forecast.status") == "scored", F.lit(False))), F.desc(score), F.desc("channel_id"))


def summary(view: DataFrame) -> DataFrame:
    return view.groupBy("bucket").agg(F.count(F.lit(1)).alias("channels"))


def history(events: DataFrame, channels: list[str], start: str, end: str) -> DataFrame:
    """Events of stated channels in [start, end], in order; filters reach the scan."""
    inside = F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    return events.where(F.col("channel_id").isin(*channels) & inside).orderBy("channel_id", "ts", "row_id")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, updated: str) -> DataFrame:
    """The latest row of each key by update time, nulls first; of equals the incoming one."""
    from tidelog.operators.ingest import latest

    both = stored.withColumn("in_", F.lit(0)).unionByName(incoming.withColumn("in_", F.lit(1)), allowMissingColumns=True)
    return latest(both, [key], [F.desc_nulls_last(updated), F.desc("in_")]).drop("in_")


def readiness(checks: dict[str, bool], forecast: dict[str, bool], external: bool) -> dict:
    """Gates of a release: stage complete, research forecast ready, operational claim ready, with what is done and what blocks."""
    done = [k for k, ok in [*checks.items(), *forecast.items()] if ok] + (["external_validation_available"] if external else [])
    blockers = [f"missing:{k}" for k, ok in [*checks.items(), *forecast.items()] if not ok] + ([] if external else ["missing:external_validation_available"])
    stage = all(checks.values())
    research = stage and all(forecast.values())
    return {"stage_complete": stage, "research_forecast_ready": research, "operational_claim_ready": research and external, "completed_checks": done, "blockers": blockers}
