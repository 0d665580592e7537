"""Short-horizon features and labels of state sensors, by segments of known, gapless observation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.timeops import seconds_between
from tidelog.operators import asof

AMBIGUOUS = "__ambiguous__"


def canonical(events: DataFrame) -> DataFrame:
    """One row a (channel_id, ts): the state, or ambiguous where several stand at one time; the alarm if any has it."""
    return events.groupBy("channel_id", "ts").agg(F.when(F.min("state") == F.max("state"), F.min("state")).otherwise(AMBIGUOUS).alias("state"), F.max("alarm").alias("alarm"))


def timeline(rows: DataFrame, fault: str, nonfault: list[str], most_gap_hours: int = 24) -> DataFrame:
    """canonical rows with known, gap, segment, onset, changed. A segment ends at a long gap and at unknown states, before and after."""
    w = Window.partitionBy("channel_id").orderBy("ts")
    known = F.col("state").isin(fault, *nonfault)
    t = rows.withColumns({"known": known, "healthy": F.col("state").isin(*nonfault), "fault": F.col("state") == fault, "gap": seconds_between(F.lag("ts").over(w), F.col("ts")) / 3600})
    broken = F.coalesce(F.col("gap") > most_gap_hours, F.lit(True)) | ~F.col("known") | ~F.coalesce(F.lag("known").over(w), F.lit(False))
    t = t.withColumn("broken", broken)
    onset = F.col("fault") & F.coalesce(F.lag("healthy").over(w), F.lit(False)) & ~F.col("broken")
    changed = F.coalesce(F.col("state") != F.lag("state").over(w), F.lit(True))
    t = t.withColumns({"segment": F.sum(F.col("broken").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "onset": onset, "changed": changed})
    end = Window.partitionBy("channel_id", "segment")
    last = lambda c: F.max(F.when(F.col(c), F.col("ts"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumns({"observed_until": F.max("ts").over(end), "changed_at": last("changed"), "fault_at": last("fault"), "first_at": F.min("ts").over(Window.partitionBy("channel_id"))})


def features_at(points: DataFrame, line: DataFrame, most_gap_hours: int = 24, history_hours: int = 24) -> DataFrame:
    """Features of the points (channel_id, t) that are healthy, fresh and have history; sums over 1, 24 and 168 h."""
    now = asof.asof_last(points, line.select("channel_id", "ts", "state", "alarm", "healthy", "changed_at", "fault_at", "first_at", "gap"), ["channel_id"], "t", "ts", "now")
    hours = lambda c: seconds_between(F.col(f"now.{c}"), F.col("t")) / 3600
    fit = now.where(F.col("now.healthy") & (hours("ts") <= most_gap_hours) & (hours("first_at") >= history_hours))
    base = fit.select(*points.columns, F.col("now.state").alias("current_state"), F.col("now.alarm").alias("current_alarm"), hours("ts").alias("hours_since_event"), hours("changed_at").alias("hours_since_state_change"), hours("first_at").alias("history_hours"), F.coalesce(hours("fault_at"), F.lit(-1.0)).alias("hours_since_fault"), F.sin(2 * F.pi() * F.hour("t") / 24).alias("hour_sin"), F.cos(2 * F.pi() * F.hour("t") / 24).alias("hour_cos"))
    signals = {"events": F.lit(1), "alarms": F.col("alarm").cast("long"), "faults": F.col("fault").cast("long"), "onsets": F.col("onset").cast("long"), "unknown": (~F.col("known")).cast("long"), "conflicts": (F.col("state") == AMBIGUOUS).cast("long"), "transitions": F.col("changed").cast("long")}
    wide = asof.trailing_sums(base, line, ["channel_id"], "t", "ts", signals, [1, 24, 168])
    shares = {f"{a}_share_{h}h": F.col(f"{n}_{h}h") / F.greatest(F.col(f"events_{h}h"), F.lit(1)) for h in (1, 24, 168) for a, n in (("alarm", "alarms"), ("unknown", "unknown"))}
    return wide.withColumns(shares)


def labels_at(points: DataFrame, line: DataFrame, horizon_hours: int = 24, most_gap_hours: int = 24) -> DataFrame:
    """points with label 1, 0 or -1 and reason: both classes need a whole observed horizon in the segment of t."""
    p = asof.asof_last(points, line.select("channel_id", "ts", "healthy", "segment", "observed_until"), ["channel_id"], "t", "ts", "now")
    p = asof.asof_last(p, line.where("onset").select("channel_id", "ts", "segment"), ["channel_id"], "t", "ts", "next", strict=True, forward=True)
    end = F.col("t") + F.expr(f"INTERVAL '{horizon_hours}' HOUR")
    whole = F.coalesce(F.col("now.healthy") & (seconds_between(F.col("now.ts"), F.col("t")) <= most_gap_hours * 3600) & (end <= F.col("now.observed_until")), F.lit(False))
    hit = whole & F.coalesce((F.col("next.segment") == F.col("now.segment")) & (F.col("next.ts") <= end), F.lit(False))
    return p.select(*points.columns, F.when(hit, 1).when(whole, 0).otherwise(-1).alias("label"), F.when(hit, "observed_onset").when(whole, "observed_24h_no_onset").otherwise("censored").alias("label_reason"), F.when(hit, F.col("next.ts")).alias("next_onset"))


def status_at(channels: DataFrame, line: DataFrame, as_of: str, most_gap_hours: int = 24, history_hours: int = 24) -> DataFrame:
    """Each channel's serving status at a time: already_faulty, unknown_state, stale_observation, insufficient_history or scored."""
    at = F.lit(as_of).cast("timestamp_ntz")
    now = line.where(F.col("ts") <= at).groupBy("channel_id").agg(F.max_by(F.struct("ts", "state", "fault", "healthy", "first_at"), "ts").alias("n"))
    age = seconds_between(F.col("n.ts"), at) / 3600
    status = F.when(F.col("n.fault"), "already_faulty").when(~F.col("n.healthy"), "unknown_state").when(age > most_gap_hours, "stale_observation").when(seconds_between(F.col("n.first_at"), at) < history_hours * 3600, "insufficient_history").otherwise("scored")
    return channels.join(now, "channel_id").select("channel_id", status.alias("status"), F.col("n.state").alias("last_state"), age.alias("hours_since_event"))
