"""Whether a channel may be scored at an hour: tri-state status with ordered reasons, from evidence up to the hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.parse import flags
from tidelog.operators import asof

#: Reasons that speak of missing statistics only, which the relaxed admission forgives.
RELAXED = ["baseline_unusable", "state_history_missing", "state_transitions_unavailable"]


def branch_status(rows: DataFrame, discrete: bool) -> DataFrame:
    """rows with branch_status and branch_reasons of the numeric or discrete branch; reasons keep a fixed order."""
    c = F.col
    reasons = [F.when(c("sensor_type").isNull(), "sensor_type_unknown_or_conflicting"), F.when(c("baseline_status") != "eligible", "baseline_unusable"), F.when(F.array_contains("availability_reasons", "insufficient_history"), "insufficient_history"), F.when(c("excluded_quality_count_24h") > 0, "quality_exclusions_24h")]
    if discrete:
        reasons += [F.when((c("baseline_state_count") == 0) | (c("state_count_24h") == 0), "state_history_missing"), F.when(c("state_transitions_24h").isNull(), "state_transitions_unavailable"), F.when(F.array_contains("window_reasons_24h", "same_time_state_ambiguity"), "same_time_state_ambiguity")]
    else:
        reasons += [F.when((c("baseline_numeric_count") == 0) | (c("numeric_count_24h") == 0), "numeric_history_missing"), F.when(c("baseline_numeric_median").isNull() | c("baseline_numeric_mad").isNull() | c("numeric_median_24h").isNull(), "numeric_summary_unavailable")]
    gone = c("availability_status") == "excluded"
    found = F.when(gone, F.array(F.lit("all_causal_observations_excluded"))).otherwise(flags(*reasons))
    return rows.withColumn("branch_reasons", found).withColumn("branch_status", F.when(gone, "excluded").when(F.size(found) > 0, "unknown").otherwise("eligible"))


def sparse_admission(points: DataFrame, events: DataFrame, timeline: DataFrame, known_types: list[str], history_days: int = 7, normal_hours: int = 168) -> DataFrame:
    """points (channel_id, segment, t) with sensor_type, admission_status, sorted admission_reasons and the evidence behind them.

    events: channel_id, segment, ts, sensor_type, excluded, ambiguous (the instant has two states). timeline: the
    registered state after each instant. All evidence comes from as-of lookups of running aggregates;
    evidence_through is the latest time that any of it is from, never after t.
    """
    from pyspark.sql import Window

    by = ["channel_id", "segment"]
    w = Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    c, ts = F.col, F.col("ts")
    at = events.groupBy(*by, "ts").agg(F.min("sensor_type").alias("lo"), F.max("sensor_type").alias("hi"), F.bool_or(c("sensor_type").isNull()).alias("untyped"), F.bool_or(~c("excluded")).alias("usable"), F.bool_or("excluded").alias("some_out"), F.bool_or("ambiguous").alias("ambiguous"))
    counted = at.withColumn("usable_times", F.sum(c("usable").cast("long")).over(w))
    last = lambda cond: F.max(F.when(cond, ts)).over(w)
    so_far = counted.select(
        *by, "ts", "usable_times", F.min("lo").over(w).alias("lo"), F.max("hi").over(w).alias("hi"), F.min(F.when(c("usable"), ts)).over(w).alias("first_usable"), F.min(F.when(c("usable") & (c("usable_times") == 2), ts)).over(w).alias("second_usable"),
        last(c("lo").isNotNull()).alias("typed_at"), last(c("untyped")).alias("untyped_at"), last(c("some_out")).alias("excluded_at"), last(c("ambiguous")).alias("ambiguous_at"),
    )
    p = asof.asof_last(points, so_far, by, "t", "ts", "past")
    p = asof.asof_last(p, timeline.select(*by, "ts", "normal_at", "active", "uncertain", "cleared_at"), by, "t", "ts", "now")
    p = asof.trailing_sums(p, events, by, "t", "ts", {"excluded_n": F.col("excluded").cast("long"), "ambiguous_n": F.col("ambiguous").cast("long")}, [24])
    kind = F.when(F.col("past.lo") == F.col("past.hi"), F.col("past.lo"))
    empty = F.col("past").isNull()
    all_out = ~empty & F.col("past.first_usable").isNull()
    live = ~all_out
    young = (F.col("past.first_usable") > F.col("t") - F.expr(f"INTERVAL '{history_days}' DAY")) | (F.col("past.usable_times") < 2)
    active, uncertain = F.coalesce("now.active", F.lit(False)), F.coalesce("now.uncertain", F.lit(False))
    untyped = F.col("past.untyped_at").isNotNull() & F.coalesce(F.col("past.untyped_at") > F.col("now.cleared_at"), F.lit(True))
    old = F.col("now.normal_at").isNull() | (F.col("now.normal_at") < F.col("t") - F.expr(f"INTERVAL '{normal_hours}' HOUR"))
    reasons = F.array_sort(flags(
        F.when(all_out, "all_causal_observations_excluded"), F.when(live & kind.isNull(), "sensor_type_unknown_or_conflicting"), F.when(live & young, "insufficient_history"), F.when(live & (F.col("excluded_n_24h") > 0), "quality_exclusions_24h"),
        F.when(live & (F.col("ambiguous_n_24h") > 0), "same_time_state_ambiguity"), F.when(kind.isNull() | ~kind.isin(*known_types), "unknown_or_conflicting_sensor_type"), F.when(active, "registered_episode_active_at_t"),
        F.when(uncertain, "uncertain_past_registered_state"), F.when(untyped, "unknown_type_observed_since_explicit_normal"), F.when(old, "no_recent_explicit_normal_at_t"),
    ))
    reasons = F.when(empty, F.array(F.lit("no_observations_in_current_archive_segment"))).otherwise(reasons)
    status = F.when(~empty & (all_out | active), "excluded").when(F.size(reasons) > 0, "unknown").otherwise("eligible")
    through = F.greatest("past.typed_at", "now.ts", "past.untyped_at", "past.excluded_at", "past.ambiguous_at", "past.first_usable", "past.second_usable")
    seen = [F.col("past.first_usable").alias("first_usable_at"), F.col("past.second_usable").alias("second_usable_at"), F.col("past.ambiguous_at").alias("last_conflict_at"), through.alias("evidence_through")]
    return p.select(*points.columns, *seen, kind.alias("sensor_type"), status.alias("admission_status"), reasons.alias("admission_reasons"), F.col("now.normal_at").alias("last_explicit_normal_at"), F.col("excluded_n_24h").alias("excluded_quality_count_24h"), F.col("ambiguous_n_24h").alias("ambiguous_count_24h"))


def relaxed(rows: DataFrame, blocking: str = "blocking_qa_count_24h") -> DataFrame:
    """rows with the admission that forgives missing statistics and nothing else; blocking quality counts are a reason of their own."""
    left = F.array_except("admission_reasons", F.array(*[F.lit(r) for r in RELAXED]))
    left = F.array_sort(F.when(F.col(blocking) > 0, F.array_append(left, F.lit("qa_unusable_measurement_24h"))).otherwise(left))
    status = F.when(F.col("admission_status") == "excluded", "excluded").when(F.size(left) > 0, "unknown").otherwise("eligible")
    return rows.withColumns({"relaxed_reasons": F.array_sort(F.array_intersect("admission_reasons", F.array(*[F.lit(r) for r in RELAXED]))), "candidate_reasons": left, "candidate_status": status})


def reentry(rows: DataFrame, policy: str, known_types: list[str]) -> DataFrame:
    """rows with research_status and research_reasons under cold_start, after_normal or combined.

    cold_start forgives a short history once two usable times exist; after_normal forgives quality exclusions if
    all come of a conflict inside the day that a later normal has settled. Guards of type, normal, quality hold.
    """
    if policy not in ("cold_start", "after_normal", "combined"):
        raise ValueError(f"no such policy: {policy}")
    c = F.col
    day = c("t") - F.expr("INTERVAL '24' HOUR")
    recent = F.coalesce((c("last_explicit_normal_at") <= c("t")) & (c("last_explicit_normal_at") >= c("t") - F.expr("INTERVAL '168' HOUR")), F.lit(False))
    guard = (c("admission_status") != "excluded") & F.coalesce(c("sensor_type").isin(*known_types), F.lit(False)) & recent & (c("blocking_qa_count_24h") == 0) & (c("ambiguous_count_24h") == 0)
    cold = guard & F.lit(policy != "after_normal") & c("second_usable_at").isNotNull()
    settled = F.coalesce((c("last_conflict_at") > day) & (c("last_conflict_at") < c("last_explicit_normal_at")), F.lit(False))
    after = guard & F.lit(policy != "cold_start") & (c("excluded_quality_count_24h") > 0) & settled & F.coalesce(c("last_hard_quality_at") <= day, F.lit(True))
    reasons = F.filter("admission_reasons", lambda r: ~((r == "insufficient_history") & cold) & ~((r == "quality_exclusions_24h") & after))
    status = F.when(c("admission_status") == "excluded", "excluded").when(F.size(reasons) > 0, "unknown").otherwise("eligible")
    return rows.withColumn("research_reasons", reasons).withColumn("research_status", status)
