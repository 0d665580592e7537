"""Causal features of channels on an hourly grid. Windows are (t - H, t]; a row at t depends on rows up to t only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.parse import flags
from tidelog.functions.timeops import ceil_hour, floor_hour, seconds_between
from tidelog.operators import asof

WINDOWS = [1, 6, 24, 168]


def hours_of(events: DataFrame, at: str = "ts") -> tuple[str, str] | None:
    """The whole hour at or before the first event, and the one at or after the last; None without events."""
    got = events.agg(F.min(floor_hour(F.col(at))).cast("string").alias("a"), F.max(ceil_hour(F.col(at))).cast("string").alias("z")).first()
    return (got.a, got.z) if got.a else None


def hourly_grid(channels: DataFrame, hours: tuple[str, str] | None, step_hours: int = 1) -> DataFrame:
    """channel_id, t: every step from the first to the last of `hours`, both included, for every channel, silent ones too."""
    if hours is None:
        return channels.select("channel_id", F.lit(None).cast("timestamp_ntz").alias("t")).limit(0)
    steps = F.expr(f"sequence(TIMESTAMP_NTZ '{hours[0]}', TIMESTAMP_NTZ '{hours[1]}', INTERVAL '{step_hours}' HOUR)")
    return channels.select("channel_id").distinct().withColumn("t", F.explode(steps))


def window_counts(grid: DataFrame, events: DataFrame, values: dict[str, Column], hours: list[int] = WINDOWS) -> DataFrame:
    """Counts of every kind in every window, at any points; events: channel_id, ts and what the values read."""
    return asof.trailing_sums(grid, events, ["channel_id"], "t", "ts", values, hours)


def hourly_counts(grid: DataFrame, events: DataFrame, values: dict[str, Column], hours: list[int] = WINDOWS) -> DataFrame:
    """The same on a grid that has every whole hour of a channel from its first event's on.

    Windows of whole hours that end at a whole hour are unions of hours (t - 1 h, t], so events are added up by
    hour before the one shuffle; a running sum less the one of `h` rows before is a window's.
    """
    names = list(values)
    cells = events.groupBy("channel_id", ceil_hour(F.col("ts")).alias("t")).agg(*[F.sum(F.coalesce(v.cast("long"), F.lit(0).cast("long"))).alias(n) for n, v in values.items()])
    both = grid.select("channel_id", "t", F.lit(True).alias("point_"), *[F.lit(0).cast("long").alias(n) for n in names]).unionByName(cells.withColumn("point_", F.lit(False)))
    order = Window.partitionBy("channel_id").orderBy("t")
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = both.select("channel_id", "t", "point_", *[F.sum(n).over(upto).alias(n) for n in names]).where("point_")
    return running.select("channel_id", "t", *[(F.col(n) - F.lag(n, h, 0).over(order)).alias(f"{n}_{h}h") for n in names for h in hours])


def numeric_block(pairs: DataFrame, by: list[str], value: str, at: str) -> DataFrame:
    """The eleven statistics of the numbers under each key: exact quantiles, MAD, deviation, slope and delta over medians by time.

    Statistics over times take the median of each time first. Deviation is null below two readings, slope and
    delta below two times.
    """
    rows = pairs.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"), F.col(at).alias("a"))
    base = rows.groupBy(*by).agg(
        F.expr("percentile(v, array(0.5, 0.25, 0.75, 0.1, 0.9))").alias("q"), F.when(F.count("v") >= 2, F.stddev_pop("v")).alias("numeric_std"), F.min("v").alias("numeric_min"), F.max("v").alias("numeric_max"), F.min("a").alias("first_a"),
    )
    spread = rows.join(base.select(*by, F.col("q")[0].alias("m")), by).groupBy(*by).agg(F.expr("percentile(abs(v - m), 0.5)").alias("numeric_mad"))
    medians = rows.groupBy(*by, "a").agg(F.expr("percentile(v, 0.5)").alias("y")).join(base.select(*by, "first_a"), by).withColumn("x", seconds_between(F.col("first_a"), F.col("a")) / 3600)
    line = medians.groupBy(*by).agg(F.when(F.count("y") >= 2, F.regr_slope("y", "x")).alias("numeric_slope_per_hour"), F.when(F.count("y") >= 2, F.max_by("y", "a") - F.min_by("y", "a")).alias("numeric_delta"))
    q = F.col("q")
    wide = base.join(spread, by).join(line, by)
    return wide.select(*by, q[0].alias("numeric_median"), "numeric_mad", (q[2] - q[1]).alias("numeric_iqr"), "numeric_std", q[3].alias("numeric_q10"), q[4].alias("numeric_q90"), "numeric_min", "numeric_max", (F.col("numeric_max") - F.col("numeric_min")).alias("numeric_range"), "numeric_delta", "numeric_slope_per_hour")


def state_block(pairs: DataFrame, by: list[str], state: str, at: str) -> DataFrame:
    """transitions, distinct states and ambiguity: a time with two states is ambiguous and breaks the chain of transitions."""
    per_time = pairs.where(F.col(state).isNotNull()).groupBy(*by, F.col(at).alias("a")).agg(F.min(state).alias("lo"), F.max(state).alias("hi"), F.collect_set(state).alias("all"))
    w = Window.partitionBy(*by).orderBy("a")
    single = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    moved = per_time.withColumn("s", single).withColumn("moved", F.coalesce(F.col("s") != F.lag("s").over(w), F.lit(False)))
    return moved.groupBy(*by).agg(F.sum(F.col("moved").cast("long")).alias("state_transitions"), F.size(F.array_distinct(F.flatten(F.collect_list("all")))).alias("state_distinct_count"), F.bool_or(F.col("lo") != F.col("hi")).alias("ambiguous"))


def maximum_gap(pairs: DataFrame, by: list[str], at: str, t: str, hours: int) -> DataFrame:
    """The longest silence in (t - hours, t], both edges counted; null without observations."""
    times = pairs.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("a")).distinct()
    w = Window.partitionBy(*by).orderBy("a")
    gaps = times.withColumn("gap", seconds_between(F.lag("a").over(w), F.col("a")))
    edge = F.greatest(F.max("gap"), seconds_between(F.col(t) - F.expr(f"INTERVAL '{hours}' HOUR"), F.min("a")), seconds_between(F.max("a"), F.col(t)))
    return gaps.groupBy(*by).agg(edge.alias("maximum_gap_seconds"))


def baseline(events: DataFrame, fits: DataFrame, lookback_hours: int, least_events: int, least_span_hours: int) -> DataFrame:
    """fits (channel_id, fit_end) with counts, median, MAD, dominant state, status and reasons over (fit_end - lookback, fit_end), open at both ends."""
    by = ["channel_id", "fit_end"]
    e = events.select("channel_id", "ts", "value", "state")
    rows = asof.window_rows(fits, e, ["channel_id"], "fit_end", "ts", lookback_hours).where("f_ts < fit_end").select(*by, F.col("f_ts").alias("ts"), F.col("f_value").alias("value"), F.col("f_state").alias("state"))
    stats = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("numeric_n"), F.count("state").alias("state_n"), F.expr("percentile(value, 0.5)").alias("median"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    mad = rows.join(stats.select(*by, F.col("median").alias("m")), by).groupBy(*by).agg(F.expr("percentile(abs(value - m), 0.5)").alias("mad"))
    states = rows.where("state IS NOT NULL").groupBy(*by, "state").count()
    dominant = states.groupBy(*by).agg(F.min(F.struct((-F.col("count")).alias("c"), "state")).alias("d")).select(*by, F.col("d.state").alias("dominant_state"))
    n = F.coalesce("n", F.lit(0))
    short = F.coalesce(seconds_between(F.col("first_at"), F.col("last_at")) < least_span_hours * 3600, F.lit(True))
    reasons = flags(F.when(n < least_events, "insufficient_baseline_events"), F.when(short, "insufficient_baseline_span"))
    wide = fits.join(stats, by, "left").join(mad, by, "left").join(dominant, by, "left")
    return wide.select(*by, n.alias("baseline_event_count"), F.coalesce("numeric_n", F.lit(0)).alias("baseline_numeric_count"), F.coalesce("state_n", F.lit(0)).alias("baseline_state_count"), F.col("median").alias("baseline_numeric_median"), F.col("mad").alias("baseline_numeric_mad"), F.col("dominant_state").alias("baseline_dominant_state"), reasons.alias("baseline_reasons"), F.when(F.size(reasons) > 0, "unknown").otherwise("eligible").alias("baseline_status"))


def window_status(hours: int, cadence_seconds: int | None, least_events: int = 3, least_coverage: float = 0.5, gap_factor: float = 3.0) -> dict[str, Column]:
    """coverage, status and ordered reasons of a window from n_usable, n_excluded, n_times, maximum_gap_seconds and ambiguous.

    Without a cadence nothing is ever eligible.
    """
    usable, excluded, times, gap = (F.col(c) for c in ("n_usable", "n_excluded", "n_times", "maximum_gap_seconds"))
    if cadence_seconds is None:
        coverage = F.lit(None).cast("double")
        tail = [F.lit("cadence_unknown")]
    else:
        expected = max(1, -(-hours * 3600 // cadence_seconds))
        coverage = F.least(F.lit(1.0), times / expected)
        tail = [F.when(times < min(least_events, expected), "insufficient_window_events"), F.when(coverage < least_coverage, "coverage_below_threshold"), F.when(gap > cadence_seconds * gap_factor, "gap_above_threshold")]
    reasons = flags(F.when(usable == 0, "no_usable_observations"), F.when(excluded > 0, "quality_exclusions_present"), F.when(F.coalesce("ambiguous", F.lit(False)), "same_time_state_ambiguity"), *tail)
    gone = (excluded > 0) & (usable == 0)
    reasons = F.when(gone, F.array_append(reasons, F.lit("all_interval_observations_excluded"))).otherwise(reasons)
    status = F.when(gone, "excluded").when(F.size(reasons) > 0, "unknown").otherwise("eligible")
    return {"coverage": coverage, "window_reasons": reasons, "window_status": status}


def burst_contrast(recent: Column, outer: Column, recent_hours: int, outer_hours: int) -> Column:
    """How far a recent count is from what the older, disjoint part of the outer window leads to expect."""
    expected = (outer - recent) * recent_hours / (outer_hours - recent_hours)
    return (recent - expected) / F.sqrt(expected + 1)


def engineered(rows: DataFrame, families: list[str], ages: list[str]) -> DataFrame:
    """log counts, disjoint log rates and recent shares between neighbouring windows, freshness of ages, counts weighed by that of the first age, shares of all events; nulls become -1."""
    extra: dict[str, Column] = {}
    pos = lambda c: F.when(F.col(c) < 0, F.lit(0)).otherwise(F.col(c))  # noqa: E731  a null stays one
    for f in families:
        for h in WINDOWS:
            extra[f"log1p__{f}_{h}h"] = F.log1p(pos(f"{f}_{h}h"))
        for a, z in zip(WINDOWS, WINDOWS[1:], strict=False):
            short, long = pos(f"{f}_{a}h"), pos(f"{f}_{z}h")
            extra[f"disjoint_log_rate__{f}_{a}v{z}h"] = F.log1p(short / a) - F.log1p(F.greatest(long - short, F.lit(0)) / (z - a))
            extra[f"recent_share__{f}_{a}v{z}h"] = short / (long + 1.0)
    for c in ages:
        hours = pos(c) / 3600.0
        extra |= {f"log1p_hours__{c}": F.log1p(hours), f"freshness24__{c}": F.exp(-hours / 24.0), f"freshness168__{c}": F.exp(-hours / 168.0)}
    if ages:
        for f in families:
            extra[f"fresh_logcount__{f}_168h"] = F.log1p(pos(f"{f}_168h")) * F.exp(-pos(ages[0]) / 3600.0 / 24.0)
    for h in WINDOWS:
        for f in families:
            if f != "event_count" and "event_count" in families:
                extra[f"per_event__{f}_{h}h"] = pos(f"{f}_{h}h") / (pos(f"event_count_{h}h") + 1.0)
    return rows.select("*", *[F.coalesce(c.cast("double"), F.lit(-1.0)).alias(n) for n, c in extra.items()])


def model_matrix(rows: DataFrame, counts: list[str]) -> DataFrame:
    """log1p of each count (0 where missing) and a missing mask beside it."""
    return rows.select("*", *[F.log1p(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"log1p__{c}") for c in counts], *[F.col(c).isNull().cast("int").alias(f"missing__{c}") for c in counts])


def robust_scaled(rows: DataFrame, by: list[str], columns: list[str], low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Columns less their median, over the spread between two quantiles, within each key; a spread of zero counts as one."""
    stats = rows.groupBy(*by).agg(*[F.expr(f"percentile({c}, array(0.5, {low}, {high}))").alias(f"q_{c}") for c in columns])
    joined = rows.join(stats, by)
    spread = lambda q: F.when(q[2] == q[1], 1.0).otherwise(q[2] - q[1])
    return joined.select(*rows.columns, *[((F.col(c) - F.col(f"q_{c}")[0]) / spread(F.col(f"q_{c}"))).alias(f"scaled_{c}") for c in columns])


def availability(rows: DataFrame, cadence_known: bool, history_hours: int = 168, least_times: int = 2) -> DataFrame:
    """rows with availability_status and ordered availability_reasons.

    rows: t, past_count, usable_count, first_usable_at, usable_times, types, objects (counts of different ones so far),
    baseline_status, baseline_reasons, windows_eligible, excluded_any. Without a known cadence nothing is eligible.
    """
    c = F.col
    young = c("first_usable_at").isNull() | (seconds_between(c("first_usable_at"), c("t")) < history_hours * 3600) | (c("usable_times") < least_times)
    head = flags(
        F.when(c("past_count") == 0, "no_observations_yet").when(c("usable_count") == 0, "all_causal_observations_excluded"), F.when(c("types") == 0, "sensor_type_unknown").when(c("types") > 1, "sensor_type_conflict"),
        F.when(c("objects") > 1, "object_mapping_conflict"), F.when(young, "insufficient_history"),
    )
    base = F.when(c("baseline_status") != "eligible", c("baseline_reasons")).otherwise(F.array().cast("array<string>"))
    tail = flags(F.when(~c("windows_eligible"), "one_or_more_windows_unusable"), F.when(c("excluded_any"), "quality_exclusions_present"), F.when(F.lit(not cadence_known), "cadence_unknown"))
    reasons = F.array_distinct(F.concat(head, base, tail))
    status = F.when((c("past_count") > 0) & (c("usable_count") == 0), "excluded").when(F.size(reasons) > 0, "unknown").otherwise("eligible")
    return rows.withColumn("availability_reasons", reasons).withColumn("availability_status", status)


def completed_history(grid: DataFrame, completed: DataFrame, hours: int = 168) -> DataFrame:
    """Episodes that ended in (t - hours, t]: count, mean duration in seconds, age of the last end. completed: channel_id, start_at, end_at."""
    spans = completed.withColumn("us", F.timestamp_diff("MICROSECOND", F.col("start_at"), F.col("end_at")))
    sums = asof.trailing_sums(grid, spans, ["channel_id"], "t", "end_at", {"n": F.lit(1), "us": F.col("us")}, [hours])
    last = asof.asof_last(sums, spans.groupBy("channel_id", "end_at").agg(F.max("start_at").alias("s")), ["channel_id"], "t", "end_at", "last")
    n = F.col(f"n_{hours}h")
    return last.select(*grid.columns, n.alias(f"completed_episode_count_{hours}h"), F.when(n > 0, F.col(f"us_{hours}h") / n / 1e6).alias("mean_duration_seconds"), seconds_between(F.col("last.end_at"), F.col("t")).alias("last_completed_episode_end_age_seconds"))


#: Names that tell of the future; no feature or decision input may have them.
FORBIDDEN, FORBIDDEN_PREFIXES = {"label", "outcome", "y"}, ("target_", "future_", "label_")


def guard(columns: list[str], allowed: list[str] | None = None) -> list[str]:
    """The columns, if none tells of the future and all are allowed."""
    bad = [c for c in columns if c in FORBIDDEN or c.startswith(FORBIDDEN_PREFIXES) or (allowed is not None and c not in allowed)]
    if bad:
        raise ValueError(f"columns not allowed as inputs: {bad}")
    return columns


def allowed(columns: list[str]) -> list[tuple[str, bool]]:
    """Each column, and whether it may be an input."""
    return [(c, c not in FORBIDDEN and not c.startswith(FORBIDDEN_PREFIXES)) for c in columns]


def project(rows: DataFrame, keys: list[str], inputs: list[str]) -> tuple[DataFrame, DataFrame]:
    """(features, diagnostics): the keys with the allowed inputs, and the keys with all else."""
    guard(inputs)
    return rows.select(*keys, *inputs), rows.select(*keys, *[c for c in rows.columns if c not in keys and c not in inputs])


def frozen_baseline(grid: DataFrame, events: DataFrame, embargo_hours: int, lookback_hours: int, least_events: int, least_span_hours: int) -> DataFrame:
    """grid rows with the baseline that their day shares: fitted up to the day's start less the embargo."""
    dated = grid.withColumn("fit_end", F.date_trunc("DAY", "t").cast("timestamp_ntz") - F.expr(f"INTERVAL '{embargo_hours}' HOUR"))
    fits = baseline(events, dated.select("channel_id", "fit_end").distinct(), lookback_hours, least_events, least_span_hours)
    return dated.hint("merge").join(fits, ["channel_id", "fit_end"])


def snapshot(grid: DataFrame, events: DataFrame, hours: list[int] = WINDOWS, cadence_seconds: int | None = None) -> DataFrame:
    """The whole block of every window for grid rows (channel_id, t): counts, eleven statistics, states, gap, coverage, status, reasons.

    events: channel_id, ts, value, state, alarm, excluded. Event and alarm counts take all rows; numbers, states
    and gaps only those that no quality flag excludes.
    """
    by, out = ["channel_id", "t"], grid.select("channel_id", "t")
    for h in hours:
        pairs = asof.window_rows(grid.select(*by), events.select("channel_id", "ts", "value", "state", "alarm", "excluded"), ["channel_id"], "t", "ts", h)
        good = pairs.where("NOT f_excluded")
        used = F.col("f_ts").isNotNull() & ~F.coalesce("f_excluded", F.lit(False))
        counts = pairs.groupBy(*by).agg(
            F.count("f_ts").alias("event_count"), F.count(F.when(F.col("f_alarm"), 1)).alias("alarm_count"), F.count(F.when(F.col("f_excluded"), 1)).alias("n_excluded"), F.count(F.when(used, 1)).alias("n_usable"),
            F.countDistinct(F.when(used, F.col("f_ts"))).alias("n_times"), F.count(F.when(used, F.col("f_value"))).alias("numeric_count"), F.count(F.when(used, F.col("f_state"))).alias("state_count"),
        )
        block = counts.join(numeric_block(good, by, "f_value", "f_ts"), by, "left").join(state_block(good, by, "f_state", "f_ts"), by, "left").join(maximum_gap(good, by, "f_ts", "t", h), by, "left")
        block = block.withColumns(window_status(h, cadence_seconds)).drop("n_usable", "n_times").withColumnRenamed("n_excluded", "excluded_quality_count")
        out = out.hint("merge").join(block.select(*by, *[F.col(c).alias(f"{c}_{h}h") for c in block.columns if c not in by]), by)
    return out
