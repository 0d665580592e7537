"""Fault episodes, their labels, and state machines over ordered events.

The registered state of a channel is computed set-wise, by running aggregates over one row a (channel, time);
what depends on its own earlier output (catalogues, hysteresis, consolidation) is an ordered fold.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators import asof
from tidelog.operators.ordered import fold


def collapse(events: DataFrame) -> DataFrame:
    """One row a (channel_id, segment, ts) of events with row_id, state, effect: what an unordered instant says.

    conflict: several states, or several sensor types; kind: fault, normal, neutral, uncertain or conflict.
    own_type: the instant's sensor type, among several that of its faults; null where that is not one. Events without
    a column sensor_type have one type for good.
    """
    typed = events if "sensor_type" in events.columns else events.withColumn("sensor_type", F.lit(None).cast("string"))
    kind, state, fault = F.col("sensor_type"), F.col("state"), F.col("effect") == "fault"
    several = F.coalesce(F.min(kind) != F.max(kind), F.lit(False)) | ((F.count(kind) > 0) & (F.count(kind) < F.count(F.lit(1))))
    of_faults = F.when(fault, kind)
    at = typed.groupBy("channel_id", "segment", "ts").agg(
        (F.coalesce(F.min(state) != F.max(state), F.lit(False)) | several).alias("conflict"), F.count(F.when(fault, 1)).alias("faults"), F.min(F.when(fault, F.col("row_id"))).alias("first_row_id"),
        F.min(F.when(fault, F.struct("row_id", "sensor_type")))["sensor_type"].alias("fault_type"), F.bool_and(F.col("effect") == "normal").alias("all_normal"), F.bool_or(F.col("effect") == "uncertain").alias("any_uncertain"),
        F.when(~several, F.max(kind)).when(F.min(of_faults) == F.max(of_faults), F.max(of_faults)).alias("own_type"),
    )
    said = F.when(F.col("conflict"), "conflict").when(F.col("faults") > 0, "fault").when(F.col("all_normal"), "normal").when(F.col("any_uncertain"), "uncertain").otherwise("neutral")
    return at.select("*", said.alias("kind"))


def typed_instants(events: DataFrame) -> DataFrame:
    """Instants with the channel's sensor type then, and the run of instants of one type they lie in.

    An instant without a type keeps the one before it in the segment; another type begins a run, into which
    nothing is carried.
    """
    w = Window.partitionBy("channel_id", "segment").orderBy("ts")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = collapse(events).withColumn("sensor_type", F.last("own_type", ignorenulls=True).over(upto))
    changed = (F.row_number().over(w) > 1) & ~F.col("sensor_type").eqNullSafe(F.lag("sensor_type").over(w))
    return rows.withColumn("changed", changed).withColumn("run", F.sum(F.col("changed").cast("int")).over(upto))


def state_timeline(events: DataFrame) -> DataFrame:
    """Per (channel, segment, ts): the registered state after it: normal_at, active, uncertain; adverse: whether it speaks against health; cleared_at: the last clear normal.

    A fault opens, a normal closes; conflicts and unclear texts make the state uncertain until the next normal;
    another sensor type starts afresh, and is adverse itself.
    """
    w = Window.partitionBy("channel_id", "segment", "run").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind = F.col("kind")
    last = lambda cond: F.max(F.when(cond, F.col("ts"))).over(w)
    rows = typed_instants(events).withColumns({
        "n_": last(kind == "normal"), "u_": last(kind.isin("uncertain", "conflict")), "f_": last((F.col("faults") > 0)), "clear_f_": last((kind == "fault")),
    })
    since_normal = lambda c: F.coalesce(F.col(c) > F.col("n_"), F.col(c).isNotNull() & F.col("n_").isNull())
    spoilt = F.greatest("u_", "f_")
    uncertain = since_normal("u_") & F.coalesce(F.col("clear_f_") < F.col("u_"), F.lit(True))
    return rows.select(
        "channel_id", "segment", "ts", "kind", "sensor_type", "faults", "first_row_id", F.when(F.coalesce(F.col("n_") > spoilt, F.col("n_").isNotNull()), F.col("n_")).alias("normal_at"),
        since_normal("f_").alias("active"), uncertain.alias("uncertain"), (kind.isin("fault", "uncertain", "conflict") | F.col("changed")).alias("adverse"), F.col("n_").alias("cleared_at"),
    )


def registered_episodes(events: DataFrame, recent_hours: int = 168) -> DataFrame:
    """The catalogue of episodes of events (channel_id, segment, ts, row_id, state, effect, and sensor_type if known).

    An episode is what lies between the first fault after a clear normal and the next clear normal, inside one run of
    a sensor type. onset_status: conflicted_same_timestamp, uncertain_prior_state, left_censored, candidate_new_onset or
    stale_normal; end_status: exact_norma, exact_norma_after_uncertainty, open_type_or_archive_boundary (the channel
    goes on with another type or segment) or open_unknown. No fold: islands of a running count, and one aggregate.
    """
    run = ["channel_id", "segment", "run"]
    upto = Window.partitionBy(*run).orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind, ts, fault = F.col("kind"), F.col("ts"), F.col("faults") > 0
    islands = typed_instants(events).withColumn("island", F.sum((kind == "normal").cast("int")).over(upto))
    unclear = kind.isin("conflict", "uncertain")
    sums = islands.groupBy(*run, "island").agg(
        F.min(F.when(fault, F.struct("ts", "first_row_id", "fault_type", "kind"))).alias("first"), F.max(F.when(kind == "normal", ts)).alias("normal_at"), F.sum("faults").alias("fault_count"),
        F.max(F.when(fault, ts)).alias("last_fault_at"), F.min(F.when(unclear, ts)).alias("unclear_from"), F.max(F.when(unclear, ts)).alias("unclear_to"),
    )
    place = F.struct(F.coalesce("segment", F.lit(-1)), F.col("run"))
    ended = sums.withColumn("end_at", F.lead("normal_at").over(Window.partitionBy(*run).orderBy("island"))).withColumn("goes_on", F.max(place).over(Window.partitionBy("channel_id")) > place)
    start, conflicted, before = F.col("first.ts"), F.col("first.kind") == "conflict", F.coalesce(F.col("unclear_from") < F.col("first.ts"), F.lit(False))
    recent = start <= F.col("normal_at") + F.expr(f"INTERVAL '{recent_hours}' HOUR")
    onset = F.when(conflicted, "conflicted_same_timestamp").when(before, "uncertain_prior_state").when(F.col("normal_at").isNull(), "left_censored").when(recent, "candidate_new_onset").otherwise("stale_normal")
    spoilt = F.coalesce(F.col("unclear_to") >= start, F.lit(False))
    end_status = F.when(F.col("end_at").isNotNull(), F.when(spoilt, "exact_norma_after_uncertainty").otherwise("exact_norma")).when(F.col("goes_on"), "open_type_or_archive_boundary").otherwise("open_unknown")
    iso = F.concat(F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(start, "SSSSSS") == "000000", "").otherwise(F.concat(F.lit("."), F.date_format(start, "SSSSSS"))))
    return ended.where("first IS NOT NULL").select(
        F.concat_ws(":", "channel_id", iso, F.col("first.first_row_id")).alias("episode_id"), "channel_id", "segment", F.col("first.fault_type").alias("sensor_type"), start.alias("start_at"), "end_at", onset.alias("onset_status"), end_status.alias("end_status"),
        F.when(~(conflicted | before), F.col("normal_at")).alias("prior_normal_at"), F.col("first.first_row_id").alias("first_row_id"), "last_fault_at", "fault_count", spoilt.alias("uncertain"),
    )


def registered_labels(points: DataFrame, events: DataFrame, episodes: DataFrame, observed_until: str, horizon_hours: int = 24, recent_hours: int = 168) -> DataFrame:
    """points (channel_id, segment, segment_end, t, and sensor_type if known) with target, label_status, reason, available_at, episode_id.

    Rules in order: an episode of the same type that another type or segment cut off leaves it unknown, one that is
    active excludes; no history of the same type, an uncertain state or no recent normal leave it
    unknown; a confident onset in (t, t + horizon] before anything adverse is positive and known at its onset;
    anything adverse there leaves it unknown, as do horizons that reach the end of what is observed or of the
    segment; the rest is negative and known at the horizon's end.
    """
    by = ["channel_id", "segment"]
    if "sensor_type" not in points.columns:
        columns = points.columns
        return registered_labels(points.withColumn("sensor_type", F.lit(None).cast("string")), events, episodes, observed_until, horizon_hours, recent_hours).drop("sensor_type").select(*columns, "target", "label_status", "reason", "available_at", "episode_id")
    timeline = state_timeline(events)
    onsets = episodes.where("onset_status = 'candidate_new_onset'").select(*by, "sensor_type", F.col("start_at"), "episode_id")
    p = asof.asof_last(points, timeline.select(*by, "ts", F.col("sensor_type").alias("type_now"), "normal_at", "active", "uncertain"), by, "t", "ts", "now")
    p = asof.asof_last(p, timeline.where("adverse").select(*by, "ts"), by, "t", "ts", "adverse", strict=True, forward=True)
    p = asof.asof_last(p, episodes.select(*by, "start_at", "end_at", "end_status", F.col("sensor_type").alias("of_type")), by, "t", "start_at", "prior")
    p = asof.asof_last(p, onsets, [*by, "sensor_type"], "t", "start_at", "onset", strict=True, forward=True)
    same = F.col("now.type_now").eqNullSafe(F.col("sensor_type"))
    running = F.col("prior").isNotNull() & F.col("prior.of_type").eqNullSafe(F.col("sensor_type")) & F.coalesce(F.col("prior.end_at") > F.col("t"), F.lit(True))
    until, end = F.lit(observed_until).cast("timestamp_ntz"), F.col("t") + F.expr(f"INTERVAL '{horizon_hours}' HOUR")
    onset_at = F.when((F.col("onset.start_at") <= end) & (F.col("onset.start_at") < until), F.col("onset.start_at"))
    recent = F.coalesce(F.col("t") <= F.col("now.normal_at") + F.expr(f"INTERVAL '{recent_hours}' HOUR"), F.lit(False))
    adverse = F.col("adverse.ts")
    positive = onset_at.isNotNull() & (adverse.isNull() | (adverse >= onset_at))

    def label(target: int | None, status: str, reason: str, available: Column, episode: Column) -> Column:
        return F.struct(F.lit(target).cast("int").alias("target"), F.lit(status).alias("label_status"), F.lit(reason).alias("reason"), available.cast("timestamp_ntz").alias("available_at"), episode.cast("string").alias("episode_id"))

    none = F.lit(None)
    out = (
        F.when(running & (F.col("prior.end_status") == "open_type_or_archive_boundary"), label(None, "unknown", "unresolved_type_or_archive_boundary", none, none))
        .when(running, label(None, "excluded", "registered_episode_active_at_t", none, none))
        .when(F.col("now").isNull() | ~same, label(None, "unknown", "no_verified_same_type_history", none, none))
        .when(F.col("now.active"), label(None, "excluded", "registered_episode_active_at_t", none, none))
        .when(F.col("now.uncertain"), label(None, "unknown", "uncertain_state_at_t", none, none))
        .when(~recent, label(None, "unknown", "no_recent_explicit_normal_at_t", none, none))
        .when(positive, label(1, "positive", "new_confident_registered_onset", onset_at, F.col("onset.episode_id")))
        .when(adverse <= end, label(None, "unknown", "future_state_or_onset_uncertain", none, none))
        .when(end >= until, label(None, "unknown", "future_events_not_loaded", none, none))
        .when(end >= F.col("segment_end"), label(None, "unknown", "future_archive_window_incomplete", none, none))
        .otherwise(label(0, "negative", "no_registered_onset_in_assumed_complete_archive", end, none))
    )
    return p.withColumn("l_", out).select(*points.columns, "l_.*")


def onset_labels(points: DataFrame, episodes: DataFrame, observed: DataFrame, horizon_hours: int) -> DataFrame:
    """Generic onset label of points (channel_id, t): 1 onset in (t, t + horizon], 0 observed without, -1 not decidable.

    observed: channel_id, start_at, end_at, status; the whole horizon must lie in one 'include' span (its end may
    be the horizon's end) and touch no 'unknown' span. A point inside an episode, or with an unconfirmed onset ahead, is -1.
    """
    by = ["channel_id"]
    base = points.withColumn("h_", F.col("t") + F.expr(f"INTERVAL '{horizon_hours}' HOUR"))
    end = F.coalesce("end_at", F.lit("9999-12-31").cast("timestamp_ntz"))
    found = episodes.select("channel_id", "start_at", end.alias("until"), "confirmed")
    spans = observed.select("channel_id", "start_at", F.col("end_at").alias("until"), "status")
    p = asof.running_max(base, spans.where("status = 'include'"), by, "t", "start_at", "until", "seen_")
    p = asof.running_max(p, spans.where("status = 'unknown'"), by, "h_", "start_at", "until", "unclear_")
    p = asof.running_max(p, found, by, "t", "start_at", "until", "ongoing_")
    for name, which in (("onset_", F.col("confirmed")), ("unconfirmed_", ~F.col("confirmed"))):
        p = asof.asof_last(p, found.where(which).select("channel_id", "start_at"), by, "t", "start_at", name, strict=True, forward=True)
    is_ = lambda c: F.coalesce(c, F.lit(False))
    seen, unclear, ongoing = is_(F.col("seen_") >= F.col("h_")), is_(F.col("unclear_") >= F.col("t")), is_(F.col("ongoing_") > F.col("t"))
    onset, unconfirmed = (is_(F.col(f"{c}.start_at") <= F.col("h_")) for c in ("onset_", "unconfirmed_"))
    return p.select(*points.columns, F.when(~seen | unclear | ongoing, -1).when(onset, 1).when(unconfirmed, -1).otherwise(0).alias("label"))


class _Hysteresis:
    """Score episodes: in after `confirm` high scores in a row, out after `recover` low ones; gaps and unknown rows break runs."""

    def __init__(self, key: tuple, enter: float, recovery: float, confirm: int, recover: int, gap: timedelta):
        self.key, self.enter, self.recovery, self.confirm, self.recover, self.gap = key, enter, recovery, confirm, recover, gap
        self.before: datetime | None = None
        self.high: list[tuple[datetime, float]] = []
        self.low: list[datetime] = []
        self.now: dict | None = None

    def _row(self, end: datetime | None, began: datetime | None) -> tuple:
        a = self.now
        return (*self.key, a["start"], a["confirmed"], end, began, a["peak"], a["peak_at"], a["n"])

    def step(self, r: dict) -> Iterable[tuple]:
        at = r["ts"]
        broken = self.before is not None and at - self.before > self.gap
        self.before = at
        if r["status"] != "eligible" or r["score"] is None:
            self.high, self.low = [], []
            return []
        s = r["score"]
        if self.now is None:
            if broken:
                self.high = []
            self.high = [*self.high, (at, s)] if s >= self.enter else []
            if len(self.high) >= self.confirm:
                peak_at, peak = max(self.high, key=lambda x: x[1])
                self.now = {"start": self.high[-self.confirm][0], "confirmed": at, "peak": peak, "peak_at": peak_at, "n": len(self.high)}
                self.high, self.low = [], []
            return []
        self.now["n"] += 1
        if s > self.now["peak"]:
            self.now["peak"], self.now["peak_at"] = s, at
        if broken:
            self.low = []
        self.low = [*self.low, at] if s <= self.recovery else []
        if len(self.low) < self.recover:
            return []
        out = [self._row(at, self.low[-self.recover])]
        self.now, self.low = None, []
        return out

    def finish(self) -> Iterable[tuple]:
        return [self._row(None, None)] if self.now else []


def score_episodes(scores: DataFrame, by: list[str], enter: float = 0.8, recovery: float = 0.4, confirm: int = 3, recover: int = 3, gap_hours: float = 2) -> DataFrame:
    """scores: by (strings), ts, status, score."""
    keys = ", ".join(f"{c} string" for c in by)
    schema = f"{keys}, start_at timestamp_ntz, confirmed_at timestamp_ntz, end_at timestamp_ntz, recovery_started_at timestamp_ntz, peak_score double, peak_at timestamp_ntz, observations long"
    return fold(scores.select(*by, "ts", "status", "score"), by, ["ts"], lambda key: _Hysteresis(key, enter, recovery, confirm, recover, timedelta(hours=gap_hours)), schema)


class _Consolidation:
    """Merges close detections of one cause, closes them at a recovery, and drops those soon after an ended one."""

    def __init__(self, key: tuple, merge: timedelta, quiet: timedelta):
        self.key, self.merge, self.quiet = key, merge, quiet
        self.now: dict | None = None
        self.ended: datetime | None = None

    def _emit(self) -> list[tuple]:
        a, self.now = self.now, None
        end, evidence = a["end_at"], a["evidence"]
        if a["recovery_at"] is not None and a["recovery_at"] >= a["confirmed_at"]:
            end, evidence = a["recovery_at"], list(dict.fromkeys([*evidence, "recovery_observed"]))
        if self.ended is not None and a["start_at"] <= self.ended + self.quiet:
            return []
        self.ended = end
        return [(*self.key, a["start_at"], a["confirmed_at"], end, a["score"], a["n"], evidence)]

    def step(self, r: dict) -> Iterable[tuple]:
        r = r | {"n": 1, "evidence": r["evidence"] or []}
        a = self.now
        if a is not None and r["start_at"] - (a["end_at"] or a["confirmed_at"]) <= self.merge:
            open_end = a["end_at"] is None or r["end_at"] is None
            scores = [x for x in (a["score"], r["score"]) if x is not None]
            a |= {"end_at": None if open_end else max(a["end_at"], r["end_at"]), "confirmed_at": min(a["confirmed_at"], r["confirmed_at"]), "score": max(scores, default=None), "n": a["n"] + 1, "evidence": list(dict.fromkeys([*a["evidence"], *r["evidence"]]))}
            return []
        out = self._emit() if a is not None else []
        self.now = r
        return out

    def finish(self) -> Iterable[tuple]:
        return self._emit() if self.now else []


def consolidate(detections: DataFrame, by: list[str], merge_minutes: int = 15, quiet_minutes: int = 10) -> DataFrame:
    """detections: by (strings), start_at, confirmed_at, end_at, score, evidence, recovery_at (of the channel, or null)."""
    keys = ", ".join(f"{c} string" for c in by)
    schema = f"{keys}, start_at timestamp_ntz, confirmed_at timestamp_ntz, end_at timestamp_ntz, score double, merged long, evidence array<string>"
    columns = [*by, "start_at", "confirmed_at", "end_at", "score", "evidence", "recovery_at"]
    return fold(detections.select(*columns), by, ["start_at", "confirmed_at"], lambda key: _Consolidation(key, timedelta(minutes=merge_minutes), timedelta(minutes=quiet_minutes)), schema)
