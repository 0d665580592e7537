"""Operators on small fixtures: boundaries, ties, causality, and state machines held against plain versions."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelog.functions import parse, rules, timeops
from tidelog.operators import admission, alerts, asof, detectors, episodes, features, ingest, intervals, observability, serving, smoke
from tidelog.sources import readers, sinks
from tidelog.streaming import shadow

T0 = datetime(2024, 1, 1)


def h(x: float) -> datetime:
    return T0 + timedelta(hours=x)


def random_events(seed: int, n: int = 300, channels: int = 4) -> list[tuple]:
    r = random.Random(seed)
    states = ["error", "signup", "view", "click", "purchase"]
    return [(i, f"c{r.randrange(channels)}", h(r.randrange(240)), r.choice(states), r.random()) for i in range(n)]


EVENT = "row_id long, channel_id string, ts timestamp_ntz, state string, value double"


def test_parse(spark):
    rows = spark.createDataFrame([("2024-01-02", "03:04:05", "T", "1,5"), ("2024-01-02", "03:04:05+03:00", "no", "nan"), ("2024-13-02", "x", "0", "1_000"), ("2024-01-02", "03:04", "FALSE ", "1d"), ("2024-01-02", "03:04:05.123456", "1", " text ")], "d string, t string, a string, v string")
    got = rows.select(parse.parse_local_timestamp(F.col("d"), F.col("t")).alias("t"), parse.parse_alarm(F.col("a")).alias("a"), parse.parse_numeric(F.col("v")).alias("v")).collect()
    assert [r.t.value for r in got] == [datetime(2024, 1, 2, 3, 4, 5), None, None, datetime(2024, 1, 2, 3, 4), datetime(2024, 1, 2, 3, 4, 5, 123456)]
    assert [r.t.flag for r in got] == [None, "timezone_present", "invalid_timestamp", None, None]
    assert [(r.a.value, r.a.flag) for r in got] == [(True, None), (None, "invalid_alarm"), (False, None), (False, None), (True, None)]
    assert [(r.v.value, r.v.flag) for r in got] == [(1.5, None), (None, "nonfinite_numeric"), (1000.0, None), (None, None), (None, None)]


def test_dispositions_keep_the_least_row_of_ten_thousand_copies(spark):
    rows = spark.range(10_000).select((F.col("id") + 5).alias("row_id"), F.lit("a").alias("k"), F.lit(None).cast("string").alias("z"), F.lit(False).alias("invalid"), F.lit(False).alias("repeated_header"))
    got = {r.disposition: r["count"] for r in ingest.classify(rows, ["k", "z"]).groupBy("disposition").count().collect()}
    assert got == {"accepted": 1, "exact_duplicate": 9_999}


def test_parent_chains_find_cycles_and_missing_parents(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), ("d", "a"), ("e", "gone"), ("f", None)], "object_id string, parent_object_id string")
    got = {r.root: (r.cycle, r.missing_parent) for r in ingest.parent_chains(spark, rows, 10).collect()}
    assert got["a"] == got["b"] == (True, False) and got["c"] == (True, False) and got["d"] == (False, False) and got["e"] == (False, True) and "f" not in got


def test_windows_are_open_at_the_left_and_closed_at_the_right(spark):
    points = spark.createDataFrame([("c", h(24))], "channel_id string, t timestamp_ntz")
    facts = spark.createDataFrame([("c", h(x)) for x in (0, 0.5, 18, 23, 24, 24.5)], "channel_id string, ts timestamp_ntz")
    got = asof.trailing_sums(points, facts, ["channel_id"], "t", "ts", {"n": F.lit(1)}, [1, 6, 24]).first()
    assert (got.n_1h, got.n_6h, got.n_24h) == (1, 2, 4)
    assert asof.window_rows(points, facts, ["channel_id"], "t", "ts", 24).count() == 4


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
def test_asof_in_all_directions(spark, strict, forward):
    points = [("c", h(x)) for x in (0, 1, 2, 5)]
    facts = [("c", h(x), i) for i, x in enumerate((1, 1.5, 2, 4))]
    got = asof.asof_last(spark.createDataFrame(points, "channel_id string, t timestamp_ntz"), spark.createDataFrame(facts, "channel_id string, ts timestamp_ntz, v int"), ["channel_id"], "t", "ts", "f", strict, forward)

    def want(t):
        ok = [(ts, v) for _, ts, v in facts if (ts > t if strict else ts >= t)] if forward else [(ts, v) for _, ts, v in facts if (ts < t if strict else ts <= t)]
        return (min(ok) if forward else max(ok))[1] if ok else None

    assert {r.t: r.f and r.f.v for r in got.collect()} == {t: want(t) for _, t in points}


def test_numeric_block_boundaries(spark):
    rows = spark.createDataFrame([("one", h(0), 5.0), ("flat", h(0), 2.0), ("flat", h(1), 2.0), ("tie", h(0), 1.0), ("tie", h(0), 3.0), ("tie", h(2), 6.0)], "k string, a timestamp_ntz, v double")
    got = {r.k: r for r in features.numeric_block(rows, ["k"], "v", "a").collect()}
    assert got["one"].numeric_std is None and got["one"].numeric_slope_per_hour is None and got["one"].numeric_median == 5
    assert got["flat"].numeric_mad == 0 and got["flat"].numeric_slope_per_hour == 0
    assert got["tie"].numeric_delta == 4 and got["tie"].numeric_slope_per_hour == pytest.approx(2)


def test_transitions_restart_after_an_ambiguous_instant(spark):
    rows = spark.createDataFrame([("k", h(0), "a"), ("k", h(1), "b"), ("k", h(2), "a"), ("k", h(2), "b"), ("k", h(3), "a"), ("k", h(4), "b")], "k string, a timestamp_ntz, s string")
    got = features.state_block(rows, ["k"], "s", "a").first()
    assert (got.state_transitions, got.state_distinct_count, got.ambiguous) == (2, 2, True)


def test_islands_and_union(spark):
    spans = spark.createDataFrame([("k", h(0), h(2)), ("k", h(1), h(3)), ("k", h(3), h(4)), ("k", h(6), h(7))], "k string, s timestamp_ntz, e timestamp_ntz")
    assert [r.seconds for r in intervals.union_seconds(spans, ["k"], "s", "e").collect()] == [5 * 3600]
    assert intervals.merged(spans, ["k"], "s", "e").count() == 2


def test_cooldown_edges(spark):
    rows = spark.createDataFrame([("c", h(x)) for x in (0, 23.9, 24, 47, 48)], "k string, ts timestamp_ntz")
    assert [r.emitted for r in alerts.cooldown(rows, ["k"], "ts", 24).orderBy("ts").collect()] == [True, False, True, False, True]
    assert [r.emitted for r in alerts.cooldown(rows, ["k"], "ts", 24, closed=True).orderBy("ts").collect()] == [True, False, False, True, False]


def test_an_early_false_warning_silences_a_true_one(spark):
    rows = spark.createDataFrame([("c", h(0), 9.0, 0, None, None), ("c", h(5), 9.0, 1, "e", h(6)), ("c", h(30), 9.0, 1, "f", h(31)), ("d", h(30), 9.0, 1, "f", h(31))], "channel_id string, prediction_time timestamp_ntz, rule_score double, target int, target_episode_id string, label_available_at timestamp_ntz")
    got = alerts.alert_outcomes(rows, "rule_score", 7.1)
    assert sorted(r.outcome for r in got.collect()) == ["duplicate_episode_warning", "matched_episode", "no_target_in_horizon"]
    s = alerts.alert_summary(rows, got).first()
    assert (s.truth, s.warnings, s.matched) == (2, 3, 1) and s.median_lead_hours == 1


def test_ranking_metrics_with_ties(spark):
    rows = [(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0)]
    got = alerts.ranking_metrics(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    assert got.average_precision == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert got.roc_auc == pytest.approx((0.5 + 1 + 0 + 1) / 4)


def test_greedy_matching_edges(spark):
    truths = spark.createDataFrame([("s", "t1", h(0), h(2)), ("s", "t2", h(1), h(3)), ("s", "t3", h(9), h(10))], "k string, truth_id string, start_at timestamp_ntz, until timestamp_ntz")
    warnings = spark.createDataFrame([("s", "w1", h(0)), ("s", "w2", h(3)), ("s", "w3", h(3)), ("s", "w4", h(11))], "k string, warning_id string, at timestamp_ntz")
    got = {(r.truth_id, r.warning_id) for r in alerts.match_episodes(truths, warnings, ["k"]).collect()}
    assert got == {("t1", "w1"), ("t2", "w2"), ("t3", None), (None, "w3"), (None, "w4")}


def level(values: list[float | None], blocked: set[int] = frozenset()) -> list[tuple]:
    return [("c", i, h(i), v, i in blocked) for i, v in enumerate(values)]


SHIFT = "channel_id string, row_id long, ts timestamp_ntz, value double, blocked boolean"


def test_level_shift_and_recurrence(spark):
    rows = spark.createDataFrame(level([10.0] * 12 + [20.0] * 3 + [10.0] * 5 + [20.0] * 3), SHIFT)
    assert [(r.start_at, r.confirmed_at, r.end_at) for r in detectors.level_shifts(rows).orderBy("start_at").collect()] == [(h(12), h(14), h(15)), (h(20), h(22), None)]
    first = detectors.first_level_shift(rows).first()
    assert (first.decision, first.start_at, first.confirmed_at, first.direction) == ("candidate", h(12), h(14), 1)


def test_a_single_spike_is_nothing_and_a_flag_ends_the_search(spark):
    assert detectors.first_level_shift(spark.createDataFrame(level([10.0] * 12 + [20.0, 10.0, 10.0]), SHIFT)).first().decision == "no_candidate"
    flagged = spark.createDataFrame(level([10.0] * 12 + [20.0] * 4, {13}), SHIFT)
    assert detectors.first_level_shift(flagged).first().decision == "unknown"
    assert [(r.start_at, r.end_at) for r in detectors.level_shifts(spark.createDataFrame(level([10.0] * 12 + [20.0] * 5, {13}), SHIFT)).collect()] == [(h(14), None)]


def test_bursts_and_switching(spark):
    minutes = lambda xs: [("c", i, T0 + timedelta(minutes=m), s, False) for i, (m, s) in enumerate(xs)]
    schema = "channel_id string, row_id long, ts timestamp_ntz, state string, blocked boolean"
    base = [(60 * i, s) for i, s in enumerate("abcabc")]
    burst = spark.createDataFrame(minutes([*base, (400, "a"), (401, "a"), (402, "a"), (500, "b")]), schema)
    assert [(r.kind, r.state, r.end_at) for r in detectors.discrete_patterns(burst).collect()] == [("repeated_state_burst", "a", T0 + timedelta(minutes=500))]
    switching = spark.createDataFrame(minutes([*base, *[(400 + i, "ab"[i % 2]) for i in range(5)]]), schema)
    assert [r.kind for r in detectors.discrete_patterns(switching).collect()] == ["rapid_switching"]


def test_score_hysteresis(spark):
    s = [0.9, 0.9, 0.9, 0.2, None, 0.2, 0.2, 0.2, 0.9]
    rows = spark.createDataFrame([("c", h(i), "eligible" if v is not None else "unknown", v) for i, v in enumerate(s)], "channel_id string, ts timestamp_ntz, status string, score double")
    got = episodes.score_episodes(rows, ["channel_id"]).collect()
    assert [(r.start_at, r.confirmed_at, r.end_at) for r in got] == [(h(0), h(2), h(7))]


def test_consolidation(spark):
    m = lambda x: T0 + timedelta(minutes=x)
    rows = spark.createDataFrame([("c", m(0), m(1), m(2), 0.5, ["a"], None), ("c", m(10), m(11), m(12), 0.9, ["b", "a"], None), ("c", m(100), m(101), None, None, [], None)], "channel_id string, start_at timestamp_ntz, confirmed_at timestamp_ntz, end_at timestamp_ntz, score double, evidence array<string>, recovery_at timestamp_ntz")
    got = episodes.consolidate(rows, ["channel_id"]).orderBy("start_at").collect()
    assert [(r.start_at, r.end_at, r.score, r.merged, r.evidence) for r in got] == [(m(0), m(12), 0.9, 2, ["a", "b"]), (m(100), None, None, 1, [])]


def with_effects(spark, events):
    return spark.createDataFrame(events, EVENT).withColumns({"effect": rules.effect(F.col("state")), "segment": F.lit(0)})


def test_episode_statuses(spark):
    rows = [(0, "c", h(0), "error", 0.0), (1, "c", h(1), "signup", 0.0), (2, "c", h(2), "error", 0.0), (3, "c", h(3), "view", 0.0), (4, "c", h(4), "signup", 0.0), (5, "c", h(200), "error", 0.0), (6, "c", h(201), "signup", 0.0), (6, "c", h(201), "error", 0.0)]
    got = episodes.registered_episodes(with_effects(spark, rows)).orderBy("start_at").collect()
    assert [(r.onset_status, r.end_status) for r in got] == [("left_censored", "exact_norma"), ("candidate_new_onset", "exact_norma_after_uncertainty"), ("stale_normal", "open_unknown")]


@pytest.mark.parametrize("seed", range(3))
def test_the_past_does_not_depend_on_the_future(spark, seed):
    events = random_events(seed)
    cut = h(120)
    full, past = with_effects(spark, events), with_effects(spark, [e for e in events if e[2] <= cut])
    rows = lambda df: {tuple(r) for r in episodes.state_timeline(df).where(F.col("ts") <= F.lit(cut)).collect()}
    assert rows(full) == rows(past)
    grid = spark.createDataFrame([(f"c{i}", cut) for i in range(4)], "channel_id string, t timestamp_ntz")
    counts = lambda df: {tuple(r) for r in features.window_counts(grid, df, {"n": F.lit(1)}).collect()}
    assert counts(full) == counts(past)


@pytest.mark.parametrize("seed", range(3))
def test_rows_of_one_instant_have_no_order(spark, seed):
    events = random_events(seed)
    shuffled = [(n, *e[1:]) for n, e in zip(random.Random(seed).sample(range(1000), len(events)), events, strict=True)]
    view = lambda ev: {tuple(r) for r in episodes.state_timeline(with_effects(spark, ev)).drop("first_row_id").collect()}
    assert view(events) == view(shuffled)


def test_stream_machine_sets_late_rows_apart_and_restores(spark):
    channel = shadow.Channel()
    row = lambda x, effect, i=0: {"ts": h(x), "row_id": i, "state": effect, "effect": effect, "technical": effect == "fault", "blocking": i == 9}
    tick = lambda x: {"ts": h(x), "row_id": None, "state": None, "effect": None, "technical": False, "blocking": False}
    out = channel.run("c", [row(0, "normal"), tick(1), row(0.5, "fault", 7), tick(2)])
    assert [r[2] for r in out] == ["decision", "late", "decision"] and out[2][3] == "eligible"
    assert channel.run("c", [row(3, "normal", 9), tick(4), tick(28)])[0][4] == "qa_unusable_measurement_24h" and channel.warned is None
    again = shadow.Channel(channel.dump())
    assert again.dump() == channel.dump()
    with pytest.raises(ValueError):
        shadow.Channel('{"version": 0}')


def test_silent_channels_get_decisions(spark):
    events = with_effects(spark, [(0, "a", h(0), "signup", 0.0), (1, "b", h(200), "signup", 0.0)]).withColumn("technical", F.lit(False))
    got = shadow.replay(shadow.with_ticks(events, "2024-01-02 00:00:00", "2024-01-02 05:00:00", 1)).where("kind = 'decision'")
    assert got.count() == 12 and got.where("channel_id = 'b'").select("reasons").distinct().first()[0] == "no_observations_in_current_archive_segment"


def test_relaxation_drops_three_reasons_only(spark):
    rows = spark.createDataFrame([("unknown", ["baseline_unusable", "insufficient_history"], 0), ("unknown", ["state_history_missing"], 0), ("excluded", ["state_history_missing"], 0), ("eligible", [], 2)], "admission_status string, admission_reasons array<string>, blocking_qa_count_24h int")
    assert [(r.candidate_status, r.candidate_reasons) for r in admission.relaxed(rows).collect()] == [("unknown", ["insufficient_history"]), ("eligible", []), ("excluded", []), ("unknown", ["qa_unusable_measurement_24h"])]


def test_branch_reasons_keep_their_order(spark):
    row = spark.createDataFrame([(None, "unknown", ["insufficient_history"], 1, 0, 0, None, ["same_time_state_ambiguity"], "unknown")], "sensor_type string, baseline_status string, availability_reasons array<string>, excluded_quality_count_24h int, baseline_state_count int, state_count_24h int, state_transitions_24h int, window_reasons_24h array<string>, availability_status string")
    assert admission.branch_status(row, True).first().branch_reasons == ["sensor_type_unknown_or_conflicting", "baseline_unusable", "insufficient_history", "quality_exclusions_24h", "state_history_missing", "state_transitions_unavailable", "same_time_state_ambiguity"]


def test_without_a_cadence_nothing_is_eligible(spark):
    points = spark.createDataFrame([("c", h(24))], "channel_id string, t timestamp_ntz")
    events = spark.createDataFrame([("c", h(x), False) for x in range(1, 25)], "channel_id string, ts timestamp_ntz, excluded boolean")
    assert observability.window_audit(points, events, 24, None).first().reasons == ["cadence_unknown"]
    assert observability.window_audit(points, events, 24, 3600).first().status == "include"


def test_smoke_labels_need_the_whole_window(spark):
    rows = spark.createDataFrame([("c", h(x), s, False) for x, s in ((0, "ok"), (24, "ok"), (47, "bad"), (49, "ok"))], "channel_id string, ts timestamp_ntz, state string, alarm boolean")
    line = smoke.timeline(smoke.canonical(rows), "bad", ["ok"])
    points = spark.createDataFrame([("c", h(24)), ("c", h(26))], "channel_id string, t timestamp_ntz")
    assert {r.t: r.label for r in smoke.labels_at(points, line).collect()} == {h(24): 1, h(26): -1}


def test_messages_never_follow_the_alarm_bit(spark):
    known = rules.dictionary(spark, [])
    rows = spark.createDataFrame([(t, s) for t in (rules.DOOR, None) for s in (rules.FAULT, rules.NORMAL, "x", None)], "sensor_type string, value_state string")
    got = {(r.sensor_type, r.value_state): r.e for r in rules.classify_messages(rows, known).withColumn("e", rules.registered_effect(F.col("message"), F.col("value_state"))).collect()}
    assert got[rules.DOOR, rules.FAULT] == "fault" and got[rules.DOOR, rules.NORMAL] == "normal" and got[rules.DOOR, "x"] == "uncertain" and got[rules.DOOR, None] == "neutral" and got[None, rules.FAULT] == "uncertain"


def test_splits_purge_the_horizon(spark):
    rows = spark.createDataFrame([(h(0),), (h(23),), (h(24),), (h(100),)], "t timestamp_ntz")
    s = timeops.split_of(F.col("t"), [("a", "2024-01-01 00:00:00", "2024-01-03 00:00:00")], 24)
    assert [tuple(r.s) for r in rows.select(s.alias("s")).collect()] == [("a", "assigned"), ("a", "assigned"), ("a", "purged_boundary"), (None, "outside_splits")]


def test_strict_csv(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text('﻿a,b\n1,"x\ny"\n,z\n', encoding="utf-8")
    assert [(r.a, r.b, r.source_row) for r in readers.strict_csv(spark, str(good), ["a", "b"]).collect()] == [("1", "x\ny", 2), ("", "z", 3)]
    with pytest.raises(ValueError):
        readers.strict_csv(spark, str(good), ["a", "c"])
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.strict_csv(spark, str(bad), ["a", "b"]).collect()


def test_uploads_and_kinds(spark, tmp_path):
    p = tmp_path / "u.csv"
    p.write_bytes("channel_id,name\n1,Норма\n".encode("cp1251"))
    assert readers.upload(spark, str(p)).first().name == "Норма"
    assert readers.detect_kind(["channel_id", "timestamp"]) == "events" and readers.detect_kind(["x"]) is None


def test_publication_is_whole_or_not_there(spark, tmp_path):
    path = f"file://{tmp_path}/run"
    assert sinks.published(spark, path) is None
    sinks.publish({"a": spark.range(3).toDF("id")}, path, {"version": "1"})
    assert sinks.published(spark, path) == {"rows": {"a": 3}, "version": "1"}
    assert not sinks.append_once(spark.range(9).toDF("id"), f"{path}/a", "all")


def test_upsert_prefers_incoming_ties(spark):
    a = spark.createDataFrame([(1, "old", 5), (2, "old", None)], "k int, v string, u int")
    b = spark.createDataFrame([(1, "new", 5), (2, "new", None), (3, "new", 1)], "k int, v string, u int")
    assert {r.k: r.v for r in serving.upsert(a, b, "k", "u").collect()} == {1: "new", 2: "new", 3: "new"}


def test_fingerprints_ignore_order(spark):
    a = spark.range(100)
    assert ingest.fingerprint(a, ["id"]).first() == ingest.fingerprint(a.orderBy(F.desc("id")).repartition(7), ["id"]).first()
    assert ingest.fingerprint(a, ["id"]).first() != ingest.fingerprint(a.union(a.limit(1)), ["id"]).first()
    assert tuple(ingest.compare_multisets(a, a.union(a.limit(2))).first()) == (0, 2)


def test_rule_fills_zero_and_the_pilot_does_not(spark):
    row = spark.createDataFrame([(2, None, 0, 1, "eligible", h(0), None, h(0), h(0))], "registered_fault_text_count_24h int, registered_fault_text_count_168h int, completed_episode_count_168h int, technical_message_count_24h int, status string, prediction_time timestamp_ntz, admission_reason string, history_through timestamp_ntz, admission_through timestamp_ntz").withColumn("admission_status", F.lit("eligible"))
    assert alerts.rule_score(row, "status").first().rule_score == pytest.approx(4.1)
    assert alerts.shadow_decisions(row).first().unavailable_reason == "missing_or_invalid_rule_count"


def test_readiness():
    got = serving.readiness({"a": True, "b": False}, {"c": True}, False)
    assert not got["stage_complete"] and got["blockers"] == ["missing:b", "missing:external_validation_available"]


def test_names_of_the_future_are_refused():
    assert features.guard(["a", "b"], ["a", "b", "c"]) == ["a", "b"]
    for bad in ("target_x", "future_y", "label", "z"):
        with pytest.raises(ValueError):
            features.guard(["a", bad], ["a", "b"])


def test_a_clear_recovery_reopens_the_cooldown(spark):
    d = spark.createDataFrame([("c", h(x), True, True, True) for x in (0, 5, 12, 14)], "channel_id string, at timestamp_ntz, eligible boolean, above boolean, healthy boolean")
    r = spark.createDataFrame([("c", h(7), h(9))], "channel_id string, onset timestamp_ntz, at timestamp_ntz")
    u = spark.createDataFrame([("c", h(10))], "channel_id string, at timestamp_ntz")
    reasons = lambda *a: [x.reason for x in alerts.recovery_reset(*a).orderBy("at").collect()]
    assert reasons(d, r, u.limit(0), True) == ["standard_24h_warning", "suppressed_24h", "recovered_episode_reset", "suppressed_24h"]
    assert reasons(d, r, u, True) == reasons(d, r, u.limit(0), False) == ["standard_24h_warning", "suppressed_24h", "suppressed_24h", "suppressed_24h"]


def test_availability_order(spark):
    row = spark.createDataFrame([(h(0), 0, 0, None, 0, 0, 2, "unknown", ["insufficient_baseline_events"], False, True)], "t timestamp_ntz, past_count int, usable_count int, first_usable_at timestamp_ntz, usable_times int, types int, objects int, baseline_status string, baseline_reasons array<string>, windows_eligible boolean, excluded_any boolean")
    assert features.availability(row, False).first().availability_reasons == ["no_observations_yet", "sensor_type_unknown", "object_mapping_conflict", "insufficient_history", "insufficient_baseline_events", "one_or_more_windows_unusable", "quality_exclusions_present", "cadence_unknown"]


@pytest.mark.parametrize("seed", [1, 2, 5, 77, 260919])
def test_synthetic_suite_is_found_and_controls_stay_silent(spark, seed):
    from tidelog.functions import simulation

    events, truth = simulation.suite(spark, seed)
    rows = truth.collect()
    controls, changed = {r.channel_id for r in rows if r.is_control}, {r.channel_id for r in rows if r.kind in ("level", "drift", "mixed")}
    found = {r.channel_id for r in detectors.level_shifts(events).collect()}
    assert changed <= found and not controls & found
    patterns = {(r.channel_id, r.kind) for r in detectors.discrete_patterns(events).collect()}
    assert {("burst-0", "repeated_state_burst"), ("mixed-0", "repeated_state_burst"), ("switching-0", "rapid_switching")} <= patterns and not controls & {c for c, _ in patterns}
    assert len(rows) == len({r.channel_id for r in events.select("channel_id").distinct().collect()}) and len(simulation.SCENARIOS) == 20


def test_synthetic_suite_repeats_itself(spark):
    from tidelog.functions import simulation

    events = simulation.suite(spark, 5)[0]
    assert events.exceptAll(simulation.suite(spark, 5)[0]).count() == 0 and events.exceptAll(simulation.suite(spark, 6)[0]).count() > 0
    silent = events.where("scenario_id IN ('silence', 'outage', 'export_gap')").groupBy("channel_id").count().collect()
    assert {r["count"] for r in silent} == {90} and events.where("scenario_id = 'stuck' AND value = 10.0").count() == 30