"""Hourly grids from the data, windows on them, points with null columns, and spans against plain versions."""

from __future__ import annotations

import random
from datetime import timedelta

from pyspark.sql import functions as F

from tests.test_operators import EVENT, h, random_events
from tidelog.operators import asof, episodes, features

POINT = "channel_id string, t timestamp_ntz"


def test_hours_come_from_the_events(spark):
    ev = spark.createDataFrame([(1, "a", h(0.5), "x", 0.0), (2, "b", h(3), "x", 0.0)], EVENT)
    assert features.hours_of(ev) == ("2024-01-01 00:00:00", "2024-01-01 03:00:00")
    assert sorted((r.channel_id, r.t) for r in features.hourly_grid(ev, features.hours_of(ev)).collect()) == [(c, h(x)) for c in "ab" for x in range(4)]
    nothing = ev.limit(0)
    assert features.hours_of(nothing) is None and features.hourly_grid(nothing, None).count() == 0


def test_hourly_counts_equal_trailing_sums(spark):
    r = random.Random(3)
    ev = spark.createDataFrame([(i, f"c{r.randrange(3)}", h(r.choice([r.randrange(200), r.random() * 200])), r.choice("xy"), 1.0) for i in range(300)], EVENT)
    grid = features.hourly_grid(ev, features.hours_of(ev))
    values = {"n": F.lit(1), "x": (F.col("state") == "x").cast("long")}
    want = {tuple(r) for r in features.window_counts(grid, ev, values).select("channel_id", "t", *[f"{n}_{w}h" for n in values for w in features.WINDOWS]).collect()}
    assert {tuple(r) for r in features.hourly_counts(grid, ev, values).collect()} == want and len(want) == grid.count()


def test_points_with_null_columns_come_out_once(spark):
    points = spark.createDataFrame([("c", h(5), None), ("c", h(50), None), ("c", h(5), "note"), (None, h(5), None)], "channel_id string, t timestamp_ntz, note string")
    facts = spark.createDataFrame([("c", h(4)), ("c", h(4.5))], "channel_id string, ts timestamp_ntz")
    got = asof.window_rows(points, facts, ["channel_id"], "t", "ts", 6)
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r.channel_id, r.t, r.note, r.f_ts) for r in got.collect()), key=key) == sorted([("c", h(5), n, h(x)) for n in (None, "note") for x in (4, 4.5)] + [("c", h(50), None, None), (None, h(5), None, None)], key=key)


def test_onset_labels_equal_a_plain_version(spark):
    r = random.Random(5)
    points = [(f"c{c}", h(x)) for c in range(3) for x in range(0, 120, 3)]
    found = [(f"c{r.randrange(3)}", h(s := r.randrange(0, 120)), None if r.random() < 0.1 else h(s + r.randint(1, 9)), r.random() < 0.7) for _ in range(25)]
    seen = [(f"c{r.randrange(3)}", h(s := r.randrange(0, 90)), h(s + r.randint(5, 60)), r.choice(["include", "include", "unknown"])) for _ in range(14)]

    def label(c, t):
        end = t + timedelta(hours=12)
        if not any(k == c and s <= t and e >= end for k, s, e, how in seen if how == "include") or any(k == c and s <= end and e >= t for k, s, e, how in seen if how == "unknown"):
            return -1
        mine = [(s, ok) for k, s, e, ok in found if k == c and s <= end and (e is None or e > t)]
        if any(s <= t for s, _ in mine):
            return -1
        return 1 if any(ok for _, ok in mine) else -1 if mine else 0

    span = "channel_id string, start_at timestamp_ntz, end_at timestamp_ntz"
    got = episodes.onset_labels(spark.createDataFrame(points, POINT), spark.createDataFrame(found, f"{span}, confirmed boolean"), spark.createDataFrame(seen, f"{span}, status string"), 12)
    assert {(x.channel_id, x.t): x.label for x in got.collect()} == {(c, t): label(c, t) for c, t in points}


TYPED = "row_id long, channel_id string, ts timestamp_ntz, state string, sensor_type string, effect string"


def catalogue(spark, *events, segment=0):
    """events: (hours, effect, sensor type)."""
    rows = [(i, "c", h(x), effect, kind, effect) for i, (x, effect, kind) in enumerate(events)]
    return spark.createDataFrame(rows, TYPED).withColumn("segment", F.lit(segment))


def test_a_change_of_type_cuts_an_episode_and_carries_nothing(spark):
    ev = catalogue(spark, (0, "normal", "smoke"), (1, "fault", "smoke"), (2, "normal", "heat"), (3, "fault", "heat"))
    got = [(r.start_at, r.end_at, r.onset_status, r.end_status, r.sensor_type) for r in episodes.registered_episodes(ev).orderBy("start_at").collect()]
    assert got == [(h(1), None, "candidate_new_onset", "open_type_or_archive_boundary", "smoke"), (h(3), None, "candidate_new_onset", "open_unknown", "heat")]
    ev = catalogue(spark, (0, "normal", "smoke"), (1, "fault", "heat"))
    assert [r.onset_status for r in episodes.registered_episodes(ev).collect()] == ["left_censored"]


def test_a_missing_type_is_unclear_but_no_change(spark):
    ev = catalogue(spark, (0, "normal", "smoke"), (1, "uncertain", None), (2, "fault", "smoke"), (3, "uncertain", None), (4, "normal", "smoke"))
    got = episodes.registered_episodes(ev).first()
    assert (got.onset_status, got.end_status, got.end_at, got.prior_normal_at) == ("uncertain_prior_state", "exact_norma_after_uncertainty", h(4), None)
    both = catalogue(spark, (0, "normal", "smoke"), (1, "fault", "smoke"), (1, "fault", "heat"))
    got = episodes.registered_episodes(both).first()
    assert (got.onset_status, got.fault_count) == ("conflicted_same_timestamp", 2)


def test_labels_ask_for_a_history_of_the_same_type(spark):
    ev = catalogue(spark, (0, "normal", "smoke"), (2, "fault", "smoke"), (3, "normal", "smoke"), (30, "fault", "smoke"), (31, "normal", "heat"))
    points = spark.createDataFrame([("c", h(x), kind) for x, kind in ((1, "smoke"), (1, "heat"), (2, "smoke"), (4, "smoke"), (32, "smoke"), (32, "heat"))], "channel_id string, t timestamp_ntz, sensor_type string")
    points = points.withColumns({"segment": F.lit(0), "segment_end": F.lit("2025-01-01").cast("timestamp_ntz")})
    got = episodes.registered_labels(points, ev, episodes.registered_episodes(ev), "2024-12-01 00:00:00")
    assert {(r.t, r.sensor_type): (r.target, r.reason) for r in got.collect()} == {
        (h(1), "smoke"): (1, "new_confident_registered_onset"), (h(1), "heat"): (None, "no_verified_same_type_history"), (h(2), "smoke"): (None, "registered_episode_active_at_t"),
        (h(4), "smoke"): (0, "no_registered_onset_in_assumed_complete_archive"), (h(32), "smoke"): (None, "unresolved_type_or_archive_boundary"), (h(32), "heat"): (0, "no_registered_onset_in_assumed_complete_archive"),
    }


def test_random_journals_still_have_episodes(spark):
    ev = spark.createDataFrame(random_events(4), EVENT).withColumns({"segment": F.lit(0), "effect": F.when(F.col("state") == "error", "fault").when(F.col("state") == "signup", "normal").otherwise("neutral")})
    got = episodes.registered_episodes(ev)
    assert got.count() > 10 and got.where("end_at <= start_at").count() == 0 and got.select("episode_id").distinct().count() == got.count()


def test_copies_with_null_keys_are_copies(spark):
    from tidelog.operators import ingest

    rows = [(7, "a", None), (3, "a", None), (5, None, "a"), (9, None, None), (11, None, None), (13, "a", "")]
    df = spark.createDataFrame(rows, "row_id long, k string, z string").withColumns({"invalid": F.col("row_id") == 5, "repeated_header": F.lit(False)})
    got = {r.row_id: (r.disposition, r.first_row_id) for r in ingest.classify(df, ["k", "z"]).collect()}
    assert got == {3: ("accepted", 3), 7: ("exact_duplicate", 3), 5: ("quarantine", 5), 9: ("accepted", 9), 11: ("exact_duplicate", 9), 13: ("accepted", 13)}
    parts = ingest.classify_parts(df, 3, ["k", "z"])
    assert {r.row_id: (r.disposition, r.first_row_id) for r in parts.collect()} == got
