"""The budget of unmatched warnings follows the channel-days of the rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from tidelog.plans import scoring


def test_budget_counts_the_channel_days(spark, monkeypatch):
    """1,000 channels over 5 days with 800 unmatched warnings: 160 per 1000 of 5,000 channel-days, 267 of 3,000."""
    start = datetime(2024, 1, 8)
    rows = [(f"c{c}", start + timedelta(days=d), 9.0 if d == 0 and c < 800 else 1.0, 0, None, None) for c in range(1000) for d in range(5)]
    frame = spark.createDataFrame(rows, "channel_id string, prediction_time timestamp_ntz, rule_score double, target int, target_episode_id long, label_available_at timestamp_ntz")
    monkeypatch.setattr(scoring, "labelled", lambda spark, sf_dir: frame)
    assert [tuple(r) for r in scoring.a05_threshold_budget(spark, "").collect()] == [(8.0, 800, 0)]
    monkeypatch.setattr(scoring, "labelled", lambda spark, sf_dir: frame.limit(0))
    assert [tuple(r) for r in scoring.a05_threshold_budget(spark, "").collect()] == [(None, None, None)]
