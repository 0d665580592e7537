"""Joins of hourly grids, which Spark takes for as small as their list of channels: none may broadcast the grid by that estimate."""

from __future__ import annotations

import pytest

from tests.conftest import DATA
from tidelog.plans import features as plans
from tidelog.plans import registry

registry.load()


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["j10_range_join_counts", "w12_state_transitions", "d08_observability", "e02_window_status", "e03_numeric_block", "w11_maximum_gap", "w13_distinct_states", "e01_snapshot", "e05_frozen_baseline"])
def test_grid_is_merged_and_not_broadcast(spark, name):
    plan = planned(registry.QUERIES[name](spark, DATA))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_rows_of_the_linear_model_are_merged(spark, monkeypatch):
    """The join is planned before the fit; the fit itself is not needed."""
    from pyspark.ml.feature import VectorAssembler

    seen = []
    monkeypatch.setattr(VectorAssembler, "transform", lambda self, rows: seen.append(planned(rows)) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        registry.QUERIES["a16_linear_model"](spark, DATA)
    top = next(line for line in seen[0].splitlines() if "Join" in line)
    assert "SortMergeJoin" in top


def test_merged_windows_still_equal_prefix_counts(spark):
    got = plans.j10_range_join_counts(spark, DATA).select("channel_id", "t", "n")
    want = plans.j09_prefix_difference_counts(spark, DATA).select("channel_id", "t", "events_24h")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
