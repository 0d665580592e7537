"""A small graph goes through one task, a larger one through stars; the roots are the same."""

import pytest

from tidelog.llm import components as c

PATH = [(i, i + 1) for i in range(-40, 60)]
EDGES = PATH[::-1] + [(1000, 1000), (2000, 3000), (3000, 2000), (2000, 3000)] + [(5000, i) for i in range(5001, 5050)] + [(-(1 << 62), 1 << 62)]
ROOTS = {i: -40 for i in range(-40, 61)} | {2000: 2000, 3000: 2000} | {i: 5000 for i in range(5000, 5050)} | {-(1 << 62): -(1 << 62), 1 << 62: -(1 << 62)}


@pytest.mark.parametrize("one_task, stars", [(None, False), (150, True), (151, False)])
def test_small_graphs_need_no_rounds(spark, monkeypatch, one_task, stars):
    names, stored = [], c.stored
    monkeypatch.setattr(c, "stored", lambda df, what: names.append(what) or stored(df, what))
    d = spark.createDataFrame(EDGES, "a long, b long")
    rows = (c.components(d) if one_task is None else c.components(d, one_task)).collect()
    assert len(rows) == len(ROOTS) and {r.node: r.root for r in rows} == ROOTS
    assert ("large-star" in names) == stars


def test_no_edges(spark):
    d = spark.createDataFrame([(7, 7)], "a long, b long")
    assert c.components(d).collect() == [] == c.components(d, -1).collect()
