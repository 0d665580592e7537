"""Every query with SQL gives what DuckDB gives on the same tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tests.conftest import DATA
from tidelog.plans import registry

registry.load()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if v is None or v != v or str(v) in ("NaT", "<NA>") else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    rows = registry.QUERIES[name](spark, DATA).toPandas()
    assert len(rows.columns) and len(rows)
