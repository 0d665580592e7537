"""Named queries of the engine and their DuckDB SQL.

A query is a function of (spark, sf_dir). `sql_query` registers one given as SQL with {table} in place of table
names; where the two dialects differ it takes the second text. Modules of queries register on import.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The sensor journal as the driver's tables hold it.
EVENTS = """SELECT event_id AS row_id, CAST(user_id AS VARCHAR(20)) AS channel_id, ts, value, event_type AS state,
event_type = 'error' AS alarm FROM {events}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """text with {table} for each table it reads."""
    names = dict.fromkeys(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def sql_query(name: str, spark_text: str, duck_text: str | None = None) -> None:
    spark_text, duck_text = (t.replace("{ev}", f"({EVENTS})") for t in (spark_text, duck_text or spark_text))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(spark, sf_dir, spark_text)

    query.__name__ = name
    QUERIES[name] = query
    SQL[name] = re.sub(r"\{(\w+)\}", r"\1", duck_text)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name; sql: DuckDB's, with {ev} for the journal."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = re.sub(r"\{(\w+)\}", r"\1", sql.replace("{ev}", f"({EVENTS})"))
        return f

    return add


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, channel_id, ts, value, state, alarm."""
    return run_sql(spark, sf_dir, EVENTS)


def load() -> None:
    """Import every module of queries."""
    from tidelog.plans import detection, features, ingestion, more, operations, relational, scoring, serving, streams  # noqa: F401
