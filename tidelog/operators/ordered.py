"""Ordered folds: state machines over rows of a key in order, for what no window expresses.

Rows are partitioned by key and sorted in the JVM; Python sees each partition as one stream of Arrow batches and
keeps the state of one key at a time, so a key may have any number of rows. A machine's state is all that a
task holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Machine(Protocol):
    def step(self, row: dict[str, Any]) -> Iterable[tuple]: ...

    def finish(self) -> Iterable[tuple]: ...


def fold(df: DataFrame, by: list[str], order: list[str], machine: Callable[[tuple], Machine], schema: str) -> DataFrame:
    """Rows that the machines of all keys give. machine: makes one from a key; its rows are tuples of schema's columns."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(out)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, rows = None, None, []
        for b in batches:
            for row in b.to_pylist():
                own = tuple(row[c] for c in by)
                if now is None or own != key:
                    if now is not None:
                        rows.extend(now.finish())
                    key, now = own, machine(own)
                rows.extend(now.step(row))
            if len(rows) >= 10_000:
                yield batch(rows)
                rows = []
        if now is not None:
            rows.extend(now.finish())
        if rows:
            yield batch(rows)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
