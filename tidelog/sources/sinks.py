"""Writes: months, append-only parts, publication by manifest, all through Spark's own writers."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that the cluster shares; one of our own only where all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidelog-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, what: str) -> DataFrame:
    """rows, written to the shared folder and read from there: what several readers need is made once."""
    path = work_path(rows.sparkSession, what)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_months(rows: DataFrame, path: str, at: str, order: list[str], files_per_month: int = 1) -> None:
    """Parquet by year and month, each file in the order given.

    A month is dealt by a hash over files_per_month files; one gives the order over the whole month, more keep a
    month of any size from becoming one task.
    """
    dated = rows.withColumns({"year": F.year(at), "month": F.month(at)})
    salt = F.pmod(F.xxhash64(order[0]), F.lit(files_per_month))
    dated.repartition("year", "month", salt).sortWithinPartitions("year", "month", *order).write.option("compression", "zstd").partitionBy("year", "month").parquet(path)


def _file(spark: SparkSession, path: str):
    """The path and its store, whatever store it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, store = _file(spark, path)
    return bool(store.exists(p))


def part_exists(spark: SparkSession, path: str) -> bool:
    """Whether a complete write stands at the path."""
    return exists(spark, f"{path}/_SUCCESS")


def append_once(rows: DataFrame, path: str, part: str) -> bool:
    """Write rows as the named part of a store; a part that is complete already is left alone and False returned.

    A failed attempt leaves no _SUCCESS and is overwritten by the next.
    """
    target = f"{path}/part={part}"
    if part_exists(rows.sparkSession, target):
        return False
    rows.write.mode("overwrite").parquet(target)
    return True


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def publish(tables: dict[str, DataFrame], path: str, facts: dict) -> dict:
    """Tables under one path that appears at once, with a manifest of their rows.

    They are written beside it, to path.inprogress; tables that an interrupted attempt has completed are kept. What
    is published already stays as it is.
    """
    spark = next(iter(tables.values())).sparkSession
    done = recover(spark, path)
    if done is not None:
        return done
    staging, rows = f"{path}.inprogress", {}
    for name, df in tables.items():
        append_once(df, f"{staging}/{name}", "all")
        rows[name] = spark.read.parquet(f"{staging}/{name}").count()
    save_json(spark, f"{staging}/manifest.json", facts | {"rows": rows})
    return recover(spark, path)


def recover(spark: SparkSession, path: str) -> dict | None:
    """Ends a publication that has its manifest, removes what one that ended left over; the manifest, or None if there is none yet."""
    staging, target = f"{path}.inprogress", _file(spark, path)
    if not exists(spark, path) and exists(spark, f"{staging}/manifest.json"):
        target[1].rename(_file(spark, staging)[0], target[0])
    if exists(spark, path):
        target[1].delete(_file(spark, staging)[0], True)
    return published(spark, path)


def published(spark: SparkSession, path: str) -> dict | None:
    """The manifest, or nothing where publication has not ended."""
    return load_json(spark, f"{path}/manifest.json")


def save_json(spark: SparkSession, path: str, content: dict) -> None:
    """A small file that is there whole or as it was: written beside its place, then renamed over it."""
    (p, store), (beside, _) = _file(spark, path), _file(spark, f"{path}.{uuid.uuid4().hex}")
    out = store.create(beside, True)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, p, over)


def load_json(spark: SparkSession, path: str) -> dict | None:
    p, store = _file(spark, path)
    return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())) if store.exists(p) else None


def append_run(spark: SparkSession, run: str, store: str, name: str) -> bool:
    """The output of a run, read again by its parts, as one part of a store; a run that is there already is left alone."""
    return append_once(read_parts(spark, run).drop("part"), store, name)


def json_rows(texts: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of JSON texts by a stated schema; missing fields are nulls, and a text that is no JSON is a row of nulls."""
    return texts.select(F.from_json(column, schema).alias("r")).select("r.*")


def with_provenance(clean: DataFrame, facts: dict[str, str]) -> DataFrame:
    """Clean rows with constant provenance columns."""
    return clean.select("*", *[F.lit(v).alias(k) for k, v in facts.items()])
