"""Scans of journal files and dictionaries; what a file may not contain fails the read."""

from __future__ import annotations

import subprocess
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The first record of a CSV file or folder, without a byte order mark."""
    row = spark.read.option("multiLine", True).option("escape", '"').csv(path).limit(1).first()
    names = [] if row is None else [x or "" for x in row]
    return [names[0].removeprefix("﻿"), *names[1:]] if names else []


def strict_csv(spark: SparkSession, path: str, header: list[str], most_rows: int | None = None) -> DataFrame:
    """The columns as text with source and source_row (the header is row 1); nulls become empty texts.

    A header that differs, a record of another width and bad quoting fail the read. The ordinal needs the
    records of a file in order, so a file is numbered by itself.
    """
    if most_rows is not None and most_rows <= 0:
        raise ValueError("most_rows must be positive")
    found = header_of(spark, path)
    if found != header:
        raise ValueError(f"header {found} differs from {header}")
    schema = ", ".join(f"`{c}` string" for c in header)
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("mode", "FAILFAST").option("enforceSchema", True).option("escape", '"').csv(path)
    numbered = rows.withColumn("source", F.input_file_name()).withColumn("order_", F.monotonically_increasing_id())
    numbered = numbered.withColumn("source_row", F.row_number().over(Window.partitionBy("source").orderBy("order_")) + 1).drop("order_")
    texts = numbered.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in header], "source", F.col("source_row").cast("long"))
    return texts if most_rows is None else texts.where(F.col("source_row") <= most_rows + 1)


def extract_archive(path: str, folder: str) -> str:
    """The one CSV member of a .zip or .7z archive, extracted on the driver to a staging folder; other contents fail."""
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(path) as z:
            names = [n for n in z.namelist() if n.lower().endswith(".csv")]
            if len(names) != 1 or len(z.namelist()) != 1:
                raise ValueError(f"{path} must hold exactly one .csv")
            return z.extract(names[0], folder)
    subprocess.run(["7z", "x", "-y", f"-o{folder}", path], check=True, capture_output=True)
    found = [p for p in Path(folder).rglob("*") if p.is_file()]
    if len(found) != 1 or found[0].suffix.lower() != ".csv":
        raise ValueError(f"{path} must hold exactly one .csv")
    return str(found[0])


def source_rows(spark: SparkSession, path: str, header: list[str], staging: str, most_rows: int | None = None) -> DataFrame:
    """A journal by its kind: .csv as it is, archives by extraction."""
    if path.lower().endswith((".zip", ".7z")):
        path = extract_archive(path, staging)
    return strict_csv(spark, path, header, most_rows)


def dictionary(spark: SparkSession, path: str, required: list[str], key: str) -> DataFrame:
    """A dictionary of texts: required columns, different keys; blanks become nulls."""
    found = header_of(spark, path)
    if len(set(found)) != len(found) or not set(required) <= set(found):
        raise ValueError(f"columns {found} lack some of {required} or repeat")
    rows = strict_csv(spark, path, found).drop("source", "source_row")
    clean = rows.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in found])
    if not clean.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} repeats")
    return clean


def state_dictionary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Different rows of a dictionary with the source lines of each."""
    return rows.groupBy(*columns).agg(F.array_sort(F.collect_list("source_row")).alias("lines"))


def parquet_files(spark: SparkSession, files: list[str], schema: str | None = None) -> DataFrame:
    """Stated files, by their own columns or by a stated schema; partition columns of paths are not read."""
    reader = spark.read.option("recursiveFileLookup", True)
    return (reader.schema(schema) if schema else reader).parquet(*files)


def scan(spark: SparkSession, path: str, columns: dict[str, str], channels: list[str] | None = None, start: str | None = None, end: str | None = None, at: str = "timestamp") -> DataFrame:
    """Columns of a store's parts, missing ones as nulls; channel and time filters (both ends inside) reach the files."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    if channels is not None:
        rows = rows.where(F.col("channel_id").isin(*channels))
    if start:
        rows = rows.where(F.col(at) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        rows = rows.where(F.col(at) <= F.lit(end).cast("timestamp_ntz"))
    return rows.select(*[(F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()])


#: Characters of the upper 128 bytes as ISO-8859-1 reads them, and as Windows-1251 means them.
_UPPER = bytes(b for b in range(128, 256) if b != 0x98)
_LATIN, _CYRILLIC = _UPPER.decode("iso-8859-1"), _UPPER.decode("cp1251")


def upload(spark: SparkSession, path: str) -> DataFrame:
    """A .parquet or .csv upload; a CSV is UTF-8, or else Windows-1251."""
    if path.lower().endswith(".parquet"):
        return spark.read.parquet(path)
    rows = spark.read.option("header", True).csv(path)
    odd = F.lit(False)
    for c in rows.columns:
        odd |= F.coalesce(F.contains(F.col(c), F.lit("�")), F.lit(False))
    if any("�" in c for c in rows.columns) or not rows.where(odd).isEmpty():
        latin = spark.read.option("header", True).option("encoding", "iso-8859-1").csv(path)
        rows = latin.select(*[F.translate(F.col(f"`{c}`"), _LATIN, _CYRILLIC).alias(c.translate(str.maketrans(_LATIN, _CYRILLIC))) for c in latin.columns])
    return rows.withColumnsRenamed({c: c.removeprefix("﻿") for c in rows.columns})


#: Tables of the store, in the order they are tried, and the columns that tell them.
KINDS = {"episodes": {"episode_id", "channel_id", "start_at"}, "forecasts": {"channel_id", "prediction_time"}, "events": {"channel_id", "timestamp"}, "sensors": {"channel_id"}}


def detect_kind(columns: list[str]) -> str | None:
    return next((k for k, need in KINDS.items() if need <= set(columns)), None)
