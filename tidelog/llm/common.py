"""What the operators of this subpackage share: tables, shared storage, row packing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A folder of our own is made only where that is unset and all tasks run on this machine, as in tests; on a
    cluster that is an error, as executors would write to disks of their own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        ours = spark.sparkContext.getCheckpointDir()
        if ours is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            ours = "file://" + tempfile.mkdtemp(prefix="tidelog-")
            spark.sparkContext.setCheckpointDir(ours)
        where = ours
    return where.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again: only what came of them, stored in its turn, is needed."""
    for df in tables:
        jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the text 'null'."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("null")).cast("binary")), F.lit(modulus))
