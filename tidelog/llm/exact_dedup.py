"""Exact dedup: group by a 128-bit content hash, keep one stable id a group, compare bytes inside groups.

Only DataFrame functions. The texts themselves are a grouping key beside their hash, so bytes are compared by
the aggregation, and texts of one hash that differ stay apart. Copies meet in each map task before anything
is shuffled, so a text that a third of all rows share costs one row a task. Rows find their group again by
hash and SHA-256, without their text; that join carries no text and splits when one hash is hot.

Defined results: a null text counts as the empty text; empty texts are equal to each other; a null id is
kept only if a group has no other; rows that repeat both id and text are one document (the report gives each,
with the same values; `deduplicate` leaves one of them). Empty tables give empty results. Other columns
are carried by `deduplicate`, whatever their names, and are ignored by the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text))


def _hashed(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(text.alias("t"), F.col("doc_id").alias("id"), *more).withColumn("h", content_hash(F.col("t")))


def exact_groups(docs: DataFrame, keep: str = "min") -> DataFrame:
    """One row per different text: h, sha, keep_id, group_size. keep: 'min' or 'max', which id stays."""
    pick = {"min": F.min, "max": F.max}[keep]
    return _hashed(docs).groupBy("h", "t").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).select("h", F.sha2("t", 256).alias("sha"), "keep_id", "group_size")


def exact_report(docs: DataFrame, keep: str = "min") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _hashed(docs).select("id", "h", F.sha2("t", 256).alias("sha"))
    return rows.join(exact_groups(docs, keep), ["h", "sha"]).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def deduplicate(docs: DataFrame, keep: str = "min") -> DataFrame:
    """docs with one row per different text, all columns as they were; of rows with one id, the least by their other columns."""
    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(F.col("text").isNull().alias("no_text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    known = F.col("id").isNotNull() if keep == "max" else F.col("id").isNull()
    order = F.struct(known, F.col("id"), F.to_json(F.col("rest")))
    pick = F.max_by if keep == "max" else F.min_by
    got = _hashed(docs, rest.alias("rest")).groupBy("h", "t").agg(pick(F.col("rest"), order).alias("rest"))
    back = {c: F.col(f"rest.c{i}") for i, c in enumerate(others)} | {"text": F.when(~F.col("rest.no_text"), F.col("t"))}
    return got.select(*[back[c].alias(c) for c in docs.columns])
