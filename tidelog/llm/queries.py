"""The queries of this subpackage, with production parameters, and their DuckDB SQL where SQL has the operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import exact_dedup, language_id, licenses, packing, permutation_index, pii, quality, sentencepiece_lattice, simhash, token_store
from tidelog.llm.common import crc_mod, fresh_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), quality.score(docs, model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), pii.EXAMPLE_KEY)


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return permutation_index.search(vectors, vectors.where(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id"), 20)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_report(table(spark, sf_dir, "documents"), keep="max")


OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-store")
    manifest = token_store.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), True, 2)
    return token_store.read(spark, path, manifest)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_mod("doc_id", 4) == 2
    model = language_id.fit(docs, ~held_out)
    return language_id.predict(docs, model).withColumn("held_out", crc_mod("doc_id", 4) == 2).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Query] = {"op1_quality": op1_quality, "op2_simhash": op2_simhash, "op3_pii": op3_pii, "op4_permutation_index": op4_permutation_index, "op5_exact_dedup": op5_exact_dedup, "op6_token_store": op6_token_store, "op7_licenses": op7_licenses, "op8_language_id": op8_language_id, "op9_sentencepiece": op9_sentencepiece, "op10_packing": op10_packing}
SQL: dict[str, str] = {"op5_exact_dedup": OP5_SQL}
