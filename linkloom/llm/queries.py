"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import pack_documents
from .sharding import shard_documents
from .topk import exact_top_k

from .substring_dedup import remove_repeated_words

from .suffix_dedup import remove_repeated_bytes

from .near_dedup import near_duplicate_classes

from .decontam import contaminated
from .decontam import oracle_sql as _decontam_sql

from .surrogates import pseudonymised, surrogate_key

from .toxicity import THRESHOLD, fit_toxicity, score_toxicity

from .hmm import hmm_scores


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(_read(spark, sf_dir, "documents"), n_shards=24)
    return out.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


def op7_histogram_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    out = exact_top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5, scale=256)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), max_tokens=4096, end_id=1)
    return out.withColumnRenamed("id", "doc_id")


def op8_level_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_words(_read(spark, sf_dir, "documents"), size=50)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(_read(spark, sf_dir, "documents"), size=100)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicate_classes(_read(spark, sf_dir, "documents"), threshold=0.8, size=5)
    return out.select(F.col("id").alias("doc_id"), "class_id", "class_size")


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "item_id", "start", "matched", "best_window")


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymised(_read(spark, sf_dir, "documents"), key=surrogate_key(spark))
    return out.select("doc_id", "text", F.size("entities").alias("n_entities"), F.array_distinct("entities.type").alias("types"))


def op5_compression_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, remainder = _read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = fit_toxicity(docs, _read(spark, sf_dir, "labels"), learn_from=remainder != 1)
    out = score_toxicity(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", (remainder == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_windows", "n_hits")


def op3_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    return hmm_scores(_read(spark, sf_dir, "documents"), train).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op3_hidden_markov, op5_compression_distance, op1_surrogates, op10_spaced_seeds, op4_weighted_minhash, op6_prefix_free_parsing, op8_level_doubling, op2_virtual_slots, op7_histogram_top_k, op9_best_two_fit)}

ORACLES = {
    "op10_spaced_seeds": _decontam_sql(),
    "op7_histogram_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x : CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i : q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5
""",
}
