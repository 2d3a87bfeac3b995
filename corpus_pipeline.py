"""The corpus pipeline: five operators of ``linkloom.llm``, each on what the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in
the shared folder and reads it again as the next stage's docs. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm._scratch import Scratch
from linkloom.llm.decontam import drop_contaminated
from linkloom.llm.near_dedup import drop_near_duplicates
from linkloom.llm.packing import pack_documents
from linkloom.llm.surrogates import pseudonymised, surrogate_key
from linkloom.llm.toxicity import drop_toxic, fit_toxicity

def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; learns from the labelled documents whose crc32 mod 3 is not 1."""
    learn_from = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn_from=learn_from)
    return drop_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of near duplicates."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no stretch of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars is counted anew where a text changed."""
    kind = docs.schema["n_chars"].dataType
    out = pseudonymised(docs, surrogate_key(spark), entities_col="entities")
    n_chars = F.when(F.size("entities") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("surrogates", surrogates),
    ("packing", packing),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
