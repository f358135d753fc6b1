"""Training-text pipeline: documents of low quality go, then repeated passages, near copies and personal data; the
rest is packed into sequences.

Every stage takes the documents its predecessor kept and returns the same columns, the last one the places of the packed
tokens. Texts may change on the way (repeated passages, personal data); ``n_chars`` follows them where it exists.
Null texts count as empty. A document whose text goes whole in line dedup stays as an empty one until near dedup,
which keeps one empty document.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepane.llm import line_dedup, packing, private_data, quality_model, shingle_join
from tidepane.session import save_round, staging_path

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Documents below this quality are rejected.
LEAST_QUALITY = 0.3


def _measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(kind))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    weights = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.withColumn("__quality", quality_model.score("text", weights))
    return scored.filter(F.col("__quality") >= LEAST_QUALITY).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in an earlier place."""
    return _measured(line_dedup.without_repeats(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id.

    SimHash of five-word shingles finds copies of near fingerprints, which are checked exactly; a join by shingles adds all
    that share 0.8 of them and have fingerprints farther apart.
    """
    return shingle_join.keep_one(docs, shingle=5)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    params = private_data.train(docs)
    return _measured(docs.withColumn("text", private_data.redacted("text", params)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every document's tokens in sequences of 4096."""
    return packing.pack_documents(docs, f"{TOKENIZERS}/word_bpe_49k.json", capacity=4096, end_id=1)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("PII", private),
    ("best-fit packing", packed),
]

#: Hashes, trained models and tokens have no SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage kept is saved before the next one reads it twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = staging_path(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = save_round(stage(spark, docs, sf_dir), folder, number)
    return STAGES[-1][1](spark, docs, sf_dir)
