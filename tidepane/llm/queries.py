"""The registered queries of this package; each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepane.llm import (
    bpe,
    conversation_repair,
    hard_negatives,
    line_dedup,
    packing,
    piece_bpe,
    private_data,
    quality_model,
    quality_rules,
    secret_scan,
    simhash,
    syncmers,
    token_counts,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Folder of the public vocabulary files; every executor has it at the same place.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


@query("op1_bpe_round_trip")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text decoded from them, as digests."""
    path = f"{TOKENIZERS}/word_bpe_49k.json"
    both = documents(spark, sf_dir, "doc_id", bpe.round_trip("text", path).alias("both"))
    return both.select(
        "doc_id",
        (F.octet_length("both.ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("both.ids", 256).alias("ids_sha256"),
        F.sha2(F.col("both.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text, and whether it exceeds 512 tokens."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    counted = token_counts.with_token_counts(docs, f"{TOKENIZERS}/byte_bpe_50k.json", limit=512)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op3_simhash_components")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every text and the component it is linked into."""
    linked = simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), shingle=3)
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_quality_scores")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text by a model that has seen no held-out label."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    weights = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select(
        "doc_id", quality_model.held_out().alias("held_out"), quality_model.score("text", weights).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op9_packed_sequences")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document's tokens in sequences of 4096."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    return packing.pack_documents(docs, f"{TOKENIZERS}/word_bpe_49k.json", capacity=4096, end_id=1)


@query("op6_line_dedup", line_dedup.ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the passages that stand in an earlier place already."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    return line_dedup.without_repeats(docs, removed="n_removed")


@query("op10_quality_rules", quality_rules.ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures of every text and whether its host's verdict keeps it."""
    judged = quality_rules.judge(documents(spark, sf_dir, "doc_id", "text", "source"))
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


@query("op4_secret_scan", secret_scan.ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: counts and a digest of the base spans, and all spans."""
    found = secret_scan.with_secrets(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "secrets")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    base = secret_scan.joined(F.filter("secrets", lambda s: s["rank"] < 3))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined(F.col("secrets")).alias("spans"),
    )


@query("op8_syncmer_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness."""
    rows = syncmers.fingerprints(documents(spark, sf_dir, "doc_id", "text"))
    rows = syncmers.with_likeness(rows, "sketch", "edited_sketch", "near_edited")
    rows = syncmers.with_likeness(rows, "sketch", "next_sketch", "near_next")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        syncmers.as_text("sketch").alias("fingerprint"),
        syncmers.as_text("edited_sketch").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query("op2_private_data")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: counts and a digest of the base spans, and all spans."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = docs.select("doc_id", private_data.private_spans("text", private_data.train(docs)).alias("spans"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["rank"] == k))).cast("bigint")
    kinds = F.array(*[F.lit(k) for k in private_data.KINDS])
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = joined(F.filter("spans", lambda s: s["base"]))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(private_data.KINDS)],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query("op11_piece_round_trip")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text under the merge-type model and the text decoded from them, as digests."""
    both = piece_bpe.round_trip("text", f"{TOKENIZERS}/piece_bpe_32k.model").alias("both")
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", both).select(
        "doc_id",
        (F.octet_length("both.ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("both.ids", 256).alias("ids_sha256"),
        F.sha2(F.col("both.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op12_hard_negatives", hard_negatives.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of other labels just below every anchor's positives."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = hard_negatives.whole_numbers(rows).withColumn("label", moved)
    return hard_negatives.mine(whole, F.col("vec_id") % 100 == 0, vector="embedding")


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cost and audit of the cheapest repair of every damaged conversation, and a digest of the repaired one."""
    rows = conversation_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_repair.with_digests(rows, conversation_repair.audits(rows))
