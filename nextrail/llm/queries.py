"""The operators applied to their whole tables, with production parameters, and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nextrail.llm import bpe, langid, lines, minhash, negatives, packing, quality, simhash, topk, toxicity, warc, whitening, wordpiece
from nextrail.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: From this score on a document counts as toxic.
TOXIC = 0.7
#: Lines found in so many documents go.
COMMON_LINE_DOCS = 10
SEQUENCE = 2048


def op1_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", topk.quantised(F.col("embedding"), 1024).alias("vector"))
    vectors = vectors.where(F.col("vector").isNotNull())
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, folder, "documents"), WORD_BPE, SEQUENCE)
    return packing.pack(pieces, SEQUENCE)


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.drop_common_lines(table(spark, folder, "documents").select("doc_id", "text"), COMMON_LINE_DOCS, 1)
    return found.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"),
    )


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, folder, "documents"), BYTE_BPE)


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, max_bits=2)


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A record that can't be read ends the query with what is wrong with it."""
    read = warc.round_trip(table(spark, folder, "pages"))
    return read.select(
        F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("page_id")).cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"))


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode(table(spark, folder, "documents"), WORD_BPE, decoded=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", topk.quantised(F.col("embedding"), 64).alias("whole"))
    return whitening.whiten(vectors.withColumn("x", F.transform("whole", lambda c: c + F.lit(1_000_000))), 32)


def op12_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.fingerprint(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id",
    )


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").select(
        "vec_id", label.alias("label"), topk.quantised(F.col("embedding"), 256).alias("vector")
    )
    return negatives.mine(vectors, 100, positives=5, negatives=10, window=(30, 100, 90))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_top_k, op2_best_fit_packing, op3_toxicity, op4_line_dedup, op5_token_counts, op6_language_id,
        op7_simhash, op8_warc, op9_quality_rules, op10_bpe, op11_whitening, op12_fingerprints, op13_hard_negatives,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_top_k": topk.ORACLE,
    "op4_line_dedup": lines.ORACLE,
    "op8_warc": warc.ORACLE,
    "op9_quality_rules": quality.oracle(),
    "op13_hard_negatives": negatives.ORACLE,
}
