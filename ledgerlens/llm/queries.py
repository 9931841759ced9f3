"""Registered queries of the training-data operators, over whole tables, and their oracle SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, exact_dedup, hard_negatives, jaccard_join, langid, license_scan, lm_score, merkle, packing, piece_dropout, simhash, topk,
               toxicity)
from .common import table


def op1_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_hash of the ids, and whether they decode to the text."""
    coded = piece_dropout.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id"))
    same = F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))
    return piece_dropout.decode(coded).select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"),
                                              same.alias("lossless"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``; texts of ids whose crc32 5 divides are lower-cased before their leaf is folded."""
    docs = table(spark, sf_dir, "documents")
    return merkle.merkle_manifest(docs, {"text": merkle.tampered_text(F.col("text"), F.col("doc_id"))})


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids that 7 divides move on by one (of ten) first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label=moved)


QUERIES = {
    "op1_piece_dropout": op1_piece_dropout,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_top_k": op3_top_k,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_language_id": op6_language_id,
    "op7_license_scan": op7_license_scan,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_lm_score": op10_lm_score,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_simhash": op12_simhash,
    "op13_hard_negatives": op13_hard_negatives,
}

OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

ORACLES = {
    "op2_jaccard_join": jaccard_join.ORACLE_SQL,
    "op3_top_k": topk.ORACLE_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op5_chat_format": chat.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
