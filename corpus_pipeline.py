"""A training-data pipeline over ``documents``: filter, de-duplicate, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next one's documents; all but the last keep the documents' columns.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import exact_dedup, jaccard_join, langid, packing, toxicity
from ledgerlens.llm.common import table
from ledgerlens.session import stored

# A document whose best language has a smaller pooled probability is no clear text of any learned language.
MIN_LANGUAGE_SCORE = 0.25
# Near copies: words of a shingle, and the Jaccard similarity from which documents link, as a fraction.
NEAR_SHINGLE, NEAR_NUM, NEAR_DEN = 5, 80, 100


def _whole_rows(docs: DataFrame) -> DataFrame:
    """Rows as one struct beside the text, so that added columns clash with none of theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the tagger, trained on the labelled ones outside the held-out fold, predicts toxic."""
    tagger = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.tag(_whole_rows(docs), tagger, keep=["row"], spans=False).where("predicted = 0").select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language the network can't tell.

    Without any labelled document to learn from, only texts without a letter go.
    """
    net = langid.train(langid.training_sample(docs))
    rows = _whole_rows(docs)
    if not net.langs:
        return rows.where(F.col("text").rlike(r"\p{L}")).select("row.*")
    known = langid.predict(rows, net, keep=["row"])
    return known.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, shingle=NEAR_SHINGLE, num=NEAR_NUM, den=NEAR_DEN)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("packing", packing_stage),
]

# The trained stages have no SQL form; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
