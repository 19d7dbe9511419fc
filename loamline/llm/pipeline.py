"""The corpus pipeline: five stages, each applying one training-data operator.

Each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``.

What all stages do: a null text counts as empty; empty and very long texts are
taken like any other; a repeated row is judged like the first, and kept with it,
but by near-dedup; rows with a null id stay; an empty table gives no rows; other
columns pass through, whatever their names, up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import packing, quality, secrets, simhash, toxicity
from loamline.llm.base import free_heap, shared_dir, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose perplexity is outside their language's bounds.

    Texts of fewer than two words (nulls and empty ones too) and languages
    without trusted texts are accepted; a perplexity at its bound is inside.
    """
    free_heap(spark)
    return quality.keep_accepted(docs, table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are predicted toxic: a score of 0.7 or more. Empty texts get the score of their features."""
    free_heap(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of near copies (one row, if its id repeats).

    Copies are alike in 0.8 or more of their five-word shingles; rows with a null id are kept.
    """
    free_heap(spark)
    return simhash.keep_representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts by a mark; ``n_chars`` follows the new text. Overlapping spans become one mark; null texts stay null."""
    free_heap(spark)
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts with their places in sequences of 2048 tokens; an empty or null text is the end id alone, equal lengths go by doc_id."""
    free_heap(spark)
    return packing.pack(docs, end_id=0)


STAGES = [
    ("quality classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: Trained models, fingerprints and tokens cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{number}")
        docs = spark.read.parquet(f"{base}/{number}")
    return docs
