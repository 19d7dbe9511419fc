"""The runs of language_runs leave no token out."""

from pyspark.sql import functions as F

from loamline.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_runs_cover_every_token(spark):
    tokens = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").select("doc_id", F.size(F.split("text", " ", -1)).alias("n"))
    runs = QUERIES["language_runs"](spark, SF)
    covered = runs.groupBy("doc_id").agg(F.sum(F.col("last_pos") - F.col("first_pos") + 1).alias("n"), F.min("first_pos").alias("first"))
    assert covered.where("first = 0").select("doc_id", "n").exceptAll(tokens).count() == 0 == tokens.exceptAll(covered.select("doc_id", "n")).count()
    assert runs.where("lang is null").count() > 0
