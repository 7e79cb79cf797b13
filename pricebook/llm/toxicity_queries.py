"""Toxicity of all documents, learned from four fifths of the labelled ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .base import documents, query
from .toxicity import fit, score


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet").filter(~held_out()).select("doc_id", "toxic")


@query()
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    scorer = fit(docs, labels(spark, sf))
    told = score(docs.select("doc_id", "text"), scorer)
    toxic = F.col("toxicity")
    return told.select("doc_id", held_out().alias("held_out"), toxic.alias("score"), (toxic >= 0.5).cast("int").alias("predicted"))
