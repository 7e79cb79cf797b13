"""Languages of all documents, learned from three quarters of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .base import documents, query
from .language import identify, train


@query()
def op8_language_profiles(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    held_out = F.coalesce(fold == 2, F.lit(False))
    prototypes = train(docs.filter(~held_out))
    told = identify(docs.select("doc_id", "text"), prototypes)
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
