"""Quality of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .base import documents, query
from .quality import judge


@query()
def op9_robust_outliers(spark: SparkSession, sf: str) -> DataFrame:
    told = judge(documents(spark, sf))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
