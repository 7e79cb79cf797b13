"""Secrets in all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .base import documents, query
from .secrets import listed, scan


@query()
def op7_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = scan(documents(spark, sf).select("doc_id", "text")).select("doc_id", "secret_spans")
    spans = F.col("secret_spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"] != "entropy")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))
