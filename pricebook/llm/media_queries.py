"""All documents as audio streams, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricebook.session import materialize

from .base import documents, query
from .flac import from_flac, to_flac


@query()
def op3_flac(spark: SparkSession, sf: str) -> DataFrame:
    media = materialize(to_flac(documents(spark, sf)), "media")
    tail = F.substring("payload", -64, 64)
    return from_flac(media).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
