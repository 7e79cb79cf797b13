"""Token files and packing over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .base import documents, query, tokenizer
from .packing import pack
from .wavelet import read_tokens, write_tokens


@query()
def op2_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = write_tokens(documents(spark, sf), tokenizer())
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op6_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = pack(documents(spark, sf), tokenizer(), size=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
