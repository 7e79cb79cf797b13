"""Benchmark passages in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .base import documents, query
from .decontaminate import mark

SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
i AS (SELECT DISTINCT item_id, size, array_to_string(words[pos : pos + size - 1], ' ') AS seq
      FROM (SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS pos
            FROM (SELECT item_id, words, least(len(words), 10) AS size FROM b) WHERE size > 0)),
z AS (SELECT DISTINCT size FROM i),
p AS (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS pos FROM w, z WHERE len(words) >= size),
s AS MATERIALIZED (SELECT doc_id, pos, size, array_to_string(words[pos : pos + size - 1], ' ') AS seq FROM p),
h AS MATERIALIZED (SELECT s.doc_id, s.pos, s.size, i.item_id FROM s JOIN i ON s.seq = i.seq AND s.size = i.size),
g AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(g.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(g.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN g ON w.doc_id = g.doc_id LEFT JOIN t ON w.doc_id = t.doc_id
"""


@query(SQL)
def op12_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    marked = mark(documents(spark, sf).select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet"), width=10)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return marked.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
