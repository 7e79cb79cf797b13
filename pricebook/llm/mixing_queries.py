"""The mix of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .base import documents, query
from .mixing import mix_plan

SQL = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (
  SELECT source, source_size, 3 * source_size AS most,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM g),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY most::DOUBLE / weight, source IS NULL, source)),
t AS (SELECT source, source_size, least(most::DOUBLE, weight * max(level) OVER ()) AS target FROM l),
p AS (
  SELECT doc_id, source, size,
         row_number() OVER (PARTITION BY source ORDER BY size, md5('mix:' || coalesce(doc_id::VARCHAR, '')), doc_id) AS place FROM s),
c AS (
  SELECT p.doc_id, p.size, t.source_size, t.target, p.place,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix-offset:' || coalesce(p.source, '')), 1, 4))::INTEGER / 65536.0::DOUBLE AS u
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate * place + u) - floor(rate * (place - 1) + u)) * size)::BIGINT AS taken FROM c
"""


@query(SQL)
def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    plan = mix_plan(documents(spark, sf)).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
