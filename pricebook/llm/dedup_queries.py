"""Repeated passages and near copies over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .base import documents, query
from .near import near_groups
from .substrings import remove_repeats

REPEATS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
n AS (SELECT doc_id, words, len(words)::BIGINT AS n FROM w),
p AS (SELECT doc_id, words, unnest(range(1, n - 11)) AS pos FROM n WHERE n >= 13),
s AS (SELECT doc_id, pos, array_to_string(words[pos : pos + 12], ' ') AS seq FROM p),
m AS (SELECT seq, min(doc_id) AS least FROM s GROUP BY seq HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT s.doc_id, s.pos + o.o AS pos FROM s JOIN m ON s.seq = m.seq AND m.least < s.doc_id, range(13) AS o(o)),
e AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, n + 1)) AS pos FROM n WHERE n > 0),
k AS (
  SELECT e.doc_id, count(g.pos) AS n_removed, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN e.word END, ' ' ORDER BY e.pos), '') AS kept
  FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id)
SELECT n.doc_id, n.n AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM n LEFT JOIN k ON n.doc_id = k.doc_id
"""


@query(REPEATS)
def op4_repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    kept = remove_repeats(documents(spark, sf), width=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op10_near_copies(spark: SparkSession, sf: str) -> DataFrame:
    return near_groups(documents(spark, sf), width=4, percent=85)
