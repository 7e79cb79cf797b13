"""Spelling variants of all words of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricebook.session import materialize

from .base import documents, query
from .crc import CRC32_TABLE, crc32_sql
from .spelling import variants, word_counts

SQL = rf"""
WITH RECURSIVE {CRC32_TABLE},
r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run
  FROM documents),
d AS (SELECT doc_id, run, count(*) AS c, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS bytes FROM r GROUP BY doc_id, run HAVING length(run) >= 7),
h AS (SELECT run, c, {crc32_sql("bytes")} AS h FROM d, crc_table),
t AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, c FROM h),
w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM t WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
o AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM o a JOIN o b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT o.word, w.word, w.n FROM o JOIN w ON o.less = w.word
  UNION SELECT w.word, o.word, o.n FROM o JOIN w ON o.less = w.word),
b AS (SELECT word, count(*) AS n_near, min({{'less': -other_n, 'other': other}}) AS best FROM p GROUP BY word),
f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
         CASE WHEN -b.best.less >= 10 * w.n THEN b.best.other END AS form, (CASE WHEN -b.best.less >= 10 * w.n THEN -b.best.less END)::BIGINT AS form_n
  FROM w LEFT JOIN b ON w.word = b.word),
c AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT c.word, c.next, f.form FROM c JOIN f ON c.next = f.word)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM f JOIN c ON f.word = c.word AND c.next IS NULL
"""


@query(SQL)
def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    words = materialize(word_counts(documents(spark, sf), least_length=7, least_count=2, every=31), "words")
    return variants(words, times=10).select("word", "form", "root", "n", "n_near", "form_n")
