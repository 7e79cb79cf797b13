"""The manifest of all documents, and an audit of rows that were tampered with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .base import documents, query
from .crc import CRC32_TABLE, crc32_sql
from .merkle import FIELDS, folded, hex_of, leaf_digest, manifest
from .spelling import LOWER, UPPER


def _told(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _levels(name: str, start: str, up: int) -> str:
    """Common tables: the nodes of each level of the trees (g, i, n, h), and the digests beside each node (l, r)."""
    out = [f"{name}0 AS MATERIALIZED ({start})"]
    for k in range(up):
        out.append(
            f"{name}{k}_sides AS (SELECT g, i, coalesce(string_agg(h, '') OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(h, '') OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE n > 1 WINDOW o AS (PARTITION BY g, i // 16 ORDER BY i))"
        )
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, i // 16 AS i, (n + 15) // 16 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k} WHERE n > 1 GROUP BY g, i // 16, n)")
    ends = " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE n = 1" for k in range(up + 1))
    return ",\n".join([*out, f"{name}_roots AS ({ends})"])


def _fold(name: str, start: str, levels: str, up: int) -> str:
    """Common tables that carry (g, i, digest, proof) of each document up the levels."""
    out = [f"{name}0 AS ({start})"]
    for k in range(up):
        out.append(
            f"{name}{k + 1} AS (SELECT f.* REPLACE (f.i // 16 AS i, CASE WHEN s.l IS NULL THEN f.digest ELSE sha256(s.l || f.digest || s.r) END AS digest, f.proof || coalesce(s.l || s.r, '') AS proof) "
            f"FROM {name}{k} f LEFT JOIN {levels}{k}_sides s ON f.g = s.g AND f.i = s.i)"
        )
    return ",\n".join(out)


UP = 8  # 16**8 leaves a source, and as many sources
SQL = f"""
WITH {CRC32_TABLE},
v AS (
  SELECT doc_id, source, lang, n_chars, text, CASE WHEN {crc32_sql("encode(doc_id::VARCHAR)")} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS other
  FROM documents, crc_table),
x AS (
  SELECT doc_id, source, sha256({" || ".join(map(_told, FIELDS))}) AS leaf, sha256({" || ".join(map(_told, (*FIELDS[:-1], "other")))}) AS claim FROM v),
p AS MATERIALIZED (
  SELECT doc_id, leaf, claim, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM x),
{_levels("n", "SELECT g, i, n, leaf AS h FROM p", UP)},
{_levels("m", "SELECT 0 AS g, g AS i, count(*) OVER () AS n, h FROM n_roots", UP)},
{_fold("f", "SELECT doc_id, leaf, g, g AS source_g, i, claim AS digest, '' AS proof FROM p", "n", UP)},
{_fold("e", f"SELECT doc_id, leaf, source_g, 0 AS g, source_g AS i, digest, proof FROM f{UP}", "m", UP)}
SELECT e.doc_id, e.leaf, n_roots.h AS subroot, m_roots.h AS root, sha256(e.proof) AS proof_sha256, e.digest AS folded_root, e.digest = m_roots.h AS verified
FROM e{UP} e JOIN n_roots ON e.source_g = n_roots.g, m_roots
"""


@query(SQL)
def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    values = {c: F.col(c) for c in FIELDS}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = {**values, "text": F.translate("text", UPPER, LOWER)}
    leaf = leaf_digest(values)
    rows = docs.select("source", "doc_id", leaf.alias("leaf"), F.when(tampered, leaf_digest(other)).otherwise(leaf).alias("claim"))
    proofs = manifest(rows).proofs()
    proof = F.array_join(F.transform("proof", lambda p: F.concat(p["left"], p["right"])), "")
    out = proofs.select(
        "doc_id",
        hex_of(F.col("leaf")).alias("leaf"),
        hex_of(F.col("subroot")).alias("subroot"),
        hex_of(F.col("root")).alias("root"),
        F.sha2(proof, 256).alias("proof_sha256"),
        folded(F.col("claim"), F.col("proof")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
