"""The Merkle manifest against a plain tree."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pricebook.llm import merkle as m

from .data import ODD, ODD_IDS, frame


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def told(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain(leaves: list[str]) -> tuple[str, list[str]]:
    """Root and each leaf's siblings, level by level, of hex digests."""
    proofs = ["" for _ in leaves]
    at, nodes = list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // 16 * 16
            proofs[k] += "".join(nodes[j] for j in range(run, min(run + 16, len(nodes))) if j != i)
            at[k] = i // 16
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], proofs


def plain_manifest(rows):
    """doc_id, source, leaf, subroot, root, proof of rows (doc_id, source, leaf)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    out, subs = [], []
    for s in order:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        sub, proofs = plain([r[2] for r in own])
        subs.append(sub)
        out += [(r, sub, p, len(subs) - 1) for r, p in zip(own, proofs, strict=True)]
    root, tops = plain(subs) if subs else ("", [])
    return sorted((str(r[0]), str(r[1]), r[2], sub, root, p + tops[k]) for r, sub, p, k in out)


def answer(rows):
    proof = F.array_join(F.transform("proof", lambda p: F.concat(p["left"], p["right"])), "")
    got = rows.select("doc_id", "source", *(m.hex_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")), proof.alias("proof"), m.folded(F.col("leaf"), F.col("proof")).alias("folded")).collect()
    assert all(r.folded == r.root for r in got)
    return sorted((str(r.doc_id), str(r.source), r.leaf, r.subroot, r.root, r.proof) for r in got)


def test_positions_are_those_of_a_postorder():
    for n in (1, 2, 15, 16, 17, 33, 256, 257, 300, 5000):
        for levels in (1, 2, 3):
            size, top = 16**levels, m.height(n, levels)
            log = []
            for block in range(0, n, size):
                names = [bytes([1]) + i.to_bytes(31, "big") for i in range(block, min(block + size, n))]
                log += m.build(names, top)
            count = [-(-n // 16**k) for k in range(top + 1)]
            level = [names for names in range(n)]
            nodes = {(0, i): bytes([1]) + i.to_bytes(31, "big") for i in level}
            for k in range(top):
                for i in range(count[k + 1]):
                    nodes[k + 1, i] = m.digest([nodes[k, j] for j in range(16 * i, min(16 * i + 16, count[k]))])
            assert len(log) == sum(count)
            for (k, i), node in nodes.items():
                assert log[m.position(k, i, n, levels)] == node


@pytest.mark.parametrize("levels", [1, 2])
def test_trees_of_many_sizes(spark, levels):
    """One-leaf, full and ragged trees, several tiers, more sources than a run, and a null one."""
    sizes = {None: 3, "a": 1, "b": 16, "c": 17, "é": 256, "Z": 257, "z": 700, "": 2} | {f"s{k}": 1 for k in range(14)}
    rows = [(i, s, sha(f"{s}:{i}")) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, hex string").select("doc_id", "source", F.unhex("hex").alias("leaf")).repartition(5)
    assert answer(m.manifest(df, levels).proofs()) == plain_manifest(rows)


def test_log_holds_every_node_once(spark):
    rows = [(i, "a", sha(str(i))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, hex string").select("doc_id", "source", F.unhex("hex").alias("leaf"))
    made = m.manifest(df, 2)
    low = sorted((r.position, r.nodes) for r in made.log[0].collect())
    assert [p for p, _ in low] == [0, 273, 546]  # 256 + 16 + 1 nodes of a full block
    log = b"".join(nodes for _, nodes in low)
    leaves = [bytes.fromhex(r[2]) for r in rows]
    assert [log[32 * m.position(0, i, 600) :][:32] for i in range(600)] == leaves
    assert len(log) // 32 == 600 + 38 + 3


def test_nulls_ties_and_repeated_rows(spark):
    texts = [*ODD, "same", "same", None, "ABC é", "same"]
    ids = [*ODD_IDS, 50, 50, None, 5, 51]
    docs = frame(spark, texts, ids=ids)
    values = {c: F.col(c) for c in m.FIELDS}
    df = docs.select("source", "doc_id", m.leaf_digest(values).alias("leaf"), F.col("text"), F.col("v"), F.lit(1).alias("block"), F.lit("x").alias("row"))
    rows = []
    for r in docs.collect():
        rows.append((r.doc_id, r.source, sha("".join(told(r[c]) for c in m.FIELDS))))
    made = m.manifest(df)
    got = made.proofs()
    assert {"text", "v", "block", "row"} <= set(got.columns)
    assert answer(got) == plain_manifest(rows)
    # A changed leaf folds to another root; an unknown place is left out.
    some = made.leaves.filter("doc_id = 50").withColumn("leaf", F.unhex(F.sha2(F.lit("other").cast("binary"), 256)))
    wrong = made.proofs(some).select(m.folded(F.col("leaf"), F.col("proof")).alias("f"), m.hex_of(F.col("root")).alias("r")).collect()
    assert len(wrong) == 2 and all(r.f != r.r for r in wrong)
    assert made.proofs(made.leaves.limit(3).withColumn("place", F.lit(10**6))).count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, leaf binary")
    made = m.manifest(df)
    assert made.sources.count() == 0 and made.proofs().collect() == []


def test_query_on_a_fixture(spark, tmp_path):
    from pricebook.llm.merkle_queries import op11_merkle_manifest

    texts = [t or "" for t in ODD[:7]] + ["UPPER", "lower", None, "Ünï UP"] * 10
    docs = frame(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*m.FIELDS).collect()]
    want = plain_manifest([(r[0], r[1], sha("".join(map(told, r)))) for r in rows])
    got = {r.doc_id: r for r in op11_merkle_manifest(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for doc, _, leaf, sub, root, proof in want:
        r = got[int(doc)]
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (leaf, sub, root, sha(proof))
        text = texts[int(doc)]
        touched = zlib.crc32(doc.encode()) % 5 == 0 and text is not None and any("A" <= c <= "Z" for c in text)
        assert r.verified == (r.folded_root == root) == (not touched)
