"""Merkle manifest of a dataset: per source a tree of digests in a postorder append log, and proofs read from it.

The documents of a source, by doc_id, are the leaves of a tree in which every 16 consecutive nodes (the last run: fewer,
even one) become the digest of their hex digests; the sources' roots, by source, are the leaves of one more tree.

A builder takes an aligned block of ``16**levels`` nodes and writes each node at the moment it is complete: leaves one by
one, a parent right after its last child.  That is postorder, and as all blocks but the last are full, the log position
of any node follows from sizes of subtrees (``position``): a builder knows where its block starts without having seen
the others, and a reader knows where the siblings of a node lie.  Blocks' roots are the leaves of the next tier, a log
of its own, until a source has one root.

Scale: texts become digests inside the scan; only narrow rows are shuffled.  A leaf's number is its place in a range
partitioning plus one count per source and partition, so no source is ever gathered; a builder holds one block.  There
are as many tiers as the logarithm of the largest source to base ``16**levels``.  Proofs come down the same way: each
block gets the proof of its root, adds its own levels, and hands them to its documents.  Two numbers reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from pricebook.session import materialize

ARITY = 16
#: Levels that one builder completes; its block has ``ARITY**LEVELS`` leaves.
LEVELS = 2
PART_BITS = 33  # monotonically_increasing_id: the partition above, the row below

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[bytes]) -> bytes:
    """The digest of some digests, as hex texts one after the other."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


def height(n: int, levels: int) -> int:
    """Levels above the leaves in the log of a tier with ``n`` of them: up to the root, ``levels`` at most."""
    h = 0
    while h < levels and n > ARITY**h:
        h += 1
    return h


def position(level: int, index: int, n: int, levels: int = LEVELS) -> int:
    """Where the node ``index`` of a level stands in the postorder log of a tier with ``n`` leaves.

    Before it come the whole subtrees to its left, on every level, and what is below it.
    """
    first, end = index * ARITY**level, min((index + 1) * ARITY**level, n)
    up_to = sum(-(-end // ARITY**k) for k in range(level + 1))
    left = sum(first // ARITY**k for k in range(level + 1, height(n, levels) + 1))
    return up_to - 1 + left


def build(leaves: list[bytes], top: int) -> list[bytes]:
    """All nodes of a block in the order of their completion, up to the one of level ``top``."""
    log: list[bytes] = []
    open_runs: list[list[bytes]] = [[] for _ in range(top + 1)]

    def put(level: int, node: bytes) -> None:
        log.append(node)
        open_runs[level].append(node)
        if level < top and len(open_runs[level]) == ARITY:
            close(level)

    def close(level: int) -> None:
        run, open_runs[level] = open_runs[level], []
        put(level + 1, digest(run))

    for leaf in leaves:
        put(0, leaf)
    for level in range(top):
        if open_runs[level]:
            close(level)
    return log


def siblings(nodes: bytes, block: int, n: int, levels: int) -> list[list[tuple[str, str]]]:
    """For each leaf of a block its siblings' digests (hex) to the left and to the right, level by level, read at their log positions."""
    size, top = ARITY**levels, height(n, levels)
    base, first = position(0, block * size, n, levels), block * size
    count = min(size, n - first)
    per_level: list[list[tuple[str, str]]] = []
    for level in range(top):
        low, high = first // ARITY**level, -(-(first + count) // ARITY**level)
        at = [position(level, i, n, levels) - base for i in range(low, high)]
        texts = [nodes[32 * p : 32 * p + 32].hex() for p in at]
        sides = []
        for run in range(0, len(texts), ARITY):
            whole = "".join(texts[run : run + ARITY])
            sides += [(whole[:k], whole[k + 64 :]) for k in range(0, len(whole), 64)]
        per_level.append(sides)
    return [[sides[i // ARITY**level] for level, sides in enumerate(per_level)] for i in range(count)]


def hex_of(c: Column) -> Column:
    return F.lower(F.hex(c))


def leaf_digest(values: dict[str, Column]) -> Column:
    """sha256 of the values in their order: each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""

    def told(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(told, values.values())).cast("binary"), 256))


def _placed(rows: DataFrame, group: list[str], order: list[str], purpose: str) -> DataFrame:
    """The rows with ``place``, their number (from 0) in the order within their group; nulls come first."""
    spread = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    spread = materialize(spread.withColumn("mid", F.monotonically_increasing_id()), purpose).withColumn("part", F.shiftright("mid", PART_BITS))
    runs = spread.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("run_rows"), F.min("mid").alias("first"))
    # One row per group and partition of the order: as many as partitions, not as rows.
    before = F.sum("run_rows").over(Window.partitionBy(*group).orderBy("part")) - F.col("run_rows")
    runs = runs.select(*(F.col(g).alias(f"r_{g}") for g in group), F.col("part").alias("r_part"), "first", before.alias("base"))
    same = F.col("part") == F.col("r_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"r_{g}"))
    return spread.join(runs, same).select(*rows.columns, (F.col("base") + F.col("mid") - F.col("first")).alias("place"))


def _last(nodes: str = "nodes") -> Column:
    return F.substring(nodes, -32, 32)


def grow(nodes: DataFrame, most: int, levels: int) -> list[DataFrame]:
    """The logs of all tiers over (g, place, node, n): tier, g, block, n, position, nodes (32 bytes each) of every block.

    ``n`` is the number of nodes of the group g, ``most`` the largest n.
    """
    size = ARITY**levels

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("place").to_numpy())
        leaves = table.column("node").take(pa.array(order)).to_pylist()
        n, block = table.column("n")[0].as_py(), table.column("block")[0].as_py()
        log = build(leaves, height(n, levels))
        return pa.table({"g": table.column("g").slice(0, 1), "block": [block], "n": [n], "position": [position(0, block * size, n, levels)], "nodes": [b"".join(log)]})

    tiers = []
    while True:
        dealt = nodes.withColumn("block", F.expr(f"place div {size}"))
        log = dealt.groupBy("g", "block").applyInArrow(run, "g long, block long, n long, position long, nodes binary")
        tiers.append(materialize(log.select(F.lit(len(tiers)).alias("tier"), "g", "block", "n", "position", "nodes"), "log"))
        if most <= size:
            return tiers
        nodes = tiers[-1].filter(F.col("n") > size).select("g", F.col("block").alias("place"), _last().alias("node"), F.expr(f"(n + {size - 1}) div {size}").alias("n"))
        most = -(-most // size)


def roots(tiers: list[DataFrame], levels: int) -> DataFrame:
    """(g, root, tiers): the last node of each group's last tier."""
    ends = [t.filter(F.col("n") <= ARITY**levels).select("g", _last().alias("root"), (F.col("tier") + 1).alias("tiers")) for t in tiers]
    out = ends[0]
    for e in ends[1:]:
        out = out.union(e)
    return out


_PROOF = "array<struct<left:string,right:string>>"
_SIDES = pa.struct([("left", pa.string()), ("right", pa.string())])


def _proofs(parts: list[list[tuple[str, str]]], above: list[tuple[str, str]]) -> pa.Array:
    sides = [side for own in parts for side in (*own, *above)]
    offsets = np.concatenate([[0], np.cumsum([len(own) + len(above) for own in parts], dtype=np.int64)]).astype(np.int32)
    left, right = pa.array([s[0] for s in sides], pa.string()), pa.array([s[1] for s in sides], pa.string())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([left, right], fields=list(_SIDES)))


def _above(value) -> list[tuple[str, str]]:
    return [(p["left"], p["right"]) for p in value]


def _with_heads(tier: DataFrame, heads: DataFrame) -> DataFrame:
    h = heads.select(F.col("g").alias("h_g"), F.col("block").alias("h_block"), "proof", "ends")
    return tier.join(h, (F.col("g") == F.col("h_g")) & (F.col("block") == F.col("h_block"))).select("g", "block", "n", "nodes", "proof", "ends")


def _down(blocks: DataFrame, levels: int) -> DataFrame:
    """Proofs (g, place, proof, ends) of all leaves of blocks that carry the proof of their roots."""
    size = ARITY**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = siblings(r["nodes"], r["block"], r["n"], levels)
                place = np.arange(len(own)) + r["block"] * size
                columns = [pa.array([r["g"]] * len(own)), pa.array(place), _proofs(own, _above(r["proof"])), pa.array([r["ends"]] * len(own), pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["g", "place", "proof", "ends"])

    return blocks.mapInArrow(run, f"g long, place long, proof {_PROOF}, ends array<binary>")


def _heads(tiers: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """(g, block, proof, ends) of the blocks of the lowest tier, from those of the groups' roots: ``tops`` (g, tiers, proof, ends)."""
    heads = None
    for t in range(len(tiers) - 1, -1, -1):
        own = tops.filter(F.col("tiers") == t + 1).select("g", F.lit(0).cast("long").alias("block"), "proof", "ends")
        below = own if heads is None else own.union(_down(_with_heads(tiers[t + 1], heads), levels).select("g", F.col("place").alias("block"), "proof", "ends"))
        heads = materialize(below, "proofs")
    return heads


@dataclass
class Manifest:
    """A dataset's leaves and logs.

    leaves: g, place, n and whatever the rows carry; sources: g, source, n, subroot; ``log`` has the tiers of the sources'
    trees, ``tree`` those of the tree above them, whose only group is 0.
    """

    leaves: DataFrame
    sources: DataFrame
    log: list[DataFrame]
    tree: list[DataFrame]
    levels: int

    def proofs(self, wanted: DataFrame | None = None) -> DataFrame:
        """The rows of ``wanted`` (all columns; g and place name the leaf; all leaves by default) with proof, subroot and root.

        ``proof`` lists, from the leaf's run up to the root's, the digests left and right of the way as hex texts.  Wanted
        rows whose leaf does not exist are left out.
        """
        wanted = self.leaves if wanted is None else wanted
        levels, size = self.levels, ARITY**self.levels
        top = roots(self.tree, levels).select("g", "tiers", F.expr(f"cast(array() AS {_PROOF})").alias("proof"), F.array("root").alias("ends"))
        of_sources = _down(_with_heads(self.tree[0], _heads(self.tree, top, levels)), levels)
        of_sources = of_sources.select(F.col("place").alias("s_g"), "proof", "ends")
        subs = roots(self.log, levels)
        tops = subs.join(of_sources, F.col("g") == F.col("s_g")).select("g", "tiers", "proof", F.concat(F.array("root"), F.col("ends")).alias("ends"))
        heads = _heads(self.log, materialize(tops, "tops"), levels)

        def meet(rows: pa.Table, blocks: pa.Table) -> pa.Table:
            own, above, ends = [], [], [b"", b""]
            if blocks.num_rows:
                r = blocks.to_pylist()[0]
                every, above, ends = siblings(r["nodes"], r["block"], r["n"], levels), _above(r["proof"]), r["ends"]
                place = rows.column("place").to_numpy() - r["block"] * size
                rows = rows.filter(pa.array((place >= 0) & (place < len(every))))
                own = [every[i] for i in (rows.column("place").to_numpy() - r["block"] * size).tolist()]
            else:
                rows = rows.slice(0, 0)
            columns = [rows.column("row").combine_chunks(), _proofs(own, above), pa.array([ends[0]] * len(own), pa.binary()), pa.array([ends[1]] * len(own), pa.binary())]
            return pa.Table.from_arrays(columns, ["row", "proof", "subroot", "root"])

        rows = wanted.select(F.struct(*(wanted[c] for c in wanted.columns)).alias("row"), F.col("g"), F.expr(f"place div {size}").alias("block"), F.col("place"))
        blocks = _with_heads(self.log[0], heads)
        schema = StructType([rows.schema["row"], *StructType.fromDDL(f"proof {_PROOF}, subroot binary, root binary").fields])
        out = rows.groupBy("g", "block").cogroup(blocks.groupBy("g", "block")).applyInArrow(lambda a, b: meet(a, b), schema)
        return out.select("row.*", "proof", "subroot", "root")


def manifest(rows: DataFrame, levels: int = LEVELS) -> Manifest:
    """The manifest of rows (source, doc_id, leaf (binary), any further columns but g, place, n and tie).

    Leaves of a source ascend by doc_id, null first, those of one doc_id by their digests; the order of rows alike in
    both does not show in any digest.  Sources ascend bytewise, null first.  No rows give empty logs.
    """
    rows = materialize(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    sizes = materialize(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "sizes")
    most, many = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    sources = materialize(_placed(sizes, [], ["source"], "sources").withColumnRenamed("place", "g"), "sources")
    leaves = _placed(rows, ["source"], ["doc_id", "leaf", "tie"], "order").drop("tie")
    s = sources.select(F.col("source").alias("s_source"), "n", "g")
    leaves = materialize(leaves.join(s, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source"), "leaves")
    log = grow(leaves.select("g", "place", F.col("leaf").alias("node"), "n"), most, levels)
    subroots = roots(log, levels).select(F.col("g").alias("r_g"), F.col("root").alias("subroot"))
    sources = materialize(sources.join(subroots, F.col("g") == F.col("r_g")).drop("r_g"), "subroots")
    tree = grow(sources.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("place"), F.col("subroot").alias("node"), F.lit(many).cast("long").alias("n")), many, levels)
    return Manifest(leaves, sources, log, tree, levels)


def folded(leaf: Column, proof: Column) -> Column:
    """The root (hex) that a leaf (binary) and a proof give."""
    return F.aggregate(proof, hex_of(leaf), lambda at, p: F.sha2(F.concat(p["left"], at, p["right"]).cast("binary"), 256))
