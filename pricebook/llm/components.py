"""Connected components of a link table: blocks of links contracted in tasks, then large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pricebook.session import materialize

#: Links that a task contracts at once.
BLOCK = 500_000


def _contracted(edges: DataFrame, blocks: int) -> DataFrame:
    """Links of each block replaced by stars: every vertex of a block's component with its smallest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(v: int) -> int:
            top = v
            while (up := root.setdefault(top, top)) != top:
                top = up
            while root[v] != top:
                root[v], v = top, root[v]
            return top

        def stars() -> pa.RecordBatch:
            made = np.array([(find(v), v) for v in list(root)], np.int64).reshape(-1, 2)
            made = made[made[:, 0] != made[:, 1]]
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], ["a", "b"])

        seen = 0
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
            seen += batch.num_rows
            if seen >= 2 * BLOCK:
                yield stars()
                seen = 0
        yield stars()

    return edges.repartition(blocks).mapInArrow(run, "a long, b long")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(v, root) of every vertex of the links (a, b), root being the smallest vertex that it is linked with.

    Links are dealt to blocks of bounded size, and a task puts stars in place of its block's links; where there is one
    block only, these are the components.  With more, each step joins edges with the least neighbour of a vertex, an
    aggregate that combines before the shuffle, until nothing changes.  No vertex's neighbours are gathered; between
    steps the edges are a written table, and two numbers reach the driver.
    """
    edges = links.filter("a <> b").select("a", "b")
    blocks = edges.count() // BLOCK + 1
    edges = materialize(_contracted(edges, blocks), "edges")
    mark = None
    while blocks > 1:
        # Large star: neighbours above a vertex are tied to the least vertex near it.
        both = edges.union(edges.select("b", "a"))
        # Written first: a plain join of two tables is one that Spark can split at the centre of a large star.
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        edges = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # Small star: neighbours below a vertex, and itself, are tied to the least of them.
        edges = materialize(edges, "edges")
        least = materialize(edges.groupBy("b").agg(F.min("a").alias("m")), "least")
        tied = edges.join(least, "b")
        edges = tied.select(F.col("m").alias("x"), F.col("a").alias("y")).union(least.select(F.col("m").alias("x"), F.col("b").alias("y")))
        edges = edges.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = materialize(edges, "edges")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("v"), F.col("a").alias("root"))
    return roots.union(edges.select(F.col("a").alias("v"), F.col("a").alias("root")).distinct())
