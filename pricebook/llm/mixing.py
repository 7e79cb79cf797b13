"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words: its share by weight of all words, never more than ``cap`` times its own,
the excess going to the others by weight.  Within a source every document has the same expected number of copies
(target / own words).  In order of size these expectations are summed up, one random offset is added, and a document
is emitted once for each whole number that the sum crosses at it.  Ordered by size, the words taken differ from the
target by about one document at most.

The order is a range partitioning of narrow rows; a document's place in its source is the place in its partition
plus one count per source and partition.  No source is ever gathered in one task, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricebook.session import materialize

from .base import WORD

PART_BITS = 33  # monotonically_increasing_id: the partition above, the row below


def words_in(text: Column) -> Column:
    """The number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sizes: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, weight): the sources by code point, null last, weigh as the cycle says, repeating."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, cycle)), (rank % len(cycle) + 1).cast("int"))
    return sizes.select("source").distinct().select("source", weight.alias("weight"))


def source_targets(sizes: DataFrame, weights: DataFrame, cap: int = 3) -> DataFrame:
    """(source, source_size, target) of the sources in ``weights``: one row each.

    Filling up by weight until none is above its cap ends at one level per unit of weight, which is the highest of
    the levels reached when the sources that fill first are taken out one after the other.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = weights.select(F.col("source").alias("w_source"), "weight")
    by = by.join(w, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source").withColumn("most", cap * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("level", (F.sum("source_size").over(every) - before) / rest)
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.max("level").over(every))
    return by.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, weights: DataFrame | None = None, cap: int = 3, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Copies of every document: doc_id, source, size, rows, source_size, target, copies; one row per distinct (doc_id, source, size).

    ``weights`` (source, weight) default to ``cyclic_weights``; a source without a weight is left out.  Rows alike in
    all three columns are one unit (``rows`` of them) and get the same copies.  A null text has no words; null ids
    and sources are values like others.  A source without words has target 0 and no copies.  No rows, no plan.
    """
    sizes = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size")), "sizes")
    weights = cyclic_weights(sizes) if weights is None else weights
    targets = source_targets(sizes, weights, cap).withColumnRenamed("source", "t_source")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    units = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")).withColumn("key", key)
    order = [F.col("source").isNull(), F.col("source"), F.col("size"), F.col("key"), F.col("doc_id")]
    placed = units.repartitionByRange(*order).sortWithinPartitions(*order).drop("key").withColumn("mid", F.monotonically_increasing_id())
    placed = materialize(placed, "order").withColumn("part", F.shiftright("mid", PART_BITS))
    runs = placed.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"))
    base = F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")
    runs = runs.select(F.col("source").alias("r_source"), F.col("part").alias("r_part"), "first", base.alias("base"))
    rows = placed.join(runs, (F.col("part") == F.col("r_part")) & F.col("source").eqNullSafe(F.col("r_source")))
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("t_source")))
    place = F.col("base") + F.col("mid") - F.col("first")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # 16 bits of a hash: sums stay exact where every document is taken a whole number of times.
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-offset:"), F.coalesce("source", F.lit("")))), 1, 4), 16, 10).cast("double") / 65536
    copies = F.floor(rate * (place + 1) + offset) - F.floor(rate * place + offset)
    return rows.select("doc_id", "source", "size", "rows", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, weights: DataFrame | None = None, cap: int = 3, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus: every row of ``docs``, all its columns, as many times as ``mix_plan`` says."""
    plan = mix_plan(docs, weights, cap, seed, doc_id, text, source).filter("copies > 0")
    plan = plan.select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), "copies")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col(doc_id).alias("k_id"), F.col(source).alias("k_source"), words_in(F.col(text)).alias("k_size"))
    same = F.col("k_id").eqNullSafe(F.col("p_id")) & F.col("k_source").eqNullSafe(F.col("p_source")) & (F.col("k_size") == F.col("p_size"))
    return rows.join(plan, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
