"""Ordered look-backs that keep working when one key holds a large share of the rows.

A plain window puts every row of a key into one task.  Here the rows of a key are
first cut along the order into buckets; only one small row per bucket is carried
from bucket to bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on the key columns."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def with_previous(df: DataFrame, keys: list[str], order: list[str], cols: list[str], bucket: Column, name: str = "prev") -> DataFrame:
    """Add a struct with ``cols`` of the previous row of the key, null on the first row.

    ``bucket`` must not decrease along ``order``.
    """
    b = df.withColumn("_bucket", bucket)
    group = keys + ["_bucket"]
    lasts = b.groupBy(*group).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_last"))
    # One row per bucket: this window is as small as the number of buckets.
    carried = lasts.withColumn("_carry", F.lag("_last").over(W.partitionBy(*keys).orderBy("_bucket"))).drop("_last")
    inside = F.lag(F.struct(*cols)).over(W.partitionBy(*group).orderBy(*order))
    return (
        b.join(carried, group, "left")
        .withColumn(name, F.coalesce(inside, F.col("_carry")))
        .drop("_bucket", "_carry")
    )


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; Spark trims every group before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n)
