"""Keyed state in tables: the newest row of each key, for jobs that run batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


class KeyedState:
    """The newest row of each key, as runs of merged batches.

    Batch k writes its own rows only, as run k of level 0.  When a level has ``fan`` new runs, they become one run of
    the next level, so a row is written again once per level and what a batch writes follows the batch, not the keys.
    The digits of k in base ``fan`` name the few runs that hold everything before batch k.  Rows are cut by a hash of
    their key into bucket folders, and a batch reads only the buckets that its own keys lie in.

    All names follow from the batch id.  A batch that is delivered again, also after a restart of the driver, reads the
    same runs and writes the same folders; what it had half written is replaced.  Of rows of one key the largest by
    ``order`` is the newest, and null keys are a key.  A state that should be there and cannot be read is an error.
    """

    def __init__(self, path: str, keys: list[str], order: list[str], schema: T.StructType, buckets: int = 64, fan: int = 8):
        self.path, self.keys, self.order, self.buckets, self.fan = path.rstrip("/"), keys, order, buckets, fan
        self.schema = schema

    def runs(self, batch_id: int) -> list[tuple[int, int]]:
        """(level, number) of the runs that hold all batches before this one."""
        out, level, n = [], 0, batch_id
        while n:
            n, digit = divmod(n, self.fan)
            out += [(level, n * self.fan + i) for i in range(digit)]
            level += 1
        return out

    def _folder(self, level: int, number: int) -> str:
        return f"{self.path}/level={level}/run={number}"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [f.name for f in self.schema if f.name not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("_l"))
        return newest.select(*self.keys, "_l.*").select(*self.schema.fieldNames())

    def _read(self, spark: SparkSession, runs: list[tuple[int, int]]) -> DataFrame:
        if not runs:
            return spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())]))
        full = T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])
        parts = [spark.read.schema(full).parquet(self._folder(*r)) for r in runs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def before(self, spark: SparkSession, batch_id: int, of: DataFrame | None = None) -> DataFrame:
        """The newest rows before a batch, of all keys or of those in ``of`` (its key columns are read)."""
        rows = self._read(spark, self.runs(batch_id))
        if of is not None:
            wanted = of.select(*self.keys).distinct()
            # At most one number per bucket reaches the driver; the folders of the others are not opened.
            touched = sorted(r[0] for r in wanted.select(self._bucket()).distinct().collect())
            rows = rows.where(F.col("_bucket").isin(touched))
            right = wanted.select(*[F.col(k).alias(f"_w_{k}") for k in self.keys])
            same = [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in self.keys]
            rows = rows.join(right, same, "left_semi")
        return self._newest(rows)

    def _write(self, rows: DataFrame, level: int, number: int) -> None:
        # Rebalanced: a small bucket is one file, a large one is written by several tasks.
        spread = rows.withColumn("_bucket", self._bucket()).hint("rebalance", F.col("_bucket"))
        spread.write.mode("overwrite").partitionBy("_bucket").parquet(self._folder(level, number))

    def put(self, rows: DataFrame, batch_id: int) -> None:
        """The rows that a batch leaves; an empty batch must be put, too."""
        self._write(self._newest(rows.select(*self.schema.fieldNames())), 0, batch_id)
        level, number = 0, batch_id
        while number % self.fan == self.fan - 1:
            group = [(level, number - self.fan + 1 + i) for i in range(self.fan)]
            level, number = level + 1, number // self.fan
            self._write(self._newest(self._read(rows.sparkSession, group)), level, number)
