"""Pointers to the newest raw row of each key, kept run by run (JOIN-18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from ..schemas import KEY, RAW
from ..streaming.state import KeyedState


class RawPointers:
    """Where the newest raw row of each key is: its id and its run.

    A run puts the pointers of its own rows; a lookup reads the buckets of the wanted keys.  With raw rows partitioned
    by run, :func:`latest_raw` then opens only the runs that the pointers name.
    """

    schema = T.StructType([RAW[c] for c in (*KEY, "id", "import_run_id")])

    def __init__(self, path: str, buckets: int = 64, fan: int = 8):
        self.state = KeyedState(path, KEY, ["id"], self.schema, buckets, fan)

    def put(self, raw: DataFrame, number: int) -> None:
        """The raw rows of the ``number``-th run, counted from 0 without gaps."""
        # The state keeps the highest id of each key; a row without a whole key belongs to no offer.
        self.state.put(raw.select(*self.schema.fieldNames()).dropna(subset=KEY), number)

    def of(self, spark: SparkSession, offers: DataFrame, runs: int) -> DataFrame:
        """The pointers of the offers' keys after so many runs."""
        return self.state.before(spark, runs, offers)
