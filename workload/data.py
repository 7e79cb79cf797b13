"""The views as DataFrames, typed the way the library's tables are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricebook.functions.costs import derive_costs
from pricebook.operators.prices import price_changes_from_log
from pricebook.session import materialize, spread

from .base import newest, table, view


class Data:
    """The tables of one scale factor; ``keep`` writes the newest observations once, for queries that read the offers several times."""

    def __init__(self, spark: SparkSession, sf: str, keep: bool = False):
        self.spark, self.sf = spark, sf
        self._latest = materialize(newest(spark, sf), "newest") if keep else None

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._view(f"v_{name}")

    def _view(self, name: str) -> DataFrame:
        return view(self.spark, self.sf, name, self._latest)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf, name)

    @property
    def offers(self) -> DataFrame:
        owned = F.when(F.col("partkey") % 12 == 0, F.array(F.lit("total_active_per_container"))).otherwise(F.array().cast("array<string>"))
        return self._view("v_offers").withColumn("operator_fields", owned)

    @property
    def listings(self) -> DataFrame:
        return spread(self._view("v_listings"))

    @property
    def ingredients(self) -> DataFrame:
        return self._view("v_ingredients").withColumn("aliases", F.array("alias"))

    @property
    def costed(self) -> DataFrame:
        rates = self.ingredients.select(F.col("id").alias("ingredient_id"), "standardization_default_pct", "elemental_percentage")
        return derive_costs(self.offers.join(rates, "ingredient_id", "left"))

    @property
    def history(self) -> DataFrame:
        """The change log of the observations, by the library's own change detection."""
        log = price_changes_from_log(self.observations, ["offer_id"], ["observed_at", "seq"], F.year("observed_at"))
        return log.withColumns({"id": F.col("seq"), "import_run_id": F.col("seq"), "changed_at": F.col("observed_at")}).drop("seq", "observed_at")

    @property
    def raw(self) -> DataFrame:
        """A raw snapshot of every offer, as the feed would have sent it."""
        return self.raw_of(self.offers)

    def raw_of(self, offers: DataFrame) -> DataFrame:
        """The raw snapshot of offers at hand, so that they are not built again."""
        return offers.select(
            "merchant_id", "source_product_id", "source_variant_id", F.col("last_seen_import_run_id").alias("id"),
            F.to_json(F.struct(F.col("source_platform").alias("source"), "source_product_id", "source_variant_id", "product_title", "variant_title")).alias("raw_json"),
        )

    def dims(self) -> dict[str, DataFrame]:
        return {"merchants": self.merchants, "canonicals": self.canonicals, "ingredients": self.ingredients}
