"""Files and tables that are written to the shared folder and read back."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from pricebook.operators import catalog as c
from pricebook.plans import ingest as ing
from pricebook.session import materialize, shared_dir
from pricebook.sources.feed import read_canonicals, read_ingredients, read_offer_feed

from .base import NOW, query
from .catalog_queries import EXPORT, export
from .data import Data
from .ingest_queries import GOOD, good


def csv_folder(df: DataFrame, purpose: str, most_rows: int = 250_000) -> str:
    """The rows as a folder of packed CSV files of at most so many rows (a file is read by one task), every cell quoted and kept as it is."""
    path = shared_dir(df.sparkSession, purpose)
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "quoteAll": True, "escape": '"', "header": True, "maxRecordsPerFile": most_rows, "compression": "gzip"}
    df.write.options(**keep).csv(path)
    return path


@query(
    "feed_file",
    """SELECT source, site, source_product_id, source_variant_id, product_title, brand, sku, regular_price, sale_price, on_sale, currency, stock_status,
source_product_url, NULL AS fatal FROM v_feed""",
)
def feed_file(spark, sf):
    rows, report = read_offer_feed(spark, csv_folder(Data(spark, sf).feed.drop("row_num"), "feed"))
    cells = ["source", "site", "source_product_id", "source_variant_id", "product_title", "brand", "sku", "regular_price", "sale_price", "on_sale", "currency", "stock_status", "source_product_url"]
    return rows.select(*cells, F.lit(report.fatal).cast("string").alias("fatal"))


@query(
    "feed_file_missing",
    "SELECT 'missing required column(s): source, on_sale, stock_status' AS fatal, count(*) AS n, count(DISTINCT source_product_id) AS products FROM v_feed",
)
def feed_file_missing(spark, sf):
    path = csv_folder(Data(spark, sf).feed.drop("row_num", "source", "on_sale", "stock_status"), "feed")
    rows, report = read_offer_feed(spark, path)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_product_id").alias("products")).withColumn("fatal", F.lit(report.fatal))


@query(
    "ingredient_file",
    """SELECT slug, name, alias AS first_alias, category, default_unit,
elemental_percentage, status FROM v_ingredients""",
)
def ingredient_file(spark, sf):
    i = Data(spark, sf).ingredients
    cells = i.select("slug", "name", F.to_json(F.array("alias")).alias("aliases"), F.upper("category").alias("category"), "default_unit", "elemental_percentage", "status")
    # As many rows without a slug, which are left out.
    blank = cells.withColumn("slug", F.lit(""))
    got = read_ingredients(spark, csv_folder(cells.unionByName(blank), "ingredients"))
    return got.select("slug", "name", F.get("aliases", F.lit(0)).alias("first_alias"), "category", "default_unit", "elemental_percentage", "status")


@query(
    "canonical_file",
    """SELECT c.slug, CASE WHEN c.id % 5 <> 0 THEN c.ingredient_id END AS ingredient_id, CASE WHEN c.id % 5 <> 0 THEN c.strength_per_serving END AS strength,
CASE WHEN c.id % 5 = 0 THEN concat('unknown ingredient: no-', i.slug) END AS error FROM v_canonicals c JOIN v_ingredients i ON i.id = c.ingredient_id""",
)
def canonical_file(spark, sf):
    d = Data(spark, sf)
    slugs = d.ingredients.select(F.col("id").alias("ingredient_id"), F.col("slug").alias("ingredient_slug"))
    rows = d.canonicals.join(slugs, "ingredient_id")
    # Every fifth product names an ingredient that is not there.
    named = rows.withColumn("ingredient_slug", F.when(F.col("id") % 5 == 0, F.concat(F.lit("no-"), "ingredient_slug")).otherwise(F.col("ingredient_slug")))
    path = csv_folder(named.select("slug", "ingredient_slug", "ingredient_form", "strength_per_serving", "status"), "canonicals")
    kept, bad = read_canonicals(spark, path, d.ingredients)
    a = kept.select("slug", "ingredient_id", F.col("strength_per_serving").alias("strength"), F.lit(None).cast("string").alias("error"))
    return a.unionByName(bad.select("slug", F.lit(None).cast("bigint").alias("ingredient_id"), F.lit(None).cast("double").alias("strength"), "error"))


@query("catalog_written", f"SELECT id, canonical_product_id FROM ({EXPORT}) e")
def catalog_written(spark, sf):
    # Both versions of both tables come from the same rows, so they are written first.
    rows = materialize(export(spark, sf), "export")
    products, offers = c.export_catalog(rows, Data(spark, sf).history, NOW)
    path = shared_dir(spark, "catalog")
    # The second version is the published one.
    c.write_catalog(products, offers.where("id < 0"), path, NOW)
    c.write_catalog(products, offers, path, NOW + timedelta(minutes=1))
    return c.read_catalog(spark, path)[1].select("id", "canonical_product_id")


@query(
    "raw_appended",
    f"SELECT r AS import_run_id, source_product_id, product_title FROM ({GOOD}) g, (SELECT unnest([7, 8]) AS r) runs",
)
def raw_appended(spark, sf):
    path, rows = shared_dir(spark, "raw"), materialize(good(spark, sf), "good")
    for run in (7, 8):
        ing.append_raw(ing.raw_rows(rows, run, NOW), path)
    return spark.read.parquet(path).select(F.col("import_run_id").cast("bigint"), "source_product_id", F.get_json_object("raw_json", "$.product_title").alias("product_title"))
