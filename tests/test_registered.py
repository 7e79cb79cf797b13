"""A sample of the registered queries against their SQL, and the contract of the entry module."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import cell
from workload.base import TABLES
from workload.data import Data
from workload.file_queries import csv_folder
from workload.source_queries import mapped_payloads

SF = "/root/testdata/sf0.001"
SAMPLE = ["cheapest_offer_per_canonical", "compare_list", "flag_duplicate_keys", "price_changes", "rapid_fire_day", "shopify_to_offers", "extract_strength", "with_siblings"]


def test_entry(spark):
    assert entry.entry(spark).columns == ["canonical_product_id", "offer_count", "lowest_cost_per_active_unit"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    theirs = sorted(tuple(cell(v) for _, v in sorted(zip(names, r))) for r in cur.fetchall())
    df = entry.queries()[name](spark, SF)
    mine = sorted(tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert sorted(names) == sorted(df.columns) and mine == theirs


def test_inputs_are_dealt_out_and_built_once(spark):
    d = Data(spark, SF, keep=True)
    for df in (d.offers, d.memory, d.suppressions):
        assert "lineitem" not in " ".join(df.inputFiles())
    kept, built = d.offers.drop("operator_fields"), Data(spark, SF).offers.drop("operator_fields")
    assert kept.exceptAll(built).isEmpty() and built.exceptAll(kept).isEmpty()
    files = spark.read.text(csv_folder(spark.range(1000).coalesce(1).withColumn("x", F.lit("a")), "feed", most_rows=300)).inputFiles()
    assert len(files) == 4
    assert mapped_payloads(d).rdd.getNumPartitions() >= 4


def test_offers_do_not_broadcast_the_part_table(spark):
    # A row per product: by the size of its compressed file it went through the driver.
    d = Data(spark, SF)
    for df in (d.offers, d.memory):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert any("ShuffledHashJoin [" in line and "p_partkey" in line for line in plan.splitlines())


def test_both_catalog_versions_come_from_rows_that_are_written_once(spark, monkeypatch):
    from workload import file_queries as q

    seen = []
    monkeypatch.setattr(q.c, "write_catalog", lambda products, offers, *rest: seen.append(products.inputFiles()))
    monkeypatch.setattr(q.c, "read_catalog", lambda *rest: (None, spark.range(1).selectExpr("id", "id AS canonical_product_id")))
    q.catalog_written(spark, "/root/testdata/sf0.001")
    assert len(seen) == 2 and seen[0] and not [f for f in seen[0] if "lineitem" in f]


def test_raw_pointers_are_put_without_a_join(spark, tmp_path, monkeypatch):
    from pricebook.plans.raw_index import RawPointers
    from pricebook.schemas import KEY

    rows = [(1, "a", "", 5, 0), (1, "a", "", 7, 0), (1, "b", "", 6, 0), (1, None, "", 8, 0)]
    raw = spark.createDataFrame(rows, "merchant_id long, source_product_id string, source_variant_id string, id long, import_run_id long").withColumn("raw_json", F.lit("{}"))
    pointers, plans = RawPointers(str(tmp_path), buckets=2, fan=2), []
    put = pointers.state.put
    monkeypatch.setattr(pointers.state, "put", lambda df, n: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), put(df, n)))
    pointers.put(raw, 0)
    assert "Join" not in plans[0] and "Aggregate" not in plans[0]
    assert sorted(r["id"] for r in pointers.of(spark, raw.select(*KEY), 1).collect()) == [6, 7]


def test_rematch_for_keys_reads_only_the_titles_of_the_queue(spark, monkeypatch):
    from pricebook.operators import memory

    monkeypatch.setattr(memory, "rematch", lambda *tables, ids: ids)
    rows = [(1, "Zinc", "pending", None), (2, "Zinc", "active", None), (3, "Zinc", "pending", 7), (4, "Iron", "pending", None)]
    offers = spark.createDataFrame(rows, "id long, product_title string, visibility_status string, canonical_product_id long")
    keys = spark.createDataFrame([("zinc",), ("",)], "title_key string")
    assert [r["id"] for r in memory.rematch_for_keys(offers, keys, None, None, None).collect()] == [1]
