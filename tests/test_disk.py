"""What a query leaves on disk between its steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricebook.operators import totals as tot
from pricebook.functions.dose import extract_count
from pricebook.functions.text import extract_form
from pricebook.schemas import KEY
from pricebook.session import discard, exists, materialize
from workload import match_queries as q

SF = "/root/testdata/sf0.001"


def _shuffles(spark) -> int:
    return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def test_a_written_table_leaves_no_shuffle_files_and_can_be_discarded(spark):
    before = _shuffles(spark)
    df = materialize(spark.range(100).repartition(4).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert _shuffles(spark) <= before and df.count() == 7
    path = df._written_to
    discard(df, spark.range(1))
    assert not exists(spark, path)


def test_the_diagnostic_keeps_its_last_table_only(spark, monkeypatch):
    written = []

    def noted(df, purpose="step", wide=False):
        out = materialize(df, purpose, wide)
        written.append(out._written_to)
        return out

    for module in (q, tot, tot.normalize_offers.__globals__):
        if isinstance(module, dict):
            monkeypatch.setitem(module, "materialize", noted)
        else:
            monkeypatch.setattr(module, "materialize", noted)
    diag = q.diagnostic(spark, SF)
    assert len(written) == 5 and [exists(spark, p) for p in written] == [False] * 4 + [True]
    assert diag.count() > 0


def test_latest_raw_shuffles_texts_once(spark):
    schema = "merchant_id long, source_product_id string, source_variant_id string, id long, raw_json string"
    raw = spark.createDataFrame([(1, "a", "", 5, "old"), (1, "a", "", 7, "new"), (1, "a", "", None, "none"), (1, "b", "", 6, "b")], schema)
    offers = spark.createDataFrame([(1, "a", ""), (2, "a", "")], schema.split(", id")[0])
    out = tot.latest_raw(offers, raw)
    # Wanted keys, ids, texts and offers, each dealt out by key.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4
    assert sorted(out.select(*KEY, "raw_json").collect()) == [(1, "a", "", "new"), (2, "a", "", None)]


def test_a_cheap_look_leaves_out_no_text(spark):
    texts = ["12 TABS", "3caps", "1200-Gummies", "x 30", "30 ct, 60 capsules", "no 5 x 0", "12cap5", "99999 tabs x7", "5 Soft  Gels", "SUB-LINGUAL", "Under-the-Tongue drops", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", extract_count(F.col("t")).alias("n"), extract_form(F.col("t")).alias("f"))
    assert [(r["n"], r["f"]) for r in rows.collect()] == [
        (12, "tablet"), (3, None), (1200, "gummy"), (30, None), (30, "capsule"), (None, None), (None, None), (7, "tablet"), (None, None),
        (None, "sublingual"), (None, "sublingual"), (None, None), (None, None),
    ]


def test_the_change_log_and_the_offers_are_written_before_they_are_read_again(spark):
    from workload.ingest_queries import delete_impact
    from workload.price_click_queries import revert_run_prices

    for query in (revert_run_prices, delete_impact):
        assert not [f for f in query(spark, SF).inputFiles() if "lineitem" in f]


def test_a_feed_is_packed_and_its_rows_stay_where_they_are_read(spark):
    from pricebook.sources.feed import _numbered, _read_csv
    from workload.file_queries import csv_folder

    path = csv_folder(spark.range(700).coalesce(1).withColumn("x", F.lit("a\nb")), "feed", most_rows=300)
    rows = _numbered(_read_csv(spark, path)[0])
    assert all(f.endswith(".csv.gz") for f in spark.read.text(path).inputFiles())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(_file" not in plan.split("BroadcastExchange")[0]
    assert rows.agg(F.min("row_num"), F.max("row_num"), F.count("x")).first()[:] == (2, 301, 700)


def test_latest_raw_of_several_tables(spark):
    # Parts of a union were taken for rows dealt out together, and a join of 48 with 96 partitions failed.
    schema = "merchant_id long, source_product_id string, source_variant_id string, id long, raw_json string"
    raw = spark.range(40).selectExpr("id AS merchant_id", "'a' AS source_product_id", "'' AS source_variant_id", "id + 100 AS id", "'new' AS raw_json")
    old = raw.withColumns({"id": F.col("id") - 50, "raw_json": F.lit("old")})
    out = tot.latest_raw(raw.select(*KEY), raw.unionByName(old))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and raw.columns == [f.split()[0] for f in schema.split(", ")]
    assert out.where("raw_json = 'new'").count() == out.count() == 40
