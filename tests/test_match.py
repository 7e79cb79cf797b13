"""Matching, learned mappings and totals."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Row, functions as F

from pricebook.operators import match as m, memory as mem, totals as tot

CANON = "id bigint, ingredient_id bigint, ingredient_form string, strength_per_serving double, standardization_percentage double, status string"
OFFER = "id bigint, merchant_id bigint, canonical_product_id bigint, product_title string, brand string, sku string, barcode string, strength_per_serving double, servings_per_container bigint"
FOUND = "id bigint, merchant_id bigint, product_title string, brand string, sku string, barcode string, found_ingredient_id bigint, found_form string, found_strength double, found_servings int, found_pct double"
MEMORY = "merchant_id bigint, title_key string, canonical_product_id bigint, sample_title string, source string, times_confirmed bigint, last_confirmed_at timestamp"


def run(spark, probes, offers=(), memory=(), canon=()):
    out = m.match_cascade(
        spark.createDataFrame(list(probes), FOUND), spark.createDataFrame(list(offers), OFFER), spark.createDataFrame(list(memory), MEMORY), spark.createDataFrame(list(canon), CANON)
    )
    return {r["id"]: (r["canonical_product_id"], float(r["confidence"]), r["tier"]) for r in out.collect()}


def test_order_of_tiers_beats_score_and_retired_products_never_match(spark):
    canon = [(1, 1, "capsule", 10.0, None, "active"), (2, 1, None, None, None, "draft"), (3, 1, None, None, None, "retired")]
    memory = [(9, "red jar", 2, "Red Jar", "manual", 1, None), (8, "blue jar", 3, "Blue Jar", "manual", 1, None)]
    offers = [(100, 5, 3, "Green Jar", "B", "S1", "777", 10.0, 30), (101, 5, 1, "Green Jar", "B", "S1", "778", 10.0, 30)]
    probes = [
        (1, 7, "Red Jar 10mg", "", "", "", 1, "capsule", 10.0, 30, None),  # others' memory at 0.80 before the 0.85 lookup
        (2, 7, "Blue Jar", "", "", "", 1, "capsule", 10.00005, 30, None),  # retired mapping is ignored
        (3, 7, "Jar", "b", "S1", "777", None, None, None, None, None),  # barcode peer is retired, brand and SKU are not
        (4, 7, "Green Jar", "b", "", "", None, None, 10.0, 30, None),  # brand and title come before the dose tier
        (5, 7, "Green Jar", "", "", "", None, None, 10.0, 30, None),
        (6, 7, "Other", "", "", "", 1, "tablet", 5.0, None, None),
        (7, 7, "Nothing", "", "", "", None, None, None, None, None),
    ]
    got = run(spark, probes, offers, memory, canon)
    assert got == {
        1: (2, 0.80, "memory_others"), 2: (1, 0.85, "canonical_attrs"), 3: (1, 0.95, "brand_sku"), 4: (1, 0.85, "brand_title"),
        5: (1, 0.65, "title_dose"), 6: (2, 0.55, "ingredient_only"),
    }


def test_other_merchants_must_agree_and_own_mapping_wins(spark):
    canon = [(1, 1, None, None, None, "active"), (2, 2, None, None, None, "active")]
    memory = [(1, "tea leaf", 1, "t", "m", 1, None), (2, "tea leaf", 2, "t", "m", 1, None), (3, "one thing", 2, "t", "m", 1, None)]
    probes = [(1, 1, "Tea Leaf", "", "", "", None, None, None, None, None), (2, 9, "Tea Leaf", "", "", "", None, None, None, None, None), (3, 9, "One Thing", "", "", "", None, None, None, None, None)]
    assert run(spark, probes, (), memory, canon) == {1: (1, 0.90, "memory_own"), 3: (2, 0.80, "memory_others")}


def test_longest_name_wins_and_tokens_are_whole(spark):
    ing = spark.createDataFrame(
        [Row(id=1, name="Theanine", aliases=["Suntea"], status="active"), Row(id=2, name="L-Theanine", aliases=[], status="active"), Row(id=3, name="Iron", aliases=["(Fe+2)"], status="active"), Row(id=4, name="Zinc Oxide", aliases=[], status="retired")],
        "id bigint, name string, aliases array<string>, status string",
    )
    texts = ["pure L-THEANINE 200mg", "theanines", "my suntea", "environment", "iron", "has (fe+2) in it", "zinc oxide"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, x string")
    got = {r["id"]: r["detected_ingredient_id"] for r in m.detect_ingredient(df, ing, "x").collect()}
    assert [got[i] for i in range(len(texts))] == [2, None, 1, None, 3, 3, None]


def test_memory_counts_the_last_unbroken_run(spark):
    at = lambda d: datetime(2024, 1, d)
    rows = [(1, "k", 5, "a", "approval", at(1), 1), (1, "k", 6, "b", "approval", at(2), 2), (1, "k", 5, "c", "edit", at(3), 3), (1, "k", 5, "d", "edit", at(4), 4), (2, "k", 5, "e", "edit", at(1), 5)]
    d = spark.createDataFrame(rows, "merchant_id bigint, title_key string, canonical_product_id bigint, sample_title string, source string, decided_at timestamp, id bigint")
    prior = spark.createDataFrame([(2, "k", 5, "z", "manual", 3, at(1)), (3, "q", 9, "y", "manual", 2, at(1))], MEMORY)
    got = {r["merchant_id"]: (r["canonical_product_id"], r["times_confirmed"], r["sample_title"]) for r in mem.memory_state(d, prior).collect()}
    assert got == {1: (5, 2, "d"), 2: (5, 4, "e"), 3: (9, 2, "y")}


def test_suggestions(spark):
    cases = [
        (("Vial A 10mg", "", "", None, 0, False), (10.0, "mg", "single_title")),
        (("Vial A 10mg", "", "", None, 0, True), None),
        (("Vial A", "20 MG", "", None, 0, True), (20.0, "mg", "single_variant")),
        (("Powder", "", '{"variant_options":{"option1":"2 kg"}}', None, 0, True), (2000.0, "g", "single_attribute")),
        (("Vial A 10mg 60 capsules", "", "", None, 0, False), None),
        (("Vial A 10mg", "", "", "capsule", 0, False), None),
        (("Vial A 5mg/ml", "", "", None, 0, False), None),
        (("Vial A 10mg (10 vials)", "", "", None, 0, False), (100.0, "mg", "pack_count")),
        (("Kit A", "10mg Kit (100mg)", "", None, 0, True), (100.0, "mg", "pack_stated")),
        (("Bulk A 10mg", "", "", None, 0, False), None),
        (("Aa + Bb 50mg + 10mg + 10mg (70mg)", "", "", None, 0, False), (70.0, "mg", "blend_stated")),
        (("Aa/Bb 13/3mg", "", "", None, 0, False), (16.0, "mg", "blend_sum")),
        (("Aa & Bb 10mg and 5mg 3-Pack", "", "", None, 0, False), (45.0, "mg", "blend_sum_pack")),
        (("Stack 10mg 5 IU", "", "", None, 0, False), None),
        (("Aa blend", "10mg vial", '{"variation_attributes":[{"name":"Size","value":"10mg vial"}]}', None, 0, True), (10.0, "mg", "blend_stated")),
    ]
    df = spark.createDataFrame([(i, *c, False) for i, (c, _) in enumerate(cases)], "i int, product_title string, variant_title string, raw_attributes_json string, ingredient_form string, servings int, has_siblings boolean, variant_level boolean")
    got = {r["i"]: r["suggestion"] for r in tot.suggest_total(df).collect()}
    assert [None if got[i] is None else tuple(got[i]) for i in range(len(cases))] == [w for _, w in cases]


def test_review_hints(spark):
    cases = [(10.0, "g", 10.0, "mg", "x", "unit slip: g stored, mg listed"), (1.0, "mg", 1.0, "g", "x", "unit slip: mg stored, g listed"), (5.0, "mg", 5000.0, "mg", "x", "1000 times off"), (5.0, "mg", 50.0, "mg", "x", "listing is 10 times stored"), (5.0, "mg", 5.3, "mg", "x", ""), (5.0, "mg", None, "mg", "x", "")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, truth double, truth_unit string, fill_total double, fill_unit string, fill_source string, want string")
    assert all(r["h"] == r["want"] for r in df.select("want", tot.review_hint().alias("h")).collect())


def test_listings_of_small_files_are_not_sent_to_the_driver(spark, tmp_path):
    # 100,000 rows in some kilobytes of files: by the files' size alone the planner would broadcast them.
    spark.range(100000).select("id", F.lit("pure zinc oxide 10mg").alias("x"), F.lit(1).cast("bigint").alias("merchant_id"), F.lit("zinc").alias("title_key")).write.parquet(str(tmp_path / "l"))
    df = spark.read.parquet(str(tmp_path / "l"))
    ing = spark.createDataFrame([Row(id=1, name="Zinc Oxide", aliases=["Oxide"], status="active"), Row(id=2, name="Iron", aliases=[], status="active")], "id bigint, name string, aliases array<string>, status string")
    memory = spark.createDataFrame([(1, "zinc", 1, "z", "m", 1, None)], MEMORY)
    canon = spark.createDataFrame([(1, 1, None, None, None, "active")], CANON)

    def listings_broadcast(out) -> bool:
        return "BuildLeft" in out._jdf.queryExecution().executedPlan().toString()

    few, many = m.detect_ingredient(df, ing, "x"), m.detect_ingredient(df, ing, "x", most_names=0)
    found = [m.tier_memory_own(df, memory, canon), m.tier_memory_others(df, memory, canon)]
    assert not any(listings_broadcast(out) for out in [few, many, *found])
    for out, column, one in [(few, "detected_ingredient_id", 1), (many, "detected_ingredient_id", 1)] + [(t, "canonical_product_id", 1) for t in found]:
        assert [tuple(r) for r in out.groupBy(column).count().collect()] == [(one, 100000)]


def test_keys_of_many_listings_are_not_broadcast(spark, monkeypatch):
    def plan(df) -> str:
        return df._jdf.queryExecution().executedPlan().toString()

    few, many = m.dealt(spark.range(5), 5), m.dealt(spark.range(6), 5)
    assert "BroadcastHashJoin" in plan(spark.range(9).join(few, "id")) and "SortMergeJoin" in plan(spark.range(9).join(many, "id"))

    found = "found_ingredient_id long, found_form string, found_strength double, found_servings int, found_pct double"
    read = spark.createDataFrame([(i, 1, "", "b", "s", "zinc", "zinc", 3, "capsule", 10.0, 60, None) for i in (1, 2)], f"id long, merchant_id long, barcode string, brand string, sku string, norm_title string, title_key string, {found}")
    index = spark.createDataFrame([("sku", "b", "s", None, None, 7, 1)], "kind string, a string, b string, strength double, servings long, canonical_product_id long, peer long")
    memory = spark.createDataFrame([], "merchant_id long, title_key string, canonical_product_id long")
    catalog = spark.createDataFrame([(7, "active", 3, "capsule", 10.0, None)], "id long, status string, ingredient_id long, ingredient_form string, strength_per_serving double, standardization_percentage double")
    for most, kind in ((2, "BroadcastHashJoin [tier"), (1, "SortMergeJoin [tier")):
        monkeypatch.setattr(m, "MOST_PROBES", most)
        hits = m.match_cascade(read, None, memory, catalog, index)
        assert kind in plan(hits) and sorted(hits.select("id", "canonical_product_id", "tier").collect()) == [(1, 7, "brand_sku"), (2, 7, "brand_sku")]
