"""Feed files, ingest runs, prices, clicks and streams."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pricebook import schemas as sc
from pricebook.functions.amounts import pack_counts
from pricebook.functions.dose import extract_count
from pricebook.operators import clicks as k, lifecycle as lc, prices as p, validate as v
from pricebook.plans.ingest import ingest
from pricebook.plans.ordered import with_previous
from pricebook.settings import Settings, site_settings
from pricebook.sources.feed import feed_metadata, read_canonicals, read_ingredients, read_offer_feed

NOW = datetime(2024, 5, 1)
HEADER = "export_run_id, exported_at ,source,site,,source_product_id,source_variant_id,product_title,current_price,on_sale,stock_status,source_product_url,variation_retrieval_status"


def feed_file(tmp_path, lines):
    path = tmp_path / "feed.csv"
    path.write_text("﻿" + "\n".join([HEADER, *lines]) + "\n", encoding="utf-8")
    return str(path)


def test_feed_reader(spark, tmp_path):
    path = feed_file(tmp_path, [',,shopify,s.com,junk,1,,"A ""b""\nc",1,true,in_stock,http://x,retrieved', "", "r9,2024-01-02 03:04:05,shopify"])
    df, report = read_offer_feed(spark, path)
    assert report.fatal is None and "" not in df.columns and "exported_at" in df.columns
    got = df.orderBy("row_num").collect()
    assert [r["row_num"] for r in got] == [2, 3] and got[0]["product_title"] == 'A "b"\nc' and got[1]["site"] == ""
    assert tuple(feed_metadata(df).first()) == ("r9", datetime(2024, 1, 2, 3, 4, 5))
    assert read_offer_feed(spark, path, max_rows=1)[1].fatal == "more than 1 data rows"
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n")
    assert read_offer_feed(spark, str(bad))[1].fatal.startswith("missing required column(s): export_run_id")


def test_catalog_files(spark, tmp_path):
    a = tmp_path / "i.csv"
    a.write_text("slug,name,aliases,category,default_unit,elemental_percentage,status\nzn,Zinc,Zn|Zincum; Z,mineral,oz,12.5,active\n,No,,,,,\nfe,Iron,\"[\"\"Fe\"\"]\",x,mg,,gone\n")
    ing = read_ingredients(spark, str(a)).orderBy("slug").collect()
    assert [(r["slug"], r["aliases"], r["category"], r["default_unit"], r["elemental_percentage"], r["status"]) for r in ing] == [
        ("fe", ["Fe"], "other", "mg", None, "draft"), ("zn", ["Zn", "Zincum", "Z"], "mineral", "mg", 12.5, "active"),
    ]
    b = tmp_path / "c.csv"
    b.write_text("slug,ingredient_slug,ingredient_form,strength_per_serving,status\nz50,zn,capsule,50,active\nq,nope,pill,,active\n")
    dims = spark.createDataFrame([(4, "zn")], "id bigint, slug string")
    good, bad = read_canonicals(spark, str(b), dims)
    assert [(r["slug"], r["ingredient_id"], r["strength_per_serving"]) for r in good.collect()] == [("z50", 4, 50.0)]
    assert [(r["slug"], r["error"]) for r in bad.collect()] == [("q", "unknown ingredient: nope")]


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def tables(spark):
    merchants = spark.createDataFrame([(1, "a", "A", "https://a.com", "shopify", "active", "", None, None), (2, "b", "B", "https://b.com", "shopify", "paused", "", None, None)], sc.MERCHANTS)
    ing = spark.createDataFrame([(7, "zinc", "Zinc", ["zn"], "mineral", "mg", None, None, None, "active", None)], sc.INGREDIENTS)
    canon = spark.createDataFrame([(70, "zinc", 7, None, None, None, None, None, "Zinc", True, "active", NOW)], sc.CANONICALS)
    return {
        "merchants": merchants, "ingredients": ing, "canonicals": canon, "offers": empty(spark, sc.OFFERS), "memory": empty(spark, sc.MEMORY),
        "suppressions": empty(spark, sc.SUPPRESSIONS), "history": empty(spark, sc.HISTORY), "raw": empty(spark, sc.RAW),
    }


def feed(spark, rows):
    cols = "source_product_id string, source_variant_id string, product_title string, current_price string, row_num bigint"
    df = spark.createDataFrame([(*r, i + 2) for i, r in enumerate(rows)], cols)
    fixed = {
        "source": "shopify", "site": "A.com/", "on_sale": "false", "stock_status": "in_stock", "source_product_url": "https://a.com/p",
        "variation_retrieval_status": "retrieved", "export_run_id": "r", "exported_at": "", "variant_title": "", "regular_price": "",
        "sale_price": "", "currency": "", "description": "", "raw_attributes_json": "",
    }
    return df.withColumns({c: F.lit(x) for c, x in fixed.items()})


def outcomes(result):
    return {r["outcome"]: r["n"] for r in result.results.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_runs_insert_update_stale_and_restore(spark):
    first = ingest(feed(spark, [("1", "", "Zinc &#8211; 50mg vial", "10"), ("2", "", "Zinc 20 mg 30 capsules", "6")]), tables(spark), 1, NOW)
    assert first.ok and outcomes(first) == {"inserted": 2}
    got = {r["source_product_id"]: r for r in first.tables["offers"].collect()}
    one, two = got["1"], got["2"]
    assert one["product_title"] == "Zinc – 50mg vial" and one["visibility_status"] == "pending" and one["canonical_product_id"] == 70
    assert (float(one["total_active_per_container"]), one["total_active_source"], float(one["cost_per_active_unit"])) == (50.0, "single_title", 0.2)
    assert (two["ingredient_form"], float(two["total_strength"]), float(two["cost_per_serving"])) == ("capsule", 600.0, 0.2)
    assert '"product_title":"Zinc &#8211; 50mg vial"' in first.tables["raw"].where("source_product_id = '1'").first()["raw_json"]

    # A price moves, a row is missing, a suppressed key stays out.
    t = dict(first.tables)
    t["suppressions"] = lc.suppress(t["suppressions"], spark.createDataFrame([(1, "3", "")], "merchant_id bigint, source_product_id string, source_variant_id string"), "manual", NOW)
    later = ingest(feed(spark, [("1", "", "Renamed", "12"), ("3", "", "Zinc 5mg", "1")]), t, 2, NOW + timedelta(days=1))
    assert outcomes(later) == {"updated": 1, "suppressed": 1, "stale": 1}
    h = later.tables["history"].collect()
    assert [(x["old_current_price"], x["new_current_price"]) for x in h] == [(10.0, 12.0)]
    now = {r["source_product_id"]: r for r in later.tables["offers"].collect()}
    assert set(now) == {"1", "2"} and now["2"]["visibility_status"] == "stale" and now["2"]["pre_stale_status"] == "pending"
    assert now["1"]["strength_per_serving"] == one["strength_per_serving"] and float(now["1"]["cost_per_active_unit"]) == 0.24

    back = ingest(feed(spark, [("2", "", "Zinc 20 mg 30 capsules", "6")]), later.tables, 3, NOW + timedelta(days=2))
    # The same row again adds no history.
    assert outcomes(back) == {"updated": 1, "stale": 1} and back.tables["history"].count() == 1
    assert {r["source_product_id"]: r["visibility_status"] for r in back.tables["offers"].collect()} == {"1": "stale", "2": "pending"}


def test_a_bad_row_stops_the_whole_file(spark):
    rows = feed(spark, [("1", "", "Zinc", "10"), ("1", "", "Zinc", "11"), ("2", "", " ", "1"), ("3", "", "Z", "abc")])
    result = ingest(rows, tables(spark), 1, NOW)
    assert not result.ok and result.tables["offers"].count() == 0
    assert {r["row_num"]: r["error"] for r in result.errors.collect()} == {3: "duplicate of row 2", 4: "product_title is empty", 5: "current_price is not a number"}


def test_owned_fields_survive_and_total_label_goes(spark):
    base = ingest(feed(spark, [("1", "", "Zinc 50mg vial", "10")]), tables(spark), 1, NOW).tables
    offer = base["offers"].first()["id"]
    edits = spark.createDataFrame([(offer, 80.0, None)], "id bigint, total_active_per_container double, strength_per_serving double")
    out = lc.curator_edit(base["offers"], edits, base["ingredients"], NOW).first()
    assert float(out["total_active_per_container"]) == 80.0 and out["total_active_source"] is None and float(out["cost_per_active_unit"]) == 0.125
    assert out["operator_fields"] == ["strength_per_serving", "total_active_per_container"]
    same = spark.createDataFrame([(offer, 50.0)], "id bigint, total_active_per_container double")
    kept = lc.curator_edit(base["offers"], same, base["ingredients"], NOW).first()
    assert kept["changed"] == [] and kept["total_active_source"] == "single_title"


def test_bucketed_previous_row_equals_a_plain_window(spark):
    from pyspark.sql import Window as W

    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.pmod(F.hash("id"), F.lit(97)).alias("t"), F.col("id"))
    plain = df.withColumn("w", F.lag("id").over(W.partitionBy("k").orderBy("t", "id")))
    mine = with_previous(df, ["k"], ["t", "id"], ["id"], F.floor(F.col("t") / 10))
    a = {r["id"]: r["w"] for r in plain.collect()}
    b = {r["id"]: (r["prev"]["id"] if r["prev"] else None) for r in mine.collect()}
    assert a == b


def test_rapid_fire_needs_earlier_clicks(spark):
    at = datetime(2024, 1, 1)
    rows = [(i, "v", at + timedelta(seconds=i)) for i in range(15)] + [(100 + i, "w", at) for i in range(12)] + [(200, "v", at + timedelta(seconds=75))]
    clicks = spark.createDataFrame(rows, "id bigint, ip_hash string, clicked_at timestamp")
    got = {r["id"] for r in k.flag_rapid_fire(clicks).where("rapid_fire").collect()}
    by_hand = {a for a, v1, t1 in rows if sum(v1 == v2 and (t2, b) < (t1, a) and t2 >= t1 - timedelta(seconds=60) for b, v2, t2 in rows) >= 10}
    assert got == by_hand and {10, 14, 110, 111} <= got and 200 not in got


def test_price_series_is_a_step_function(spark):
    offers = spark.createDataFrame([(1, 9, 5.0), (2, 9, 7.0)], "id bigint, canonical_product_id bigint, current_price double")
    rows = [(1, 1, datetime(2024, 4, 1), 8.0, 6.0), (2, 1, datetime(2024, 4, 29, 9), 6.0, 4.0), (3, 1, datetime(2024, 4, 29, 10), 4.0, 5.0)]
    h = spark.createDataFrame(rows, "id bigint, offer_id bigint, changed_at timestamp, old_current_price double, new_current_price double")
    got = [(r["low_price"], r["avg_price"]) for r in p.price_series(offers, h, NOW, 4).orderBy("day").collect()]
    assert got == [(6.0, 6.5), (5.0, 6.0), (5.0, 6.0), (5.0, 6.0)]
    moves = {r["offer_id"]: (r["dir"], r["pct"]) for r in p.price_moves(h, NOW, 30).collect()}
    assert moves == {1: ("up", 25.0)}


def test_settings_are_clamped():
    s = Settings(warn_hours=0, min_offers_to_publish=500, stale_minutes=1)
    assert (s.warn_hours, s.min_offers_to_publish, s.stale_minutes) == (1, 100, 5)


def test_settings_of_sites(spark):
    rows = [
        (1, "currency", "e1u2r3o"), (1, "stale_minutes", "-7 min"), (1, "price_move_days", "99999999999999999999"), (1, "min_offers_to_publish", "abc"),
        (1, "default_view", " Cost_Per_Serving"), (2, "other", "x"), (2, "hide_hours", None), (2, "warn_hours", "0"), (None, "warn_hours", "5"), (3, "warn_hours", "2"), (3, "warn_hours", "3"),
    ]
    got = {r["site_id"]: r for r in site_settings(spark.createDataFrame(rows, "site_id long, name string, value string")).collect()}
    one, two = got[1], got[2]
    assert (one["currency"], one["stale_minutes"], one["price_move_days"], one["min_offers_to_publish"], one["default_view"]) == ("EUR", 7, 3650, 1, "cost_per_serving")
    assert (two["currency"], two["warn_hours"], two["hide_hours"], two["default_view"]) == ("USD", 1, 168, "cost_per_active_unit")
    assert got[None]["warn_hours"] == 5 and got[3]["warn_hours"] == 3 and len(got) == 4
    assert Settings(price_move_days=9999, default_view="?").price_move_days == 3650 and Settings(default_view="?") == Settings()


def test_limits_of_counts(spark):
    row = spark.sql("SELECT 'pack of 120, 6000 capsules' AS t")
    told = row.select(pack_counts(F.col("t")).alias("a"), pack_counts(F.col("t"), most=200).alias("b"), extract_count(F.col("t")).alias("c"), extract_count(F.col("t"), most=9_999).alias("d")).first()
    assert (told["a"], told["b"], told["c"], told["d"]) == ([], [120], None, 6000)


def test_validation_names_the_first_broken_rule(spark):
    rows = feed(spark, [("1", "", "T", "1")]).withColumns({"source": F.lit("ebay"), "stock_status": F.lit("?")})
    assert v.validate_rows(rows).first()["error"] == "source is not allowed"


def test_raw_rows_keep_unknown_columns(spark):
    import json

    rows = feed(spark, [("1", "", "Zinc 50mg vial", "10")]).withColumn("shelf", F.lit("top"))
    raw = json.loads(ingest(rows, tables(spark), 1, NOW).tables["raw"].first()["raw_json"])
    assert raw["shelf"] == "top" and "row_num" not in raw and "merchant_id" not in raw


def test_rapid_fire_keeps_clicks_without_a_visitor(spark):
    rows = [(n, None if n < 20 else "v", NOW + timedelta(seconds=n % 20)) for n in range(40)]
    out = k.flag_rapid_fire(spark.createDataFrame(rows, "id bigint, ip_hash string, clicked_at timestamp"), 60, 10).collect()
    assert len(out) == 40 and {r["id"] for r in out if r["rapid_fire"]} == set(range(30, 40))


def test_feeds_of_other_column_order_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("slug,name\nx,X\n")
    (tmp_path / "b.csv").write_text("name,slug\nY,y\n")
    with pytest.raises(Exception, match="CSV header|conform"):
        read_ingredients(spark, str(tmp_path)).collect()


def test_catalog_versions(spark, tmp_path):
    from pricebook.operators.catalog import read_catalog, write_catalog

    a = spark.createDataFrame([(1, "a")], "id bigint, name string")
    b = spark.createDataFrame([(2, "b"), (3, "c")], "id bigint, name string")
    write_catalog(a, a, f"{tmp_path}/out", NOW)
    old = read_catalog(spark, f"{tmp_path}/out")[0]
    write_catalog(b, b, f"{tmp_path}/out", NOW + timedelta(minutes=1))
    # The former version can still be read while and after the next one is written.
    assert [r["id"] for r in old.collect()] == [1]
    assert sorted(r["id"] for r in read_catalog(spark, f"{tmp_path}/out")[1].collect()) == [2, 3]


@pytest.fixture(scope="module")
def started(spark):
    """A first run of two rows, and the event that it told."""
    from pricebook.plans import ingest as plan

    told = []
    plan.on_change(told.append)
    result = ingest(feed(spark, [("1", "", "Zinc 50mg vial", "10"), ("2", "", "Zinc 5mg vial", "3")]), tables(spark), 1, NOW)
    plan._callbacks.clear()
    return result, told[0]


def test_open_run_writes_all_offers_once_per_batch(spark, tmp_path, started, monkeypatch):
    from pricebook.plans import ingest as plan
    from pricebook.streaming.jobs import IngestRun

    sizes, write = {}, plan.materialize

    def counted(df, purpose):
        out = write(df, purpose)
        sizes[purpose] = out.count()
        return out

    monkeypatch.setattr(plan, "materialize", counted)
    run = IngestRun(started[0].tables, 2, str(tmp_path))
    run.batch(NOW + timedelta(days=1))(feed(spark, [("3", "", "Zinc 5mg vial", "3"), ("4", "", "Zinc 7mg vial", "3")]), 0)
    # Beside the version in the run's folder only the batch's own rows are written.
    assert sizes and max(sizes.values()) == 2
    totals = {r["source_product_id"]: r["total_active_per_container"] for r in run.tables()["offers"].collect()}
    # A stored offer has the third one's title: siblings are looked for among all offers.
    assert totals == {"1": 50.0, "2": 5.0, "3": None, "4": 7.0}


def test_open_run_counts_each_batch_once_and_closes_all_merchants(spark, tmp_path, started):
    from pricebook.streaming.jobs import IngestRun

    start = started[0].tables
    gone = spark.createDataFrame([(1, "9", "")], "merchant_id bigint, source_product_id string, source_variant_id string")
    start = {**start, "suppressions": lc.suppress(start["suppressions"], gone, "manual", NOW)}
    run = IngestRun(start, 2, str(tmp_path))
    assert run.ledger() is None
    step = run.batch(NOW + timedelta(days=1))
    # All rows of the only batch are suppressed or in error: the merchant still took part.
    page = feed(spark, [("9", "", "Zinc 1mg vial", "1"), ("8", "", "Zinc", "abc")])
    step(page, 0)
    step(page, 0)
    counts = run.ledger().first()
    assert counts["error_log"] == "row 3: current_price is not a number"
    closed = run.close(NOW + timedelta(days=1))
    assert {r["visibility_status"] for r in closed["offers"].collect()} == {"stale"}
    # A new driver sees the same run; a batch that was not committed is written again.
    again = IngestRun(start, 2, str(tmp_path))
    assert again.ledger().first() == counts and again.close(NOW).keys() == closed.keys()
    (tmp_path / "raw" / "batch=1").mkdir(parents=True)
    (tmp_path / "raw" / "batch=1" / "part-0.parquet").write_bytes(b"half")
    again.batch(NOW + timedelta(days=1))(feed(spark, [("2", "", "Zinc 5mg vial", "4")]), 1)
    raw = [(r["source_product_id"], r["id"]) for r in again.tables()["raw"].where("import_run_id = 2").collect()]
    assert raw == [("2", max(r["id"] for r in start["raw"].collect()) + 2)]
    assert {r["source_product_id"]: r["visibility_status"] for r in again.close(NOW)["offers"].collect()} == {"1": "stale", "2": "pending"}


def test_a_run_tells_its_counters_in_the_pass_that_does_it(spark, started):
    from pricebook.plans import ingest as plan

    first, event = started
    told = [event]
    plan.on_change(told.append)
    try:
        ban = spark.createDataFrame([(1, "2", "")], "merchant_id bigint, source_product_id string, source_variant_id string")
        banned = {**first.tables, "suppressions": lc.suppress(first.tables["suppressions"], ban, "manual", NOW)}
        second = ingest(feed(spark, [("1", "", "Zinc 50mg vial", "11"), ("2", "", "T", "3"), ("4", "", "Zinc", "x"), ("5", "", "New", "2")]), banned, 2, NOW, all_or_nothing=False)
        kept = plan.materialize_event(second.tables["offers"], "kept", "status_change", {"rows": F.count(F.lit(1))}, user=3)
    finally:
        plan._callbacks.clear()
    for e, result in zip(told, (first, second)):
        counted = lc.run_counters(result.results).first().asDict()
        assert {name: e[name] for name in counted} == counted
    assert told[1]["stale"] == 1 and told[1]["suppressed"] == 1 and told[1]["errored"] == 1
    assert told[2] == {"source": "status_change", "user": 3, "rows": kept.count()}


def test_keyed_state_reads_merged_runs_and_only_touched_buckets(spark, tmp_path):
    from pricebook.streaming.state import KeyedState

    rows = lambda *r: spark.createDataFrame(list(r), "k string, at long, v string")
    state = KeyedState(str(tmp_path), ["k"], ["at"], rows(("a", 1, "x")).schema, buckets=4, fan=2)
    assert state.runs(0) == [] and state.runs(5) == [(0, 4), (2, 0)] and state.runs(4) == [(2, 0)]
    want = {}
    for n in range(6):
        put = [(c, n, f"{c}{n}") for c in "abcdef"[n % 3 :: 2]] + [(None, n, f"null{n}")]
        state.put(rows(*put), n)
        want |= {k: v for k, _, v in put}
        assert {r["k"]: r["v"] for r in state.before(spark, n + 1).collect()} == want
    # A batch that comes again sees what it saw before, and replaces what it wrote.
    state.put(rows(("a", 5, "late")), 5)
    assert {r["k"]: r["v"] for r in state.before(spark, 6).collect()}["a"] == "late"
    some = state.before(spark, 5, rows(("b", 0, ""), (None, 0, ""), ("zz", 0, "")))
    assert {r["k"] for r in some.collect()} == {"b", None}
    state.put(rows(), 6)
    assert state.before(spark, 7).count() == state.before(spark, 6).count()


def test_rapid_fire_over_batches_with_a_busy_visitor_and_late_clicks(spark, tmp_path):
    from pricebook.streaming.jobs import RapidFire

    schema = "visitor string, id long, clicked_at timestamp"
    rows = [("busy" if n % 2 else f"v{n % 7}" if n % 10 else None, n, NOW + timedelta(seconds=n // 3)) for n in range(4000)]
    whole = k.flag_rapid_fire(spark.createDataFrame(rows, schema).withColumnRenamed("visitor", "ip_hash"), 30, 12)
    job = lambda: RapidFire(str(tmp_path), 30, 12, delay_seconds=60)
    cuts = [0, 700, 2500, 4000]
    for b, (x, y) in enumerate(zip(cuts, cuts[1:])):
        job()(spark.createDataFrame(rows[x:y], schema), b)
    job()(spark.createDataFrame(rows[2500:], schema), 2)
    got = {r["id"]: r["rapid_fire"] for r in job().flags(spark).collect()}
    assert got == {r["id"]: r["rapid_fire"] for r in whole.collect()}
    # Far behind the watermark: written, never flagged, held against nobody.
    late = [("busy", 10_000 + n, NOW) for n in range(30)]
    job()(spark.createDataFrame(late, schema), 3)
    told = job().flags(spark).where("id >= 10000").collect()
    assert len(told) == 30 and all(r["late"] and not r["rapid_fire"] for r in told)


def test_a_catalog_change_reaches_only_offers_with_its_keys(spark, tmp_path):
    from pricebook.streaming.jobs import CatalogRematch

    t = tables(spark)
    names = ["Zinc 50mg vial", "Copper drops", "Tin foil", "Zinc 50mg vial"]
    # One offer is published as product 70, with the same title as one of the queue.
    rows = [(n, 1, str(n), x, "B", "pending", None if n else 70) for n, x in enumerate(names)]
    offers = spark.createDataFrame(rows, "id bigint, merchant_id bigint, source_product_id string, product_title string, brand string, visibility_status string, canonical_product_id bigint")
    offers = offers.select(*[(F.col(f.name) if f.name in offers.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in sc.OFFERS])
    job = CatalogRematch(str(tmp_path), offers, t["memory"], t["canonicals"].withColumn("status", F.lit("retired")), t["ingredients"])
    same = t["canonicals"].withColumns({"status": F.lit("retired"), "display_name": F.lit("other")})
    job(same, 0)
    assert job.matches(spark, 1).count() == 0 and job._matches().before(spark, 1).count() == 0
    job(t["canonicals"], 1)
    reached = job._matches().before(spark, 2).collect()
    by_id = {r["id"]: r["product_title"] for r in offers.collect()}
    assert {by_id[r["id"]] for r in reached} == {"Zinc 50mg vial"}
    assert [(by_id[r["id"]], r["canonical_product_id"], r["match_tier"]) for r in job.matches(spark, 2).collect()] == [("Zinc 50mg vial", 70, "brand_title")]
    job(same, 2)
    assert job.matches(spark, 3).count() == 0


def test_price_changes_need_the_state_before(spark, tmp_path):
    from pricebook.streaming.jobs import PriceChanges

    job = PriceChanges(str(tmp_path / "p"), ["key"], lambda: F.date_trunc("week", "observed_at"))
    cols = "key string, observed_at timestamp, seq bigint, regular_price double, sale_price double, current_price double, stock_status string"

    def batch(*rows):
        return spark.createDataFrame([(key, NOW + timedelta(hours=h), n, None, None, price, "in_stock") for n, (key, h, price) in enumerate(rows)], cols)

    job(batch(("a", 0, 1.0), ("b", 0, 5.0)), 0)
    job(batch(("a", 1, 2.0), ("b", 1, 5.0), ("a", -5, 9.0)), 1)
    assert [(r["key"], r["old_current_price"], r["new_current_price"]) for r in job.events(spark).collect()] == [("a", 1.0, 2.0)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        job(batch(("a", 2, 3.0)), 7)
