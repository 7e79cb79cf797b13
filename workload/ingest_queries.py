"""Feed validation, ingest steps and the life cycle of stored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricebook.functions.costs import canonical_derived, reconcile_totals, seed_total
from pricebook.operators import lifecycle as lc, validate as v
from pricebook.plans import ingest as ing
from pricebook.schemas import KEY
from pricebook.session import materialize
from pricebook.settings import site_settings as settings_of
from pricebook.sources.feed import feed_metadata, union_feeds

from .base import NOW, NOW_SQL, ROUND, VIEWS, query, view
from .data import Data

# The first broken rule of a feed row, and the rows that pass all row rules and the merchant gate.
ERROR = """CASE WHEN trim(product_title) = '' THEN 'product_title is empty' WHEN lower(trim(source)) = 'ebay' THEN 'source is not allowed'
WHEN stock_status = 'gone' THEN 'stock_status is not allowed' WHEN sale_price = 'n/a' THEN 'sale_price is not a number'
WHEN length(currency) <> 3 THEN 'currency is not a 3-letter code' END"""
GATED = f"""SELECT f.*, m.id AS merchant_id, coalesce({ERROR}, CASE WHEN m.id IS NULL THEN 'unknown merchant' WHEN m.status <> 'active' THEN concat('merchant is ', m.status) END) AS error
FROM v_feed f LEFT JOIN v_merchants m ON lower(replace(m.site_url, '/', '')) = lower(replace(f.site, '/', ''))"""
CHECKED = f"""SELECT g.*, CASE WHEN error IS NULL AND row_num > first_row THEN concat('duplicate of row ', CAST(first_row AS STRING)) ELSE error END AS final_error
FROM (SELECT *, min(CASE WHEN error IS NULL THEN row_num END) OVER (PARTITION BY merchant_id, source_product_id, source_variant_id) AS first_row FROM ({GATED}) g0) g"""


def checked(spark, sf):
    d = Data(spark, sf)
    return v.validate_feed(d.feed, d.merchants)


@query("validate_rows", f"SELECT row_num, {ERROR} AS error FROM v_feed")
def validate_rows(spark, sf):
    return v.validate_rows(Data(spark, sf).feed).select("row_num", "error")


@query("resolve_merchants", f"SELECT row_num, merchant_id, error FROM ({GATED}) g")
def resolve_merchants(spark, sf):
    d = Data(spark, sf)
    return v.resolve_merchants(v.validate_rows(d.feed), d.merchants).select("row_num", "merchant_id", "error")


@query("flag_duplicate_keys", f"SELECT row_num, final_error AS error FROM ({CHECKED}) c")
def flag_duplicates(spark, sf):
    return checked(spark, sf).select("row_num", "error")


@query("feed_ok", f"SELECT count(*) AS rows, count(final_error) AS errors, count(final_error) = 0 AS ok FROM ({CHECKED}) c")
def feed_ok(spark, sf):
    return v.feed_ok(checked(spark, sf))


@query("missing_merchants", f"SELECT site, count(*) AS n FROM ({GATED}) g WHERE error = 'unknown merchant' GROUP BY 1")
def missing_merchants(spark, sf):
    return v.missing_merchants(checked(spark, sf))


@query(
    "error_sample",
    f"""SELECT run_id, row_num, error FROM (SELECT CAST(merchant_id AS STRING) AS run_id, row_num, final_error AS error,
row_number() OVER (PARTITION BY merchant_id ORDER BY row_num, final_error) AS rn FROM ({CHECKED}) c WHERE final_error IS NOT NULL AND merchant_id IS NOT NULL) x WHERE rn <= 25""",
)
def error_sample(spark, sf):
    rows = checked(spark, sf).where("merchant_id is not null").withColumn("run_id", F.col("merchant_id").cast("string"))
    return v.error_sample(rows)


@query("feed_metadata", "SELECT arg_min(export_run_id, row_num) AS export_run_id, CAST(arg_min(exported_at, row_num) AS TIMESTAMP) AS exported_at FROM v_feed")
def metadata(spark, sf):
    return feed_metadata(Data(spark, sf).feed)


@query(
    "union_feeds",
    """SELECT 'feed' AS origin, source_product_id, brand, '' AS handle FROM v_feed
UNION ALL SELECT 'parts', CAST(p_partkey AS STRING), '', p_name FROM part""",
)
def unioned(spark, sf):
    d = Data(spark, sf)
    a = d.feed.select(F.lit("feed").alias("origin"), "source_product_id", "brand")
    b = d.table("part").select(F.lit("parts").alias("origin"), F.col("p_partkey").cast("string").alias("source_product_id"), F.col("p_name").alias("handle"))
    return union_feeds(a, b)


@query(
    "to_offer_columns",
    """SELECT row_num, source AS source_platform, source_product_id, replace(product_title, '&amp;', '&') AS product_title, CAST(regular_price AS DOUBLE) AS regular_price,
lower(on_sale) IN ('true', '1') AS on_sale, upper(currency) AS currency, CASE WHEN stock_status = 'gone' THEN 'unknown' ELSE lower(stock_status) END AS stock_status, source_product_url
FROM v_feed""",
)
def offer_columns(spark, sf):
    rows = Data(spark, sf).feed
    out = v.to_offer_columns(v.decode_feed_text(rows))
    return out.select(
        "row_num", "source_platform", "source_product_id", "product_title", F.col("regular_price").cast("double").alias("regular_price"),
        "on_sale", "currency", "stock_status", "source_product_url",
    )


GOOD = f"SELECT * FROM ({CHECKED}) c WHERE final_error IS NULL"


def good(spark, sf):
    return checked(spark, sf).where("error is null")


@query(
    "split_insert_update",
    f"""SELECT g.row_num, o.id AS offer_id, CASE WHEN o.id IS NULL THEN 'insert' ELSE 'update' END AS action FROM ({GOOD}) g
LEFT JOIN (SELECT * FROM v_offers WHERE visibility_status <> 'needs_review') o ON o.merchant_id = g.merchant_id AND o.source_product_id = g.source_product_id AND o.source_variant_id = g.source_variant_id""",
)
def split_insert_update(spark, sf):
    known = Data(spark, sf).offers.where("visibility_status <> 'needs_review'")
    return lc.split_insert_update(good(spark, sf), known).select("row_num", "offer_id", "action")


@query(
    "drop_suppressed",
    f"""SELECT g.row_num, s.source_offer_id IS NOT NULL AS suppressed FROM ({GOOD}) g LEFT JOIN v_suppressions s
ON s.merchant_id = g.merchant_id AND s.source_product_id = g.source_product_id AND s.source_variant_id = g.source_variant_id""",
)
def drop_suppressed(spark, sf):
    # Both are read twice.
    rows, suppressions = materialize(good(spark, sf), "good"), materialize(Data(spark, sf).suppressions, "suppressions")
    kept = lc.drop_suppressed(rows, suppressions).select("row_num", F.lit(False).alias("suppressed"))
    return kept.unionByName(lc.suppressed_rows(rows, suppressions).select("row_num", F.lit(True).alias("suppressed")))


@query(
    "dry_run",
    f"""SELECT count_if(o.id IS NULL) AS inserted, count_if(o.id IS NOT NULL) AS updated FROM ({GOOD}) g
LEFT JOIN (SELECT * FROM v_offers WHERE visibility_status <> 'needs_review') o ON o.merchant_id = g.merchant_id AND o.source_product_id = g.source_product_id AND o.source_variant_id = g.source_variant_id
LEFT JOIN v_suppressions s ON s.merchant_id = g.merchant_id AND s.source_product_id = g.source_product_id AND s.source_variant_id = g.source_variant_id WHERE s.source_offer_id IS NULL""",
)
def dry_run(spark, sf):
    d = Data(spark, sf)
    return lc.dry_run(good(spark, sf), d.offers.where("visibility_status <> 'needs_review'"), d.suppressions)


@query(
    "raw_snapshot",
    f"SELECT 7 AS import_run_id, merchant_id, source_product_id, site, product_title, sku FROM ({GOOD}) g",
)
def raw_snapshot(spark, sf):
    raw = ing.raw_rows(good(spark, sf), 7, NOW)
    cells = [F.get_json_object("raw_json", f"$.{c}").alias(c) for c in ("site", "product_title", "sku")]
    return raw.select("import_run_id", "merchant_id", "source_product_id", *cells)


OUTCOMES = f"""SELECT CASE WHEN merchant_id IS NULL THEN -1 ELSE merchant_id END AS run_id, row_num, final_error,
CASE WHEN final_error IS NOT NULL THEN 'errored' WHEN row_num % 2 = 0 THEN 'inserted' ELSE 'updated' END AS outcome FROM ({CHECKED}) c"""


def outcomes(spark, sf):
    rows = checked(spark, sf).withColumn("run_id", F.coalesce("merchant_id", F.lit(-1)))
    return rows.withColumn("outcome", F.when(F.col("error").isNotNull(), "errored").when(F.col("row_num") % 2 == 0, "inserted").otherwise("updated"))


@query(
    "run_counters",
    f"""SELECT run_id, count_if(outcome = 'inserted') AS inserted, count_if(outcome = 'updated') AS updated, count_if(outcome = 'suppressed') AS suppressed,
count_if(outcome = 'stale') AS stale, count_if(outcome = 'errored') AS errored FROM ({OUTCOMES}) o GROUP BY 1""",
)
def run_counters(spark, sf):
    return lc.run_counters(outcomes(spark, sf))


@query(
    "close_run",
    f"""SELECT o.run_id, count_if(outcome = 'errored') AS errored, coalesce(max(l.error_log), '') AS error_log FROM ({OUTCOMES}) o LEFT JOIN (
SELECT run_id, concat(string_agg(line, chr(10) ORDER BY row_num, line) FILTER (rn <= 50), CASE WHEN count(*) > 50 THEN concat(chr(10), '… and ', CAST(count(*) - 50 AS STRING), ' more') ELSE '' END) AS error_log
FROM (SELECT run_id, row_num, concat('row ', CAST(row_num AS STRING), ': ', final_error) AS line, row_number() OVER (PARTITION BY run_id ORDER BY row_num, final_error) AS rn
FROM ({OUTCOMES}) b WHERE final_error IS NOT NULL) e GROUP BY 1) l ON l.run_id = o.run_id GROUP BY 1""",
)
def close_run(spark, sf):
    rows = outcomes(spark, sf)
    return ing.close_run(rows.select("run_id", "outcome"), rows).select("run_id", "errored", "error_log")


# --- state changes ---------------------------------------------------------------------------------------------------


@query(
    "mark_stale",
    """SELECT id, CASE WHEN goes THEN 'stale' ELSE visibility_status END AS visibility_status, CASE WHEN goes THEN visibility_status ELSE pre_stale_status END AS pre_stale_status
FROM (SELECT *, merchant_id IN (SELECT id FROM v_merchants WHERE platform = 'shopify') AND last_seen_import_run_id <> 12345
AND visibility_status IN ('pending', 'active', 'needs_review') AS goes FROM v_offers) x""",
)
def mark_stale(spark, sf):
    d = Data(spark, sf)
    part = d.merchants.where("platform = 'shopify'").select(F.col("id").alias("merchant_id"))
    return lc.mark_stale(d.offers, 12345, part, NOW).select("id", "visibility_status", "pre_stale_status")


@query(
    "restore_status",
    "SELECT id, CASE WHEN visibility_status <> 'stale' THEN visibility_status WHEN pre_stale_status IN ('active', 'pending', 'needs_review') THEN pre_stale_status ELSE 'pending' END AS status FROM v_offers",
)
def restore_status(spark, sf):
    return Data(spark, sf).offers.select("id", lc.restore_status(F.col("visibility_status"), F.col("pre_stale_status")).alias("status"))


@query(
    "set_visibility",
    f"""SELECT id, CASE WHEN merchant_id = 3 THEN 'rejected' WHEN merchant_id = 4 THEN visibility_status ELSE visibility_status END AS visibility_status,
CASE WHEN merchant_id = 3 THEN {NOW_SQL} ELSE updated_at END AS updated_at FROM v_offers""",
)
def set_visibility(spark, sf):
    o = Data(spark, sf).offers
    a = o.where("merchant_id = 3").select("id", F.lit("paused").alias("visibility"), F.lit(1).alias("seq"))
    b = o.where("merchant_id = 3").select("id", F.lit("rejected").alias("visibility"), F.lit(2).alias("seq"))
    x = o.where("merchant_id = 4").select("id", F.lit("nonsense").alias("visibility"), F.lit(3).alias("seq"))
    return lc.set_visibility(o, a.unionByName(b).unionByName(x), NOW).select("id", "visibility_status", "updated_at")


@query(
    "backfill_owned_fields",
    "SELECT id, CASE WHEN partkey % 12 = 0 OR total_active_per_container IS NOT NULL THEN 'total_active_per_container' ELSE '' END AS owned FROM v_offers",
)
def backfill_owned(spark, sf):
    return lc.backfill_owned_fields(Data(spark, sf).offers).select("id", F.array_join("operator_fields", "|").alias("owned"))


EDIT_TOTAL = "CASE WHEN partkey % 15 = 0 THEN total_active_per_container WHEN partkey % 3 = 0 THEN CAST(500 AS DOUBLE) END"


@query(
    "curator_edit",
    f"""SELECT id, new_total AS total_active_per_container, CASE WHEN total_moved THEN NULL ELSE total_active_source END AS total_active_source,
concat_ws('|', CASE WHEN total_moved THEN 'total_active_per_container' END) AS changed,
CASE WHEN partkey % 12 = 0 OR total_moved THEN 'total_active_per_container' ELSE '' END AS owned,
CASE WHEN new_total > 0 THEN {ROUND("new_total", 4)} ELSE {ROUND("strength_per_serving * servings_per_container", 4)} END AS total_strength,
partkey % 3 = 0 AND canonical_product_id IS NULL AS learns
FROM (SELECT *, CASE WHEN partkey % 3 = 0 THEN {EDIT_TOTAL} ELSE total_active_per_container END AS new_total,
partkey % 3 = 0 AND coalesce(total_active_per_container <> {EDIT_TOTAL}, (total_active_per_container IS NULL) <> ({EDIT_TOTAL} IS NULL)) AS total_moved FROM v_offers) x""",
)
def curator_edit(spark, sf):
    d = Data(spark, sf)
    o = d.costed
    target = F.when(F.col("partkey") % 15 == 0, F.col("total_active_per_container")).otherwise(F.lit(500.0))
    edits = o.where("partkey % 3 = 0").select(
        "id", target.alias("total_active_per_container"), F.coalesce("canonical_product_id", F.lit(1)).alias("canonical_product_id")
    )
    out = lc.curator_edit(o.drop("standardization_default_pct", "elemental_percentage"), edits, d.ingredients, NOW)
    return out.select(
        "id", "total_active_per_container", "total_active_source", F.array_join("changed", "|").alias("changed"),
        F.array_join("operator_fields", "|").alias("owned"), "total_strength", "learns",
    )


@query(
    "clean_curator_edits",
    """SELECT l_orderkey * 8 + l_linenumber AS id, CASE WHEN l_partkey % 2 = 0 THEN 'capsule' END AS ingredient_form, CASE WHEN l_partkey % 3 = 0 THEN 'IU' END AS strength_unit,
CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS strength_per_serving, least(1.0, greatest(0.0, l_quantity / 25)) AS match_confidence,
CASE WHEN l_partkey % 2 = 0 THEN 'GMP|NSF' ELSE 'A|B' END AS certifications, l_returnflag = 'R' AS coa_available FROM lineitem""",
)
def clean_edits(spark, sf):
    li = Data(spark, sf).table("lineitem")
    even = F.col("l_partkey") % 2 == 0
    raw = li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.when(even, "Capsule").otherwise("pill").alias("ingredient_form"),
        F.when(F.col("l_partkey") % 3 == 0, "IU").otherwise("oz").alias("strength_unit"),
        F.when(F.col("l_linenumber") == 1, " ").otherwise(F.col("l_quantity").cast("string")).alias("strength_per_serving"),
        (F.col("l_quantity") / 25).cast("string").alias("match_confidence"),
        F.when(even, '["GMP", " NSF ", ""]').otherwise(" A ; B,").alias("certifications"),
        F.when(F.col("l_returnflag") == "R", "Yes").otherwise("no").alias("coa_available"),
    )
    return v.clean_curator_edits(raw).withColumn("certifications", F.array_join("certifications", "|"))


@query(
    "owned_fields",
    "SELECT id, CASE WHEN partkey % 12 = 0 THEN 'total_active_per_container|strength_unit' ELSE 'strength_unit' END AS owned FROM v_offers",
)
def owned_fields(spark, sf):
    changed = F.array(F.lit("strength_unit"), F.lit("brand"))
    return Data(spark, sf).offers.select("id", F.array_join(v.owned_fields(F.col("operator_fields"), changed), "|").alias("owned"))


KEYS = "merchant_id, source_product_id, source_variant_id"


@query(
    "suppress",
    f"""SELECT {KEYS}, CASE WHEN visibility_status = 'pending' THEN 'manual' ELSE 'rejected_cleanup' END AS reason,
CASE WHEN visibility_status = 'pending' THEN {NOW_SQL} ELSE updated_at END AS suppressed_at FROM v_offers WHERE visibility_status IN ('rejected', 'pending')""",
)
def suppress(spark, sf):
    d = Data(spark, sf)
    keys = d.offers.where("visibility_status = 'pending'").withColumn("source_offer_id", F.col("id"))
    once = lc.suppress(d.suppressions, keys, "manual", NOW)
    return lc.suppress(once, keys, "manual", NOW).select(*KEYS.split(", "), "reason", "suppressed_at")


@query("lift", f"SELECT {KEYS} FROM v_suppressions WHERE merchant_id <> 5")
def lift(spark, sf):
    s = Data(spark, sf).suppressions
    return lc.lift(s, s.where("merchant_id = 5")).select(*KEYS.split(", "))


@query(
    "upsert_catalog",
    """SELECT coalesce(i.slug, n.slug) AS slug, coalesce(nullif(n.name, ''), i.name) AS name, coalesce(i.category, '') AS category, i.id IS NULL AS is_new
FROM v_ingredients i FULL OUTER JOIN (SELECT replace(p_name, ' ', '-') AS slug, max(CASE WHEN p_type = 'PROMO' THEN upper(p_name) ELSE '' END) AS name FROM part GROUP BY 1
UNION ALL SELECT lower(n_name), n_name FROM nation) n ON n.slug = i.slug""",
)
def upsert_catalog(spark, sf):
    d = Data(spark, sf)
    now = d.ingredients.select("id", "slug", "name", "category")
    parts = d.table("part").select(F.regexp_replace("p_name", " ", "-").alias("slug"), F.when(F.col("p_type") == "PROMO", F.upper("p_name")).otherwise("").alias("name"))
    new = parts.unionByName(d.table("nation").select(F.lower("n_name").alias("slug"), F.col("n_name").alias("name")))
    top = now.agg(F.max("id")).first()[0]
    return lc.upsert_catalog(now, new).select("slug", "name", F.coalesce("category", F.lit("")).alias("category"), (F.col("id") > top).alias("is_new"))


@query(
    "delete_impact",
    """SELECT 'merchant' AS kind, m.id, coalesce(o.n, 0) AS offers, coalesce(h.n, 0) AS history_rows, coalesce(c.n, 0) AS clicks FROM v_merchants m
LEFT JOIN (SELECT merchant_id, count(*) AS n FROM v_offers GROUP BY 1) o ON o.merchant_id = m.id
LEFT JOIN (SELECT merchant_id, count(*) AS n FROM v_history h JOIN v_offers o ON o.id = h.offer_id GROUP BY 1) h ON h.merchant_id = m.id
LEFT JOIN (SELECT merchant_id, count(*) AS n FROM v_clicks GROUP BY 1) c ON c.merchant_id = m.id
UNION ALL SELECT 'offer', o.id, 1, coalesce(h.n, 0), coalesce(c.n, 0) FROM v_offers o
LEFT JOIN (SELECT offer_id, count(*) AS n FROM v_history GROUP BY 1) h ON h.offer_id = o.id LEFT JOIN (SELECT offer_id, count(*) AS n FROM v_clicks GROUP BY 1) c ON c.offer_id = o.id
WHERE o.visibility_status = 'rejected'
UNION ALL SELECT 'canonical', k.id, coalesce(o.n, 0), 0, coalesce(c.n, 0) FROM v_canonicals k LEFT JOIN (SELECT canonical_product_id, count(*) AS n FROM v_offers GROUP BY 1) o
ON o.canonical_product_id = k.id LEFT JOIN (SELECT canonical_product_id, count(*) AS n FROM v_clicks GROUP BY 1) c ON c.canonical_product_id = k.id
UNION ALL SELECT 'ingredient', i.id, coalesce(o.n, 0), coalesce(k.n, 0), 0 FROM v_ingredients i LEFT JOIN (SELECT ingredient_id, count(*) AS n FROM v_offers GROUP BY 1) o
ON o.ingredient_id = i.id LEFT JOIN (SELECT ingredient_id, count(*) AS n FROM v_canonicals GROUP BY 1) k ON k.ingredient_id = i.id""",
)
def delete_impact(spark, sf):
    # Every table is counted several times: what the counts ask of it is written once.
    history = materialize(Data(spark, sf).history.select("offer_id"), "history")
    d = Data(spark, sf, keep=True)
    offers = materialize(d.offers.select("id", *KEY, "canonical_product_id", "ingredient_id", "visibility_status"), "offers")
    t = {"offers": offers, "history": history, "raw": d.raw, "clicks": materialize(d.clicks, "clicks"), "canonicals": d.canonicals}
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    m = lc.delete_impact("merchant", d.merchants, t).select(F.lit("merchant").alias("kind"), "id", "offers", "history_rows", "clicks")
    o = lc.delete_impact("offer", offers.where("visibility_status = 'rejected'"), t).select(F.lit("offer").alias("kind"), "id", one.alias("offers"), "history_rows", "clicks")
    c = lc.delete_impact("canonical", d.canonicals, t).select(F.lit("canonical").alias("kind"), "id", "offers", zero.alias("history_rows"), "clicks")
    i = lc.delete_impact("ingredient", d.ingredients, t).select(F.lit("ingredient").alias("kind"), "id", "offers", F.col("canonicals").alias("history_rows"), zero.alias("clicks"))
    return m.unionByName(o).unionByName(c).unionByName(i)


@query(
    "delete_cascade",
    """SELECT 'offers' AS tbl, count(*) AS n FROM v_offers WHERE visibility_status <> 'rejected'
UNION ALL SELECT 'history', count(*) FROM v_history WHERE offer_id NOT IN (SELECT id FROM v_offers WHERE visibility_status = 'rejected')
UNION ALL SELECT 'suppressions', count(*) FROM v_offers WHERE visibility_status = 'rejected'
UNION ALL SELECT 'clicks_with_offer', count(*) FROM v_clicks WHERE offer_id NOT IN (SELECT id FROM v_offers WHERE visibility_status = 'rejected')
UNION ALL SELECT 'clicks', count(*) FROM v_clicks UNION ALL SELECT 'raw', count(*) FROM v_offers WHERE visibility_status <> 'rejected'""",
)
def delete_cascade(spark, sf):
    d = Data(spark, sf, keep=True)
    offers = materialize(d.offers, "offers")
    t = {"offers": offers, "history": d.history, "raw": d.raw_of(offers), "clicks": d.clicks, "suppressions": d.suppressions}
    out = lc.delete_cascade("offer", offers, t, NOW)
    out["clicks_with_offer"] = out["clicks"].where("offer_id is not null")
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in out.items()]
    total = parts[0]
    for x in parts[1:]:
        total = total.unionByName(x)
    return total


DEAD, RETIRED = "(SELECT id FROM v_merchants WHERE status = 'dead')", "(SELECT id FROM v_canonicals WHERE status = 'retired')"
LOOSE = "(SELECT id FROM v_ingredients WHERE status = 'retired' AND id % 2 = 1)"


@query(
    "delete_cascade_kinds",
    f"""SELECT 'merchant' AS kind, 'merchants' AS tbl, count(*) AS n, count(*) AS refs FROM v_merchants WHERE status <> 'dead'
UNION ALL SELECT 'merchant', 'offers', count(*), count(*) FROM v_offers WHERE merchant_id NOT IN {DEAD}
UNION ALL SELECT 'merchant', 'history', count(*), count(*) FROM v_history h JOIN v_offers o ON o.id = h.offer_id WHERE o.merchant_id NOT IN {DEAD}
UNION ALL SELECT 'merchant', 'raw', count(*), count(*) FROM v_offers WHERE merchant_id NOT IN {DEAD}
UNION ALL SELECT 'merchant', 'clicks', count(*), count(CASE WHEN merchant_id IS NOT NULL AND merchant_id NOT IN {DEAD} THEN 1 END) FROM v_clicks
UNION ALL SELECT 'merchant', 'click offers', count(*), count(CASE WHEN offer_id IS NOT NULL AND offer_id NOT IN (SELECT id FROM v_offers WHERE merchant_id IN {DEAD}) THEN 1 END) FROM v_clicks
UNION ALL SELECT 'canonical', 'canonicals', count(*), count(*) FROM v_canonicals WHERE status <> 'retired'
UNION ALL SELECT 'canonical', 'offers', count(*), count(CASE WHEN canonical_product_id IS NOT NULL AND canonical_product_id NOT IN {RETIRED} THEN 1 END) FROM v_offers
UNION ALL SELECT 'canonical', 'clicks', count(*), count(CASE WHEN canonical_product_id IS NOT NULL AND canonical_product_id NOT IN {RETIRED} THEN 1 END) FROM v_clicks
UNION ALL SELECT 'canonical', 'memory', count(*), count(*) FROM v_memory WHERE canonical_product_id NOT IN {RETIRED}
UNION ALL SELECT 'ingredient', 'ingredients', count(*), count(*) FROM v_ingredients WHERE id NOT IN {LOOSE}
UNION ALL SELECT 'ingredient', 'offers', count(*), count(CASE WHEN ingredient_id IS NOT NULL AND ingredient_id NOT IN {LOOSE} THEN 1 END) FROM v_offers""",
)
def delete_cascade_kinds(spark, sf):
    d = Data(spark, sf, keep=True)
    offers, clicks = materialize(d.offers, "offers"), materialize(d.clicks, "clicks")
    t = {"offers": offers, "history": d.history, "raw": d.raw_of(offers), "clicks": clicks, "suppressions": d.suppressions, "memory": d.memory, "merchants": d.merchants, "ingredients": d.ingredients}

    def told(kind, tbl, df, ref=None):
        refs = F.count(F.lit(1) if ref is None else F.col(ref))
        return df.agg(F.count(F.lit(1)).alias("n"), refs.alias("refs")).select(F.lit(kind).alias("kind"), F.lit(tbl).alias("tbl"), "n", "refs")

    # Everything is asked for; what may not go, stays.
    m = lc.delete_cascade("merchant", d.merchants, t, NOW)
    k = lc.delete_cascade("canonical", d.canonicals, {**t, "canonicals": d.canonicals}, NOW)
    # Only even ingredients are in use.
    i = lc.delete_cascade("ingredient", d.ingredients, {**t, "canonicals": d.canonicals.where("ingredient_id % 2 = 0")}, NOW)
    parts = [
        told("merchant", "merchants", m["merchants"]), told("merchant", "offers", m["offers"]), told("merchant", "history", m["history"]), told("merchant", "raw", m["raw"]),
        told("merchant", "clicks", m["clicks"], "merchant_id"), told("merchant", "click offers", m["clicks"], "offer_id"),
        told("canonical", "canonicals", k["canonicals"]), told("canonical", "offers", k["offers"], "canonical_product_id"), told("canonical", "clicks", k["clicks"], "canonical_product_id"),
        told("canonical", "memory", k["memory"]), told("ingredient", "ingredients", i["ingredients"]), told("ingredient", "offers", i["offers"], "ingredient_id"),
    ]
    total = parts[0]
    for x in parts[1:]:
        total = total.unionByName(x)
    return total


@query(
    "potential_duplicates",
    """SELECT merchant_id, source_product_id, count_if(source_variant_id = '') AS blank_offers, count_if(source_variant_id <> '') AS variant_offers, true AS same_url, 2 AS confidence
FROM v_offers GROUP BY 1, 2 HAVING count_if(source_variant_id = '') > 0 AND count_if(source_variant_id <> '') > 0""",
)
def potential_duplicates(spark, sf):
    return lc.potential_duplicates(Data(spark, sf).offers)


@query(
    "canonical_derived",
    f"""SELECT c.id, CASE WHEN strength_per_serving > 0 AND servings_per_container > 0 THEN {ROUND("strength_per_serving * servings_per_container", 4)} END AS total_strength,
coalesce({ROUND("strength_per_serving * (coalesce(standardization_percentage, i.standardization_default_pct, i.elemental_percentage) / 100)", 4)}, strength_per_serving) AS active_compound_per_serving,
i.name || coalesce(' ' || CAST(CAST(strength_per_serving AS BIGINT) AS STRING) || 'mg', '')
|| coalesce(' ' || upper(substr(ingredient_form, 1, 1)) || substr(ingredient_form, 2) || CASE WHEN ingredient_form = 'powder' THEN '' ELSE 's' END, '') AS derived_name
FROM v_canonicals c JOIN v_ingredients i ON i.id = c.ingredient_id""",
)
def derived(spark, sf):
    d = Data(spark, sf)
    return canonical_derived(d.canonicals, d.ingredients).select("id", "total_strength", "active_compound_per_serving", "derived_name")


@query(
    "reconcile_totals",
    """SELECT id, total_active_per_container AS total, CASE WHEN total_active_per_container > 0 THEN total_active_per_container / servings_per_container ELSE strength_per_serving END AS strength,
coalesce(total_active_per_container, strength_per_serving * servings_per_container) AS seed FROM v_offers""",
)
def reconcile(spark, sf):
    o = Data(spark, sf).offers
    seed = seed_total(F.col("total_active_per_container"), F.lit(None).cast("double"), F.col("strength_per_serving"), F.col("servings_per_container"))
    return reconcile_totals(o.withColumn("seed", seed)).select("id", F.col("total_active_per_container").alias("total"), F.col("strength_per_serving").alias("strength"), "seed")


# Every customer is a site; its options are stored as text, some out of range, some not stored.
VIEWS["v_site_options"] = """
SELECT c_custkey AS site_id, 'currency' AS name, CASE c_custkey % 6 WHEN 0 THEN 'eur' WHEN 1 THEN ' g-b-p ' WHEN 2 THEN 'Dollars' WHEN 3 THEN '12'
    WHEN 4 THEN '' ELSE concat('x', substr(c_mktsegment, 1, 2)) END AS value FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT c_custkey, 'default_view', CASE c_custkey % 5 WHEN 0 THEN 'cost_per_serving' WHEN 1 THEN 'Cost_Per_Serving !' WHEN 2 THEN 'cost-per-serving'
    WHEN 3 THEN '' ELSE 'cost_per_active_unit' END FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, 'warn_hours', CAST(c_custkey % 97 - 48 AS STRING) FROM customer WHERE c_custkey % 5 <> 1
UNION ALL SELECT c_custkey, 'hide_hours', concat(' ', CAST(c_custkey % 400 AS STRING), ' h') FROM customer WHERE c_custkey % 5 <> 2
UNION ALL SELECT c_custkey, 'price_move_days', CASE WHEN c_custkey % 4 = 0 THEN 'never' ELSE CAST(c_custkey * 37 % 9000 AS STRING) END FROM customer WHERE c_custkey % 5 <> 3
UNION ALL SELECT c_custkey, 'min_offers_to_publish', CAST(c_custkey % 150 AS STRING) FROM customer WHERE c_custkey % 5 <> 4
UNION ALL SELECT c_custkey, 'stale_minutes', concat(CAST(c_custkey % 3000 AS STRING), '.9') FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT c_custkey, 'unknown', 'kept out' FROM customer"""

# The numbers behind the stored texts, moved into their ranges.
SITE_SETTINGS = """
SELECT c_custkey AS site_id,
  CASE WHEN c_custkey % 7 = 0 THEN 'USD' ELSE CASE c_custkey % 6 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' WHEN 2 THEN 'DOL' WHEN 3 THEN 'USD' WHEN 4 THEN 'USD'
    ELSE upper(concat('x', substr(c_mktsegment, 1, 2))) END END AS currency,
  CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 IN (0, 1) THEN 'cost_per_serving' ELSE 'cost_per_active_unit' END AS default_view,
  CAST(CASE WHEN c_custkey % 5 = 1 THEN 48 ELSE greatest(1, abs(c_custkey % 97 - 48)) END AS BIGINT) AS warn_hours,
  CAST(CASE WHEN c_custkey % 5 = 2 THEN 168 ELSE greatest(1, c_custkey % 400) END AS BIGINT) AS hide_hours,
  CAST(CASE WHEN c_custkey % 5 = 3 THEN 30 WHEN c_custkey % 4 = 0 THEN 0 ELSE least(3650, c_custkey * 37 % 9000) END AS BIGINT) AS price_move_days,
  CAST(CASE WHEN c_custkey % 5 = 4 THEN 1 ELSE least(100, greatest(1, c_custkey % 150)) END AS BIGINT) AS min_offers_to_publish,
  CAST(CASE WHEN c_custkey % 5 = 0 THEN 30 ELSE least(1440, greatest(5, c_custkey % 3000)) END AS BIGINT) AS stale_minutes
FROM customer"""


@query("site_settings", SITE_SETTINGS)
def site_settings(spark, sf):
    return settings_of(view(spark, sf, "v_site_options"))
