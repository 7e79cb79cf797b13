"""Catalog reads: publish star, rollups, filters, sorts, documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from pricebook.operators import catalog as c, clicks as k
from pricebook.operators.validate import clean_canonicals, clean_ingredients, clean_merchants
from pricebook.session import materialize

from .base import FRESH_SQL, HIDE_HOURS, NOW, NOW_SQL, WARN_HOURS, query
from .data import Data

LIVE = f"visibility_status = 'active' AND {FRESH_SQL}"
EXPORT = f"""SELECT o.*, c.display_name, c.slug AS canonical_slug, c.ingredient_form AS canonical_form, i.name AS ingredient_name, i.category,
 i.alias, m.name AS merchant_name, m.slug AS merchant_slug
FROM v_costed o JOIN v_merchants m ON m.id = o.merchant_id AND m.status = 'active'
JOIN v_canonicals c ON c.id = o.canonical_product_id AND c.status <> 'retired'
JOIN v_ingredients i ON i.id = c.ingredient_id AND i.status <> 'retired'
WHERE o.{LIVE}""".replace("o.visibility", "o.visibility").replace("AND last_synced_at", "AND o.last_synced_at")


def export(spark, sf, min_active: int = 1):
    d = Data(spark, sf)
    return c.export_rows(d.costed, d.merchants, d.canonicals, d.ingredients, NOW, HIDE_HOURS, min_active)


@query(
    "cheapest_offer_per_canonical",
    f"""SELECT canonical_product_id, count(*) AS offer_count, min(cost_per_active_unit) AS lowest_cost_per_active_unit
FROM ({EXPORT}) e GROUP BY canonical_product_id""",
)
def flagship(spark, sf):
    return c.export_rollup(export(spark, sf))


@query(
    "unit_costs",
    "SELECT id, total_strength, active_compound_per_serving, active_compound_total, cost_per_serving, cost_per_active_unit FROM v_costed",
)
def unit_costs(spark, sf):
    return Data(spark, sf).costed.select(
        "id", "total_strength", "active_compound_per_serving", "active_compound_total", "cost_per_serving", "cost_per_active_unit"
    )


@query(
    "export_star",
    f"SELECT id, canonical_product_id, merchant_slug, canonical_slug, ingredient_name, cost_per_active_unit FROM ({EXPORT}) e",
)
def export_star(spark, sf):
    return export(spark, sf).select("id", "canonical_product_id", "merchant_slug", "canonical_slug", "ingredient_name", "cost_per_active_unit")


@query(
    "publish_gate",
    f"SELECT canonical_product_id FROM v_offers WHERE canonical_product_id IS NOT NULL AND {LIVE} GROUP BY 1 HAVING count(*) >= 20",
)
def publish_gate(spark, sf):
    return c.publish_gate(Data(spark, sf).offers, 20, NOW, HIDE_HOURS)


@query(
    "export_star_gated",
    f"""SELECT count(*) AS offers, count(DISTINCT canonical_product_id) AS products FROM ({EXPORT}) e WHERE canonical_product_id IN
(SELECT canonical_product_id FROM v_offers WHERE canonical_product_id IS NOT NULL AND {LIVE} GROUP BY 1 HAVING count(*) >= 20)""",
)
def export_gated(spark, sf):
    return export(spark, sf, 20).agg(F.count(F.lit(1)).alias("offers"), F.count_distinct("canonical_product_id").alias("products"))


@query(
    "export_order",
    f"""SELECT id, canonical_product_id, cost_per_active_unit FROM ({EXPORT}) e
ORDER BY canonical_product_id, cost_per_active_unit ASC NULLS FIRST, id""",
)
def export_order(spark, sf):
    return c.export_order(export(spark, sf)).select("id", "canonical_product_id", "cost_per_active_unit")


@query(
    "freshness",
    f"SELECT id, last_synced_at < {NOW_SQL} - INTERVAL 200 DAY AS is_stale FROM v_offers WHERE {FRESH_SQL}",
)
def freshness(spark, sf):
    return c.with_freshness(Data(spark, sf).offers, NOW, WARN_HOURS, HIDE_HOURS).select("id", "is_stale")


@query(
    "active_counts",
    f"SELECT canonical_product_id, count(*) AS active_offers FROM v_offers WHERE canonical_product_id IS NOT NULL AND {LIVE} GROUP BY 1",
)
def active_counts(spark, sf):
    return c.active_counts(Data(spark, sf).offers, NOW, HIDE_HOURS)


@query(
    "price_stats",
    f"""SELECT canonical_product_id, min(current_price) AS low, max(current_price) AS high, count(*) AS offers,
bool_or(stock_status = 'in_stock') AS any_in_stock, max(currency) AS currency FROM v_offers
WHERE canonical_product_id IS NOT NULL AND {LIVE} GROUP BY 1""",
)
def price_stats(spark, sf):
    return c.price_stats(Data(spark, sf).offers, NOW, HIDE_HOURS)


@query(
    "compare_list",
    f"""SELECT canonical_product_id, display_name, count(*) AS offers, count(DISTINCT merchant_id) AS merchants,
min(cost_per_active_unit) AS lowest_cost, arg_min(id, CAST(cost_per_active_unit AS DECIMAL(38,6)) * 1000000000000 + CAST(id AS DECIMAL(38,6)) / 1000000) AS lowest_offer_id
FROM ({EXPORT}) e GROUP BY 1, 2""".replace(
        "arg_min(id, CAST(cost_per_active_unit AS DECIMAL(38,6)) * 1000000000000 + CAST(id AS DECIMAL(38,6)) / 1000000)",
        "arg_min(id, {'c': cost_per_active_unit, 'i': id})",
    ),
)
def compare_list(spark, sf):
    return c.compare_list(export(spark, sf)).drop("lowest_price")


@query(
    "compare_list_filtered",
    f"""SELECT canonical_product_id, display_name, count(*) AS offers, count(DISTINCT merchant_id) AS merchants, min(cost_per_active_unit) AS lowest_cost
FROM ({EXPORT}) e WHERE stock_status = 'in_stock' AND third_party_tested AND (current_price IS NULL OR current_price >= 500)
AND (current_price IS NULL OR current_price <= 9000)
AND contains(lower(concat_ws(' ', product_title, brand, display_name, ingredient_name, alias)), 'gear') GROUP BY 1, 2""",
)
def compare_list_filtered(spark, sf):
    return c.compare_list(
        export(spark, sf), in_stock=True, third_party=True, min_price=500, max_price=9000, search="GEAR"
    ).drop("lowest_offer_id", "lowest_price")


@query(
    "filter_catalog",
    f"""SELECT id FROM ({EXPORT}) e WHERE coa_available AND merchant_slug = 'm-3' AND canonical_form = 'capsule'""",
)
def filter_catalog(spark, sf):
    return c.filter_catalog(export(spark, sf), coa=True, merchant="m-3", form="capsule").select("id")


@query("filter_detail", f"SELECT id FROM ({EXPORT}) e WHERE stock_status = 'in_stock' AND third_party_tested AND coa_available")
def filter_detail(spark, sf):
    return c.filter_detail(export(spark, sf), in_stock=True, third_party=True, coa=True).select("id")


@query(
    "page_stats",
    f"SELECT count(DISTINCT canonical_product_id) AS products, count(*) AS offers, count(DISTINCT merchant_id) AS merchants FROM ({EXPORT}) e",
)
def page_stats(spark, sf):
    return c.page_stats(export(spark, sf))


@query(
    "at_a_glance",
    f"""SELECT count(*) AS live_offers, count_if(stock_status = 'in_stock') AS in_stock, count_if(stock_status = 'out_of_stock') AS out_of_stock,
count_if(stock_status NOT IN ('in_stock', 'out_of_stock')) AS other_stock, count_if(new > old) AS price_up, count_if(new < old) AS price_down,
count_if(old IS NULL) AS unchanged, (SELECT count(*) FROM v_canonicals WHERE status <> 'retired') AS canonicals,
(SELECT count(*) FROM v_merchants) AS merchants, (SELECT count(*) FROM v_merchants WHERE status = 'active') AS active_merchants
FROM ({EXPORT}) e LEFT JOIN (SELECT offer_id, arg_max(old_current_price, {{'t': changed_at, 'i': id}}) AS old, arg_max(new_current_price, {{'t': changed_at, 'i': id}}) AS new
FROM v_history WHERE changed_at >= {NOW_SQL} - INTERVAL 300 DAY AND old_current_price > 0 AND abs(new_current_price - old_current_price) > 0.00005
GROUP BY 1) h ON h.offer_id = e.id""",
)
def at_a_glance(spark, sf):
    d = Data(spark, sf)
    return c.at_a_glance(d.costed, d.merchants, d.canonicals, d.ingredients, d.history, NOW, HIDE_HOURS, 300)


@query(
    "facets",
    f"""SELECT facet, value, min(label) AS label FROM (
SELECT 'form' AS facet, canonical_form AS value, canonical_form AS label FROM ({EXPORT}) e
UNION ALL SELECT 'ingredient', ingredient_name, ingredient_name FROM ({EXPORT}) e
UNION ALL SELECT 'merchant', merchant_slug, merchant_name FROM ({EXPORT}) e) x WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2""",
)
def facets(spark, sf):
    return c.facets(export(spark, sf))


INDEXABLE = f"""SELECT c.id, c.slug, n AS active_offers FROM v_canonicals c JOIN (SELECT canonical_product_id, count(*) AS n FROM v_offers
WHERE canonical_product_id IS NOT NULL AND {LIVE} GROUP BY 1) k ON k.canonical_product_id = c.id WHERE c.seo_indexable AND c.status <> 'retired' AND n >= 10"""


@query("indexable", INDEXABLE)
def indexable(spark, sf):
    d = Data(spark, sf)
    return c.indexable(d.canonicals, d.offers, NOW, 10, HIDE_HOURS).select("id", "slug", "active_offers")


@query(
    "sitemap_entries",
    f"SELECT concat('https://x.example/compare/', slug, '/') AS loc, '2001-01-01' AS lastmod, 'daily' AS changefreq FROM ({INDEXABLE}) i",
)
def sitemap_entries(spark, sf):
    d = Data(spark, sf)
    return c.sitemap_entries(d.canonicals, d.offers, NOW, "https://x.example/", 10, HIDE_HOURS)


@query(
    "aggregate_offer_markup",
    f"""SELECT c.id AS canonical_product_id, c.display_name AS name, k.low, k.high, k.n AS offers,
CASE WHEN k.stock THEN 'https://schema.org/InStock' ELSE 'https://schema.org/OutOfStock' END AS availability, i.category
FROM v_canonicals c JOIN (SELECT canonical_product_id, min(current_price) AS low, max(current_price) AS high, count(*) AS n,
bool_or(stock_status = 'in_stock') AS stock FROM v_offers WHERE canonical_product_id IS NOT NULL AND {LIVE} GROUP BY 1) k ON k.canonical_product_id = c.id
JOIN v_ingredients i ON i.id = c.ingredient_id""",
)
def aggregate_offer_markup(spark, sf):
    d = Data(spark, sf)
    m = c.aggregate_offer_markup(d.canonicals, d.ingredients, d.offers, NOW, HIDE_HOURS)

    def at(p, kind="string"):
        return F.get_json_object("markup", p).cast(kind)

    return m.select(
        "canonical_product_id", at("$.name").alias("name"), at("$.offers.lowPrice", "double").alias("low"),
        at("$.offers.highPrice", "double").alias("high"), at("$.offers.offerCount", "bigint").alias("offers"),
        at("$.offers.availability").alias("availability"), at("$.category").alias("category"),
    )


@query(
    "public_offer",
    f"""SELECT id, merchant_slug AS slug, brand, nullif(variant_title, '') AS variant_title, sale_price, on_sale,
concat('https://x.example/go/', CAST(id AS STRING)) AS buy_url, strftime(last_synced_at, '%Y-%m-%dT%H:%M:%SZ') AS last_synced_at,
last_synced_at < {NOW_SQL} - INTERVAL 200 DAY AS is_stale FROM ({EXPORT}) e""",
)
def public_offer(spark, sf):
    return c.public_offer(export(spark, sf), NOW, WARN_HOURS, "https://x.example").select(
        "id", "merchant.slug", "brand", "variant_title", "sale_price", "on_sale", "buy_url", "last_synced_at", "is_stale"
    )


@query(
    "public_canonical",
    f"""SELECT e.canonical_product_id AS id, c.slug, c.display_name, i.name AS ingredient_name, i.alias AS aliases, coalesce(c.ingredient_form, '') AS form,
c.strength_per_serving, c.standardization_compound, c.standardization_percentage, min(cost_per_active_unit) AS lowest, count(*) AS offer_count
FROM ({EXPORT}) e JOIN v_canonicals c ON c.id = e.canonical_product_id JOIN v_ingredients i ON i.id = c.ingredient_id GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9""",
)
def public_canonical(spark, sf):
    return c.public_canonical(export(spark, sf)).select(
        "id", "slug", "display_name", F.col("ingredient.name").alias("ingredient_name"), F.array_join("ingredient.aliases", "|").alias("aliases"),
        "form", "strength_per_serving", "standardization_compound", "standardization_percentage",
        F.col("lowest_cost_per_active_unit").alias("lowest"), "offer_count",
    )


@query(
    "export_catalog",
    f"""SELECT e.id, h.dir, h.pct FROM ({EXPORT}) e LEFT JOIN (SELECT offer_id, CASE WHEN new > old THEN 'up' ELSE 'down' END AS dir,
CAST(round(CAST(abs((new - old) / old) * 100 AS DECIMAL(30,12)), 2) AS DOUBLE) AS pct FROM (SELECT offer_id,
arg_max(old_current_price, {{'t': changed_at, 'i': id}}) AS old, arg_max(new_current_price, {{'t': changed_at, 'i': id}}) AS new FROM v_history
WHERE changed_at >= {NOW_SQL} - INTERVAL 30 DAY AND old_current_price > 0 AND abs(new_current_price - old_current_price) > 0.00005 GROUP BY 1) x) h ON h.offer_id = e.id""",
)
def export_catalog(spark, sf):
    _, offers = c.export_catalog(export(spark, sf), Data(spark, sf).history, NOW)
    return offers.select("id", "price_move.dir", "price_move.pct")


@query(
    "with_names",
    """SELECT o.id, m.name AS merchant_name, c.display_name AS canonical_display_name, i.name AS ingredient_name FROM v_offers o
LEFT JOIN v_merchants m ON m.id = o.merchant_id LEFT JOIN v_canonicals c ON c.id = o.canonical_product_id LEFT JOIN v_ingredients i ON i.id = o.ingredient_id""",
)
def with_names(spark, sf):
    d = Data(spark, sf)
    return c.with_names(d.offers, d.merchants, d.canonicals, d.ingredients).select("id", "merchant_name", "canonical_display_name", "ingredient_name")


@query(
    "query_offers",
    """SELECT id FROM v_offers WHERE visibility_status IN ('pending', 'needs_review') AND match_confidence >= 0.6
AND canonical_product_id IS NOT NULL AND (contains(lower(product_title), 'bolt') OR contains(lower(variant_title), 'bolt') OR contains(lower(brand), 'bolt') OR contains(lower(sku), 'bolt'))""",
)
def query_offers(spark, sf):
    return c.query_offers(Data(spark, sf).offers, ["pending", "needs_review"], min_confidence=0.6, has_canonical="yes", search="BOLT").select("id")


@query(
    "query_catalog_lists",
    """SELECT 'canonical' AS kind, id FROM v_canonicals WHERE status = 'active' AND ingredient_form = 'tablet' AND contains(lower(display_name), 'ring')
UNION ALL SELECT 'ingredient', id FROM v_ingredients WHERE category = 'vitamin' AND (contains(lower(name), 'ring-') OR contains(slug, 'ring-') OR contains(alias, 'ring-'))
UNION ALL SELECT 'merchant', id FROM v_merchants WHERE platform = 'shopify' AND status = 'active'""",
)
def query_lists(spark, sf):
    d = Data(spark, sf)
    a = c.query_canonicals(d.canonicals, status="active", form="tablet", search="ring").select(F.lit("canonical").alias("kind"), "id")
    b = c.query_ingredients(d.ingredients, category="vitamin", search="RING-").select(F.lit("ingredient").alias("kind"), "id")
    m = c.query_merchants(d.merchants, status="active", platform="shopify").select(F.lit("merchant").alias("kind"), "id")
    return a.unionByName(b).unionByName(m)


@query(
    "page_offers",
    "SELECT id, current_price FROM v_offers ORDER BY current_price ASC NULLS FIRST, id LIMIT 50 OFFSET 25",
)
def page_offers(spark, sf):
    return c.page_offers(Data(spark, sf).offers, "current_price", "asc", 50, 25).select("id", "current_price")


@query(
    "sort_detail",
    f"SELECT id, last_synced_at FROM ({EXPORT}) e ORDER BY last_synced_at DESC NULLS LAST, id",
)
def sort_detail(spark, sf):
    return c.sort_detail(export(spark, sf), "last_synced_at").select("id", "last_synced_at")


@query(
    "sort_list",
    f"""SELECT canonical_product_id, merchants FROM (SELECT canonical_product_id, count(DISTINCT merchant_id) AS merchants FROM ({EXPORT}) e GROUP BY 1) x
ORDER BY merchants DESC NULLS LAST, canonical_product_id""",
)
def sort_list(spark, sf):
    return c.sort_list(c.compare_list(export(spark, sf)), "merchant_count").select("canonical_product_id", "merchants")


def _positions(ordered, *columns):
    """The rows of an ordered table with their position: the place in the partition after all partitions before it."""
    rows = materialize(ordered.withColumn("_mid", F.monotonically_increasing_id()).select(*columns, "_mid"), "ordered").withColumn("_part", F.shiftright("_mid", 33))
    runs = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    runs = runs.withColumn("_base", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    return rows.join(runs, "_part").select(*columns, (F.col("_base") + F.col("_mid") - F.col("_first") + 1).alias("position"))


def _all_orders(keys: dict[str, str], tie: str) -> str:
    parts = [f"SELECT '{k}' AS sorted_by, '{d}' AS direction, {tie}, row_number() OVER (ORDER BY {e} {d} NULLS LAST, {tie}) AS position FROM e" for k, e in keys.items() for d in ("asc", "desc")]
    return " UNION ALL ".join(parts)


DETAIL_SQL = {k: {"merchant": "lower(coalesce(merchant_name, ''))", "brand": "lower(coalesce(brand, ''))"}.get(k, k) for k in c.DETAIL_KEYS}
LIST_SQL = {"display_name": "lower(coalesce(display_name, ''))", "cost_per_active_unit": "lowest_cost", "merchant_count": "merchants"}


@query("sort_detail_all", f", e AS ({EXPORT})\n{_all_orders(DETAIL_SQL, 'id')}", "v_costed v_merchants v_canonicals v_ingredients")
def sort_detail_all(spark, sf):
    rows = materialize(export(spark, sf).select("id", "merchant_name", *[k for k in c.DETAIL_KEYS if k != "merchant"]), "export")
    parts = [
        _positions(c.sort_detail(rows, k, d), "id").select(F.lit(k).alias("sorted_by"), F.lit(d).alias("direction"), "id", "position") for k in c.DETAIL_KEYS for d in ("asc", "desc")
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "sort_list_all",
    f""", e AS (SELECT canonical_product_id, display_name, count(DISTINCT merchant_id) AS merchants, min(cost_per_active_unit) AS lowest_cost FROM ({EXPORT}) x GROUP BY 1, 2)
{_all_orders(LIST_SQL, 'canonical_product_id')}""",
    "v_costed v_merchants v_canonicals v_ingredients",
)
def sort_list_all(spark, sf):
    rows = materialize(c.compare_list(export(spark, sf)), "list")
    parts = [
        _positions(c.sort_list(rows, k, d), "canonical_product_id").select(F.lit(k).alias("sorted_by"), F.lit(d).alias("direction"), "canonical_product_id", "position")
        for k in c.LIST_KEYS
        for d in ("asc", "desc")
    ]
    return reduce(DataFrame.unionByName, parts)


@query("recent_rows", "SELECT id, started_at FROM v_attempts ORDER BY id DESC LIMIT 50")
def recent_rows(spark, sf):
    return k.recent(Data(spark, sf).attempts, 50).select("id", "started_at")


@query(
    "list_canonicals",
    "SELECT c.id, c.display_name, i.name AS ingredient_name FROM v_canonicals c LEFT JOIN v_ingredients i ON i.id = c.ingredient_id",
)
def list_canonicals(spark, sf):
    d = Data(spark, sf)
    return c.list_canonicals(d.canonicals, d.ingredients).select("id", "display_name", "ingredient_name")


@query(
    "list_memory_and_suppressions",
    """SELECT 'memory' AS kind, o.title_key AS item, m.name AS merchant_name FROM v_memory o LEFT JOIN v_merchants m ON m.id = o.merchant_id
LEFT JOIN v_canonicals c ON c.id = o.canonical_product_id
WHERE contains(lower(title_key), 'rod') OR contains(lower(sample_title), 'rod') OR contains(lower(m.name), 'rod') OR contains(lower(c.display_name), 'rod')
UNION ALL SELECT 'suppression', s.source_product_id, m.name FROM v_suppressions s LEFT JOIN v_merchants m ON m.id = s.merchant_id
WHERE contains(lower(product_title), 'rod') OR contains(lower(brand), 'rod') OR contains(lower(source_product_id), 'rod') OR contains(lower(m.name), 'rod')""",
)
def list_memory(spark, sf):
    d = Data(spark, sf)
    a = c.list_memory(d.memory, d.merchants, d.canonicals, "rod").select(F.lit("memory").alias("kind"), F.col("title_key").alias("item"), "merchant_name")
    b = c.list_suppressions(d.suppressions, d.merchants, "rod").select(F.lit("suppression").alias("kind"), F.col("source_product_id").alias("item"), "merchant_name")
    return a.unionByName(b)


ORPHANS = """SELECT 'merchant' AS kind, id FROM v_merchants WHERE status = 'dead' AND id NOT IN (SELECT merchant_id FROM v_offers)
UNION ALL SELECT 'canonical', id FROM v_canonicals WHERE status = 'retired' AND id NOT IN (SELECT canonical_product_id FROM v_offers WHERE canonical_product_id IS NOT NULL AND visibility_status = 'rejected')
UNION ALL SELECT 'ingredient', id FROM v_ingredients WHERE status = 'retired' AND id NOT IN (SELECT ingredient_id FROM v_canonicals)"""


@query("orphans", ORPHANS)
def orphans(spark, sf):
    d = Data(spark, sf)
    dims = d.dims()
    rejected = d.offers.where("visibility_status = 'rejected'")
    out = [("merchant", d.offers), ("canonical", rejected), ("ingredient", rejected)]
    parts = [c.orphans(kind, dims, offers).select(F.lit(kind).alias("kind"), "id") for kind, offers in out]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "cleanup_counts",
    """SELECT 'rejected_offers' AS category, count_if(visibility_status = 'rejected') AS n FROM v_offers
UNION ALL SELECT 'dead_offers', count_if(visibility_status = 'dead') FROM v_offers
UNION ALL SELECT 'empty_dead_merchants', count(*) FROM v_merchants WHERE status = 'dead' AND id NOT IN (SELECT merchant_id FROM v_offers)
UNION ALL SELECT 'empty_retired_canonicals', count(*) FROM v_canonicals WHERE status = 'retired' AND id NOT IN (SELECT canonical_product_id FROM v_offers WHERE canonical_product_id IS NOT NULL)
UNION ALL SELECT 'empty_retired_ingredients', count(*) FROM v_ingredients WHERE status = 'retired' AND id NOT IN (SELECT ingredient_id FROM v_canonicals) AND id NOT IN (SELECT ingredient_id FROM v_offers)""",
)
def cleanup_counts(spark, sf):
    d = Data(spark, sf)
    return c.cleanup_counts(d.offers, d.dims())


# --- crawl attempts --------------------------------------------------------------------------------------------------


@query("open_attempts", "SELECT site_id, count(*) AS open, max(id) AS latest_id FROM v_attempts WHERE status IN ('pending', 'running') GROUP BY 1")
def open_attempts(spark, sf):
    return c.open_attempts(Data(spark, sf).attempts)


@query("attempts_by_status", "SELECT status, count(*) AS n FROM v_attempts WHERE started_at >= TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 2000 HOUR GROUP BY 1")
def attempts_by_status(spark, sf):
    from datetime import datetime

    return c.attempts_by_status(Data(spark, sf).attempts, datetime(2000, 1, 1), 2000)


@query(
    "stuck_runs",
    f"""SELECT id, site_id FROM v_attempts WHERE status = 'running' AND started_at < {NOW_SQL} - INTERVAL 1 YEAR
AND id NOT IN (SELECT l_orderkey FROM lineitem)""".replace("INTERVAL 1 YEAR", "INTERVAL 525600 MINUTE"),
)
def stuck_runs(spark, sf):
    d = Data(spark, sf)
    live = d.table("lineitem").select(F.col("l_orderkey").alias("id"))
    return c.stuck_runs(d.attempts, live, NOW, 525600).select("id", "site_id")


@query(
    "run_history",
    """SELECT a.id, a.status, m.name AS site_name FROM (SELECT * FROM v_attempts WHERE status = 'failed' ORDER BY id DESC LIMIT 100) a
LEFT JOIN v_merchants m ON m.id = a.site_id""",
)
def run_history(spark, sf):
    d = Data(spark, sf)
    return c.run_history(d.attempts, d.merchants, "failed", 100).select("id", "status", "site_name")


@query("run_durations", f"SELECT id, CAST(epoch(coalesce(finished_at, {NOW_SQL})) - epoch(started_at) AS BIGINT) AS seconds FROM v_attempts")
def run_durations(spark, sf):
    return c.run_durations(Data(spark, sf).attempts, NOW).select("id", "seconds")


@query(
    "last_run_by_site",
    "SELECT site_id, arg_max(status, id) AS status, arg_max(offer_count, id) AS offer_count FROM v_attempts GROUP BY 1",
)
def last_run_by_site(spark, sf):
    return c.last_run_by_site(Data(spark, sf).attempts).select("site_id", "status", "offer_count")


# --- catalog cleaning ------------------------------------------------------------------------------------------------


@query(
    "clean_catalog",
    """SELECT 'ingredient' AS kind, p_partkey AS id, CASE WHEN p_type = 'PROMO' THEN 'active' ELSE 'draft' END AS status,
CASE WHEN p_size % 2 = 0 THEN 'vitamin' ELSE 'other' END AS a, CASE WHEN p_size % 3 = 0 THEN 'IU' ELSE 'mg' END AS b, CAST(p_size AS DOUBLE) AS x FROM part
UNION ALL SELECT 'canonical', p_partkey, CASE WHEN p_type = 'PROMO' THEN 'active' ELSE 'draft' END, CASE WHEN p_size % 2 = 0 THEN 'gummy' END, NULL, NULL FROM part
UNION ALL SELECT 'merchant', s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'paused' ELSE 'active' END, concat('https://', s_name, '.example.com'), 'generic', NULL FROM supplier""",
)
def clean_catalog(spark, sf):
    d = Data(spark, sf)
    p = d.table("part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_type") == "PROMO", " Active ").otherwise("gone").alias("status"),
        F.when(F.col("p_size") % 2 == 0, "Vitamin").otherwise("?").alias("category"), F.when(F.col("p_size") % 3 == 0, " IU ").otherwise("oz").alias("default_unit"),
        F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("elemental_percentage"), F.lit(" ").alias("standardization_compound"),
        F.lit("").alias("standardization_default_pct"), F.when(F.col("p_size") % 2 == 0, "GUMMY").otherwise("").alias("ingredient_form"),
        F.lit("x").alias("strength_per_serving"),
    )
    s = d.table("supplier").select(
        F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "PAUSED").otherwise("odd").alias("status"), F.col("s_name").alias("name"),
        F.concat(F.lit(" "), "s_name", F.lit(".example.com// ")).alias("site_url"), F.lit("magento").alias("platform"),
    )
    i = clean_ingredients(p).select(F.lit("ingredient").alias("kind"), "id", "status", F.col("category").alias("a"), F.col("default_unit").alias("b"), F.col("elemental_percentage").alias("x"))
    q = clean_canonicals(p).select(
        F.lit("canonical").alias("kind"), "id", "status", F.col("ingredient_form").alias("a"), F.lit(None).cast("string").alias("b"), F.col("strength_per_serving").alias("x")
    )
    m = clean_merchants(s).select(F.lit("merchant").alias("kind"), "id", "status", F.col("site_url").alias("a"), F.col("platform").alias("b"), F.lit(None).cast("double").alias("x"))
    return i.unionByName(q).unionByName(m)
