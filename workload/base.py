"""The driver's star schema seen as a price-comparison data set.

Each view is one SQL text that both engines run: nations are merchants, part names
are ingredients, part name and type are catalog products, line items are price
observations and events are clicks.  Listing text is built from known numbers, so
the expected result of a text rule is arithmetic on those numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

# The clock of every query: some days before the last observation.
NOW = datetime(2001, 9, 1)
NOW_SQL = "TIMESTAMP '2001-09-01 00:00:00'"
HIDE_HOURS = 24 * 400
WARN_HOURS = 24 * 200
FRESH_SQL = f"last_synced_at >= {NOW_SQL} - INTERVAL 400 DAY"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {}

VIEWS["v_merchants"] = """
SELECT CAST(n_nationkey AS BIGINT) AS id, concat('m-', CAST(n_nationkey AS STRING)) AS slug, n_name AS name,
  concat('https://m', CAST(n_nationkey AS STRING), '.example.com') AS site_url,
  CASE n_nationkey % 3 WHEN 0 THEN 'shopify' WHEN 1 THEN 'woocommerce' ELSE 'generic' END AS platform,
  CASE n_nationkey WHEN 9 THEN 'paused' WHEN 17 THEN 'dead' ELSE 'active' END AS status,
  CASE n_nationkey % 4 WHEN 0 THEN '{product_url}?aff=7' WHEN 1 THEN 'https://go.example.net/?u={url_encoded_product_url}'
    WHEN 2 THEN 'https://go.example.net/{handle}' ELSE '' END AS affiliate_url_template
FROM nation"""

VIEWS["v_ingredients"] = """
SELECT id, replace(name, ' ', '-') AS slug, name, concat(split_part(name, ' ', 2), '-', split_part(name, ' ', 1)) AS alias,
  CASE WHEN id % 5 = 0 THEN CAST(14.1 AS DOUBLE) END AS elemental_percentage,
  CASE WHEN id % 7 = 0 THEN CAST(50 AS DOUBLE) END AS standardization_default_pct,
  CASE WHEN id % 11 = 0 THEN 'retired' ELSE 'active' END AS status, 'mg' AS default_unit,
  CASE id % 3 WHEN 0 THEN 'mineral' WHEN 1 THEN 'vitamin' ELSE 'sports' END AS category
FROM (SELECT min(p_partkey) + 1 AS id, p_name AS name FROM part GROUP BY p_name) d"""

VIEWS["v_canonicals"] = """
SELECT c.id, concat(replace(c.p_name, ' ', '-'), '-', lower(c.p_type)) AS slug, concat(c.p_name, ' ', c.p_type) AS display_name,
  c.p_name, c.p_type, i.id AS ingredient_id,
  CASE c.p_type WHEN 'LARGE' THEN 'capsule' WHEN 'MEDIUM' THEN 'tablet' WHEN 'PROMO' THEN 'powder' WHEN 'SMALL' THEN 'softgel' END AS ingredient_form,
  CASE WHEN c.id % 4 = 0 THEN CAST(c.size * 10 AS DOUBLE) END AS strength_per_serving,
  CASE WHEN c.id % 4 = 0 THEN CAST(30 AS BIGINT) END AS servings_per_container,
  CASE WHEN c.id % 9 = 0 THEN CAST(25 AS DOUBLE) END AS standardization_percentage,
  CASE WHEN c.id % 9 = 0 THEN 'extract' END AS standardization_compound,
  CASE WHEN c.id % 13 = 0 THEN 'retired' ELSE 'active' END AS status, c.id % 2 = 0 AS seo_indexable,
  TIMESTAMP '2001-01-01 00:00:00' AS updated_at
FROM (SELECT min(p_partkey) + 1 AS id, p_name, p_type, min(p_size) AS size FROM part GROUP BY p_name, p_type) c
JOIN v_ingredients i ON i.name = c.p_name"""

# A nation holds many suppliers, so a product is seen again and again and prices move.
VIEWS["v_observations"] = """
SELECT CAST(s_nationkey AS BIGINT) AS merchant_id, CAST(l_partkey AS STRING) AS source_product_id,
  CASE l_linestatus WHEN 'F' THEN 'v2' ELSE '' END AS source_variant_id, l_partkey AS partkey,
  (CAST(s_nationkey AS BIGINT) * 1000000000 + l_partkey) * 2 + CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END AS offer_id,
  l_shipdate AS observed_at, l_orderkey * 8 + l_linenumber AS seq,
  floor(l_extendedprice / l_quantity / 500) * 500 + 19.99 AS regular_price,
  CASE WHEN l_discount >= 0.05 THEN floor(l_extendedprice / l_quantity / 500) * 500 + 9.99 END AS sale_price,
  floor(l_extendedprice / l_quantity / 500) * 500 + CASE WHEN l_discount >= 0.05 THEN 9.99 ELSE 19.99 END AS current_price,
  CASE l_returnflag WHEN 'N' THEN 'in_stock' WHEN 'R' THEN 'out_of_stock' ELSE 'backorder' END AS stock_status
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"""

# The newest observation per offer; the two engines say this in their own ways.
_LATEST_SQL = """SELECT * FROM (SELECT *, min(observed_at) OVER (PARTITION BY offer_id) AS first_seen_at,
  row_number() OVER (PARTITION BY offer_id ORDER BY observed_at DESC, seq DESC) AS rn FROM v_observations) r WHERE rn = 1"""
_LATEST_SPARK = """SELECT offer_id, l.*, first_seen_at FROM (SELECT offer_id, min(observed_at) AS first_seen_at,
  max(struct(observed_at, seq, merchant_id, source_product_id, source_variant_id, partkey, regular_price, sale_price,
    current_price, stock_status)) AS l FROM v_observations GROUP BY offer_id) g"""

_OFFERS = """
SELECT o.offer_id AS id, o.merchant_id, 'shopify' AS source_platform, o.source_product_id, o.source_variant_id,
  concat(p.p_name, ' ', CAST(p.p_size * 10 AS STRING), 'mg ', CAST(30 * (1 + o.partkey % 4) AS STRING), ' capsules') AS product_title,
  CASE WHEN o.source_variant_id = '' THEN '' ELSE concat(CAST(p.p_size * 10 AS STRING), ' mg') END AS variant_title,
  p.p_brand AS brand, concat('SKU-', CAST(o.partkey AS STRING)) AS sku,
  CASE WHEN o.partkey % 3 = 0 THEN concat('00', CAST(4000000000 + o.partkey AS STRING)) ELSE '' END AS barcode,
  CASE WHEN o.partkey % 9 <> 0 THEN c.id END AS canonical_product_id, c.ingredient_id, c.ingredient_form,
  CAST(p.p_size * 10 AS DOUBLE) AS strength_per_serving, 'mg' AS strength_unit, CAST(30 * (1 + o.partkey % 4) AS BIGINT) AS servings_per_container,
  CASE WHEN o.partkey % 5 = 0 THEN CAST(p.p_size * 100 AS DOUBLE) END AS total_active_per_container,
  CASE WHEN o.partkey % 10 = 0 THEN 'blend_sum' WHEN o.partkey % 5 = 0 THEN 'single_title' END AS total_active_source,
  CASE WHEN o.partkey % 6 = 0 THEN CAST(80 AS DOUBLE) END AS standardization_percentage,
  o.regular_price, o.sale_price, o.current_price, o.sale_price IS NOT NULL AS on_sale, 'USD' AS currency, o.stock_status,
  o.partkey % 2 = 0 AS third_party_tested, o.partkey % 3 = 0 AS coa_available,
  concat('https://m', CAST(o.merchant_id AS STRING), '.example.com/products/item-', CAST(o.partkey AS STRING), CASE WHEN o.partkey % 4 = 0 THEN '?ref=a b' ELSE '' END) AS source_product_url,
  CASE o.partkey % 8 WHEN 0 THEN 'pending' WHEN 1 THEN 'stale' WHEN 2 THEN 'needs_review' WHEN 3 THEN CASE WHEN o.partkey % 7 = 0 THEN 'rejected' ELSE 'active' END ELSE 'active' END AS visibility_status,
  CASE o.partkey % 16 WHEN 1 THEN 'active' ELSE NULL END AS pre_stale_status,
  CAST(CASE o.partkey % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.85 ELSE 0.55 END AS DOUBLE) AS match_confidence,
  o.first_seen_at, o.observed_at AS last_synced_at, o.observed_at AS updated_at, o.seq AS last_seen_import_run_id, o.partkey
FROM ({latest}) o JOIN part p ON p.p_partkey = o.partkey
JOIN v_canonicals c ON c.p_name = p.p_name AND c.p_type = p.p_type"""

VIEWS["v_offers"] = _OFFERS
_PART_JOIN = "JOIN part p ON p.p_partkey = o.partkey"

# Mode A and B of the cost formulas on decimals, so that halves round the same way in both engines.
def _round(expr: str, digits: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(30,12)), {digits}) AS DOUBLE)"


ROUND = _round

VIEWS["v_costed"] = f"""
SELECT r.*, {_round("current_price / active_compound_total", 6)} AS cost_per_active_unit FROM (
SELECT q.*, coalesce(per_container, {_round("per_serving * servings_per_container", 4)}) AS active_compound_total,
  coalesce({_round("per_container / servings_per_container", 4)}, per_serving) AS active_compound_per_serving,
  {_round("current_price / servings_per_container", 4)} AS cost_per_serving FROM (
SELECT o.*, {_round("CASE WHEN total_active_per_container > 0 THEN total_active_per_container ELSE strength_per_serving * servings_per_container END", 4)} AS total_strength,
  CASE WHEN total_active_per_container > 0 THEN {_round("total_active_per_container * coalesce(coalesce(o.standardization_percentage, i.standardization_default_pct, i.elemental_percentage) / 100, 1)", 4)} END AS per_container,
  CASE WHEN total_active_per_container > 0 THEN NULL ELSE {_round("strength_per_serving * coalesce(coalesce(o.standardization_percentage, i.standardization_default_pct, i.elemental_percentage) / 100, 1)", 4)} END AS per_serving
FROM v_offers o LEFT JOIN v_ingredients i ON i.id = o.ingredient_id) q) r"""

VIEWS["v_history"] = f"""
SELECT offer_id, seq AS id, seq AS import_run_id, observed_at AS changed_at, old_regular_price, regular_price AS new_regular_price,
  old_sale_price, sale_price AS new_sale_price, old_current_price, current_price AS new_current_price, old_stock_status,
  stock_status AS new_stock_status
FROM (SELECT *, lag(seq) OVER w AS old_seq, lag(regular_price) OVER w AS old_regular_price, lag(sale_price) OVER w AS old_sale_price,
  lag(current_price) OVER w AS old_current_price, lag(stock_status) OVER w AS old_stock_status
  FROM v_observations WINDOW w AS (PARTITION BY offer_id ORDER BY observed_at, seq)) x
WHERE old_seq IS NOT NULL AND (old_regular_price <> regular_price OR old_current_price <> current_price
  OR (old_sale_price IS NULL) <> (sale_price IS NULL) OR coalesce(old_sale_price <> sale_price, false) OR old_stock_status <> stock_status)"""

VIEWS["v_clicks"] = """
SELECT e.event_id AS id, o.id AS offer_id, o.canonical_product_id, o.merchant_id, date_trunc('second', e.ts) AS clicked_at,
  CAST(e.user_id AS STRING) AS ip_hash, e.event_type,
  CASE WHEN e.event_type = 'error' THEN 'ExampleBot/1.0' WHEN e.event_type = 'signup' THEN '' ELSE 'Mozilla/5.0' END AS user_agent
FROM events e LEFT JOIN (SELECT partkey, min(id) AS id, min(canonical_product_id) AS canonical_product_id, min(merchant_id) AS merchant_id
  FROM v_offers GROUP BY partkey) o ON o.partkey = e.event_id"""

# Mappings learned from published offers, keyed by what is left of their titles: the part's name.
VIEWS["v_memory"] = """
SELECT merchant_id, title_key, min(canonical_product_id) AS canonical_product_id, min(product_title) AS sample_title, 'approval' AS source,
  count(*) AS times_confirmed, max(updated_at) AS last_confirmed_at
FROM (SELECT o.*, p.p_name AS title_key FROM v_offers o JOIN part p ON p.p_partkey = o.partkey) x
WHERE visibility_status = 'active' AND canonical_product_id IS NOT NULL AND ingredient_form = 'powder'
GROUP BY merchant_id, title_key"""

VIEWS["v_suppressions"] = """
SELECT merchant_id, source_product_id, source_variant_id, product_title, brand, 'rejected_cleanup' AS reason, id AS source_offer_id, updated_at AS suppressed_at
FROM v_offers WHERE visibility_status = 'rejected'"""

# One listing per part, in eight styles; the numbers a text rule must find are columns.
VIEWS["v_listings"] = """
SELECT p_partkey AS id, p_partkey % 25 AS merchant_id, p_name, p_brand AS brand,
  CASE WHEN p_partkey % 2 = 0 THEN concat('SKU-', CAST(p_partkey AS STRING)) ELSE '' END AS sku,
  CASE WHEN p_partkey % 3 = 0 THEN concat('00', CAST(4000000000 + p_partkey AS STRING)) ELSE '' END AS barcode,
  style, size, cnt, '' AS variant_title, 'Plain text.' AS description, '' AS raw_attributes_json,
  CASE style
    WHEN 0 THEN concat(p_name, ' ', s, 'mg ', c, ' capsules')
    WHEN 1 THEN concat(p_name, ' 1,', lpad(s, 3, '0'), ' mg per serving (12,000 mg total per bottle) ', c, ' tablets')
    WHEN 2 THEN concat(p_name, ' &amp;#8211; ', s, ' mcg softgels x60')
    WHEN 3 THEN concat(p_name, ' molecular weight: 403.9 g, ', s, 'mg powder')
    WHEN 4 THEN concat(p_name, ' ', s, ' billion CFU 60 caps')
    WHEN 5 THEN concat(p_name, ' ', s, 'mg x 10 vials')
    WHEN 6 THEN concat(p_name, ' standardized to ', CAST(p_size AS STRING), '% saponins ', s, ' mg liquid')
    ELSE concat(p_name, ' alpha + beta blend ', s, 'mg + 5mg') END AS product_title,
  CASE style WHEN 1 THEN concat(p_name, ' per total per bottle') WHEN 2 THEN concat(p_name, ' x60')
    WHEN 3 THEN concat(p_name, ' molecular weight') WHEN 4 THEN concat(p_name, ' billion cfu') WHEN 5 THEN concat(p_name, ' x vials')
    WHEN 6 THEN concat(p_name, ' standardized to saponins') WHEN 7 THEN concat(p_name, ' alpha beta blend') ELSE p_name END AS known_title,
  CAST(CASE style WHEN 1 THEN size + 1000 ELSE size END AS DOUBLE) AS known_strength,
  CASE style WHEN 2 THEN 'mcg' WHEN 4 THEN 'billion_cfu' ELSE 'mg' END AS known_unit,
  CASE style WHEN 0 THEN cnt WHEN 1 THEN cnt WHEN 2 THEN 60 WHEN 4 THEN 60 WHEN 5 THEN 10 END AS known_count,
  CASE style WHEN 0 THEN 'capsule' WHEN 1 THEN 'tablet' WHEN 2 THEN 'softgel' WHEN 3 THEN 'powder' WHEN 4 THEN 'capsule' WHEN 6 THEN 'liquid' END AS known_form,
  CASE style WHEN 6 THEN CAST(p_size AS DOUBLE) END AS known_pct
FROM (SELECT *, p_partkey % 8 AS style, p_size * 10 AS size, 30 * (1 + p_partkey % 4) AS cnt, CAST(p_size * 10 AS STRING) AS s,
  CAST(30 * (1 + p_partkey % 4) AS STRING) AS c FROM part) p"""

# Crawl attempts: one per order, a site per nation.
VIEWS["v_attempts"] = """
SELECT o_orderkey AS id, CAST(c_nationkey AS BIGINT) AS site_id, o_orderdate AS started_at,
  CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,
  CASE o_orderstatus WHEN 'O' THEN NULL ELSE o_orderdate + INTERVAL 90 SECOND END AS finished_at,
  CAST(floor(o_totalprice / 1000) AS BIGINT) AS offer_count, CASE o_orderstatus WHEN 'P' THEN 'timeout' END AS error
FROM orders JOIN customer ON c_custkey = o_custkey"""

# Feed rows: the line items of every order as one shop's upload, some of them unsound.
VIEWS["v_feed"] = """
SELECT concat('run-', CAST(l_orderkey AS STRING)) AS export_run_id, CAST(l_shipdate AS STRING) AS exported_at,
  CASE WHEN l_partkey % 50 = 7 THEN 'ebay' ELSE 'Shopify ' END AS source,
  concat('HTTPS://m', CAST(s_nationkey + CASE WHEN l_partkey % 40 = 3 THEN 100 ELSE 0 END AS STRING), '.example.com/') AS site,
  CAST(l_partkey AS STRING) AS source_product_id, CASE l_linestatus WHEN 'F' THEN 'v2' ELSE '' END AS source_variant_id,
  CASE WHEN l_partkey % 60 = 11 THEN ' ' ELSE concat('Item &amp; ', CAST(l_partkey AS STRING)) END AS product_title,
  '' AS variant_title, 'Brand' AS brand, CAST(l_tax AS STRING) AS sku, CAST(l_quantity AS STRING) AS regular_price,
  CASE WHEN l_partkey % 70 = 13 THEN 'n/a' ELSE '' END AS sale_price, CAST(l_quantity AS STRING) AS current_price,
  CASE WHEN l_discount > 0.05 THEN 'TRUE' ELSE '0' END AS on_sale, CASE WHEN l_partkey % 80 = 17 THEN 'US' ELSE 'usd' END AS currency,
  CASE l_returnflag WHEN 'N' THEN 'in_stock' WHEN 'R' THEN 'Out_Of_Stock' ELSE CASE WHEN l_partkey % 90 = 19 THEN 'gone' ELSE 'backorder' END END AS stock_status,
  concat('https://m', CAST(s_nationkey AS STRING), '.example.com/products/', CAST(l_partkey AS STRING)) AS source_product_url,
  'retrieved' AS variation_retrieval_status, l_orderkey * 8 + l_linenumber AS row_num
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"""


def with_views(names: list[str], spark: bool) -> str:
    """The WITH clause that defines views and everything they use, in order."""
    latest = _LATEST_SPARK if spark else _LATEST_SQL
    needed, todo = set(), list(names)
    while todo:
        n = todo.pop()
        if n not in needed:
            needed.add(n)
            todo += [v for v in VIEWS if v != n and v in VIEWS[n].replace("{latest}", latest)]
    parts = [f"{n} AS ({VIEWS[n].replace('{latest}', latest).strip()})" for n in VIEWS if n in needed]
    return "WITH " + ",\n".join(parts)


def view(spark: SparkSession, sf: str, name: str, latest: DataFrame | None = None) -> DataFrame:
    """One of the views as a DataFrame over the tables in ``sf``; ``latest`` has the rows of :func:`newest`, where they are kept."""
    for t in TABLES:
        if t in _used(name):
            spark.read.parquet(f"{sf}/{t}.parquet").createOrReplaceTempView(t)
    text = f"{with_views([name], True)}\nSELECT * FROM {name}"
    if _PART_JOIN in text:
        # By the size of its compressed file the planner would send the part table, a row per product, through the driver.
        table(spark, sf, "part").hint("shuffle_hash").createOrReplaceTempView("part_rows")
        text = text.replace(_PART_JOIN, _PART_JOIN.replace("JOIN part ", "JOIN part_rows "))
    if latest is None or _LATEST_SPARK not in text:
        return spark.sql(text)
    return spark.sql(text.replace(_LATEST_SPARK, "SELECT * FROM {latest}"), latest=latest)


def newest(spark: SparkSession, sf: str) -> DataFrame:
    """The newest observation per offer, with the time of the first."""
    for t in ("lineitem", "supplier"):
        spark.read.parquet(f"{sf}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(f"{with_views(['v_observations'], True)}\n{_LATEST_SPARK}")


def _used(name: str) -> set[str]:
    text = with_views([name], True)
    return {t for t in TABLES if f" {t}" in text}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query and, where there is one, the SQL over ``views`` that must agree with it."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            used = views.split() or [v for v in VIEWS if v in sql]
            ORACLE[name] = f"{with_views(used, False)}\n{sql.strip()}" if used else sql.strip()
        return fn

    return register
