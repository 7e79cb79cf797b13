"""Price history and click analytics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pricebook.functions.text import client_ip, salted_hash
from pricebook.operators import clicks as k, prices as p

from pricebook.session import materialize

from .base import NOW, NOW_SQL, query
from .data import Data

CLOCK = datetime(2024, 1, 20)
CLOCK_SQL = "TIMESTAMP '2024-01-20 00:00:00'"
LAST = "{'t': changed_at, 'i': id}"


@query(
    "price_changes",
    """SELECT offer_id, id, changed_at, old_regular_price, new_regular_price, old_sale_price, new_sale_price, old_current_price, new_current_price,
old_stock_status, new_stock_status FROM v_history""",
)
def price_changes(spark, sf):
    return Data(spark, sf).history.drop("import_run_id")


@query(
    "price_changes_between_versions",
    """SELECT a.offer_id, a.old, b.new FROM (SELECT offer_id, first(current_price ORDER BY observed_at, seq) AS old, first(regular_price ORDER BY observed_at, seq) AS oldr,
first(sale_price ORDER BY observed_at, seq) AS olds, first(stock_status ORDER BY observed_at, seq) AS oldt FROM v_observations GROUP BY 1) a
JOIN (SELECT id, current_price AS new, regular_price AS newr, sale_price AS news, stock_status AS newt FROM v_offers) b ON b.id = a.offer_id
WHERE old <> new OR oldr <> newr OR (olds IS NULL) <> (news IS NULL) OR coalesce(olds <> news, false) OR oldt <> newt""",
)
def price_changes_between(spark, sf):
    d = Data(spark, sf)
    fields = ["regular_price", "sale_price", "current_price", "stock_status"]
    first = d.observations.groupBy(F.col("offer_id").alias("id")).agg(F.min_by(F.struct(*fields), F.struct("observed_at", "seq")).alias("f")).select("id", "f.*")
    return p.price_changes(first, d.offers, 1, NOW).select("offer_id", F.col("old_current_price").alias("old"), F.col("new_current_price").alias("new"))


@query(
    "price_moves",
    f"""SELECT offer_id, CASE WHEN new > old THEN 'up' ELSE 'down' END AS dir, CAST(round(CAST(abs((new - old) / old) * 100 AS DECIMAL(30,12)), 2) AS DOUBLE) AS pct
FROM (SELECT offer_id, arg_max(old_current_price, {LAST}) AS old, arg_max(new_current_price, {LAST}) AS new FROM v_history
WHERE changed_at >= {NOW_SQL} - INTERVAL 90 DAY AND old_current_price > 0 AND abs(new_current_price - old_current_price) > 0.00005 GROUP BY 1) x""",
)
def price_moves(spark, sf):
    return p.price_moves(Data(spark, sf).history, NOW, 90)


@query(
    "offer_history",
    """SELECT offer_id, id, changed_at, new_current_price FROM v_history WHERE offer_id = (SELECT max(offer_id) FROM v_history) ORDER BY changed_at DESC, id DESC LIMIT 50""",
)
def offer_history(spark, sf):
    h = Data(spark, sf).history
    newest = h.agg(F.max("offer_id")).first()[0]
    return p.offer_history(h, newest).select("offer_id", "id", "changed_at", "new_current_price")


SERIES = f"""SELECT canonical_product_id, day, CAST(round(CAST(sum(CAST(price AS DECIMAL(20,4))) AS DOUBLE) / count(*), 4) AS DOUBLE) AS avg_price,
min(price) AS low_price, count(*) AS offers FROM (
SELECT o.canonical_product_id, d.day, CASE WHEN s.offer_id IS NULL THEN o.current_price ELSE coalesce((SELECT arg_max(h.new_current_price, {{'t': h.changed_at, 'i': h.id}})
  FROM v_history h WHERE h.offer_id = o.id AND CAST(h.changed_at AS DATE) <= d.day), s.seed) END AS price
FROM v_offers o CROSS JOIN (SELECT CAST(range AS DATE) AS day FROM range(DATE '2001-08-26', DATE '2001-09-02', INTERVAL 1 DAY)) d
LEFT JOIN (SELECT offer_id, arg_min(old_current_price, {LAST}) AS seed FROM v_history WHERE CAST(changed_at AS DATE) <= DATE '2001-09-01' GROUP BY 1) s ON s.offer_id = o.id
WHERE o.canonical_product_id IS NOT NULL) x WHERE price IS NOT NULL GROUP BY 1, 2"""
SERIES = SERIES.replace(
    "CAST(round(CAST(sum(CAST(price AS DECIMAL(20,4))) AS DOUBLE) / count(*), 4) AS DOUBLE)",
    "CAST(round(CAST(CAST(sum(CAST(price AS DECIMAL(20,4))) AS DOUBLE) / count(*) AS DECIMAL(30,12)), 4) AS DOUBLE)",
)


@query("price_series", SERIES, "v_offers v_history")
def price_series(spark, sf):
    d = Data(spark, sf)
    return p.price_series(d.offers, d.history, NOW, 7)


# The lows need change points only: the level at the start of the window and the last price of each day with a change.
LOWS = """, h AS (SELECT offer_id, CAST(changed_at AS DATE) AS day, {'t': changed_at, 'i': id} AS k, old_current_price AS old, new_current_price AS new
  FROM v_history WHERE new_current_price IS NOT NULL AND CAST(changed_at AS DATE) <= DATE '2001-09-01'),
whole AS (SELECT offer_id, arg_min(old, k) AS seed, arg_max(new, k) AS last, arg_max(new, k) FILTER (WHERE day < DATE '2001-06-04') AS before FROM h GROUP BY 1),
daily AS (SELECT offer_id, day, arg_max(new, k) AS price FROM h WHERE day >= DATE '2001-06-04' GROUP BY 1, 2),
o AS (SELECT o.id, o.canonical_product_id, w.offer_id IS NULL AS flat, o.current_price, w.seed, w.last, w.before FROM v_offers o LEFT JOIN whole w ON w.offer_id = o.id
  WHERE o.canonical_product_id IS NOT NULL),
p AS (SELECT canonical_product_id, CASE WHEN flat THEN current_price ELSE coalesce(before, seed) END AS price FROM o
    WHERE NOT EXISTS (SELECT 1 FROM daily d WHERE d.offer_id = o.id AND d.day = DATE '2001-06-04')
  UNION ALL SELECT o.canonical_product_id, d.price FROM daily d JOIN o ON o.id = d.offer_id),
low AS (SELECT canonical_product_id, min(price) AS window_low FROM p GROUP BY 1),
cur AS (SELECT canonical_product_id, min(CASE WHEN flat THEN current_price ELSE last END) AS current_low FROM o GROUP BY 1)
SELECT low.canonical_product_id, window_low, current_low, current_low <= window_low + 0.00005 AS at_low FROM low JOIN cur ON cur.canonical_product_id = low.canonical_product_id"""


@query("price_series_90_days_lows", LOWS, "v_offers v_history")
def price_series_90(spark, sf):
    d = Data(spark, sf)
    return p.window_low(p.price_series(d.offers, d.history, NOW, 90))


@query(
    "window_low",
    f"""SELECT canonical_product_id, min(low_price) AS window_low, arg_max(low_price, day) AS current_low,
arg_max(low_price, day) <= min(low_price) + 0.00005 AS at_low FROM ({SERIES}) s GROUP BY 1""",
    "v_offers v_history",
)
def window_low(spark, sf):
    d = Data(spark, sf)
    return p.window_low(p.price_series(d.offers, d.history, NOW, 7))


@query(
    "move_counts",
    f"""SELECT o.canonical_product_id, count(h.id) AS moves, count(h.id) < 2 AS sparse FROM v_offers o LEFT JOIN (SELECT * FROM v_history
WHERE changed_at >= {NOW_SQL} - INTERVAL 90 DAY AND abs(new_current_price - old_current_price) > 0.00005) h ON h.offer_id = o.id
WHERE o.canonical_product_id IS NOT NULL GROUP BY 1""",
)
def move_counts(spark, sf):
    d = Data(spark, sf)
    return p.move_counts(d.offers, d.history, NOW, 90)


@query(
    "revert_run_prices",
    """SELECT o.id, coalesce(h.old_current_price, o.current_price) AS current_price, coalesce(h.old_stock_status, o.stock_status) AS stock_status,
CASE WHEN h.offer_id IS NULL THEN o.sale_price ELSE h.old_sale_price END AS sale_price
FROM v_offers o LEFT JOIN (SELECT * FROM v_history WHERE import_run_id = (SELECT max(import_run_id) FROM v_history)) h ON h.offer_id = o.id""",
)
def revert_run_prices(spark, sf):
    # The change log is read for its newest run and for the run's rows: written once, and before the newest observations.
    h = materialize(Data(spark, sf).history, "history")
    run = h.agg(F.max("import_run_id")).first()[0]
    reverted, _ = p.revert_run_prices(Data(spark, sf, keep=True).offers, h, run, NOW)
    return reverted.select("id", "current_price", "stock_status", "sale_price")


# --- clicks ----------------------------------------------------------------------------------------------------------

BOT = "(user_agent = '' OR user_agent LIKE '%Bot%')"


def clicks(spark, sf):
    return Data(spark, sf).clicks.withColumn("is_bot_suspected", k.is_bot_ua(F.col("user_agent")))


@query("is_bot_ua", f"SELECT id, {BOT} AS bot FROM v_clicks")
def is_bot_ua(spark, sf):
    return clicks(spark, sf).select("id", F.col("is_bot_suspected").alias("bot"))


RAPID = """SELECT id, count(*) OVER (PARTITION BY ip_hash ORDER BY s RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)
- count(*) OVER (PARTITION BY ip_hash, s ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= {n} AS rapid_fire
FROM (SELECT *, CAST(epoch(clicked_at) AS BIGINT) AS s FROM v_clicks) x"""


@query("rapid_fire_day", RAPID.format(w=86400, n=3))
def rapid_fire_day(spark, sf):
    return k.flag_rapid_fire(Data(spark, sf).clicks, 86400, 3).select("id", "rapid_fire")


@query("rapid_fire_default", RAPID.format(w=60, n=10))
def rapid_fire_default(spark, sf):
    return k.flag_rapid_fire(Data(spark, sf).clicks).select("id", "rapid_fire")


@query("rapid_fire_minute", RAPID.format(w=1800, n=1))
def rapid_fire_short(spark, sf):
    return k.flag_rapid_fire(Data(spark, sf).clicks, 1800, 1).select("id", "rapid_fire")


@query("click_log_bots", f"SELECT x.id, x.rapid_fire OR {BOT} AS bot FROM ({RAPID.format(w=7200, n=2)}) x JOIN v_clicks c ON c.id = x.id")
def click_log_bots(spark, sf):
    return k.mark_bots(Data(spark, sf).clicks, 7200, 2).select("id", F.col("is_bot_suspected").alias("bot"))


@query(
    "click_totals",
    f"SELECT count(*) AS clicks, count_if(NOT {BOT}) AS human, count_if({BOT}) AS bot FROM v_clicks WHERE clicked_at >= {CLOCK_SQL} - INTERVAL 7 DAY",
)
def click_totals(spark, sf):
    return k.click_totals(clicks(spark, sf), k.window_start("7d", CLOCK))


@query(
    "click_windows",
    f"""SELECT 'today' AS win, count(*) AS clicks FROM v_clicks WHERE clicked_at >= {CLOCK_SQL}
UNION ALL SELECT '7d', count(*) FROM v_clicks WHERE clicked_at >= {CLOCK_SQL} - INTERVAL 7 DAY
UNION ALL SELECT '30d', count(*) FROM v_clicks WHERE clicked_at >= {CLOCK_SQL} - INTERVAL 30 DAY UNION ALL SELECT 'all', count(*) FROM v_clicks""",
)
def click_windows(spark, sf):
    rows = clicks(spark, sf)
    parts = [k.in_window(rows, k.window_start(w, CLOCK)).agg(F.count(F.lit(1)).alias("clicks")).select(F.lit(w).alias("win"), "clicks") for w in ("today", "7d", "30d", "all")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _top(by: str, keep_null: bool) -> str:
    extra = "" if keep_null else f"AND {by} IS NOT NULL"
    return f"SELECT {by}, count(*) AS clicks FROM v_clicks WHERE NOT {BOT} {extra} GROUP BY 1 ORDER BY clicks DESC, {by} ASC NULLS LAST LIMIT 10"


@query("top_clicks_by_offer", _top("offer_id", True))
def top_by_offer(spark, sf):
    return k.top_clicks(clicks(spark, sf), "offer_id")


@query("top_clicks_by_merchant", _top("merchant_id", True))
def top_by_merchant(spark, sf):
    return k.top_clicks(clicks(spark, sf), "merchant_id")


@query("top_clicks_by_canonical", _top("canonical_product_id", False))
def top_by_canonical(spark, sf):
    return k.top_clicks(clicks(spark, sf), "canonical_product_id")


@query(
    "clicks_with_names",
    f"SELECT t.merchant_id, t.clicks, m.name AS merchant_name FROM ({_top('merchant_id', True)}) t LEFT JOIN v_merchants m ON m.id = t.merchant_id",
)
def clicks_with_names(spark, sf):
    return k.clicks_with_names(k.top_clicks(clicks(spark, sf), "merchant_id"), "merchant_id", Data(spark, sf).merchants, {"name": "merchant_name"})


@query("salted_hash", "SELECT event_id AS id, sha256(concat('salt|', CAST(user_id AS STRING))) AS ip_hash FROM events")
def hashed(spark, sf):
    e = Data(spark, sf).table("events")
    ip = client_ip(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" , 10.0.0.1")), F.lit("10.0.0.2"))
    return e.select(F.col("event_id").alias("id"), salted_hash(ip, "salt").alias("ip_hash"))
