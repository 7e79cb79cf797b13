"""Matching, learned mappings and container totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricebook.operators import match as m, memory as mem, totals as tot
from pricebook.plans.ingest import append_raw
from pricebook.plans.raw_index import RawPointers
from pricebook.schemas import KEY
from pricebook.session import discard, materialize, shared_dir, spread

from .base import ROUND, query
from .data import Data


def title():
    return F.col("product_title")


@query("detect_ingredient", "SELECT l.id, CASE WHEN i.status <> 'retired' THEN i.id END AS ingredient_id FROM v_listings l JOIN v_ingredients i ON i.name = l.p_name")
def detect_ingredient(spark, sf):
    d = Data(spark, sf)
    return m.detect_ingredient(d.listings, d.ingredients, "product_title").select("id", F.col("detected_ingredient_id").alias("ingredient_id"))


@query("detect_ingredient_by_alias", "SELECT l.id, CASE WHEN i.status <> 'retired' THEN i.id END AS ingredient_id FROM v_listings l JOIN v_ingredients i ON i.name = l.p_name")
def detect_by_alias(spark, sf):
    d = Data(spark, sf)
    alias = F.concat(F.lit("Best ("), F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lit("-"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("), new!"))
    return m.detect_ingredient(d.listings.withColumn("x", alias), d.ingredients, "x").select("id", F.col("detected_ingredient_id").alias("ingredient_id"))


@query(
    "normalize_offers",
    """SELECT l.id, CASE WHEN i.status <> 'retired' THEN i.id END AS ingredient_id, known_form AS form, known_strength AS strength, known_unit AS unit,
known_count AS servings, known_pct AS pct FROM v_listings l JOIN v_ingredients i ON i.name = l.p_name""",
)
def normalize_offers(spark, sf):
    d = Data(spark, sf)
    return m.normalize_offers(d.listings, d.ingredients).select(
        "id", F.col("found_ingredient_id").alias("ingredient_id"), F.col("found_form").alias("form"), F.col("found_strength").alias("strength"),
        F.col("found_unit").alias("unit"), F.col("found_servings").alias("servings"), F.col("found_pct").alias("pct"),
    )


def read(d: Data):
    return m.with_title_keys(m.normalize_offers(d.listings, d.ingredients))


# Peers and each tier's hits, from the known numbers.
TIERS_SQL = """peers AS (SELECT o.*, p.p_name AS norm_title FROM v_offers o JOIN v_canonicals c ON c.id = o.canonical_product_id AND c.status <> 'retired' JOIN part p ON p.p_partkey = o.partkey),
probe AS (SELECT l.*, CASE WHEN i.status <> 'retired' THEN i.id END AS found_ingredient FROM v_listings l JOIN v_ingredients i ON i.name = l.p_name),
mem AS (SELECT k.* FROM v_memory k JOIN v_canonicals c ON c.id = k.canonical_product_id AND c.status <> 'retired'),
t_barcode AS (SELECT p.id, arg_min(o.canonical_product_id, o.id) AS canonical FROM probe p JOIN peers o ON o.barcode = p.barcode WHERE p.barcode <> '' GROUP BY 1),
t_sku AS (SELECT p.id, arg_min(o.canonical_product_id, o.id) AS canonical FROM probe p JOIN peers o ON lower(o.brand) = lower(p.brand) AND o.sku = p.sku WHERE p.sku <> '' GROUP BY 1),
t_own AS (SELECT p.id, min(k.canonical_product_id) AS canonical FROM probe p JOIN mem k ON k.merchant_id = p.merchant_id AND k.title_key = p.known_title GROUP BY 1),
t_others AS (SELECT p.id, min(k.canonical_product_id) AS canonical FROM probe p JOIN mem k ON k.title_key = p.known_title GROUP BY 1 HAVING count(DISTINCT k.canonical_product_id) = 1),
t_attrs AS (SELECT p.id, min(c.id) AS canonical FROM probe p JOIN v_canonicals c ON c.ingredient_id = p.found_ingredient AND c.ingredient_form = p.known_form AND c.status <> 'retired'
  AND abs(c.strength_per_serving - p.known_strength) < 0.0001 AND (p.known_pct IS NULL OR abs(coalesce(c.standardization_percentage, -1) - p.known_pct) < 0.5) GROUP BY 1 HAVING count(*) = 1),
t_title AS (SELECT p.id, arg_min(o.canonical_product_id, o.id) AS canonical FROM probe p JOIN peers o ON lower(o.brand) = lower(p.brand) AND o.norm_title = p.known_title GROUP BY 1),
t_btdose AS (SELECT p.id, arg_min(o.canonical_product_id, o.id) AS canonical FROM probe p JOIN peers o ON lower(o.brand) = lower(p.brand) AND o.norm_title = p.known_title
  AND abs(o.strength_per_serving - p.known_strength) < 0.0001 AND o.servings_per_container = p.known_count GROUP BY 1),
t_dose AS (SELECT p.id, arg_min(o.canonical_product_id, o.id) AS canonical FROM probe p JOIN peers o ON o.norm_title = p.known_title
  AND abs(o.strength_per_serving - p.known_strength) < 0.0001 AND o.servings_per_container = p.known_count GROUP BY 1),
t_only AS (SELECT p.id, min(c.id) AS canonical FROM probe p JOIN v_canonicals c ON c.ingredient_id = p.found_ingredient AND c.ingredient_form IS NULL AND c.strength_per_serving IS NULL AND c.status <> 'retired'
  GROUP BY 1 HAVING count(*) = 1)"""
USES = "v_listings v_offers v_canonicals v_ingredients v_memory"
NAMES = {
    "barcode": "t_barcode", "brand_sku": "t_sku", "memory_own": "t_own", "memory_others": "t_others", "canonical_attrs": "t_attrs",
    "brand_title": "t_title", "brand_title_dose": "t_btdose", "title_dose": "t_dose", "ingredient_only": "t_only",
}


def _with(sql: str) -> str:
    return f", {TIERS_SQL}\n{sql}"


def _tier_query(name: str, fn):
    query(f"tier_{name}", _with(f"SELECT id, canonical AS canonical_product_id FROM {NAMES[name]}"), USES)(
        lambda spark, sf: fn(Data(spark, sf)).select("id", "canonical_product_id")
    )


def _peers(d: Data):
    return m.with_title_keys(m.live_peers(d.offers, d.canonicals))


_tier_query("barcode", lambda d: m.tier_barcode(d.listings, _peers(d)))
_tier_query("brand_sku", lambda d: m.tier_brand_sku(d.listings, _peers(d)))
_tier_query("memory_own", lambda d: m.tier_memory_own(m.with_title_keys(d.listings), d.memory, d.canonicals))
_tier_query("memory_others", lambda d: m.tier_memory_others(m.with_title_keys(d.listings), d.memory, d.canonicals))
_tier_query("canonical_attrs", lambda d: m.tier_canonical_attrs(read(d), d.canonicals))
_tier_query("brand_title", lambda d: m.tier_brand_title(m.with_title_keys(d.listings), _peers(d)))
_tier_query("brand_title_dose", lambda d: m.tier_brand_title_dose(read(d), _peers(d)))
_tier_query("title_dose", lambda d: m.tier_title_dose(read(d), _peers(d)))
_tier_query("ingredient_only", lambda d: m.tier_ingredient_only(read(d), d.canonicals))

_CASE = " ".join(f"WHEN {t}.id IS NOT NULL THEN '{n}'" for n, t in NAMES.items())
CASCADE = _with(
    f"""SELECT p.id, coalesce({', '.join(t + '.canonical' for t in NAMES.values())}) AS canonical_product_id, CASE {_CASE} END AS tier
FROM probe p {' '.join(f'LEFT JOIN {t} ON {t}.id = p.id' for t in NAMES.values())}"""
)


@query("match_cascade", f"{CASCADE} WHERE coalesce({', '.join(t + '.id' for t in NAMES.values())}) IS NOT NULL", USES)
def match_cascade(spark, sf):
    d = Data(spark, sf, keep=True)
    return m.match_cascade(m.normalize_offers(d.listings, d.ingredients), d.offers, d.memory, d.canonicals).select("id", "canonical_product_id", "tier")


@query("match_tier_counts", _with(f"SELECT coalesce(tier, 'none') AS tier, count(*) AS n FROM ({CASCADE.split(TIERS_SQL, 1)[1]}) c GROUP BY 1"), USES)
def match_tier_counts(spark, sf):
    d = Data(spark, sf, keep=True)
    out = m.match_offers(m.normalize_offers(d.listings, d.ingredients), d.offers, d.memory, d.canonicals)
    return out.groupBy(F.coalesce("match_tier", F.lit("none")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "apply_match",
    _with(
        f"""SELECT x.id, coalesce(c.ingredient_id, p.found_ingredient) AS ingredient_id, coalesce(c.ingredient_form, p.known_form) AS ingredient_form,
coalesce(c.strength_per_serving, p.known_strength) AS strength_per_serving, coalesce(c.standardization_percentage, p.known_pct) AS standardization_percentage
FROM ({CASCADE.split(TIERS_SQL, 1)[1]}) x JOIN probe p ON p.id = x.id LEFT JOIN v_canonicals c ON c.id = x.canonical_product_id"""
    ),
    USES,
)
def apply_match(spark, sf):
    d = Data(spark, sf, keep=True)
    out = m.apply_match(m.match_offers(m.normalize_offers(d.listings, d.ingredients), d.offers, d.memory, d.canonicals), d.canonicals)
    return out.select("id", "ingredient_id", "ingredient_form", "strength_per_serving", "standardization_percentage")


# --- learned mappings ------------------------------------------------------------------------------------------------

DECIDED = """SELECT o.merchant_id, p.p_name AS title_key, coalesce(b.canonical_product_id, 1) AS canonical_product_id, o.observed_at AS decided_at, o.seq AS id
FROM v_observations o JOIN part p ON p.p_partkey = o.partkey JOIN (SELECT partkey, max(canonical_product_id) AS canonical_product_id FROM v_offers GROUP BY 1) b ON b.partkey = o.partkey"""


def decisions(d: Data):
    best = d.offers.groupBy("partkey").agg(F.max("canonical_product_id").alias("canonical_product_id"))
    part = d.table("part").select(F.col("p_partkey").alias("partkey"), F.col("p_name").alias("sample_title"))
    return (
        d.observations.join(part, "partkey")
        .join(best, "partkey")
        .select(
            "merchant_id", F.col("sample_title").alias("title_key"), F.coalesce("canonical_product_id", F.lit(1)).alias("canonical_product_id"),
            "sample_title", F.lit("approval").alias("source"), F.col("observed_at").alias("decided_at"), F.col("seq").alias("id"),
        )
    )


@query(
    "memory_state",
    f"""SELECT merchant_id, title_key, arg_max(canonical_product_id, {{'t': decided_at, 'i': id}}) AS canonical_product_id,
count_if(island = last_island) AS times_confirmed, max(decided_at) AS last_confirmed_at FROM (SELECT *, max(island) OVER (PARTITION BY merchant_id, title_key) AS last_island FROM (
SELECT *, sum(CASE WHEN was IS NULL OR was <> canonical_product_id THEN 1 ELSE 0 END) OVER (PARTITION BY merchant_id, title_key ORDER BY decided_at, id) AS island FROM (
SELECT *, lag(canonical_product_id) OVER (PARTITION BY merchant_id, title_key ORDER BY decided_at, id) AS was FROM ({DECIDED}) a) b) c) d GROUP BY 1, 2""",
    "v_observations v_offers",
)
def memory_state(spark, sf):
    return mem.memory_state(decisions(Data(spark, sf))).select("merchant_id", "title_key", "canonical_product_id", "times_confirmed", "last_confirmed_at")


@query(
    "learn_from_approvals",
    """SELECT coalesce(a.merchant_id, k.merchant_id) AS merchant_id, coalesce(a.title_key, k.title_key) AS title_key, coalesce(a.canonical_product_id, k.canonical_product_id) AS canonical_product_id
FROM v_memory k FULL OUTER JOIN (SELECT o.merchant_id, p.p_name AS title_key, arg_max(o.canonical_product_id, {'t': o.updated_at, 'i': o.id}) AS canonical_product_id
FROM v_offers o JOIN v_canonicals c ON c.id = o.canonical_product_id AND c.status <> 'retired' JOIN part p ON p.p_partkey = o.partkey
WHERE o.visibility_status = 'pending' GROUP BY 1, 2) a ON a.merchant_id = k.merchant_id AND a.title_key = k.title_key""",
)
def learn(spark, sf):
    d = Data(spark, sf, keep=True)
    approved = d.offers.where("visibility_status = 'pending'").withColumn("decided_at", F.col("updated_at"))
    state, _ = mem.learn_from_approvals(approved, d.memory, d.canonicals)
    return state.select("merchant_id", "title_key", "canonical_product_id")


@query(
    "backfill_memory",
    """SELECT merchant_id, title_key, canonical_product_id, n AS times_confirmed FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id, title_key ORDER BY n DESC, canonical_product_id) AS rn FROM (
SELECT o.merchant_id, p.p_name AS title_key, o.canonical_product_id, count(*) AS n FROM v_offers o JOIN v_canonicals c ON c.id = o.canonical_product_id AND c.status <> 'retired'
JOIN part p ON p.p_partkey = o.partkey WHERE o.visibility_status NOT IN ('pending', 'needs_review', 'rejected') GROUP BY 1, 2, 3) a) b
WHERE rn = 1 AND (merchant_id, title_key) NOT IN (SELECT merchant_id, title_key FROM v_memory)""",
)
def backfill(spark, sf):
    d = Data(spark, sf, keep=True)
    return mem.backfill_memory(d.offers, d.memory, d.canonicals).select("merchant_id", "title_key", "canonical_product_id", "times_confirmed")


@query(
    "rekey_memory",
    """SELECT merchant_id, CASE WHEN merchant_id % 3 = 1 THEN concat(title_key, ' ltd') WHEN merchant_id % 3 = 2 THEN concat(title_key, ' amp ltd') ELSE title_key END AS title_key,
merchant_id % 3 = 1 AS rekeyed FROM v_memory""",
)
def rekey(spark, sf):
    k = Data(spark, sf).memory
    third = F.col("merchant_id") % 3
    old = k.withColumns(
        {
            "sample_title": F.when(third == 0, F.col("title_key")).when(third == 1, F.concat("title_key", F.lit(" &amp; Ltd"))).otherwise(F.lit("&;")),
            "title_key": F.when(third == 0, F.col("title_key")).otherwise(F.concat("title_key", F.lit(" amp ltd"))),
        }
    )
    return mem.rekey_memory(old).select("merchant_id", "title_key", "rekeyed")


REMATCHED = """, queue AS (SELECT o.*, p.p_name AS norm_title FROM v_offers o JOIN part p ON p.p_partkey = o.partkey WHERE o.visibility_status IN ('pending', 'needs_review') AND o.canonical_product_id IS NULL),
peers AS (SELECT o.*, p.p_name AS norm_title FROM v_offers o JOIN v_canonicals c ON c.id = o.canonical_product_id AND c.status <> 'retired' JOIN part p ON p.p_partkey = o.partkey),
mem AS (SELECT k.* FROM v_memory k JOIN v_canonicals c ON c.id = k.canonical_product_id AND c.status <> 'retired'),
a AS (SELECT q.id, min(k.canonical_product_id) AS canonical FROM queue q JOIN mem k ON k.merchant_id = q.merchant_id AND k.title_key = q.norm_title GROUP BY 1),
b AS (SELECT q.id, min(k.canonical_product_id) AS canonical FROM queue q JOIN mem k ON k.title_key = q.norm_title GROUP BY 1 HAVING count(DISTINCT k.canonical_product_id) = 1),
f AS (SELECT q.*, coalesce(q.ingredient_form, 'capsule') AS form FROM queue q),
c AS (SELECT q.id, min(c.id) AS canonical FROM f q JOIN v_canonicals c ON c.ingredient_id = q.ingredient_id AND c.ingredient_form = q.form AND c.status <> 'retired'
  AND abs(c.strength_per_serving - q.strength_per_serving) < 0.0001 AND (q.standardization_percentage IS NULL OR abs(coalesce(c.standardization_percentage, -1) - q.standardization_percentage) < 0.5) GROUP BY 1 HAVING count(*) = 1),
t AS (SELECT q.id, arg_min(o.canonical_product_id, o.id) AS canonical FROM queue q JOIN peers o ON lower(o.brand) = lower(q.brand) AND o.norm_title = q.norm_title GROUP BY 1),
e AS (SELECT q.id, arg_min(o.canonical_product_id, o.id) AS canonical FROM queue q JOIN peers o ON o.norm_title = q.norm_title AND abs(o.strength_per_serving - q.strength_per_serving) < 0.0001
  AND o.servings_per_container = q.servings_per_container GROUP BY 1),
g AS (SELECT q.id, min(c.id) AS canonical FROM queue q JOIN v_canonicals c ON c.ingredient_id = q.ingredient_id AND c.ingredient_form IS NULL AND c.strength_per_serving IS NULL AND c.status <> 'retired' GROUP BY 1 HAVING count(*) = 1),
r AS (SELECT q.id, coalesce(a.canonical, b.canonical, c.canonical, t.canonical, e.canonical, g.canonical) AS canonical FROM queue q LEFT JOIN a ON a.id = q.id LEFT JOIN b ON b.id = q.id
  LEFT JOIN c ON c.id = q.id LEFT JOIN t ON t.id = q.id LEFT JOIN e ON e.id = q.id LEFT JOIN g ON g.id = q.id)"""


@query(
    "rematch",
    f"""{REMATCHED}
SELECT r.id, r.canonical AS canonical_product_id, q.ingredient_id, coalesce(q.ingredient_form, k.ingredient_form) AS ingredient_form,
coalesce(q.standardization_percentage, k.standardization_percentage) AS standardization_percentage
FROM r JOIN queue q ON q.id = r.id JOIN v_canonicals k ON k.id = r.canonical""",
    "v_offers v_canonicals v_memory v_ingredients",
)
def rematch(spark, sf):
    d = Data(spark, sf, keep=True)
    # No peer shares barcode or SKU with the queue here: all offers of such a part lack a product.
    # Learned titles are read for the same merchant and for the others: written once.
    out = mem.rematch(d.offers, materialize(d.memory, "memory"), d.canonicals, d.ingredients)
    return out.select("id", "canonical_product_id", "ingredient_id", "ingredient_form", "standardization_percentage")


@query(
    "rematch_for_keys",
    f"""{REMATCHED}
SELECT r.id, r.canonical AS canonical_product_id FROM r JOIN queue q ON q.id = r.id
WHERE r.canonical IS NOT NULL AND q.norm_title IN (SELECT title_key FROM v_memory WHERE merchant_id = 3 AND title_key <> '')""",
    "v_offers v_canonicals v_memory v_ingredients",
)
def rematch_for_keys(spark, sf):
    d = Data(spark, sf, keep=True)
    # Three steps read the learned titles: written once.
    memory = materialize(d.memory, "memory")
    keys = memory.where("merchant_id = 3").select("title_key")
    return mem.rematch_for_keys(d.offers, keys, memory, d.canonicals, d.ingredients).select("id", "canonical_product_id")


# Queue rows with the codes of a published product: the barcode for one half of the offers, brand and SKU for the other.
CODED = """, coded AS (SELECT o.*, '00' || CAST(4000000000 + o.partkey + 3 AS STRING) AS code, 'SKU-' || CAST(o.partkey + 3 AS STRING) AS other FROM v_offers o
  WHERE o.visibility_status IN ('pending', 'needs_review') AND o.canonical_product_id IS NULL),
peers AS (SELECT o.* FROM v_offers o JOIN v_canonicals c ON c.id = o.canonical_product_id AND c.status <> 'retired')
SELECT q.id, arg_min(p.canonical_product_id, p.id) AS canonical_product_id, 'barcode' AS tier FROM coded q JOIN peers p ON p.barcode = q.code WHERE q.id % 2 = 0 GROUP BY 1
UNION ALL SELECT q.id, arg_min(p.canonical_product_id, p.id), 'brand_sku' FROM coded q JOIN peers p ON p.sku = q.other WHERE q.id % 2 = 1 GROUP BY 1"""


@query("rematch_codes", CODED, "v_offers v_canonicals")
def rematch_codes(spark, sf):
    d = Data(spark, sf)
    queued = F.col("visibility_status").isin("pending", "needs_review") & F.col("canonical_product_id").isNull()
    even, near = F.col("id") % 2 == 0, F.col("partkey") + 3
    offers = d.offers.withColumns(
        {
            "brand": F.lit("One"),
            "barcode": F.when(queued & even, F.concat(F.lit("00"), (near + 4000000000).cast("string"))).when(queued, "").otherwise(F.col("barcode")),
            "sku": F.when(queued & even, "").when(queued, F.concat(F.lit("SKU-"), near.cast("string"))).otherwise(F.col("sku")),
        }
    )
    out = mem.rematch(materialize(offers, "offers"), d.memory.limit(0), d.canonicals, d.ingredients)
    return out.where(F.col("match_tier").isin("barcode", "brand_sku")).select("id", "canonical_product_id", F.col("match_tier").alias("tier"))


# --- totals ----------------------------------------------------------------------------------------------------------

SIBLINGS = """(source_product_id <> '' AND count(*) OVER (PARTITION BY merchant_id, source_product_id) > 1) OR count(*) OVER (PARTITION BY merchant_id, product_title) > 1"""


@query("with_siblings", f"SELECT id, {SIBLINGS} AS has_siblings FROM v_offers")
def with_siblings(spark, sf):
    return tot.with_siblings(Data(spark, sf).offers).select("id", "has_siblings")


@query("latest_raw", "SELECT id, product_title AS title FROM v_offers")
def latest_raw(spark, sf):
    d = Data(spark, sf)
    # The offers are read by every step: what the steps ask of them is written once.
    offers = materialize(d.offers.select("id", *KEY, "source_platform", "product_title", "variant_title", "last_seen_import_run_id"), "offers")
    raw = d.raw_of(offers)
    old = raw.withColumns({"id": F.col("id") - 1, "raw_json": F.lit('{"product_title":"old"}')})
    return tot.latest_raw(offers.select("id", *KEY), raw.unionByName(old)).select("id", F.get_json_object("raw_json", "$.product_title").alias("title"))


@query(
    "latest_raw_pointers",
    "SELECT id, CASE WHEN partkey % 3 = 0 THEN product_title WHEN partkey % 2 = 0 THEN 'second' ELSE 'first' END AS title FROM v_offers WHERE visibility_status = 'pending'",
)
def latest_raw_pointers(spark, sf):
    # Three runs of raw rows, partitioned by run; pointers are kept run by run.
    d = Data(spark, sf)
    offers = materialize(d.offers, "offers")
    folder, pointers = shared_dir(spark, "raw"), RawPointers(shared_dir(spark, "pointers"), buckets=8, fan=2)
    runs = [(F.lit(True), F.lit("first")), (F.col("partkey") % 2 == 0, F.lit("second")), (F.col("partkey") % 3 == 0, F.col("product_title"))]
    for n, (some, title_) in enumerate(runs):
        rows = offers.where(some).select(*KEY, (F.col("id") + n * 10**12).alias("id"), F.lit(n).cast("bigint").alias("import_run_id"), F.to_json(F.struct(title_.alias("product_title"))).alias("raw_json"))
        append_raw(rows, folder)
        pointers.put(spark.read.schema(rows.schema).parquet(folder).where(F.col("import_run_id") == n), n)
    raw = spark.read.schema(rows.schema).parquet(folder)
    queue = offers.where("visibility_status = 'pending'")
    return tot.latest_raw(queue, raw, pointers.of(spark, queue, len(runs))).select("id", F.get_json_object("raw_json", "$.product_title").alias("title"))


SUGGESTED = """CASE style WHEN 5 THEN size * 10 WHEN 6 THEN size WHEN 7 THEN size + 5 END"""


@query(
    "suggest_total",
    f"""SELECT id, CAST(CASE WHEN id % 3 <> 0 THEN {SUGGESTED} END AS DOUBLE) AS total,
CASE WHEN id % 3 <> 0 THEN CASE style WHEN 5 THEN 'pack_count' WHEN 6 THEN 'single_title' WHEN 7 THEN 'blend_sum' END END AS source FROM v_listings""",
)
def suggest_total(spark, sf):
    # Every third listing has siblings, so its title says nothing about the one variant.
    rows = Data(spark, sf).listings.withColumns(
        {"ingredient_form": F.lit(None).cast("string"), "servings": F.lit(None).cast("bigint"), "has_siblings": F.col("id") % 3 == 0, "variant_level": F.lit(False)}
    )
    return tot.suggest_total(rows).select("id", "suggestion.total", "suggestion.source")


@query(
    "suggest_total_variants",
    """SELECT p_partkey AS id, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size * 10 WHEN 2 THEN p_size * 3 + 7 WHEN 3 THEN p_size * 100 END AS DOUBLE) AS total,
CASE p_partkey % 4 WHEN 0 THEN 'g' ELSE 'mg' END AS unit, CASE p_partkey % 4 WHEN 0 THEN 'single_variant' WHEN 1 THEN 'pack_stated' WHEN 2 THEN 'blend_stated' ELSE 'pack_count' END AS source FROM part""",
)
def suggest_variants(spark, sf):
    n = F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 4
    triple = (F.col("p_size") * 3 + 7).cast("string")
    variant = (
        F.when(kind == 0, F.concat(n, F.lit(" g tub")))
        .when(kind == 1, F.concat(n, F.lit("mg Kit ("), (F.col("p_size") * 10).cast("string"), F.lit("mg)")))
        .when(kind == 2, F.concat(n, F.lit("mg / "), (F.col("p_size") * 2).cast("string"), F.lit("mg / 7mg ("), triple, F.lit("mg)")))
        .otherwise(F.concat(n, F.lit("mg")))
    )
    rows = spread(Data(spark, sf).table("part")).select(
        F.col("p_partkey").alias("id"),
        F.when(kind == 2, "Red Blend").when(kind == 3, "Red pack of 100 vials").otherwise("Red").alias("product_title"),
        variant.alias("variant_title"),
        F.concat(F.lit('{"variation_attributes":[{"name":"Size","value":"'), variant, F.lit('"}]}')).alias("raw_attributes_json"),
        F.lit("powder").alias("ingredient_form"), F.lit(0).cast("bigint").alias("servings"), F.lit(True).alias("has_siblings"), F.lit(False).alias("variant_level"),
    )
    return tot.suggest_total(rows).select("id", "suggestion.*")


@query("source_labels", "SELECT id, CASE total_active_source WHEN 'blend_sum' THEN 'parts of the mixture added up' WHEN 'single_title' THEN 'one amount, in the title' ELSE '' END AS label FROM v_offers")
def source_labels(spark, sf):
    return Data(spark, sf).offers.select("id", tot.source_label(F.col("total_active_source")).alias("label"))


def vial_names():
    """Titles that state the amount of one vial, and the offer's unit."""
    size = F.col("strength_per_serving").cast("int").cast("string")
    return {
        "product_title": F.concat(F.lit("Vial "), size, F.lit("mg no "), F.col("source_product_id")),
        "variant_title": F.when(F.col("source_variant_id") != "", F.concat(size, F.lit(" mg"))).otherwise(""),
        "strength_unit": F.when(F.col("partkey") % 2 == 0, "g").otherwise("mg"),
    }


def vial_offers(d: Data):
    """Queue offers of single vials: the title states the amount and some variants share a product."""
    return d.offers.withColumns({**vial_names(), "ingredient_form": F.lit("powder"), "servings_per_container": F.lit(None).cast("int")})


def vial_raw(vials):
    return vials.select(
        "merchant_id", "source_product_id", "source_variant_id", F.lit(1).alias("id"),
        F.to_json(F.struct(F.lit("shopify").alias("source"), "source_product_id", "source_variant_id", "product_title", "variant_title")).alias("raw_json"),
    )


FILLABLE = f"""SELECT *, {SIBLINGS.replace("count(*) OVER (PARTITION BY merchant_id, product_title) > 1", "false")} AS sib FROM v_offers"""


@query(
    "fill_totals",
    f"""SELECT id, {ROUND("CASE WHEN partkey % 2 = 0 THEN strength_per_serving / 1000 ELSE strength_per_serving END", 4)} AS total, CASE WHEN partkey % 2 = 0 THEN 'g' ELSE 'mg' END AS unit,
CASE WHEN source_variant_id <> '' THEN 'single_variant' ELSE 'single_title' END AS source
FROM ({FILLABLE}) x WHERE visibility_status IN ('pending', 'needs_review') AND total_active_per_container IS NULL AND partkey % 12 <> 0 AND (source_variant_id <> '' OR NOT sib)""",
)
def fill_totals(spark, sf):
    d = Data(spark, sf)
    rates = d.ingredients
    vials = materialize(vial_offers(d), "offers")
    out = tot.fill_totals(vials, vial_raw(vials), rates=rates)
    # The suggestions are written, and the fill reads nothing else of the offers.
    discard(vials)
    return out.select("id", F.col("total_active_per_container").alias("total"), F.col("strength_unit").alias("unit"), F.col("total_active_source").alias("source"))


@query(
    "blend_repair",
    """SELECT 'recheck' AS kind, id FROM v_offers WHERE total_active_source LIKE 'blend%' AND total_active_per_container IS NOT NULL AND visibility_status NOT IN ('pending', 'needs_review')
UNION ALL SELECT 'cleared', id FROM v_offers WHERE total_active_source LIKE 'blend%' AND total_active_per_container IS NOT NULL AND visibility_status IN ('pending', 'needs_review')""",
)
def blend_repair(spark, sf):
    d = Data(spark, sf)
    # The titles name capsules, so no automatic total can stand.
    offers = materialize(d.costed.drop("standardization_default_pct", "elemental_percentage"), "offers", wide=True)
    repaired, recheck = tot.blend_repair(offers, d.raw_of(offers))
    a = recheck.select(F.lit("recheck").alias("kind"), "id")
    return a.unionByName(repaired.where("total_active_per_container is null").select(F.lit("cleared").alias("kind"), "id"))


@query(
    "probe_totals",
    """SELECT id, CASE WHEN known_count IS NULL OR style = 4 THEN 'missing' WHEN abs(known_strength * known_count - size) / size <= 0.01 THEN 'ok' ELSE 'wrong' END AS status,
coalesce(known_count > 1 AND known_unit = 'mg' AND abs(known_strength - size) / size <= 0.01, false) AS strength_is_total, CASE WHEN style IN (1, 2, 4) THEN 'not_found' ELSE 'title' END AS best_source FROM v_listings""",
)
def probe_totals(spark, sf):
    rows = Data(spark, sf).listings.withColumns(
        {
            "truth": F.col("size").cast("double"), "truth_unit": F.lit("mg"), "current_strength": F.col("known_strength"),
            "current_strength_unit": F.col("known_unit"), "current_servings": F.col("known_count"),
        }
    )
    out = tot.probe_totals(rows)
    return out.select("id", F.col("current_status").alias("status"), F.coalesce("strength_is_total", F.lit(False)).alias("strength_is_total"), "best_source")


def diagnostic(spark, sf):
    d = Data(spark, sf)
    offers = materialize(d.costed.drop("standardization_default_pct", "elemental_percentage"), "offers", wide=True)
    out = tot.total_diagnostic(offers, d.raw_of(offers), d.merchants, d.ingredients)
    # The diagnostic is written, and reads the offers no more.
    discard(offers)
    return out


CONFIRMED = """SELECT o.*, m.name AS merchant, CASE WHEN total_active_per_container > 0 THEN total_active_per_container ELSE total_strength END AS truth,
CASE WHEN total_active_per_container > 0 THEN 'operator_total' ELSE 'approved_derived' END AS truth_source
FROM v_costed o LEFT JOIN v_merchants m ON m.id = o.merchant_id WHERE total_active_per_container > 0 OR (visibility_status IN ('active', 'paused') AND total_strength > 0)"""
SCORED = f"""SELECT *, CASE WHEN strength_per_serving * servings_per_container = truth THEN 'ok' WHEN abs(strength_per_serving * servings_per_container - truth) / truth <= 0.01 THEN 'ok' ELSE 'wrong' END AS status,
CASE WHEN abs(strength_per_serving * servings_per_container - truth) / truth <= 0.01 THEN 'per_serving_x_count' ELSE 'not_found' END AS best FROM ({CONFIRMED}) c"""


@query("total_diagnostic", f"SELECT id AS offer_id, merchant, truth, truth_source, status AS current_status, best AS best_source, 'none' AS fill_status FROM ({SCORED}) s")
def total_diagnostic(spark, sf):
    return diagnostic(spark, sf).select("offer_id", "merchant", "truth", "truth_source", "current_status", "best_source", "fill_status")


@query(
    "diagnostic_summary",
    f"""SELECT truth_source, best AS best_source, count(*) AS n, count_if(status = 'ok') AS ok, count_if(status = 'wrong') AS wrong FROM ({SCORED}) s GROUP BY CUBE (truth_source, best)""",
)
def diagnostic_summary(spark, sf):
    return tot.diagnostic_summary(diagnostic(spark, sf)).select("truth_source", "best_source", "n", "ok", "wrong")


@query("fill_summary", f"SELECT '' AS fill_source, 0 AS \"right\", 0 AS wrong, count(*) AS \"none\" FROM ({SCORED}) s")
def fill_summary(spark, sf):
    return tot.fill_summary(diagnostic(spark, sf))


@query(
    "diagnostic_by_merchant",
    f"""SELECT merchant, count(*) AS n, count_if(status = 'ok') AS ok, count_if(best = 'per_serving_x_count') AS from_per_serving_x_count, count_if(best = 'not_found') AS from_not_found
FROM ({SCORED}) s GROUP BY 1""",
)
def diagnostic_by_merchant(spark, sf):
    return tot.diagnostic_by_merchant(diagnostic(spark, sf)).select("merchant", "n", "ok", "from_per_serving_x_count", "from_not_found")


# Vials with a confirmed total: the one that the title states, twice that, or (of published offers) one derived from other numbers.
FILLS = f"""SELECT *, CASE WHEN told IS NOT NULL THEN told ELSE total_strength END AS truth, CASE WHEN source_variant_id <> '' THEN 'single_variant' WHEN NOT sib THEN 'single_title' ELSE '' END AS fill_source
FROM (SELECT o.*, m.name AS merchant, {SIBLINGS.replace("count(*) OVER (PARTITION BY merchant_id, product_title) > 1", "false")} AS sib,
  CASE partkey % 3 WHEN 0 THEN amount WHEN 1 THEN 2 * amount END AS told FROM (SELECT *, CASE WHEN partkey % 2 = 0 THEN strength_per_serving / 1000 ELSE strength_per_serving END AS amount FROM v_costed) o
  LEFT JOIN v_merchants m ON m.id = o.merchant_id) x WHERE told IS NOT NULL OR (visibility_status = 'active' AND total_strength > 0)"""
FILLED = f"""SELECT *, CASE WHEN fill_source = '' THEN 'none' WHEN partkey % 3 = 0 THEN 'right' ELSE 'wrong' END AS fill_status, CASE WHEN partkey % 3 = 0 THEN 'title' ELSE '' END AS found FROM ({FILLS}) f"""


def filled_diagnostic(spark, sf):
    d = Data(spark, sf)
    amount = F.when(F.col("partkey") % 2 == 0, F.col("strength_per_serving") / 1000).otherwise(F.col("strength_per_serving"))
    third = F.col("partkey") % 3
    costed = d.costed.drop("standardization_default_pct", "elemental_percentage")
    # The names of vials on the same rows; their numbers stay those of the offers.
    offers = costed.withColumn("total_active_per_container", F.when(third == 0, amount).when(third == 1, 2 * amount)).withColumns(vial_names())
    offers = materialize(offers, "offers", wide=True)
    out = tot.total_diagnostic(offers, vial_raw(offers), d.merchants, d.ingredients)
    discard(offers)
    return out


@query("total_diagnostic_fills", f"SELECT id AS offer_id, merchant, truth, fill_source, fill_status, found AS found_in, CASE WHEN found = '' THEN 'not_found' ELSE found END AS best_source FROM ({FILLED}) s")
def total_diagnostic_fills(spark, sf):
    return filled_diagnostic(spark, sf).select("offer_id", "merchant", "truth", "fill_source", "fill_status", F.array_join("found_in", "|").alias("found_in"), "best_source")


@query("fill_summary_by_source", f"SELECT fill_source, count_if(fill_status = 'right') AS \"right\", count_if(fill_status = 'wrong') AS wrong, count_if(fill_status = 'none') AS \"none\" FROM ({FILLED}) s GROUP BY 1")
def fill_summary_by_source(spark, sf):
    return tot.fill_summary(filled_diagnostic(spark, sf))


@query(
    "diagnostic_csv_fills",
    f"""SELECT CAST(id AS STRING) AS offer_id, visibility_status AS visibility, merchant, '1' AS has_raw, found AS found_in, fill_source, fill_status, CASE WHEN partkey % 2 = 0 THEN 'g' ELSE 'mg' END AS truth_unit,
CASE WHEN told IS NOT NULL THEN 'operator_total' ELSE 'approved_derived' END AS truth_source FROM ({FILLED}) s""",
)
def diagnostic_csv_fills(spark, sf):
    cells = ["offer_id", "visibility", "merchant", "has_raw", "found_in", "fill_source", "fill_status", "truth_unit", "truth_source"]
    return tot.diagnostic_csv(filled_diagnostic(spark, sf)).select(*cells)


@query("diagnostic_attribute_keys", "SELECT concat('Dose ', p_type) AS attribute_key, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def attribute_keys(spark, sf):
    size = F.col("p_size").cast("string")
    rows = spread(Data(spark, sf).table("part")).select(
        F.col("p_size").cast("double").alias("truth"), F.lit("mg").alias("truth_unit"), F.col("p_name").alias("product_title"), F.lit("").alias("variant_title"),
        F.lit("").alias("description"), F.concat(F.lit('{"Dose '), "p_type", F.lit('":"'), size, F.lit(' mg"}')).alias("raw_attributes_json"),
        F.lit(None).cast("double").alias("current_strength"), F.lit("mg").alias("current_strength_unit"), F.lit(None).cast("int").alias("current_servings"),
    )
    return tot.diagnostic_attribute_keys(tot.probe_totals(rows))


@query("queue_without_total", "SELECT count_if(visibility_status IN ('pending', 'needs_review') AND (total_strength IS NULL OR total_strength <= 0)) AS queue_missing FROM v_costed")
def queue_without_total(spark, sf):
    return tot.queue_without_total(Data(spark, sf).costed)


@query(
    "review_order",
    f"""SELECT id AS offer_id, visibility_status AS visibility FROM ({SCORED}) s ORDER BY CASE visibility_status WHEN 'active' THEN 0 WHEN 'paused' THEN 1 WHEN 'needs_review' THEN 2 WHEN 'pending' THEN 3 WHEN 'stale' THEN 4 ELSE 9 END, id""",
)
def review_order(spark, sf):
    return tot.review_order(diagnostic(spark, sf)).select("offer_id", "visibility")


@query(
    "diagnostic_csv",
    f"""SELECT CAST(id AS STRING) AS offer_id, CASE WHEN truth = CAST(truth AS BIGINT) THEN CAST(CAST(truth AS BIGINT) AS STRING) ELSE CAST(truth AS STRING) END AS truth, '1' AS has_raw, CASE WHEN best = 'not_found' THEN '' ELSE best END AS found FROM ({SCORED}) s""".replace(
        "CASE WHEN best = 'not_found' THEN '' ELSE best END AS found", "'' AS found_in"
    ),
)
def diagnostic_csv(spark, sf):
    return tot.diagnostic_csv(diagnostic(spark, sf)).select("offer_id", "truth", "has_raw", "found_in")


@query(
    "review_hints",
    """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'unit slip: g stored, mg listed' WHEN 1 THEN '1000 times off' WHEN 2 THEN 'another variant' WHEN 3 THEN 'stored is half'
WHEN 4 THEN 'listing is 7 times stored' ELSE 'stored is 5 times listing' END AS hint FROM part""",
)
def review_hints(spark, sf):
    kind, size = F.col("p_partkey") % 6, F.col("p_size").cast("double")
    factor = F.when(kind == 0, 1.0).when(kind == 1, 1000.0).when(kind == 2, 2.0).when(kind == 3, 2.0).when(kind == 4, 7.0).otherwise(0.2)
    rows = Data(spark, sf).table("part").select(
        F.col("p_partkey").alias("id"), size.alias("truth"), F.when(kind == 0, "g").otherwise("mg").alias("truth_unit"),
        (size * factor).alias("fill_total"), F.lit("mg").alias("fill_unit"), F.when(kind == 2, "single_variant").otherwise("pack_count").alias("fill_source"),
    )
    return rows.select("id", tot.review_hint().alias("hint"))
