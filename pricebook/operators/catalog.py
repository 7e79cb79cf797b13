"""Reading and publishing the catalog: filters, joins, rollups, sorts and documents.

FIL-4..8, FIL-10, JOIN-15..17, 20, 21, 23..25, AGG-1..6, 10, 11, 19..22, 24, ORD-1..5, SNK-2..4.
"""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import blank, strip_html, text
from ..plans.ordered import top_n
from ..settings import DEFAULTS
from .prices import price_moves


def hours_ago(now: datetime, hours: int) -> Column:
    return F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(max(1, hours)))


def contains_text(needle: str, *cols: str) -> Column:
    """Case-insensitive search over columns; the needle is literal text."""
    wanted = F.lit(needle.lower())
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c)), wanted), F.lit(False)) for c in cols])


def fresh_active(offers: DataFrame, now: datetime, hide_h: int = DEFAULTS.hide_hours) -> DataFrame:
    """FIL-8: offers that are active and were synced within the hide window."""
    return offers.where((F.col("visibility_status") == "active") & (F.col("last_synced_at") >= hours_ago(now, hide_h)))


def with_freshness(offers: DataFrame, now: datetime, warn_h: int = 48, hide_h: int = 168) -> DataFrame:
    """FIL-8: keep what is recent enough to publish and add is_stale."""
    kept = offers.where(F.col("last_synced_at") >= hours_ago(now, hide_h))
    return kept.withColumn("is_stale", F.col("last_synced_at") < hours_ago(now, warn_h))


def query_offers(
    offers: DataFrame,
    visibility: list[str] | None = None,
    merchant_id: int | None = None,
    ingredient_id: int | None = None,
    min_confidence: float = 0,
    has_canonical: str = "",
    search: str = "",
) -> DataFrame:
    """FIL-4: the review filter."""
    out = offers
    if visibility:
        out = out.where(F.col("visibility_status").isin(visibility))
    if merchant_id:
        out = out.where(F.col("merchant_id") == merchant_id)
    if ingredient_id:
        out = out.where(F.col("ingredient_id") == ingredient_id)
    if min_confidence > 0:
        out = out.where(F.col("match_confidence") >= min_confidence)
    if has_canonical in ("yes", "no"):
        present = F.col("canonical_product_id").isNotNull()
        out = out.where(present if has_canonical == "yes" else ~present)
    if search:
        out = out.where(contains_text(search, "product_title", "variant_title", "brand", "sku"))
    return out


def _query(df: DataFrame, equals: dict, search: str, columns: list[str]) -> DataFrame:
    for c, v in equals.items():
        if v not in (None, ""):
            df = df.where(F.col(c) == v)
    return df.where(contains_text(search, *columns)) if search else df


def query_canonicals(canonicals: DataFrame, status=None, form=None, ingredient_id=None, search: str = "") -> DataFrame:
    """FIL-5 for catalog products."""
    return _query(
        canonicals, {"status": status, "ingredient_form": form, "ingredient_id": ingredient_id}, search, ["display_name", "slug"]
    )


def query_ingredients(ingredients: DataFrame, status=None, category=None, search: str = "") -> DataFrame:
    """FIL-5 for ingredients; the search also looks into the aliases."""
    df = ingredients.withColumn("_aliases", F.array_join(F.coalesce("aliases", F.array()), " "))
    return _query(df, {"status": status, "category": category}, search, ["name", "slug", "_aliases"]).drop("_aliases")


def query_merchants(merchants: DataFrame, status=None, platform=None, search: str = "") -> DataFrame:
    """FIL-5 for merchants."""
    return _query(merchants, {"status": status, "platform": platform}, search, ["name", "slug", "site_url"])


def _dim(df: DataFrame, key: str, **cols: str) -> DataFrame:
    return df.select(F.col("id").alias(key), *[F.col(v).alias(k) for k, v in cols.items()])


def with_names(offers: DataFrame, merchants: DataFrame, canonicals: DataFrame, ingredients: DataFrame) -> DataFrame:
    """JOIN-17: names for review; offers without a partner stay."""
    return (
        offers.join(_dim(merchants, "merchant_id", merchant_name="name", merchant_slug="slug"), "merchant_id", "left")
        .join(_dim(canonicals, "canonical_product_id", canonical_display_name="display_name", canonical_slug="slug"), "canonical_product_id", "left")
        .join(_dim(ingredients, "ingredient_id", ingredient_name="name", ingredient_unit="default_unit"), "ingredient_id", "left")
    )


def active_counts(offers: DataFrame, now: datetime, hide_h: int = DEFAULTS.hide_hours) -> DataFrame:
    """AGG-1: fresh active offers per canonical product."""
    live = fresh_active(offers, now, hide_h).where(F.col("canonical_product_id").isNotNull())
    return live.groupBy("canonical_product_id").agg(F.count(F.lit(1)).alias("active_offers"))


def publish_gate(offers: DataFrame, min_active: int, now: datetime, hide_h: int = DEFAULTS.hide_hours) -> DataFrame:
    """JOIN-16: canonical products with enough fresh active offers, counted before any other filter."""
    return active_counts(offers, now, hide_h).where(F.col("active_offers") >= min_active).select("canonical_product_id")


def export_rows(
    offers: DataFrame,
    merchants: DataFrame,
    canonicals: DataFrame,
    ingredients: DataFrame,
    now: datetime,
    hide_h: int = DEFAULTS.hide_hours,
    min_active: int = 1,
) -> DataFrame:
    """JOIN-15: the published offers with merchant, product and ingredient fields.

    The dimensions are filtered and narrowed before the joins; whether one is
    broadcast is left to the optimizer, which knows its size.
    """
    m = _dim(merchants.where(F.col("status") == "active"), "merchant_id", merchant_slug="slug", merchant_name="name")
    c = _dim(
        canonicals.where(F.col("status") != "retired"), "canonical_product_id", canonical_slug="slug",
        canonical_display_name="display_name", canonical_form="ingredient_form", canonical_strength="strength_per_serving",
        canonical_std_compound="standardization_compound", canonical_std_pct="standardization_percentage",
        canonical_ingredient_id="ingredient_id",
    )
    i = _dim(
        ingredients.where(F.col("status") != "retired"), "canonical_ingredient_id", ingredient_name="name",
        ingredient_category="category", ingredient_unit="default_unit", ingredient_aliases="aliases",
    )
    live = fresh_active(offers, now, hide_h).where(F.col("canonical_product_id").isNotNull())
    if min_active > 1:
        live = live.join(publish_gate(offers, min_active, now, hide_h), "canonical_product_id", "left_semi")
    return live.join(m, "merchant_id").join(c, "canonical_product_id").join(i, "canonical_ingredient_id")


def export_rollup(rows: DataFrame) -> DataFrame:
    """AGG-3: offer count and lowest cost per active unit of each published product."""
    return rows.groupBy("canonical_product_id").agg(
        F.count(F.lit(1)).alias("offer_count"), F.min("cost_per_active_unit").alias("lowest_cost_per_active_unit")
    )


def export_order(rows: DataFrame) -> DataFrame:
    """ORD-5: product, cost with missing values first, offer id."""
    return rows.orderBy("canonical_product_id", F.asc_nulls_first("cost_per_active_unit"), "id")


def price_stats(offers: DataFrame, now: datetime, hide_h: int = DEFAULTS.hide_hours, by_currency: bool = False) -> DataFrame:
    """AGG-2: lowest and highest price, count, any in stock and a currency per canonical product."""
    keys = ["canonical_product_id", *(["currency"] if by_currency else [])]
    live = fresh_active(offers, now, hide_h).where(F.col("canonical_product_id").isNotNull())
    aggs = [
        F.min("current_price").alias("low"),
        F.max("current_price").alias("high"),
        F.count(F.lit(1)).alias("offers"),
        F.max(F.col("stock_status") == "in_stock").alias("any_in_stock"),
    ]
    return live.groupBy(*keys).agg(*aggs, *([] if by_currency else [F.max("currency").alias("currency")]))


def filter_catalog(
    rows: DataFrame, in_stock: bool = False, third_party: bool = False, coa: bool = False, min_price: float | None = None,
    max_price: float | None = None, merchant: str = "", form: str = "", ingredient: str = "", search: str = "",
) -> DataFrame:
    """FIL-6: the public list filter over export rows; an offer without a price passes the price limits."""
    out = filter_detail(rows, in_stock, third_party, coa)
    price = F.col("current_price")
    if min_price is not None:
        out = out.where(price.isNull() | (price >= min_price))
    if max_price is not None:
        out = out.where(price.isNull() | (price <= max_price))
    for column, wanted in (("merchant_slug", merchant), ("canonical_form", form), ("ingredient_name", ingredient)):
        if wanted:
            out = out.where(F.col(column) == wanted)
    if search:
        words = [text(F.col(c)) for c in ("product_title", "brand", "canonical_display_name", "ingredient_name")]
        hay = F.lower(F.concat_ws(" ", *words, F.array_join(F.coalesce("ingredient_aliases", F.array()), " ")))
        out = out.where(F.contains(hay, F.lit(search.lower())))
    return out


def filter_detail(rows: DataFrame, in_stock: bool = False, third_party: bool = False, coa: bool = False) -> DataFrame:
    """FIL-7: the public detail filter."""
    out = rows
    if in_stock:
        out = out.where(F.col("stock_status") == "in_stock")
    if third_party:
        out = out.where(F.coalesce("third_party_tested", F.lit(False)))
    if coa:
        out = out.where(F.coalesce("coa_available", F.lit(False)))
    return out


def compare_list(rows: DataFrame, **filters) -> DataFrame:
    """AGG-4: per product the cheapest offer (lowest id on ties), the offers and the merchants that sell it.

    Distinct merchants are counted in two steps, so a product that everybody sells
    is combined before the shuffle.
    """
    kept = filter_catalog(rows, **filters)
    per_merchant = kept.groupBy("canonical_product_id", "canonical_display_name", "merchant_id").agg(
        F.count(F.lit(1)).alias("_offers"),
        F.min(F.when(F.col("cost_per_active_unit").isNotNull(), F.struct("cost_per_active_unit", "id", "current_price"))).alias("_best"),
    )
    return (
        per_merchant.groupBy("canonical_product_id", "canonical_display_name")
        .agg(
            F.sum("_offers").alias("offers"),
            F.count("merchant_id").alias("merchants"),
            F.min("_best").alias("_best"),
        )
        .select(
            "canonical_product_id",
            F.col("canonical_display_name").alias("display_name"),
            "offers",
            "merchants",
            F.col("_best.cost_per_active_unit").alias("lowest_cost"),
            F.col("_best.id").alias("lowest_offer_id"),
            F.col("_best.current_price").alias("lowest_price"),
        )
    )


def page_stats(rows: DataFrame) -> DataFrame:
    """AGG-5: products, offers and distinct merchants of a page."""
    pairs = rows.groupBy("canonical_product_id", "merchant_id").agg(F.count(F.lit(1)).alias("_n"))
    return pairs.agg(
        F.count_distinct("canonical_product_id").alias("products"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("offers"),
        F.count_distinct("merchant_id").alias("merchants"),
    )


def at_a_glance(
    offers: DataFrame, merchants: DataFrame, canonicals: DataFrame, ingredients: DataFrame, history: DataFrame, now: datetime,
    hide_h: int = DEFAULTS.hide_hours, move_days: int = DEFAULTS.price_move_days, min_active: int = 1,
) -> DataFrame:
    """AGG-6: the dashboard's numbers in one row."""
    live = export_rows(offers, merchants, canonicals, ingredients, now, hide_h, min_active).select("id", "stock_status")
    moves = price_moves(history, now, move_days).withColumnRenamed("offer_id", "id")
    stock = F.col("stock_status")
    counts = live.join(moves, "id", "left").agg(
        F.count(F.lit(1)).alias("live_offers"),
        F.count_if(stock == "in_stock").alias("in_stock"),
        F.count_if(stock == "out_of_stock").alias("out_of_stock"),
        F.count_if(~F.coalesce(stock.isin("in_stock", "out_of_stock"), F.lit(False))).alias("other_stock"),
        F.count_if(F.col("dir") == "up").alias("price_up"),
        F.count_if(F.col("dir") == "down").alias("price_down"),
        F.count_if(F.col("dir").isNull()).alias("unchanged"),
    )
    products = canonicals.agg(F.count_if(F.col("status") != "retired").alias("canonicals"))
    shops = merchants.agg(F.count(F.lit(1)).alias("merchants"), F.count_if(F.col("status") == "active").alias("active_merchants"))
    # Three one-row results fold into one row without a join.
    parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [counts, products, shops])
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def facets(rows: DataFrame) -> DataFrame:
    """AGG-21: (facet, value, label) for forms, ingredients and merchants."""
    combos = rows.select("canonical_form", "ingredient_name", "merchant_slug", "merchant_name").distinct()
    entry = F.explode(
        F.array(
            *[
                F.struct(F.lit(facet).alias("facet"), F.col(value).alias("value"), F.col(label).alias("label"))
                for facet, value, label in (
                    ("form", "canonical_form", "canonical_form"),
                    ("ingredient", "ingredient_name", "ingredient_name"),
                    ("merchant", "merchant_slug", "merchant_name"),
                )
            ]
        )
    )
    return (
        combos.select(entry.alias("e"))
        .where(~blank(F.col("e.value")))
        .groupBy("e.facet", "e.value")
        .agg(F.min("e.label").alias("label"))
        .orderBy("facet", "label", "value")
    )


def indexable(canonicals: DataFrame, offers: DataFrame, now: datetime, min_publish: int = 1, hide_h: int = DEFAULTS.hide_hours) -> DataFrame:
    """AGG-22: flagged products with at least three (or the publish minimum) fresh active offers."""
    counts = active_counts(offers, now, hide_h).where(F.col("active_offers") >= max(3, min_publish))
    flagged = canonicals.where(F.col("seo_indexable") & (F.col("status") != "retired"))
    return flagged.join(counts, flagged["id"] == counts["canonical_product_id"]).drop("canonical_product_id")


def sitemap_entries(canonicals: DataFrame, offers: DataFrame, now: datetime, base_url: str, min_publish: int = 1, hide_h: int = DEFAULTS.hide_hours) -> DataFrame:
    """SNK-3: (loc, lastmod, changefreq), newest first."""
    rows = indexable(canonicals, offers, now, min_publish, hide_h)
    loc = F.concat(F.lit(base_url.rstrip("/") + "/compare/"), F.col("slug"), F.lit("/"))
    return rows.orderBy(F.desc("updated_at"), "slug").select(
        loc.alias("loc"), F.date_format("updated_at", "yyyy-MM-dd").alias("lastmod"), F.lit("daily").alias("changefreq")
    )


def aggregate_offer_markup(canonicals: DataFrame, ingredients: DataFrame, offers: DataFrame, now: datetime, hide_h: int = DEFAULTS.hide_hours) -> DataFrame:
    """SNK-4: schema.org markup per product that has offers."""
    stats = price_stats(offers, now, hide_h)
    ing = _dim(ingredients, "ingredient_id", _category="category")
    joined = canonicals.join(stats, canonicals["id"] == stats["canonical_product_id"]).join(ing, "ingredient_id", "left")
    description = strip_html(F.col("seo_content")) if "seo_content" in canonicals.columns else F.lit("")
    short = F.when(F.length(description) > 500, F.concat(F.substring(description, 1, 497), F.lit("…"))).otherwise(description)
    offer = F.struct(
        F.lit("AggregateOffer").alias("@type"),
        F.coalesce(F.nullif(F.col("currency"), F.lit("")), F.lit("USD")).alias("priceCurrency"),
        F.col("low").cast("double").alias("lowPrice"),
        F.col("high").cast("double").alias("highPrice"),
        F.col("offers").alias("offerCount"),
        F.when(F.col("any_in_stock"), "https://schema.org/InStock").otherwise("https://schema.org/OutOfStock").alias("availability"),
    )
    doc = F.struct(
        F.lit("https://schema.org/").alias("@context"),
        F.lit("Product").alias("@type"),
        F.col("display_name").alias("name"),
        F.nullif(short, F.lit("")).alias("description"),
        F.nullif(text(F.col("_category")), F.lit("")).alias("category"),
        offer.alias("offers"),
    )
    # "<" and ">" are escaped so that the text cannot close the script element it sits in.
    escaped = F.replace(F.replace(F.to_json(doc), F.lit("<"), F.lit("\\u003C")), F.lit(">"), F.lit("\\u003E"))
    return joined.select("canonical_product_id", "slug", escaped.alias("markup"))


def _finite(name: str) -> Column:
    v = F.col(name).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v).alias(name)


def _or_null(name: str) -> Column:
    return F.nullif(F.col(name).cast("string"), F.lit("")).alias(name)


def public_offer(rows: DataFrame, now: datetime, warn_h: int = 48, base_url: str = "") -> DataFrame:
    """FIL-10: the public fields of an offer; no source or affiliate URL, description or note."""
    have = set(rows.columns)

    def opt(name: str, kind: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    merchant = F.struct(
        F.col("merchant_id").alias("id"),
        F.col("merchant_slug").alias("slug"),
        F.col("merchant_name").alias("name"),
        F.nullif(opt("merchant_coupon_code", "string"), F.lit("")).alias("coupon_code"),
        F.nullif(opt("merchant_coupon_details", "string"), F.lit("")).alias("coupon_details"),
    )
    synced = F.col("last_synced_at")
    return rows.select(
        "id", "canonical_product_id", merchant.alias("merchant"), text(F.col("brand")).alias("brand"),
        text(F.col("product_title")).alias("product_title"), _or_null("variant_title"),
        _finite("current_price"), _finite("regular_price"), _finite("sale_price"),
        F.coalesce("on_sale", F.lit(False)).alias("on_sale"), text(F.col("currency")).alias("currency"),
        F.col("servings_per_container").cast("int").alias("servings_per_container"),
        *[_finite(c) for c in ("strength_per_serving", "active_compound_per_serving", "active_compound_total", "cost_per_serving", "cost_per_active_unit")],
        text(F.col("stock_status")).alias("stock_status"),
        F.coalesce("third_party_tested", F.lit(False)).alias("third_party_tested"),
        F.coalesce("coa_available", F.lit(False)).alias("coa_available"),
        F.nullif(opt("coa_url", "string"), F.lit("")).alias("coa_url"),
        F.coalesce(opt("certifications", "array<string>"), F.array().cast("array<string>")).alias("certifications"),
        F.concat(F.lit(base_url.rstrip("/") + "/go/"), F.col("id").cast("string")).alias("buy_url"),
        F.date_format(synced, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("last_synced_at"),
        F.coalesce(synced < hours_ago(now, warn_h), F.lit(False)).alias("is_stale"),
        *([F.col("price_move")] if "price_move" in have else []),
    )


def public_canonical(rows: DataFrame) -> DataFrame:
    """FIL-10: one public entry per product, with its rollup."""
    first = [
        F.first(c).alias(c)
        for c in ("canonical_slug", "canonical_display_name", "canonical_ingredient_id", "ingredient_name", "ingredient_category",
                  "ingredient_aliases", "canonical_form", "canonical_strength", "ingredient_unit", "canonical_std_compound", "canonical_std_pct")
    ]
    grouped = rows.groupBy("canonical_product_id").agg(
        *first, F.count(F.lit(1)).alias("offer_count"), F.min("cost_per_active_unit").alias("_low")
    )
    return grouped.select(
        F.col("canonical_product_id").alias("id"),
        text(F.col("canonical_slug")).alias("slug"),
        text(F.col("canonical_display_name")).alias("display_name"),
        F.struct(
            F.col("canonical_ingredient_id").alias("id"),
            text(F.col("ingredient_name")).alias("name"),
            text(F.col("ingredient_category")).alias("category"),
            F.coalesce("ingredient_aliases", F.array().cast("array<string>")).alias("aliases"),
        ).alias("ingredient"),
        text(F.col("canonical_form")).alias("form"),
        F.col("canonical_strength").cast("double").alias("strength_per_serving"),
        text(F.col("ingredient_unit")).alias("strength_unit"),
        F.nullif(text(F.col("canonical_std_compound")), F.lit("")).alias("standardization_compound"),
        F.col("canonical_std_pct").cast("double").alias("standardization_percentage"),
        text(F.col("ingredient_unit")).alias("active_unit_label"),
        F.col("_low").cast("double").alias("lowest_cost_per_active_unit"),
        "offer_count",
    )


def export_catalog(rows: DataFrame, history: DataFrame, now: datetime, settings=DEFAULTS, base_url: str = "") -> tuple[DataFrame, DataFrame]:
    """SNK-2: the published document as two tables, products and offers with their price move."""
    moves = price_moves(history, now, settings.price_move_days).select(F.col("offer_id").alias("id"), F.struct("dir", "pct").alias("price_move"))
    offers = public_offer(rows.join(moves, "id", "left"), now, settings.warn_hours, base_url)
    return public_canonical(rows), offers


SCHEMA_VERSION = 1


def write_catalog(products: DataFrame, offers: DataFrame, path: str, now: datetime) -> None:
    """SNK-2: write both tables as JSON lines into a folder of their own, then publish it.

    Publishing appends one small row that names the folder, so a reader sees the last
    whole version while the next one is being written.
    """
    version = f"{now:%Y%m%dT%H%M%S}-{uuid.uuid4().hex}"
    products.write.json(f"{path}/{version}/canonical_products")
    offers.write.json(f"{path}/{version}/offers")
    head = products.sparkSession.range(1).select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.date_format(F.lit(now).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"),
        F.lit(version).alias("version"),
    )
    head.coalesce(1).write.mode("append").json(f"{path}/published")


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The products and offers of the version published last."""
    version = spark.read.json(f"{path}/published").agg(F.max("version")).first()[0]
    return spark.read.json(f"{path}/{version}/canonical_products"), spark.read.json(f"{path}/{version}/offers")


# The sort keys of the two public tables with the direction of a first click.
DETAIL_KEYS = {
    "merchant": "asc", "active_compound_total": "desc", "strength_per_serving": "desc", "servings_per_container": "desc",
    "cost_per_serving": "asc", "cost_per_active_unit": "asc", "current_price": "asc", "brand": "asc", "last_synced_at": "desc",
}
LIST_KEYS = {"display_name": "asc", "cost_per_active_unit": "asc", "merchant_count": "desc"}


def default_direction(key: str) -> str:
    """ORD-3: the direction of the first click on a column."""
    return DETAIL_KEYS.get(key) or LIST_KEYS.get(key, "asc")


def _nulls_last(c: Column, direction: str) -> Column:
    return c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last()


def sort_detail(rows: DataFrame, key: str = "cost_per_active_unit", direction: str | None = None) -> DataFrame:
    """ORD-1: nulls last both ways, offer id on ties; text compares lower-cased."""
    key = key if key in DETAIL_KEYS else "cost_per_active_unit"
    c = {"merchant": F.lower(text(F.col("merchant_name"))), "brand": F.lower(text(F.col("brand")))}.get(key, F.col(key))
    return rows.orderBy(_nulls_last(c, direction or default_direction(key)), "id")


def sort_list(rows: DataFrame, key: str = "cost_per_active_unit", direction: str | None = None) -> DataFrame:
    """ORD-2: the product list by name, merchants or lowest cost."""
    key = key if key in LIST_KEYS else "cost_per_active_unit"
    c = {"display_name": F.lower(text(F.col("display_name"))), "merchant_count": F.col("merchants")}.get(key, F.col("lowest_cost"))
    return rows.orderBy(_nulls_last(c, direction or default_direction(key)), "canonical_product_id")


REVIEW_KEYS = ["id", "brand", "product_title", "current_price", "match_confidence", "cost_per_active_unit", "updated_at"]


def page_offers(rows: DataFrame, orderby: str = "updated_at", order: str = "DESC", limit: int = 20, offset: int = 0) -> DataFrame:
    """ORD-4: one page of the review list; an unknown key falls back to updated_at."""
    key = orderby if orderby in REVIEW_KEYS else "updated_at"
    c = F.col(key).asc_nulls_first() if order.upper() == "ASC" else F.col(key).desc_nulls_last()
    return rows.orderBy(c, "id").offset(max(0, offset)).limit(max(1, limit))


def list_canonicals(canonicals: DataFrame, ingredients: DataFrame) -> DataFrame:
    """JOIN-25: catalog products with their ingredient's name."""
    return canonicals.join(_dim(ingredients, "ingredient_id", ingredient_name="name", ingredient_unit="default_unit"), "ingredient_id", "left")


def list_memory(memory: DataFrame, merchants: DataFrame, canonicals: DataFrame, search: str = "") -> DataFrame:
    """JOIN-24: learned mappings with names."""
    out = memory.join(_dim(merchants, "merchant_id", merchant_name="name"), "merchant_id", "left").join(
        _dim(canonicals, "canonical_product_id", canonical_display_name="display_name"), "canonical_product_id", "left"
    )
    return out.where(contains_text(search, "title_key", "sample_title", "merchant_name", "canonical_display_name")) if search else out


def list_suppressions(suppressions: DataFrame, merchants: DataFrame, search: str = "") -> DataFrame:
    """JOIN-24: suppressed keys with names."""
    out = suppressions.join(_dim(merchants, "merchant_id", merchant_name="name"), "merchant_id", "left")
    return out.where(contains_text(search, "product_title", "brand", "source_product_id", "merchant_name")) if search else out


def orphans(kind: str, dims: dict[str, DataFrame], offers: DataFrame) -> DataFrame:
    """JOIN-20: dead merchants, retired products or retired ingredients that nothing refers to."""

    def unused(df: DataFrame, status: str, *users: tuple[DataFrame, str]) -> DataFrame:
        out = df.where(F.col("status") == status)
        for table, column in users:
            out = out.join(table.select(F.col(column).alias("id")).where("id is not null"), "id", "left_anti")
        return out

    if kind == "merchant":
        return unused(dims["merchants"], "dead", (offers, "merchant_id"))
    if kind == "canonical":
        return unused(dims["canonicals"], "retired", (offers, "canonical_product_id"))
    return unused(dims["ingredients"], "retired", (dims["canonicals"], "ingredient_id"), (offers, "ingredient_id"))


def cleanup_counts(offers: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """AGG-19: (category, n) for the five things a clean-up can remove."""
    states = offers.agg(
        F.count_if(F.col("visibility_status") == "rejected").alias("rejected_offers"),
        F.count_if(F.col("visibility_status") == "dead").alias("dead_offers"),
    ).select(F.explode(F.create_map(F.lit("rejected_offers"), "rejected_offers", F.lit("dead_offers"), "dead_offers")).alias("category", "n"))
    empty = [
        orphans(kind, dims, offers).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("category"), "n")
        for kind, name in (("merchant", "empty_dead_merchants"), ("canonical", "empty_retired_canonicals"), ("ingredient", "empty_retired_ingredients"))
    ]
    return reduce(DataFrame.unionByName, [states, *empty])


# --- crawl attempts --------------------------------------------------------------------------------------------------


def open_attempts(attempts: DataFrame) -> DataFrame:
    """AGG-11: open attempts per site, with the newest one's id."""
    return (
        attempts.where(F.col("status").isin("pending", "running"))
        .groupBy("site_id")
        .agg(F.count(F.lit(1)).alias("open"), F.max("id").alias("latest_id"))
    )


def attempts_by_status(attempts: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """AGG-10: attempts per status that started in the last hours."""
    return attempts.where(F.col("started_at") >= hours_ago(now, hours)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def stuck_runs(attempts: DataFrame, live_ids: DataFrame | None, now: datetime, minutes: int = DEFAULTS.stale_minutes) -> DataFrame:
    """JOIN-21: open attempts that are old and no longer alive; nothing when the live set is unknown."""
    if live_ids is None:
        return attempts.limit(0)
    limit = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    old = attempts.where(F.col("status").isin("pending", "running") & (F.col("started_at") < limit))
    return old.join(live_ids.select("id"), "id", "left_anti")


def run_history(attempts: DataFrame, sites: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    """JOIN-23: recent attempts with their site."""
    rows = attempts.where(F.col("status") == status) if status else attempts
    newest = rows.orderBy(F.desc("id")).limit(limit)
    return newest.join(_dim(sites, "site_id", site_name="name", site_url="site_url"), "site_id", "left")


def run_durations(attempts: DataFrame, now: datetime) -> DataFrame:
    """AGG-24: seconds per attempt; open ones are measured to now."""
    end = F.coalesce("finished_at", F.lit(now).cast("timestamp"))
    return attempts.withColumn("seconds", F.unix_timestamp(end) - F.unix_timestamp("started_at"))


def last_run_by_site(attempts: DataFrame) -> DataFrame:
    """AGG-24: the last attempt's status, count and error per site."""
    last = attempts.groupBy("site_id").agg(F.max_by(F.struct("status", "offer_count", "error", "started_at"), "id").alias("_l"))
    return last.select("site_id", "_l.*")


def newest_per(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The newest rows of each group."""
    return top_n(df, by, [F.desc(order)], n).drop("_rank")
