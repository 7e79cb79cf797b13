"""Feed validation and cleaning (FIL-1..3, FIL-9, FIL-11, FIL-12, JOIN-1, WIN-1, SET-5, AGG-13, AGG-23)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import ascii_lower, blank, decode_entities, json_list_or_words, numeric, text
from ..functions.urls import site_key
from ..plans.ordered import top_n
from ..schemas import FEED_REQUIRED, KEY
from ..settings import (
    CATALOG_STATUSES,
    DEFAULTS,
    FEED_SOURCES,
    FORMS,
    INGREDIENT_CATEGORIES,
    MERCHANT_STATUSES,
    OWNABLE,
    PLATFORMS,
    STOCK,
    UNITS,
    VARIATION_STATUS,
)

PRICES = ["regular_price", "sale_price", "current_price"]
YES = ["1", "true", "yes", "t", "y", "on"]


def missing_columns(header: list[str], required: list[str] = FEED_REQUIRED) -> list[str]:
    """SET-5: the required columns a header lacks."""
    return [c for c in required if c not in header]


def _lowered(name: str) -> Column:
    return ascii_lower(F.trim(text(F.col(name))))


def validate_rows(df: DataFrame) -> DataFrame:
    """FIL-1: add ``error``, the first rule a row breaks, null when it is sound."""
    have = set(df.columns)

    def one_of(name: str, allowed: list[str]) -> Column:
        return F.when(~_lowered(name).isin(allowed), F.lit(f"{name} is not allowed"))

    rules = [
        F.when(F.trim(text(F.col(c))) == "", F.lit(f"{c} is empty"))
        for c in ("source", "site", "source_product_id", "product_title", "source_product_url")
    ]
    rules += [
        one_of("source", FEED_SOURCES),
        one_of("on_sale", ["true", "false", "1", "0"]),
        one_of("stock_status", STOCK),
        one_of("variation_retrieval_status", VARIATION_STATUS),
    ]
    rules += [
        F.when((F.trim(text(F.col(c))) != "") & numeric(F.col(c)).isNull(), F.lit(f"{c} is not a number"))
        for c in PRICES
        if c in have
    ]
    if "currency" in have:
        code = F.trim(text(F.col("currency")))
        rules.append(F.when((code != "") & ~code.rlike("^[A-Za-z]{3}$"), F.lit("currency is not a 3-letter code")))
    return df.withColumn("error", F.coalesce(*rules))


def resolve_site(df: DataFrame, merchants: DataFrame) -> DataFrame:
    """JOIN-1: add merchant_id and merchant_status by site URL; the lowest merchant id wins."""
    dims = (
        merchants.withColumn("_site", site_key(F.col("site_url")))
        .where(F.col("_site") != "")
        .groupBy("_site")
        .agg(F.min(F.struct("id", "status")).alias("_m"))
        .select("_site", F.col("_m.id").alias("merchant_id"), F.col("_m.status").alias("merchant_status"))
    )
    return df.withColumn("_site", site_key(F.col("site"))).join(dims, "_site", "left").drop("_site")


def resolve_merchants(validated: DataFrame, merchants: DataFrame) -> DataFrame:
    """FIL-2: unknown and inactive merchants become errors of rows that had none."""
    joined = resolve_site(validated, merchants)
    gate = F.when(F.col("merchant_id").isNull(), F.lit("unknown merchant")).when(
        F.col("merchant_status") != "active", F.concat(F.lit("merchant is "), F.col("merchant_status"))
    )
    return joined.withColumn("error", F.coalesce("error", gate)).drop("merchant_status")


def flag_duplicate_keys(df: DataFrame) -> DataFrame:
    """WIN-1: a sound row whose natural key an earlier sound row used is an error naming that row.

    The first row per key comes from an aggregate, so a key that fills a third of
    the feed is combined before it is shuffled.
    """
    keyed = df.withColumn("source_variant_id", text(F.col("source_variant_id")))
    first = keyed.where(F.col("error").isNull()).groupBy(*KEY).agg(F.min("row_num").alias("_first"))
    again = F.col("error").isNull() & (F.col("row_num") > F.col("_first"))
    said = F.concat(F.lit("duplicate of row "), F.col("_first").cast("string"))
    return (
        keyed.join(first, KEY, "left")
        .withColumn("error", F.when(again, said).otherwise(F.col("error")))
        .drop("_first")
        .select(*df.columns)
    )


def validate_feed(feed: DataFrame, merchants: DataFrame) -> DataFrame:
    """FIL-1, FIL-2 and WIN-1 in their order."""
    return flag_duplicate_keys(resolve_merchants(validate_rows(feed), merchants))


def feed_ok(validated: DataFrame) -> DataFrame:
    """FIL-3: one row; any error means that nothing of the file may be imported."""
    return validated.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    ).withColumn("ok", F.col("errors") == 0)


def missing_merchants(validated: DataFrame) -> DataFrame:
    """AGG-13: sites without a merchant and how many rows they sent."""
    return validated.where(F.col("error") == "unknown merchant").groupBy("site").agg(F.count(F.lit(1)).alias("n"))


def error_sample(errors: DataFrame, n: int = 25, by: str = "run_id") -> DataFrame:
    """AGG-23: the first errors of each run."""
    return top_n(errors.where(F.col("error").isNotNull()), [by], [F.col("row_num"), F.col("error")], n).select(by, "row_num", "error")


def _http_only(c: Column) -> Column:
    u = F.trim(text(c))
    return F.when(u.rlike("(?i)^https?://"), u).otherwise("")


def _or_else(c: Column, allowed: list[str], other) -> Column:
    return F.when(c.isin(allowed), c).otherwise(other)


def to_offer_columns(df: DataFrame, currency: str = DEFAULTS.currency) -> DataFrame:
    """FIL-9: the feed-owned columns of an offer, typed and cleaned; no text is cut."""
    have = set(df.columns)

    def cell(name: str) -> Column:
        return text(F.col(name)) if name in have else F.lit("")

    code = F.substring(F.upper(F.regexp_replace(cell("currency"), "[^A-Za-z]", "")), 1, 3)
    columns = {
        "source_platform": cell("source"),
        "source_product_id": cell("source_product_id"),
        "source_variant_id": cell("source_variant_id"),
        "product_title": cell("product_title"),
        "variant_title": cell("variant_title"),
        "brand": cell("brand"),
        "sku": cell("sku"),
        "barcode": cell("barcode"),
        **{p: numeric(cell(p)).cast("decimal(10,4)") for p in PRICES},
        "on_sale": ascii_lower(F.trim(cell("on_sale"))).isin(YES),
        "currency": F.when(code != "", code).otherwise(currency),
        "stock_status": _or_else(ascii_lower(F.trim(cell("stock_status"))), STOCK, "unknown"),
        "source_product_url": _http_only(cell("source_product_url")),
        "source_variant_url": F.nullif(_http_only(cell("source_variant_url")), F.lit("")),
        "variation_retrieval_status": _or_else(
            ascii_lower(F.trim(cell("variation_retrieval_status"))), VARIATION_STATUS, "not_applicable"
        ),
    }
    passed = [c for c in ("merchant_id", "row_num", "description", "raw_attributes_json", "raw_json") if c in have]
    return df.select(*passed, *[v.alias(k) for k, v in columns.items()])


def decode_feed_text(df: DataFrame) -> DataFrame:
    """Decode entities in the free-text cells; attribute JSON is decoded only after parsing."""
    cells = [c for c in ("product_title", "variant_title", "brand", "description") if c in df.columns]
    return df.withColumns({c: decode_entities(F.col(c)) for c in cells})


def _null_if_blank(c: Column) -> Column:
    return F.nullif(F.trim(text(c)), F.lit(""))


def _clean(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.withColumns({k: v for k, v in rules.items() if k in df.columns})


def clean_ingredients(df: DataFrame) -> DataFrame:
    """FIL-11 for ingredients: enum fallbacks, blanks to null, numbers typed."""
    return _clean(
        df,
        {
            "name": F.trim(text(F.col("name"))),
            "category": _or_else(_lowered("category"), INGREDIENT_CATEGORIES, "other"),
            "default_unit": _or_else(F.trim(text(F.col("default_unit"))), UNITS, "mg"),
            "elemental_percentage": numeric(F.col("elemental_percentage")),
            "standardization_compound": _null_if_blank(F.col("standardization_compound")),
            "standardization_default_pct": numeric(F.col("standardization_default_pct")),
            "status": _or_else(_lowered("status"), CATALOG_STATUSES, "draft"),
        },
    )


def clean_canonicals(df: DataFrame) -> DataFrame:
    """FIL-11 for catalog products."""
    return _clean(
        df,
        {
            "ingredient_form": _or_else(_lowered("ingredient_form"), FORMS, F.lit(None).cast("string")),
            "strength_per_serving": numeric(F.col("strength_per_serving")),
            "servings_per_container": numeric(F.col("servings_per_container")).cast("int"),
            "standardization_compound": _null_if_blank(F.col("standardization_compound")),
            "standardization_percentage": numeric(F.col("standardization_percentage")),
            "seo_indexable": _lowered("seo_indexable").isin(YES),
            "status": _or_else(_lowered("status"), CATALOG_STATUSES, "draft"),
        },
    )


def clean_merchants(df: DataFrame) -> DataFrame:
    """FIL-11 for merchants: the site URL gets a scheme and loses its trailing slashes."""
    site = F.trim(text(F.col("site_url")))
    full = F.when((site != "") & ~site.rlike("(?i)^https?://"), F.concat(F.lit("https://"), site)).otherwise(site)
    return _clean(
        df,
        {
            "name": F.trim(text(F.col("name"))),
            "platform": _or_else(_lowered("platform"), PLATFORMS, "generic"),
            "status": _or_else(_lowered("status"), MERCHANT_STATUSES, "active"),
            "site_url": F.regexp_replace(full, "/+$", ""),
            "coupon_code": _null_if_blank(F.col("coupon_code")),
            "coupon_details": _null_if_blank(F.col("coupon_details")),
        },
    )


def clean_curator_edits(df: DataFrame) -> DataFrame:
    """FIL-12: a curator's edit: enums checked, blanks to null, lists split, confidence between 0 and 1."""
    yes = {c: _lowered(c).isin(YES) for c in ("third_party_tested", "coa_available")}
    conf = numeric(F.col("match_confidence"))
    return _clean(
        df,
        {
            "canonical_product_id": F.nullif(text(F.col("canonical_product_id")), F.lit("")).try_cast("bigint"),
            "ingredient_id": F.nullif(text(F.col("ingredient_id")), F.lit("")).try_cast("bigint"),
            "ingredient_form": _or_else(_lowered("ingredient_form"), FORMS, F.lit(None).cast("string")),
            "strength_unit": _or_else(F.trim(text(F.col("strength_unit"))), UNITS, F.lit(None).cast("string")),
            "strength_per_serving": numeric(F.col("strength_per_serving")),
            "servings_per_container": numeric(F.col("servings_per_container")).cast("int"),
            "total_active_per_container": numeric(F.col("total_active_per_container")),
            "standardization_percentage": numeric(F.col("standardization_percentage")),
            **yes,
            "coa_url": F.nullif(_http_only(F.col("coa_url")), F.lit("")),
            "certifications": json_list_or_words(F.col("certifications")),
            "match_confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)),
        },
    )


def owned_fields(old: Column, changed: Column) -> Column:
    """SET-4: the owned fields plus the newly changed ones, limited to the tracked fields."""
    tracked = F.array(*[F.lit(f) for f in OWNABLE])
    kept = F.array_intersect(F.coalesce(old, F.array().cast("array<string>")), tracked)
    return F.array_union(kept, F.array_intersect(changed, tracked))


def changed_fields(before: str, after: str, fields: list[str], numeric_fields: set[str]) -> Column:
    """The tracked fields whose value differs between two column prefixes; blank against a value counts."""

    def differs(f: str) -> Column:
        a, b = F.col(before + f), F.col(after + f)
        if f in numeric_fields:
            gone, here = a.isNull(), b.isNull()
            moved = F.abs(a.cast("double") - b.cast("double")) > 0.00005
        else:
            gone, here = blank(a.cast("string")), blank(b.cast("string"))
            moved = a.cast("string") != b.cast("string")
        return F.when((gone != here) | (~gone & ~here & moved), F.lit(f))

    tags: list[Column] = reduce(lambda acc, f: acc + [differs(f)], fields, [])
    return F.filter(F.array(*tags), lambda x: x.isNotNull())
