"""Explicit schemas of the feed, the working tables and the landed payloads."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# The feed's columns, in their published order.
FEED_COLUMNS = """export_run_id exported_at source site source_product_id source_variant_id product_title
variant_title handle brand product_type sku barcode regular_price sale_price current_price on_sale currency
currency_minor_unit price_source stock_status purchasable source_product_url source_variant_url source_created_at
source_updated_at is_variable_parent variation_retrieval_status description raw_attributes_json store_name""".split()

FEED_REQUIRED = """export_run_id exported_at source site source_product_id product_title on_sale stock_status
source_product_url variation_retrieval_status""".split()

FEED = T.StructType([T.StructField(c, T.StringType()) for c in FEED_COLUMNS])

INGREDIENT_CSV = """slug name aliases category default_unit elemental_percentage standardization_compound
standardization_default_pct status notes""".split()

CANONICAL_CSV = """slug ingredient_slug ingredient_form strength_per_serving servings_per_container
standardization_compound standardization_percentage display_name seo_indexable status""".split()

KEY = ["merchant_id", "source_product_id", "source_variant_id"]


_TYPES = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "DOUBLE": T.DoubleType(),
    "TIMESTAMP": T.TimestampType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()),
}


def _fields(text: str) -> T.StructType:
    """A schema from "name TYPE, ..." without needing a running session."""

    def kind(name: str) -> T.DataType:
        decimal = re.fullmatch(r"DECIMAL\((\d+),(\d+)\)", name)
        return T.DecimalType(*map(int, decimal.groups())) if decimal else _TYPES[name]

    columns = re.findall(r"(\w+) (DECIMAL\(\d+,\d+\)|[A-Z<>]+)", text)
    return T.StructType([T.StructField(c, kind(t)) for c, t in columns])


OFFERS = _fields(
    """id BIGINT, merchant_id BIGINT, source_platform STRING, source_product_id STRING, source_variant_id STRING,
    product_title STRING, variant_title STRING, brand STRING, sku STRING, barcode STRING,
    ingredient_id BIGINT, canonical_product_id BIGINT, ingredient_form STRING,
    strength_per_serving DECIMAL(12,4), strength_unit STRING, servings_per_container INT,
    total_active_per_container DECIMAL(14,4), total_active_source STRING, total_strength DECIMAL(14,4),
    standardization_percentage DECIMAL(5,2), active_compound_per_serving DECIMAL(12,4),
    active_compound_total DECIMAL(14,4), regular_price DECIMAL(10,4), sale_price DECIMAL(10,4),
    current_price DECIMAL(10,4), on_sale BOOLEAN, currency STRING, cost_per_serving DECIMAL(10,4),
    cost_per_active_unit DECIMAL(12,6), stock_status STRING, third_party_tested BOOLEAN, coa_available BOOLEAN,
    coa_url STRING, certifications ARRAY<STRING>, source_product_url STRING, source_variant_url STRING,
    variation_retrieval_status STRING, visibility_status STRING, pre_stale_status STRING,
    match_confidence DECIMAL(3,2), operator_fields ARRAY<STRING>, operator_notes STRING,
    last_seen_import_run_id BIGINT, first_seen_at TIMESTAMP, last_synced_at TIMESTAMP, updated_at TIMESTAMP"""
)

MERCHANTS = _fields(
    """id BIGINT, slug STRING, name STRING, site_url STRING, platform STRING, status STRING,
    affiliate_url_template STRING, coupon_code STRING, coupon_details STRING"""
)

INGREDIENTS = _fields(
    """id BIGINT, slug STRING, name STRING, aliases ARRAY<STRING>, category STRING, default_unit STRING,
    elemental_percentage DECIMAL(5,2), standardization_compound STRING, standardization_default_pct DECIMAL(5,2),
    status STRING, notes STRING"""
)

CANONICALS = _fields(
    """id BIGINT, slug STRING, ingredient_id BIGINT, ingredient_form STRING, strength_per_serving DECIMAL(12,4),
    servings_per_container INT, standardization_compound STRING, standardization_percentage DECIMAL(5,2),
    display_name STRING, seo_indexable BOOLEAN, status STRING, updated_at TIMESTAMP"""
)

RAW = _fields(
    """import_run_id BIGINT, merchant_id BIGINT, source_platform STRING, source_product_id STRING,
    source_variant_id STRING, raw_json STRING, imported_at TIMESTAMP, id BIGINT"""
)

HISTORY = _fields(
    """id BIGINT, offer_id BIGINT, import_run_id BIGINT, old_regular_price DOUBLE, new_regular_price DOUBLE,
    old_sale_price DOUBLE, new_sale_price DOUBLE, old_current_price DOUBLE, new_current_price DOUBLE,
    old_stock_status STRING, new_stock_status STRING, changed_at TIMESTAMP"""
)

CLICKS = _fields(
    """id BIGINT, offer_id BIGINT, canonical_product_id BIGINT, merchant_id BIGINT, clicked_at TIMESTAMP,
    ip_hash STRING, user_agent_hash STRING, referrer STRING, is_bot_suspected BOOLEAN"""
)

MEMORY = _fields(
    """merchant_id BIGINT, title_key STRING, canonical_product_id BIGINT, sample_title STRING, source STRING,
    times_confirmed BIGINT, last_confirmed_at TIMESTAMP"""
)

SUPPRESSIONS = _fields(
    """merchant_id BIGINT, source_product_id STRING, source_variant_id STRING, product_title STRING, brand STRING,
    reason STRING, source_offer_id BIGINT, suppressed_at TIMESTAMP"""
)
