"""Landed shop payloads to offer rows (SRC-5, SRC-6, VAR-1, VAR-2).

A payload is one product's JSON text per row.  The schema is explicit, so the
parser reads only the fields in use and fields keep the text they were sent as.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import compare_at_pricing, minor_unit_money, sale_if_on_sale
from ..functions.stock import stock_from_shopify, stock_from_woo
from ..functions.text import ascii_lower, numeric, strip_html, text
from ..functions.urls import variation_url
from ..schemas import FEED_COLUMNS

SHOPIFY_PRODUCT = """id STRING, title STRING, handle STRING, body_html STRING, vendor STRING, product_type STRING,
tags STRING, created_at STRING, updated_at STRING,
options ARRAY<STRUCT<name: STRING, position: INT, values: ARRAY<STRING>>>,
variants ARRAY<STRUCT<id: STRING, title: STRING, option1: STRING, option2: STRING, option3: STRING, sku: STRING,
barcode: STRING, price: STRING, compare_at_price: STRING, available: BOOLEAN, inventory_quantity: STRING,
inventory_policy: STRING>>"""

WOO_PRICES = """STRUCT<price: STRING, regular_price: STRING, sale_price: STRING, currency_code: STRING,
currency_minor_unit: STRING, price_range: STRUCT<min_amount: STRING, max_amount: STRING>>"""

WOO_PRODUCT = f"""id STRING, name STRING, slug STRING, permalink STRING, description STRING, short_description STRING,
sku STRING, global_unique_id STRING, has_options BOOLEAN, on_sale BOOLEAN, is_in_stock BOOLEAN, is_on_backorder BOOLEAN,
is_purchasable BOOLEAN, prices {WOO_PRICES}, brands ARRAY<STRUCT<name: STRING>>,
categories ARRAY<STRUCT<name: STRING>>, tags ARRAY<STRUCT<name: STRING>>,
attributes ARRAY<STRUCT<id: STRING, name: STRING, taxonomy: STRING, has_variations: BOOLEAN,
terms: ARRAY<STRUCT<id: STRING, name: STRING, slug: STRING>>, options: ARRAY<STRING>>>,
variations ARRAY<STRUCT<id: STRING, attributes: ARRAY<STRUCT<name: STRING, value: STRING>>>>"""

WOO_VARIATION = f"""id STRING, parent STRING, sku STRING, variation STRING, on_sale BOOLEAN, is_in_stock BOOLEAN,
is_on_backorder BOOLEAN, is_purchasable BOOLEAN, prices {WOO_PRICES},
attributes ARRAY<STRUCT<name: STRING, value: STRING>>"""


def feed_rows(df: DataFrame, cells: dict[str, Column], site: str, run: dict[str, str]) -> DataFrame:
    """The 31 feed columns in order; what a source does not know is blank."""
    fixed = {"export_run_id": run["export_run_id"], "exported_at": run["exported_at"], "site": site, "store_name": run.get("store_name", "")}
    every = {**{k: F.lit(v) for k, v in fixed.items()}, **cells}
    return df.select(*[text(every[c] if c in every else F.lit("")).alias(c) for c in FEED_COLUMNS])


def yes_no(c: Column) -> Column:
    return F.when(c, "true").when(~c, "false").otherwise("")


def shopify_to_offers(payloads: DataFrame, site: str, run: dict[str, str], currency: str = "", col: str = "json") -> DataFrame:
    """SRC-5: one row per variant, one row for a product without any."""
    p = payloads.select(F.from_json(F.col(col), SHOPIFY_PRODUCT).alias("p")).where(F.col("p").isNotNull())
    p = p.select("p", F.explode_outer("p.variants").alias("v"))
    v, real = F.col("v"), F.col("v").isNotNull()
    default = F.coalesce(v["title"] == "Default Title", F.lit(False))
    price = compare_at_pricing(v["price"], v["compare_at_price"])
    tags = F.coalesce(F.from_json("p.tags", "array<string>"), F.array(text(F.col("p.tags"))))
    base = [
        tags.alias("tags"),
        text(F.col("p.product_type")).alias("product_type"),
        F.coalesce("p.options", F.array().cast("array<struct<name:string,position:int,values:array<string>>>")).alias("options"),
        text(F.col("p.vendor")).alias("vendor"),
    ]
    options = F.struct(*[F.nullif(v[o], F.lit("")).alias(o) for o in ("option1", "option2", "option3")])
    inventory = F.struct(
        v["inventory_policy"].alias("policy"), v["inventory_quantity"].alias("quantity"), v["available"].alias("available")
    )
    with_variant = F.to_json(F.struct(*base, options.alias("variant_options"), inventory.alias("inventory")))
    handle = text(F.col("p.handle"))
    url = F.when(handle != "", F.concat(F.lit(site.rstrip("/") + "/products/"), handle)).otherwise("")
    own_url = (url != "") & (text(v["id"]) != "") & ~default
    cells = {
        "source": F.lit("shopify"),
        "source_product_id": F.col("p.id"),
        "source_variant_id": v["id"],
        "product_title": F.col("p.title"),
        "variant_title": F.when(default, "").otherwise(v["title"]),
        "handle": handle,
        "brand": F.col("p.vendor"),
        "product_type": F.col("p.product_type"),
        "sku": v["sku"],
        "barcode": v["barcode"],
        "regular_price": F.when(text(v["price"]) != "", price["regular"]),
        "sale_price": F.when(text(v["price"]) != "", price["sale"]),
        "current_price": v["price"],
        "on_sale": F.when(real & (text(v["price"]) != ""), price["on_sale"]).otherwise("false"),
        "currency": F.lit(currency),
        "currency_minor_unit": F.lit("2"),
        "price_source": F.lit("shopify_variant"),
        "stock_status": stock_from_shopify(v["available"], v["inventory_quantity"], v["inventory_policy"]),
        "purchasable": yes_no(v["available"]),
        "source_product_url": url,
        "source_variant_url": F.when(own_url, F.concat(url, F.lit("?variant="), v["id"])),
        "source_created_at": F.col("p.created_at"),
        "source_updated_at": F.col("p.updated_at"),
        "variation_retrieval_status": F.when(real & ~default, "retrieved").otherwise("not_applicable"),
        "description": strip_html(F.col("p.body_html")),
        "raw_attributes_json": F.when(real, with_variant).otherwise(F.to_json(F.struct(*base))),
    }
    return feed_rows(p, cells, site, run)


def brand_of(p: Column) -> Column:
    """VAR-2: the first brand, else the first term or option of an attribute called brand."""
    named = F.get(F.filter(p["attributes"], lambda a: ascii_lower(F.trim(a["name"])) == "brand"), F.lit(0))
    term = F.get(named["terms"], F.lit(0))["name"]
    return F.coalesce(F.get(p["brands"], F.lit(0))["name"], term, F.get(named["options"], F.lit(0)), F.lit(""))


def barcode_of(p: Column) -> Column:
    """VAR-2: the global trade id."""
    gtin = text(p["global_unique_id"])
    return F.when(gtin == "0", "").otherwise(gtin)


_PAIRS = "array<struct<name:string,value:string,label:string>>"
_UNIT_NAMES = r"(?i)^(?:mg|mcg|g|iu|ml)$"


def variation_attributes(p: Column, v: Column) -> Column:
    """VAR-1: array<struct<name, value, label>> of the options a variation stands for.

    Taken from the parent's list by variation id, else from the variation's own
    text split at the parent's attribute names, else from its own attributes.
    """
    no_terms = F.array().cast("array<struct<id:string,name:string,slug:string>>")

    def terms_of(name: Column) -> Column:
        same = F.filter(p["attributes"], lambda a: ascii_lower(a["name"]) == ascii_lower(name))
        return F.flatten(F.transform(same, lambda a: F.coalesce(a["terms"], no_terms)))

    def label(name: Column, slug: Column) -> Column:
        known = F.try_element_at(F.filter(terms_of(name), lambda t: t["slug"] == slug), F.lit(-1))["name"]
        shown = F.coalesce(known, slug)
        bare = numeric(shown).isNotNull() & F.trim(name).rlike(_UNIT_NAMES)
        return F.when(bare, F.concat(shown, F.lit(" "), F.trim(name))).otherwise(shown)

    def labelled(pairs: Column) -> Column:
        return F.transform(
            F.filter(pairs, lambda a: text(a["value"]) != ""),
            lambda a: F.struct(text(a["name"]).alias("name"), a["value"].alias("value"), label(text(a["name"]), a["value"]).alias("label")),
        )

    listed = F.get(F.filter(p["variations"], lambda x: (x["id"] == v["id"]) & (F.size(x["attributes"]) > 0)), F.lit(0))["attributes"]
    from_parent = labelled(listed)

    # "Size: 10MG, Form: Vial": only a comma before a known attribute name ends a value.
    names = F.transform(p["attributes"], lambda a: a["name"])
    pieces = F.split(F.trim(text(v["variation"])), r",\s*")

    def starts(piece: Column) -> Column:
        return F.exists(names, lambda n: piece.startswith(F.concat(n, F.lit(":"))))

    start = F.array().cast("array<string>")
    joined = F.aggregate(
        pieces,
        start,
        lambda acc, piece: F.when(starts(piece) | (F.size(acc) == 0), F.concat(acc, F.array(piece))).otherwise(
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.concat(F.try_element_at(acc, F.lit(-1)), F.lit(", "), piece)),
            )
        ),
    )

    def read(piece: Column) -> Column:
        name = F.get(F.filter(names, lambda n: piece.startswith(F.concat(n, F.lit(":")))), F.lit(0))
        shown = F.trim(F.substring(piece, F.length(name) + 2, F.length(piece)))
        slug = F.coalesce(F.get(F.filter(terms_of(name), lambda t: t["name"] == shown), F.lit(0))["slug"], shown)
        return F.struct(name.alias("name"), slug.alias("value"), label(name, slug).alias("label"))

    spelled = F.transform(F.filter(joined, starts), read)
    own = labelled(v["attributes"])
    empty = F.array().cast(_PAIRS)
    return F.coalesce(
        F.when(F.size(from_parent) > 0, from_parent),
        F.when(F.size(spelled) > 0, spelled),
        own,
        empty,
    )


def woo_to_offers(products: DataFrame, variations: DataFrame, site: str, run: dict[str, str], col: str = "json") -> DataFrame:
    """SRC-6: simple products give one row, variable ones a row per variation, or one parent row when none were landed."""
    p = products.select(F.from_json(F.col(col), WOO_PRODUCT).alias("p")).where(F.col("p").isNotNull())
    v = variations.select(F.from_json(F.col(col), WOO_VARIATION).alias("v")).select("v", F.col("v.parent").alias("_parent"))
    variable = F.coalesce(F.col("p.has_options"), F.lit(False))
    # Simple products take no part in the join.
    joined = (
        p.where(variable)
        .join(v, F.col("p.id") == F.col("_parent"), "left")
        .drop("_parent")
        .unionByName(p.where(~variable).withColumn("v", F.lit(None).cast(v.schema["v"].dataType)))
    )
    prod, var = F.col("p"), F.col("v")
    joined = joined.withColumn("_pairs", F.when(var.isNotNull(), variation_attributes(prod, var)))
    is_var = var.isNotNull()
    fallback = F.coalesce(prod["has_options"], F.lit(False)) & ~is_var
    minor = F.coalesce(var["prices"]["currency_minor_unit"], prod["prices"]["currency_minor_unit"])

    def either(name: str) -> Column:
        return F.when(is_var, var[name]).otherwise(prod[name])

    def price(name: str) -> Column:
        return F.when(is_var, var["prices"][name]).otherwise(prod["prices"][name])

    on_sale = F.coalesce(either("on_sale"), F.lit(False))
    sale = sale_if_on_sale(on_sale, text(price("sale_price")), text(price("regular_price")))
    names = lambda c: F.filter(F.transform(c, lambda x: text(x["name"])), lambda n: n != "")
    none = F.array().cast("array<string>")
    categories = F.coalesce(names(prod["categories"]), none)
    base = [
        categories.alias("categories"),
        F.coalesce(names(prod["tags"]), none).alias("tags"),
        prod["attributes"].alias("attributes"),
        F.coalesce(prod["has_options"], F.lit(False)).alias("has_options"),
    ]
    chosen = F.transform("_pairs", lambda a: F.struct(a["name"].alias("name"), a["label"].alias("value"), a["value"].alias("slug")))
    span = F.struct(prod["prices"]["price_range"]["min_amount"].alias("min"), prod["prices"]["price_range"]["max_amount"].alias("max"))
    raw = (
        F.when(is_var, F.to_json(F.struct(*base, chosen.alias("variation_attributes"))))
        .when(fallback, F.to_json(F.struct(*base, F.lit(True).alias("variable_product_fallback"), span.alias("price_range")), {"ignoreNullFields": "false"}))
        .otherwise(F.to_json(F.struct(*base)))
    )
    title = F.array_join(F.filter(F.transform("_pairs", lambda a: F.when(a["label"] != "", a["label"]).otherwise(a["name"])), lambda s: s != ""), " / ")
    link = variation_url(prod["permalink"], F.col("_pairs"), F.transform(prod["attributes"], lambda a: F.struct(a["name"], a["taxonomy"])))
    cells = {
        "source": F.lit("woocommerce"),
        "source_product_id": prod["id"],
        "source_variant_id": var["id"],
        "product_title": prod["name"],
        "variant_title": F.when(is_var, title).when(fallback, "(variations not retrieved)"),
        "handle": prod["slug"],
        "brand": brand_of(prod),
        "product_type": F.array_join(categories, ", "),
        "sku": either("sku"),
        "barcode": F.when(~is_var, barcode_of(prod)),
        "regular_price": F.when(~fallback, minor_unit_money(price("regular_price"), minor)),
        "sale_price": F.when(~fallback, F.when(sale != "", minor_unit_money(sale, minor))),
        "current_price": minor_unit_money(price("price"), minor),
        "on_sale": yes_no(on_sale),
        "currency": F.coalesce(F.nullif(var["prices"]["currency_code"], F.lit("")), prod["prices"]["currency_code"]),
        "currency_minor_unit": minor,
        "price_source": F.when(is_var, "woo_variation_api").otherwise("woo_store_api"),
        "stock_status": stock_from_woo(either("is_in_stock"), either("is_on_backorder")),
        "purchasable": yes_no(either("is_purchasable")),
        "source_product_url": prod["permalink"],
        "source_variant_url": F.when(is_var & (link != prod["permalink"]), link),
        "is_variable_parent": F.when(fallback, "true"),
        "variation_retrieval_status": F.when(is_var, "retrieved").when(fallback, "fallback_parent_only").otherwise("not_applicable"),
        "description": strip_html(F.coalesce(F.nullif(prod["description"], F.lit("")), prod["short_description"])),
        "raw_attributes_json": raw,
    }
    return feed_rows(joined, cells, site, run)
