"""Landed HTML pages and sitemaps (SRC-7, 8, 10, 11)."""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.stock import stock_from_jsonld
from ..functions.text import ascii_lower, blank, decode_entities, json_value, stringify, strip_html, text
from ..functions.urls import url_host, url_path
from ..session import materialize
from .shops import feed_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LD_SCRIPT = r"""(?is)<script[^>]*\stype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>"""


def _nodes(tree):
    """Every node of a JSON-LD document, through lists and @graph."""
    if isinstance(tree, list):
        for item in tree:
            yield from _nodes(item)
    elif isinstance(tree, dict):
        yield tree
        yield from _nodes(tree.get("@graph"))


def _is_a(node: dict, kinds: set) -> bool:
    t = node.get("@type")
    return bool(kinds & {x for x in (t if isinstance(t, list) else [t]) if isinstance(x, str)})


def _parse(doc: str):
    try:
        return json.loads(doc.strip())
    except (ValueError, AttributeError):
        return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _products(docs: pd.Series) -> pd.Series:
    keep = {"Product"}
    return docs.map(lambda d: [json.dumps(n, ensure_ascii=False) for n in _nodes(_parse(d)) if _is_a(n, keep)])


@F.pandas_udf(T.StringType())
def _site_name(docs: pd.Series) -> pd.Series:
    keep = {"Organization", "WebSite"}

    def first(d):
        names = (n.get("name") for n in _nodes(_parse(d)) if _is_a(n, keep))
        return next((x.strip() for x in names if isinstance(x, str) and x), None)

    return docs.map(first)


def _scripts(pages: DataFrame) -> DataFrame:
    """(page columns, pos, doc): the JSON-LD scripts; pages without any are dropped before the regular expression runs."""
    some = pages.where(F.contains(F.lower("html"), F.lit("application/ld+json")))
    return some.select(
        *[c for c in pages.columns if c != "html"],
        F.posexplode(F.regexp_extract_all("html", F.lit(LD_SCRIPT), F.lit(1))).alias("pos", "doc"),
    )


def jsonld_products(pages: DataFrame) -> DataFrame:
    """SRC-7: one row per Product node: the page's columns and its JSON text in ``product``."""
    s = _scripts(pages)
    kept = [c for c in pages.columns if c != "html"]
    return s.select(*kept, "pos", F.posexplode(_products("doc")).alias("node", "product"))


def _lower_keys(doc: Column) -> Column:
    """A JSON object as a map with lower-cased keys; on a clash the last one counts."""
    entries = F.map_entries(F.from_json(doc, "map<string,string>"))
    lowered = F.transform(entries, lambda e: F.struct(ascii_lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.aggregate(
        lowered,
        F.create_map().cast("map<string,string>"),
        lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != e["key"]), F.map_from_entries(F.array(e))),
    )


def jsonld_to_offers(products: DataFrame, site: str, run: dict[str, str], source: str = "generic") -> DataFrame:
    """SRC-8: offer rows of Product nodes; needs ``product`` (JSON text) and ``url``."""
    p = products.withColumns({"_p": F.from_json("product", "map<string,string>"), "_lp": _lower_keys(F.col("product"))})
    offers = F.trim(text(F.element_at("_lp", "offers")))
    outer = _lower_keys(F.when(offers.startswith("{"), offers))
    inner = F.trim(text(F.element_at(outer, "offers")))
    types = text(F.element_at(outer, "@type"))
    nested = types.rlike(r'(^AggregateOffer$)|"AggregateOffer"') & inner.startswith("[")
    listed = (
        F.when(offers.startswith("["), F.from_json(offers, "array<string>"))
        .when(offers.startswith("{") & nested, F.from_json(inner, "array<string>"))
        .when(offers.startswith("{"), F.array(offers))
        .otherwise(F.array(F.lit("{}")))
    )
    p = p.select("*", F.explode(listed).alias("_o")).where(F.trim(F.col("_o")).startswith("{"))
    p = p.withColumns({"_lo": _lower_keys(F.col("_o")), "_oo": F.from_json("_o", "map<string,string>")})

    def top(name: str) -> Column:
        return F.element_at("_p", name)

    def of_offer(*keys: str) -> Column:
        return F.coalesce(*[F.element_at("_lo", k) for k in keys])

    price = text(of_offer("price", "lowprice"))
    sku = F.coalesce(F.nullif(text(of_offer("sku")), F.lit("")), top("sku"), F.lit(""))
    gtin = F.coalesce(*[F.nullif(top(g), F.lit("")) for g in ("gtin13", "gtin12", "gtin14", "gtin8", "gtin")])
    category = stringify(top("category"))
    promoted = ["price", "pricecurrency", "availability", "sku"]
    # The left-over keys stay JSON: values that were objects or lists are JSON text already.
    rest = F.filter(F.map_entries("_oo"), lambda e: ~ascii_lower(e["key"]).isin(promoted))
    members = F.transform(rest, lambda e: F.concat(json_value(e["key"]), F.lit(":"), json_value(e["value"])))
    raw = F.concat(
        F.lit('{"jsonld_category":'), json_value(category), F.lit(',"jsonld_offer":{'), F.array_join(members, ","), F.lit("}}")
    )
    cells = {
        "source": F.lit(source),
        "source_product_id": F.when(sku != "", sku).otherwise(F.col("url")),
        "product_title": top("name"),
        "brand": stringify(top("brand")),
        "product_type": category,
        "sku": sku,
        "barcode": gtin,
        "regular_price": price,
        "current_price": price,
        "on_sale": F.lit("false"),
        "currency": of_offer("pricecurrency"),
        "price_source": F.lit("jsonld"),
        "stock_status": stock_from_jsonld(of_offer("availability")),
        "source_product_url": F.col("url"),
        "variation_retrieval_status": F.lit("not_applicable"),
        "description": strip_html(top("description")),
        "raw_attributes_json": raw,
    }
    return feed_rows(p, cells, site, run)


# Names a fresh site carries by default.
DEFAULT_SITE_NAMES = ["", "my site", "my wordpress site", "just another wordpress site"]


def store_names(pages: DataFrame, site_col: str = "site", home_col: str = "is_home") -> DataFrame:
    """SRC-11: (site, store_name).

    A home page is read for og:site_name, then its JSON-LD Organization or WebSite,
    then its title.  Where that is a platform default, the seller and then the brand
    of the site's first product page is used.
    """
    home = pages.where(F.col(home_col))
    og = r"""(?is)<meta\b(?=[^>]*\bproperty\s*=\s*["']og:site_name["'])[^>]*\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    shown = home.select(
        site_col,
        "url",
        F.trim(decode_entities(F.coalesce(F.nullif(F.regexp_extract("html", og, 1), F.lit("")), F.regexp_extract("html", og, 2)))).alias("og"),
        F.trim(decode_entities(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))).alias("title"),
    )
    named = (
        _scripts(home)
        .select(site_col, "url", "pos", _site_name("doc").alias("org"))
        .where(~blank(F.col("org")))
        .groupBy(site_col)
        .agg(F.min_by("org", F.struct("url", "pos")).alias("org"))
    )
    per_site = shown.groupBy(site_col).agg(F.min(F.struct("url", "og", "title")).alias("_h"))
    first = F.coalesce(F.nullif(F.col("_h.og"), F.lit("")), F.col("org"), F.col("_h.title"), F.lit(""))
    base = per_site.join(named, site_col, "left").select(site_col, first.alias("store_name"))

    others = jsonld_products(pages.where(~F.col(home_col)))
    lp = _lower_keys(F.col("product"))
    offers = F.trim(text(F.element_at(lp, "offers")))
    listed = F.when(offers.startswith("["), F.from_json(offers, "array<string>")).when(offers.startswith("{"), F.array(offers))
    sellers = F.transform(listed, lambda o: F.get_json_object(F.element_at(_lower_keys(o), "seller"), "$.name"))
    seller = F.get(F.filter(sellers, lambda x: F.trim(x) != ""), F.lit(0))
    brand = F.get_json_object("product", "$.brand.name")
    found = F.coalesce(F.nullif(F.trim(seller), F.lit("")), F.nullif(F.trim(brand), F.lit("")))
    fallback = (
        others.select(site_col, "url", "pos", "node", found.alias("name"))
        .where(F.col("name").isNotNull())
        .groupBy(site_col)
        .agg(F.min_by("name", F.struct("url", "pos", "node")).alias("_seller"))
    )
    plain = F.lower("store_name").isin(DEFAULT_SITE_NAMES)
    return base.join(fallback, site_col, "left").select(
        site_col, F.when(plain & F.col("_seller").isNotNull(), F.col("_seller")).otherwise(F.col("store_name")).alias("store_name")
    )


# Where shops keep their sitemaps (in the order they are tried), how product
# paths look, and paths that are never products.
SITEMAP_PATHS = ["/sitemap_products_1.xml", "/product-sitemap.xml", "/wp-sitemap-posts-product-1.xml", "/sitemap.xml"]
PRODUCT_HINTS = ["/product", "/products/", "/shop/", "/p/", "/item/", "/dp/"]
NO_PRODUCT_PATHS = [
    "/blog", "/learn", "/news", "/article", "/about", "/contact", "/faq", "/privacy", "/terms", "/refund", "/shipping", "/policy",
    "/policies", "/cart", "/checkout", "/account", "/login", "/register", "/search",
]


def _mentions(c: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))


def sitemap_product_urls(sitemaps: DataFrame, probe_all: bool = False, cap: int | None = None) -> DataFrame:
    """SRC-10: (site, url) of product pages from landed sitemap documents (site, url, xml).

    Child sitemaps are followed by joining landed documents on their address, level by
    level until there are no new ones, on the site's own host or its subdomains.  The
    first known sitemap path of a site that gives any product wins.  With ``cap`` a site
    keeps at most so many URLs.
    """
    docs = sitemaps.select("site", "url", "xml").where(F.contains("xml", F.lit("<")))
    path = F.substring("url", F.length(F.regexp_replace("site", "/+$", "")) + 1, F.length("url"))
    candidate = F.array_position(F.array(*[F.lit(p) for p in SITEMAP_PATHS]), path)
    level = docs.withColumn("_cand", candidate).where(F.col("_cand") > 0).withColumn("_trust", F.lit(probe_all) | F.contains(path, F.lit("product")))

    def locs(parent: str) -> Column:
        return F.transform(F.expr(f"xpath(xml, '/*[local-name()=\"{parent}\"]/*/*[local-name()=\"loc\"]/text()')"), lambda x: F.trim(x))

    parts, depth = [], 0
    seen = level.select("site", "url")
    while True:
        parts.append(level.select("site", "_cand", "_trust", F.lit(depth).alias("_depth"), "url", F.posexplode(locs("urlset")).alias("_pos", "loc")).withColumnRenamed("url", "_doc"))
        kids = level.select("site", "_cand", F.explode(locs("sitemapindex")).alias("loc"))
        host, base = F.lower(url_host(F.col("loc"))), F.lower(url_host(F.col("site")))
        own = (host == base) | F.endswith(host, F.concat(F.lit("."), base))
        kids = kids.where((F.contains("loc", F.lit("product")) | F.contains("loc", F.lit("shop"))) & own).distinct()
        level = kids.join(docs.select(F.col("site"), F.col("url").alias("loc"), "xml"), ["site", "loc"]).select(
            "site", F.col("loc").alias("url"), "xml", "_cand", F.lit(True).alias("_trust")
        )
        # A document that was met on a higher level is not followed again, so circles end.
        level = materialize(level.join(seen, ["site", "url"], "left_anti"), "sitemaps")
        if level.isEmpty():
            break
        seen, depth = seen.union(level.select("site", "url")).distinct(), depth + 1
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = found.where(F.col("loc") != "")
    home = F.regexp_replace("site", "/+$", "")
    if probe_all:
        p = ascii_lower(url_path(F.col("loc")))
        keep = ~F.col("loc").isin(home, F.concat(home, F.lit("/"))) & ~p.isin("", "/") & ~_mentions(p, NO_PRODUCT_PATHS)
    else:
        keep = F.col("_trust") | _mentions(F.col("loc"), PRODUCT_HINTS)
    kept = found.where(keep)
    # The earliest place a URL was seen, per site and candidate sitemap.
    place = F.struct(-F.col("_depth"), F.col("_doc"), F.col("_pos"))
    once = kept.groupBy("site", "_cand", "loc").agg(F.min(place).alias("_at"))
    best = once.groupBy("site").agg(F.min("_cand").alias("_cand"))
    urls = once.join(best, ["site", "_cand"])
    if cap is not None:
        rank = F.row_number().over(W.partitionBy("site").orderBy("_at", "loc"))
        urls = urls.withColumn("_rank", rank).where(F.col("_rank") <= cap)
    return urls.select("site", F.col("loc").alias("url"))
