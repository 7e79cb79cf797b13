"""Payload sources over JSON, HTML and XML that Spark builds from the part, line item and page tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pricebook.session import spread
from pricebook.sources import mapped, pages as pg, shops

from .base import query
from .data import Data

RUN = {"export_run_id": "r1", "exported_at": "2001-09-01T00:00:00Z", "store_name": "Shop"}
SITE = "https://s.example.com"


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def shop_payloads(d: Data):
    """One product per part; its line items are the variants."""
    variants = d.table("lineitem").select(
        F.col("l_partkey").alias("p_partkey"),
        F.struct(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
            F.when(F.col("l_linenumber") == 1, "Default Title").otherwise(F.concat(_s("l_quantity"), F.lit(" mg"))).alias("title"),
            F.concat(_s("l_quantity"), F.lit(" mg")).alias("option1"),
            _s("l_quantity").alias("price"),
            F.when(F.col("l_returnflag") == "R", (F.col("l_quantity") + 5).cast("string")).alias("compare_at_price"),
            (F.col("l_linestatus") == "O").alias("available"),
            (F.col("l_linenumber") - 3).alias("inventory_quantity"),
            F.lit("continue").alias("inventory_policy"),
        ).alias("v"),
    )
    # A landed payload holds all variants of a product; a product's variants are few.
    grouped = variants.groupBy("p_partkey").agg(F.collect_list("v").alias("variants"))
    part = d.table("part").join(grouped, "p_partkey", "left")
    doc = F.struct(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.regexp_replace("p_name", " ", "-").alias("handle"),
        F.concat(F.lit("<p>"), "p_name", F.lit("<br/>new</p>")).alias("body_html"), F.col("p_brand").alias("vendor"), "variants",
    )
    return part.select(F.to_json(doc).alias("json"))


LINE_KEY = "CAST(l_orderkey * 8 + l_linenumber AS STRING)"


@query(
    "shopify_to_offers",
    f"""SELECT CAST(p_partkey AS STRING) AS source_product_id, coalesce({LINE_KEY}, '') AS source_variant_id, p_name AS product_title,
CASE WHEN l_linenumber IS NULL OR l_linenumber = 1 THEN '' ELSE concat(CAST(l_quantity AS STRING), ' mg') END AS variant_title,
CASE WHEN l_quantity IS NULL THEN '' WHEN l_returnflag = 'R' THEN CAST(l_quantity + 5 AS STRING) ELSE CAST(l_quantity AS STRING) END AS regular_price,
CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS STRING) ELSE '' END AS sale_price, CASE WHEN l_returnflag = 'R' THEN 'true' ELSE 'false' END AS on_sale,
CASE WHEN l_linestatus IS NULL THEN 'unknown' WHEN l_linestatus = 'F' THEN 'out_of_stock' WHEN l_linenumber <= 3 THEN 'backorder' ELSE 'in_stock' END AS stock_status,
CASE WHEN l_linenumber IS NULL OR l_linenumber = 1 THEN '' ELSE concat('https://s.example.com/products/', replace(p_name, ' ', '-'), '?variant=', {LINE_KEY}) END AS source_variant_url,
concat(p_name, ' new') AS description, coalesce(concat(CAST(l_quantity AS STRING), ' mg'), '') AS option1
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey""",
)
def shopify(spark, sf):
    out = shops.shopify_to_offers(shop_payloads(Data(spark, sf)), SITE, RUN, "USD")
    option = F.coalesce(F.get_json_object("raw_attributes_json", "$.variant_options.option1"), F.lit("")).alias("option1")
    return out.select(
        "source_product_id", "source_variant_id", "product_title", "variant_title", "regular_price", "sale_price", "on_sale", "stock_status",
        "source_variant_url", "description", option,
    )


def woo_payloads(d: Data):
    """Parts: even sizes are variable products, of which those of type PROMO have no landed variations."""
    n = _s("p_size")
    doc = F.struct(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("https://w.example.com/product/"), _s("p_partkey"), F.lit("/")).alias("permalink"),
        (F.col("p_size") % 2 == 0).alias("has_options"), (F.col("p_size") % 3 == 0).alias("on_sale"), F.lit(True).alias("is_in_stock"),
        F.struct(
            (F.col("p_size") * 100).cast("string").alias("price"), (F.col("p_size") * 200).cast("string").alias("regular_price"),
            (F.col("p_size") * 100).cast("string").alias("sale_price"), F.lit("EUR").alias("currency_code"), F.lit(2).alias("currency_minor_unit"),
        ).alias("prices"),
        F.array(F.struct(F.col("p_type").alias("name"))).alias("categories"),
        F.array(
            F.struct(F.lit("MG").alias("name"), F.lit("pa_mg").alias("taxonomy"), F.array(F.struct(n.alias("name"), F.concat(F.lit("s"), n).alias("slug"))).alias("terms")),
            F.struct(F.lit("Brand").alias("name"), F.lit(None).cast("string").alias("taxonomy"), F.array(F.struct(F.col("p_brand").alias("name"), F.lit("b").alias("slug"))).alias("terms")),
        ).alias("attributes"),
        F.array(
            F.struct(F.concat(_s("p_partkey"), F.lit("1")).alias("id"), F.array(F.struct(F.lit("MG").alias("name"), F.concat(F.lit("s"), n).alias("value"))).alias("attributes"))
        ).alias("variations"),
    )
    products = d.table("part").select(F.to_json(doc).alias("json"))
    landed = d.table("part").where("p_size % 2 = 0 and p_type <> 'PROMO'")
    kinds = landed.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    var = F.struct(
        F.concat(_s("p_partkey"), _s("k")).alias("id"), F.col("p_partkey").alias("parent"),
        F.when(F.col("k") == 2, F.concat(F.lit("MG: "), n, F.lit(", Brand: A, B"))).alias("variation"), (F.col("k") == 1).alias("is_in_stock"),
        F.struct((F.col("p_size") * 100 + F.col("k")).cast("string").alias("price")).alias("prices"),
    )
    return products, kinds.select(F.to_json(var).alias("json"))


@query(
    "woo_to_offers",
    """SELECT CAST(p_partkey AS STRING) AS source_product_id, CASE WHEN k IS NULL THEN '' ELSE concat(CAST(p_partkey AS STRING), CAST(k AS STRING)) END AS source_variant_id,
CASE WHEN k = 1 THEN concat(CAST(p_size AS STRING), ' MG') WHEN k = 2 THEN concat(CAST(p_size AS STRING), ' MG / A, B') WHEN p_size % 2 = 0 THEN '(variations not retrieved)' ELSE '' END AS variant_title,
printf('%d.%02d', (p_size * 100 + coalesce(k, 0)) // 100, (p_size * 100 + coalesce(k, 0)) % 100) AS current_price,
CASE WHEN k IS NULL AND p_size % 2 = 1 THEN printf('%d.00', p_size * 2) ELSE '' END AS regular_price, CASE WHEN k IS NULL AND p_size % 2 = 1 AND p_size % 3 = 0 THEN printf('%d.00', p_size) ELSE '' END AS sale_price,
CASE WHEN k IS NOT NULL THEN 'retrieved' WHEN p_size % 2 = 0 THEN 'fallback_parent_only' ELSE 'not_applicable' END AS variation_retrieval_status,
p_brand AS brand, p_type AS product_type, CASE WHEN k = 2 THEN 'out_of_stock' ELSE 'in_stock' END AS stock_status,
CASE k WHEN 1 THEN concat('https://w.example.com/product/', CAST(p_partkey AS STRING), '/?attribute_pa_mg=s', CAST(p_size AS STRING))
WHEN 2 THEN concat('https://w.example.com/product/', CAST(p_partkey AS STRING), '/?attribute_pa_mg=s', CAST(p_size AS STRING), '&attribute_brand=A%2C%20B') ELSE '' END AS source_variant_url
FROM part LEFT JOIN (SELECT 1 AS k UNION ALL SELECT 2) x ON p_size % 2 = 0 AND p_type <> 'PROMO'""",
)
def woo(spark, sf):
    products, variations = woo_payloads(Data(spark, sf))
    out = shops.woo_to_offers(products, variations, "https://w.example.com", RUN)
    return out.select(
        "source_product_id", "source_variant_id", "variant_title", "current_price", "regular_price", "sale_price", "variation_retrieval_status",
        "brand", "product_type", "stock_status", "source_variant_url",
    )


def ld_pages(d: Data):
    """The landed pages, each with the JSON-LD of one part put into its head."""
    page = d.table("pages")
    part = d.table("part").select(F.col("p_partkey").alias("page_id"), "p_name", "p_brand", "p_size", "p_type")
    node = F.concat(
        F.lit('{"@context":"https://schema.org","@graph":[{"@type":"WebPage"},{"@type":["Product","Thing"],"name":"'), "p_name", F.lit('","brand":{"name":"'), "p_brand",
        F.lit('"},"gtin13":"","gtin12":"77","Offers":'),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('{"@type":"AggregateOffer","offers":[{"Price":"'), _s("p_size"), F.lit('","priceCurrency":"USD","Availability":"https://schema.org/InStock","sku":"A"},{"lowPrice":"3"}]}')))
        .otherwise(F.concat(F.lit('{"price":'), _s("p_size"), F.lit(',"availability":"BackOrder"}'))),
        F.lit("}]}"),
    )
    script = F.concat(F.lit('<head><script type="application/ld+json">'), node, F.lit('</script><script type="application/ld+json">{bad</script>'))
    return page.join(part, "page_id").select("page_id", "url", F.replace("html", F.lit("<head>"), script).alias("html"))


@query(
    "jsonld_products",
    "SELECT page_id, p_name AS name, p_brand AS brand FROM pages JOIN part ON p_partkey = page_id WHERE contains(html, '<head>')",
)
def jsonld_products(spark, sf):
    out = pg.jsonld_products(ld_pages(Data(spark, sf)))
    return out.select("page_id", F.get_json_object("product", "$.name").alias("name"), F.get_json_object("product", "$.brand.name").alias("brand"))


@query(
    "jsonld_to_offers",
    """SELECT CASE WHEN p_size % 2 = 0 AND k = 1 THEN 'A' ELSE url END AS source_product_id, p_name AS product_title, p_brand AS brand, '77' AS barcode,
CASE WHEN p_size % 2 = 0 AND k = 2 THEN '3' ELSE CAST(p_size AS STRING) END AS current_price, CASE WHEN p_size % 2 = 0 AND k = 1 THEN 'USD' ELSE '' END AS currency,
CASE WHEN p_size % 2 = 1 THEN 'backorder' WHEN k = 1 THEN 'in_stock' ELSE 'unknown' END AS stock_status, url AS source_product_url
FROM pages JOIN part ON p_partkey = page_id JOIN (SELECT 1 AS k UNION ALL SELECT 2) x ON k = 1 OR p_size % 2 = 0 WHERE contains(html, '<head>')""",
)
def jsonld_offers(spark, sf):
    out = pg.jsonld_to_offers(pg.jsonld_products(ld_pages(Data(spark, sf))), "https://g.example.com", RUN)
    return out.select("source_product_id", "product_title", "brand", "barcode", "current_price", "currency", "stock_status", "source_product_url")


@query(
    "store_names",
    """SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS site, count(*) AS n FROM pages GROUP BY 1""",
)
def store_name_sites(spark, sf):
    d = Data(spark, sf)
    pages = d.table("pages").select("url", "html", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("site"))
    # Every page counts as a home page; the first address of a site names it.
    named = pg.store_names(pages.withColumn("is_home", F.lit(True)))
    return named.join(pages.groupBy("site").agg(F.count(F.lit(1)).alias("n")), "site").select("site", "n")


@query(
    "store_names_seller",
    "SELECT CAST(p_partkey AS STRING) AS site, CASE p_partkey % 3 WHEN 0 THEN concat('Shop ', p_name) WHEN 1 THEN p_brand ELSE 'Org' END AS store_name FROM part",
)
def store_names(spark, sf):
    kind = F.col("p_partkey") % 3
    home = F.when(kind == 0, F.concat(F.lit('<meta property="og:site_name" content="Shop '), "p_name", F.lit('"><title>t</title>'))).when(kind == 1, "<title>My Site</title>").otherwise(
        '<script type="application/ld+json">[{"@type":"WebSite","name":" Org "}]</script><title>x</title>'
    )
    item = F.concat(F.lit('<script type="application/ld+json">{"@type":"Product","brand":{"name":"'), "p_brand", F.lit('"}}</script>'))
    rows = Data(spark, sf).table("part").select(
        _s("p_partkey").alias("site"),
        F.explode(F.array(F.struct(F.lit("/").alias("url"), home.alias("html"), F.lit(True).alias("is_home")), F.struct(F.lit("/p").alias("url"), item.alias("html"), F.lit(False).alias("is_home")))).alias("x"),
    )
    return pg.store_names(rows.select("site", "x.*"))


@query(
    "sitemap_product_urls",
    """SELECT concat('https://m', CAST(s_nationkey AS STRING), '.example.com') AS site, concat('https://m', CAST(s_nationkey AS STRING), '.example.com/', kind, CAST(s_suppkey AS STRING)) AS url
FROM supplier JOIN (SELECT 'zz' AS kind UNION ALL SELECT 'product/' AS kind) k ON true WHERE kind = 'zz' OR s_nationkey % 2 = 1""".replace(
        "WHERE kind = 'zz' OR s_nationkey % 2 = 1", "WHERE (s_nationkey % 2 = 0 AND kind = 'zz') OR (s_nationkey % 2 = 1 AND kind = 'product/')"
    ),
)
def sitemap_urls(spark, sf):
    d = Data(spark, sf)
    site = F.concat(F.lit("https://m"), _s("s_nationkey"), F.lit(".example.com"))

    def url_tags(kind: str) -> Column:
        # A landed sitemap lists its site's pages; sitemaps hold at most 50,000 by their own rules.
        return F.array_join(F.collect_list(F.concat(F.lit("<url><loc> "), F.col("site"), F.lit(f"/{kind}"), _s("s_suppkey"), F.lit(" </loc></url>"))), "")

    rows = d.table("supplier").select(site.alias("site"), "s_suppkey", "s_nationkey")
    per_site = rows.groupBy("site", "s_nationkey").agg(url_tags("zz").alias("zz"), url_tags("product/").alias("product"))
    ns = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    even = F.col("s_nationkey") % 2 == 0
    index = F.concat(
        F.lit('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>'), "site",
        F.lit("/shop-1.xml</loc></sitemap><sitemap><loc>https://other.example.org/shop-1.xml</loc></sitemap></sitemapindex>"),
    )
    docs = F.array(
        F.struct(F.concat("site", F.lit("/sitemap.xml")).alias("url"), F.when(even, index).otherwise(F.concat(F.lit(ns), "zz", "product", F.lit("</urlset>"))).alias("xml")),
        F.struct(F.concat("site", F.lit("/shop-1.xml")).alias("url"), F.concat(F.lit(ns), "zz", F.lit("</urlset>")).alias("xml")),
    )
    landed = per_site.select("site", F.explode(docs).alias("x")).select("site", "x.*")
    return pg.sitemap_product_urls(landed)


MAPPING = {
    "list_url": "https://j.example.com/list",
    "variants_path": "data.vars",
    "fields": {
        "source_product_id": ["sku", "slug"],
        "source_variant_id": "@variant.id",
        "product_title": "data.names[0]",
        "current_price": "@variant.price",
        "sale_price": {"from": ["data.sale"]},
        "stock_status": {"from": "@variant.qty", "transform": "gt_zero_to_status"},
        "source_product_url": {"template": "https://old.example.com/c/{slug}"},
    },
    "raw_attributes": ["@variant.dose"],
    "currency_default": "USD",
}


def mapped_payloads(d: Data):
    size = _s("p_size")
    one = lambda k: F.concat(F.lit(f'{{"id":{k},"price":"{k}9.50","qty":'), (F.col("p_size") % 2 if k == 1 else F.lit(0)).cast("string"), F.lit(',"dose":"'), size, F.lit(' mg"}'))
    doc = F.concat(
        F.lit('{"sku":"'), F.when(F.col("p_size") % 3 == 0, "").otherwise(_s("p_partkey")), F.lit('","slug":"'), "p_name", F.lit('","data":{"names":["'), "p_name", F.lit('"],"sale":"15.00"'),
        F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat(F.lit(',"vars":['), one(1), F.lit(","), one(2), F.lit("]"))), F.lit("}}"),
    )
    return spread(d.table("part")).select(doc.alias("json"))


MAPPED = """SELECT CASE WHEN p_size % 3 = 0 THEN p_name ELSE CAST(p_partkey AS STRING) END AS source_product_id, coalesce(CAST(k AS STRING), '') AS source_variant_id, p_name AS product_title,
coalesce(CAST(k AS STRING) || '9.50', '') AS regular_price, CASE WHEN k IS NULL THEN 'false' WHEN 15.00 < k * 10 + 9.5 THEN 'true' ELSE 'false' END AS on_sale,
CASE WHEN k IS NULL THEN 'unknown' WHEN k = 1 AND p_size % 2 = 1 THEN 'in_stock' ELSE 'out_of_stock' END AS stock_status,
concat('https://{host}/c/', replace(p_name, ' ', '%20')) AS source_product_url, CASE WHEN k IS NULL THEN '' ELSE concat('{{"dose":"', CAST(p_size AS STRING), ' mg"}}') END AS raw_attributes_json, 'USD' AS currency
FROM part LEFT JOIN (SELECT 1 AS k UNION ALL SELECT 2) x ON p_size % 5 <> 0"""
MAPPED_COLUMNS = ["source_product_id", "source_variant_id", "product_title", "regular_price", "on_sale", "stock_status", "source_product_url", "raw_attributes_json", "currency"]


@query("json_feed_to_offers", MAPPED.format(host="old.example.com"))
def json_feed(spark, sf):
    return mapped.json_feed_to_offers(mapped_payloads(Data(spark, sf)), MAPPING, "https://j.example.com", RUN).select(*MAPPED_COLUMNS)


@query("rewrite_feed_urls", MAPPED.format(host="new.example.com"))
def rewritten_feed(spark, sf):
    rows = mapped.json_feed_to_offers(mapped_payloads(Data(spark, sf)), MAPPING, "https://j.example.com", RUN)
    return mapped.rewrite_feed_urls(rows, {"from_host": "old.example.com", "to_host": "new.example.com"}).select(*MAPPED_COLUMNS)


@query(
    "preview_mapping",
    """SELECT 'rows' AS k, '3 of 3 right' AS v UNION ALL SELECT 'problems', '' UNION ALL SELECT 'broken', 'list_url is missing|unknown field: no_such_field|unknown transform: no_such' UNION ALL SELECT 'all', CAST(count(*) AS STRING) FROM part LEFT JOIN (SELECT 1 AS k UNION ALL SELECT 2) x ON p_size % 5 <> 0""",
)
def preview(spark, sf):
    d = Data(spark, sf)
    site = "https://j.example.com"
    rows, problems = mapped.preview_mapping(mapped_payloads(d), MAPPING, site, RUN, {"from_host": "old.example.com", "to_host": "new.example.com"})
    # Every cell of the preview is held against the part that its row came from.
    part = d.table("part").select(_s("p_partkey").alias("key"), "p_name", F.col("p_size").alias("size"))
    same = (F.col("source_product_id") == F.when(F.col("size") % 3 == 0, F.col("p_name")).otherwise(F.col("key"))) & (F.col("product_title") == F.col("p_name"))
    price = F.when(F.col("source_variant_id") == "", "").otherwise(F.concat("source_variant_id", F.lit("9.50")))
    dose = F.when(F.col("source_variant_id") == "", "").otherwise(F.concat(F.lit('{"dose":"'), _s("size"), F.lit(' mg"}')))
    url = F.concat(F.lit("https://new.example.com/c/"), F.replace("p_name", F.lit(" "), F.lit("%20")))
    right = same & (F.col("regular_price") == price) & (F.col("raw_attributes_json") == dose) & (F.col("source_product_url") == url) & (F.col("currency") == "USD")
    seen = rows.withColumn("row", F.monotonically_increasing_id()).join(part, F.col("product_title") == F.col("p_name"))
    held = seen.groupBy("row").agg(F.max(F.when(right, 1).otherwise(0)).alias("ok")).agg(F.sum("ok").alias("ok"), F.count(F.lit(1)).alias("n"))
    told = held.select(F.lit("rows").alias("k"), F.concat(_s("ok"), F.lit(" of "), _s("n"), F.lit(" right")).alias("v"))
    broken = mapped.mapping_errors({"fields": {"product_title": {"from": "a", "transform": "no_such"}, "no_such_field": "b"}})
    every, _ = mapped.preview_mapping(mapped_payloads(d), MAPPING, site, RUN, n=10**9)
    fixed = spark.createDataFrame([("problems", " ".join(problems)), ("broken", "|".join(broken))], "k string, v string")
    return told.unionByName(fixed).unionByName(every.agg(F.count(F.lit(1)).alias("n")).select(F.lit("all").alias("k"), _s("n").alias("v")))
