"""Text rules over listings whose facts are known, and over the whole texts of the document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricebook.functions import amounts as a, attributes as at, dose, money, stock, text as t, urls as u

from .base import query
from .data import Data

def _title():
    return F.col("product_title")


def listings(spark, sf):
    return Data(spark, sf).listings


@query("normalize_title", "SELECT id, known_title AS title, CASE WHEN length(known_title) >= 3 THEN known_title ELSE '' END AS title_key FROM v_listings")
def normalize_title(spark, sf):
    return listings(spark, sf).select("id", t.normalize_title(_title()).alias("title"), t.title_key(_title()).alias("title_key"))


@query("extract_strength", "SELECT id, known_strength AS value, known_unit AS unit FROM v_listings")
def extract_strength(spark, sf):
    s = listings(spark, sf).select("id", dose.extract_strength(t.decode_entities(_title())).alias("s"))
    return s.select("id", "s.value", "s.unit")


@query("strength_of", "SELECT id, CAST(CASE WHEN id % 2 = 0 THEN 7 ELSE known_strength END AS DOUBLE) AS value, CASE WHEN id % 2 = 0 THEN 'g' ELSE known_unit END AS unit FROM v_listings")
def strength_of(spark, sf):
    variant = F.when(F.col("id") % 2 == 0, "Tub / 7 g").otherwise("Red")
    s = listings(spark, sf).select("id", dose.strength_of(variant, t.search_text(variant, _title())).alias("s"))
    return s.select("id", "s.value", "s.unit")


@query("extract_count", "SELECT id, known_count AS cnt FROM v_listings")
def extract_count(spark, sf):
    return listings(spark, sf).select("id", dose.extract_count(t.decode_entities(_title())).alias("cnt"))


@query("extract_form", "SELECT id, known_form AS form FROM v_listings")
def extract_form(spark, sf):
    return listings(spark, sf).select("id", t.extract_form(_title()).alias("form"))


@query("extract_standardization", "SELECT id, known_pct AS pct, CASE WHEN known_pct IS NOT NULL THEN 'saponins' END AS compound FROM v_listings")
def extract_standardization(spark, sf):
    return listings(spark, sf).select("id", t.extract_standardization(_title()).alias("s")).select("id", "s.pct", "s.compound")


AMOUNTS = """CASE style WHEN 1 THEN 2 WHEN 3 THEN 2 WHEN 7 THEN 2 ELSE 1 END AS n,
CASE style WHEN 1 THEN size + 1000 + 12000 WHEN 2 THEN CAST(size AS DOUBLE) / 1000 WHEN 3 THEN 403900.0 + size WHEN 4 THEN NULL WHEN 7 THEN size + 5 ELSE size END"""


@query("scan_amounts", f"SELECT id, {AMOUNTS} AS mg FROM v_listings")
def scan_amounts(spark, sf):
    found = listings(spark, sf).select("id", a.scan_amounts(t.decode_entities(_title())).alias("f"))
    mg = F.aggregate(F.transform("f", lambda x: a.convert_unit(x["value"], x["unit"], F.lit("mg"))), F.lit(0.0), lambda s, v: s + v)
    return found.select("id", F.size("f").alias("n"), t.half_up(mg, 6).alias("mg"))


@query(
    "distinct_amounts",
    "SELECT id, CASE style WHEN 1 THEN 2 WHEN 3 THEN 2 WHEN 7 THEN 2 ELSE 1 END AS n, CASE style WHEN 4 THEN 'billion_cfu' WHEN 3 THEN 'g' WHEN 2 THEN 'mcg' ELSE 'mg' END AS unit FROM v_listings",
)
def distinct_amounts(spark, sf):
    # The title twice, so that every amount has a duplicate.
    twice = F.concat_ws(" | ", t.decode_entities(_title()), t.decode_entities(_title()))
    d = listings(spark, sf).select("id", a.distinct_amounts(a.scan_amounts(twice)).alias("d"))
    return d.select("id", F.size("d").alias("n"), F.get("d", F.lit(0))["unit"].alias("unit"))


@query("scan_packs", "SELECT id, CASE WHEN style = 5 THEN CAST(size * 10 AS DOUBLE) END AS mg FROM v_listings")
def scan_packs(spark, sf):
    return listings(spark, sf).select("id", F.get(a.scan_packs(_title()), F.lit(0))["value"].alias("mg"))


@query("pack_counts", "SELECT id, CASE WHEN style = 5 THEN '10' ELSE '' END AS counts FROM v_listings")
def pack_counts(spark, sf):
    return listings(spark, sf).select("id", F.array_join(a.pack_counts(_title()).cast("array<string>"), "|").alias("counts"))


@query(
    "amount_list",
    "SELECT p_partkey AS id, 4 AS n, CAST(p_size + 10 + 10 + p_size AS DOUBLE) AS mg FROM part",
)
def amount_list(spark, sf):
    # "13/10/10mg, 13 mg, 7 mg each": the shared unit counts for the whole list and the part amount is left out.
    size = F.col("p_size").cast("string")
    title = F.concat(F.col("p_name"), F.lit(" "), size, F.lit("/10/10mg + "), size, F.lit(" mg, 7 mg each"))
    out = Data(spark, sf).table("part").select(F.col("p_partkey").alias("id"), a.amount_list(title).alias("l"))
    return out.select("id", F.size("l").alias("n"), F.aggregate("l", F.lit(0.0), lambda s, x: s + x["mg"]).alias("mg"))


@query(
    "amounts_within",
    "SELECT p_partkey AS id, p_size % 2 = 0 AS inside FROM part",
)
def amounts_within(spark, sf):
    size = F.col("p_size").cast("string")
    title = F.concat(size, F.lit(" g blend with "), size, F.lit("5 mg"))
    attr = F.concat(size, F.lit("000 mg"), F.when(F.col("p_size") % 2 == 1, " and 1 IU").otherwise(""))
    return Data(spark, sf).table("part").select(F.col("p_partkey").alias("id"), a.amounts_within(a.amount_list(attr), a.amount_list(title)).alias("inside"))


@query(
    "convert_units",
    """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'mg' WHEN 1 THEN 'mcg' WHEN 2 THEN 'g' WHEN 3 THEN 'IU' END AS unit,
CAST(CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN CAST(p_size AS DOUBLE) * 0.001 WHEN 2 THEN p_size * 1000 END AS DOUBLE) AS mg, p_partkey % 5 = 0 AS same FROM part""",
)
def convert_units(spark, sf):
    raw = F.element_at(F.array(*[F.lit(x) for x in (" Milligrams", "µg", "GRAM", "iu", "oz")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    p = Data(spark, sf).table("part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("v"), a.canonical_unit(raw).alias("unit"))
    mg = a.convert_unit(F.col("v"), F.col("unit"), F.lit("mg"))
    return p.select("id", "unit", mg.alias("mg"), F.coalesce(a.same_amount(mg, F.col("v") * 1.005), F.lit(False)).alias("same"))


# --- whole documents -------------------------------------------------------------------------------------------------

ASCII = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "strip_html_pages",
    """SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS body FROM pages""",
)
def strip_html(spark, sf):
    return Data(spark, sf).table("pages").select("page_id", t.strip_html(F.col("html")).alias("body"))


@query("slugify_documents", f"SELECT doc_id, regexp_replace(regexp_replace({ASCII.format(c='trim(text)')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def slugify(spark, sf):
    return Data(spark, sf).table("documents").select("doc_id", t.slugify(F.col("text")).alias("slug"))


STOP = ", ".join(f"'{w}'" for w in t.TITLE_STOP_WORDS + t.TITLE_UNITS)


@query(
    "normalize_title_documents",
    f"""SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(regexp_replace({ASCII.format(c='text')}, '([a-z])-([0-9])', '\\1\\2', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '),
lambda w: w <> '' AND w NOT IN ({STOP}) AND NOT regexp_full_match(w, '[0-9]+(mg|mgs|mcg|ug|g|kg|iu|ml)?')), ' ') AS title FROM documents""",
)
def normalize_documents(spark, sf):
    docs = Data(spark, sf).table("documents")
    return docs.select("doc_id", t.normalize_title(F.col("text")).alias("title"))


@query(
    "form_words_conversations",
    """SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(softgels?|soft-gels?|soft[ \\t\\n\\r\\f\\v]+gel)([^A-Za-z0-9_]|$)') THEN 'softgel'
WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(sublinguals?|under-the-tongue|sub-lingual)([^A-Za-z0-9_]|$)') THEN 'sublingual'
WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(gummies|gummy)([^A-Za-z0-9_]|$)') THEN 'gummy' WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(capsules?|caps?)([^A-Za-z0-9_]|$)') THEN 'capsule'
WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(tablets?|tabs?)([^A-Za-z0-9_]|$)') THEN 'tablet' WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(powders?|powdered)([^A-Za-z0-9_]|$)') THEN 'powder'
WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(liquids?|tinctures?|drops?|syrups?)([^A-Za-z0-9_]|$)') THEN 'liquid' END AS form FROM conversations""",
)
def form_conversations(spark, sf):
    return Data(spark, sf).table("conversations").select("conv_id", "turn", t.extract_form(F.col("text")).alias("form"))


@query("decode_entities", "SELECT page_id, concat('<', url, '> & ', CAST(page_id AS STRING), ' – é') AS decoded FROM pages")
def decode(spark, sf):
    raw = F.concat(F.lit("&lt;"), F.col("url"), F.lit("&gt; &amp;amp; "), F.col("page_id").cast("string"), F.lit(" &amp;#8211; &eacute;"))
    return Data(spark, sf).table("pages").select("page_id", t.decode_entities(raw).alias("decoded"))


@query("search_text", "SELECT id, concat(replace(product_title, '&amp;#8211;', '–'), ' | Plain text. | ', p_name) AS found FROM v_listings")
def search_text(spark, sf):
    cols = [F.col("variant_title"), _title(), F.col("description"), F.col("p_name")]
    return listings(spark, sf).select("id", t.search_text(*cols).alias("found"))


# --- attributes ------------------------------------------------------------------------------------------------------


def attribute_docs(spark, sf):
    """Per part: a named attribute, option values, a number with its unit and parts that must be skipped."""
    size = F.col("p_size").cast("string")
    doc = F.concat(
        F.lit('{"options":[{"name":"Dose","values":["'), size, F.lit(' mg","99 mg"]}],"variant_options":{"option1":"'), size,
        F.lit(' mg"},"dosage":'), size, F.lit(',"dosage_unit":"mg","weight":{"value":3,"unitText":"g"},"note":"'), F.col("p_name"),
        F.lit('","deep":{"name":"Form","terms":[{"name":"Vial"}]},"n":5}'),
    )
    return Data(spark, sf).table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("p_name"), F.col("p_size").alias("p_size"), doc.alias("json"))


S = "CAST(p_size AS STRING)"


@query("flatten_attributes", f"SELECT p_partkey AS id, concat({S}, ' mg | Dose | ', {S}, ' mg | 99 mg | ', {S}, ' mg | ', p_name, ' | Form | Vial') AS found FROM part")
def flatten_attributes(spark, sf):
    return attribute_docs(spark, sf).select("id", at.flatten_attributes(F.col("json")).alias("found"))


@query(
    "attribute_pairs",
    f"SELECT p_partkey AS id, concat('dosage=', {S}, ' mg|Dose=', {S}, ' mg|Dose=99 mg|Dose=', {S}, ' mg|value=3 g|note=', p_name, '|Form=Vial') AS pairs FROM part",
)
def attribute_pairs(spark, sf):
    shown = F.transform(at.attribute_pairs(F.col("json")), lambda p: F.concat_ws("=", p["label"], p["value"]))
    return attribute_docs(spark, sf).select("id", F.array_join(shown, "|").alias("pairs"))


@query(
    "split_attributes",
    f"SELECT p_partkey AS id, concat({S}, ' mg') AS variant, concat({S}, ' mg|', {S}, ' mg|99 mg|3 g|', p_name, '|Vial') AS product FROM part",
)
def split_attributes(spark, sf):
    s = attribute_docs(spark, sf).select("id", at.split_attributes(F.col("json")).alias("s"))
    return s.select("id", F.array_join("s.variant", "|").alias("variant"), F.array_join("s.product", "|").alias("product"))


@query("new_variant_values", f"SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'Red' ELSE concat({S}, ' MG|Red') END AS fresh FROM part")
def new_variant_values(spark, sf):
    size = F.col("p_size").cast("string")
    title = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Vial "), size, F.lit(" mg"))).otherwise("Vial")
    vals = F.array(F.concat(size, F.lit(" MG")), F.lit(" "), F.lit("Red"))
    return Data(spark, sf).table("part").select(F.col("p_partkey").alias("id"), F.array_join(at.new_variant_values(vals, title), "|").alias("fresh"))


@query("stringify", "SELECT p_partkey AS id, p_name || ', ' || p_brand || ', x' AS s FROM part")
def stringify(spark, sf):
    doc = F.concat(F.lit('[{"name":"'), "p_name", F.lit('"},"'), "p_brand", F.lit('",{"@id":"x"},{"z":1}]'))
    return Data(spark, sf).table("part").select(F.col("p_partkey").alias("id"), t.stringify(doc).alias("s"))


# --- prices, stock, URLs ---------------------------------------------------------------------------------------------


@query(
    "compare_at_pricing",
    "SELECT l_orderkey * 8 + l_linenumber AS id, CASE WHEN l_tax > l_discount THEN CAST(l_tax AS STRING) ELSE CAST(l_discount AS STRING) END AS regular, CASE WHEN l_tax > l_discount THEN CAST(l_discount AS STRING) ELSE '' END AS sale, CASE WHEN l_tax > l_discount THEN 'true' ELSE 'false' END AS on_sale FROM lineitem",
)
def compare_at(spark, sf):
    li = Data(spark, sf).table("lineitem")
    p = money.compare_at_pricing(F.col("l_discount").cast("string"), F.col("l_tax").cast("string"))
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), p.alias("p")).select("id", "p.*")


@query(
    "minor_unit_money",
    """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN printf('%d.%02d', cents // 100, cents % 100) WHEN 1 THEN CAST(cents AS STRING) ELSE 'call us' END AS price
FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) o""",
)
def minor_units(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")
    third = F.col("o_orderkey") % 3
    raw = F.when(third == 2, "call us").otherwise(cents)
    return Data(spark, sf).table("orders").select(F.col("o_orderkey").alias("id"), money.minor_unit_money(raw, F.when(third == 1, "0").otherwise("2")).alias("price"))


@query(
    "sale_if_on_sale",
    "SELECT l_orderkey * 8 + l_linenumber AS id, CASE WHEN l_returnflag = 'R' AND l_tax <> l_discount THEN CAST(l_tax AS STRING) ELSE '' END AS sale FROM lineitem",
)
def sale_only(spark, sf):
    li = Data(spark, sf).table("lineitem")
    sale = money.sale_if_on_sale(F.col("l_returnflag") == "R", F.col("l_tax").cast("string"), F.col("l_discount").cast("string"))
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), sale.alias("sale"))


@query(
    "stock_words",
    """SELECT l_orderkey * 8 + l_linenumber AS id, CASE l_returnflag WHEN 'N' THEN CASE WHEN l_quantity <= 10 THEN 'backorder' ELSE 'in_stock' END WHEN 'R' THEN 'out_of_stock' ELSE 'unknown' END AS shopify,
CASE l_returnflag WHEN 'N' THEN CASE WHEN l_linestatus = 'F' THEN 'backorder' ELSE 'in_stock' END WHEN 'R' THEN 'out_of_stock' ELSE 'unknown' END AS woo,
CASE l_returnflag WHEN 'N' THEN 'in_stock' WHEN 'R' THEN 'out_of_stock' ELSE 'backorder' END AS jsonld,
CASE WHEN l_quantity > 25 THEN 'in_stock' ELSE 'out_of_stock' END AS positive, CASE l_linestatus WHEN 'F' THEN 'in_stock' ELSE 'out_of_stock' END AS truthy FROM lineitem""",
)
def stock_words(spark, sf):
    li = Data(spark, sf).table("lineitem")
    flag = F.col("l_returnflag")
    yes = F.when(flag == "N", True).when(flag == "R", False)
    url = F.concat(F.lit("https://schema.org/"), F.when(flag == "N", "InStock").when(flag == "R", "OutOfStock").otherwise("BackOrder"))
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        stock.stock_from_shopify(yes, (F.col("l_quantity") - 10).cast("string"), F.lit("continue")).alias("shopify"),
        stock.stock_from_woo(yes, F.col("l_linestatus") == "F").alias("woo"),
        stock.stock_from_jsonld(url).alias("jsonld"),
        stock.TRANSFORMS["gt_zero_to_status"]((F.col("l_quantity") - 25).cast("string")).alias("positive"),
        stock.TRANSFORMS["truthy_to_status"](F.when(F.col("l_linestatus") == "F", " Yes").otherwise("0.0")).alias("truthy"),
    )


@query(
    "format_prices",
    """SELECT id, CASE WHEN sale_price IS NULL THEN '—' ELSE concat('€', CAST(CAST(sale_price AS DECIMAL(30,2)) AS STRING)) END AS price, concat('XAU ', CAST(CAST(regular_price AS DECIMAL(30,2)) AS STRING)) AS other,
CASE WHEN strength_per_serving / 1000 >= 0.05 THEN concat('▲ ', regexp_replace(CAST(round(CAST(strength_per_serving / 1000 AS DECIMAL(30,12)), 1) AS DECIMAL(20,1))::STRING, '\\.0$', ''), '%') END AS move FROM v_offers""",
)
def format_prices(spark, sf):
    o = Data(spark, sf).offers
    return o.select(
        "id", money.format_price(F.col("sale_price"), F.lit("eur")).alias("price"), money.format_price(F.col("regular_price"), F.lit("xau")).alias("other"),
        money.format_move(F.lit("up"), F.col("strength_per_serving") / 1000).alias("move"),
    )


@query("pages_url_parts", "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^?#]*/products?/[^/?#]') THEN regexp_extract(url, '^https?://[^?#]*?/products?/([^/?#]+)', 1) WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) IN ('', '/') THEN '' ELSE regexp_extract(rtrim(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), '([^/]*)$', 1) END AS handle FROM pages")
def url_parts(spark, sf):
    return Data(spark, sf).table("pages").select("page_id", u.handle_of(F.col("url")).alias("handle"))


ENC = "replace(replace(replace(replace(replace(replace({c}, ':', '%3A'), '/', '%2F'), '?', '%3F'), '=', '%3D'), ' ', '%20'), '&', '%26')"


@query(
    "affiliate_urls",
    f"""SELECT o.id, CASE m.affiliate_url_template WHEN '{{product_url}}?aff=7' THEN concat(source_product_url, CASE WHEN contains(source_product_url, '?') THEN '&' ELSE '?' END, 'aff=7')
WHEN '' THEN source_product_url WHEN 'https://go.example.net/{{handle}}' THEN concat('https://go.example.net/item-', CAST(partkey AS STRING))
ELSE concat('https://go.example.net/?u=', {ENC.format(c='source_product_url')}) END AS target, o.visibility_status
FROM v_offers o JOIN v_merchants m ON m.id = o.merchant_id WHERE o.visibility_status <> 'rejected'""",
)
def affiliate_urls(spark, sf):
    d = Data(spark, sf)
    m = d.merchants.select(F.col("id").alias("merchant_id"), "affiliate_url_template")
    target = u.destination(F.col("source_product_url"), F.lit(None).cast("string"), F.col("affiliate_url_template"), F.col("visibility_status"))
    return d.offers.join(m, "merchant_id").select("id", target.alias("target"), "visibility_status").where("target is not null")


@query(
    "check_templates",
    "SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'bad scheme' WHEN 2 THEN CASE WHEN NOT contains(n_name, ' ') THEN concat('unknown: ', lower(n_name)) END END AS problem FROM nation",
)
def check_templates(spark, sf):
    n = Data(spark, sf).table("nation")
    raw = F.element_at(
        F.array(F.lit(" "), F.lit("javascript:{handle}"), F.concat(F.lit("https://x/{"), F.lower("n_name"), F.lit("}{path}")), F.lit("{product_url}?a=1")),
        (F.col("n_nationkey") % 4 + 1).cast("int"),
    )
    return n.select(F.col("n_nationkey").alias("id"), u.check_template(raw).alias("problem"))


@query(
    "rewrite_urls",
    """SELECT page_id, CASE WHEN regexp_extract(url, '^https?://([^/?#]+)', 1) = host THEN concat(regexp_extract(url, '^(https?)://', 1), '://new.example.org/moved',
rtrim(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), CASE WHEN contains(url, '?') THEN concat('?', regexp_extract(url, '\\?([^#]*)', 1)) ELSE '' END) ELSE url END AS url
FROM (SELECT *, (SELECT min(regexp_extract(url, '^https?://([^/?#]+)', 1)) FROM pages) AS host FROM pages) p""",
)
def rewrite_urls(spark, sf):
    pages = Data(spark, sf).table("pages")
    host = pages.agg(F.min(u.url_host(F.col("url")))).first()[0]
    rule = {"from_host": host, "to_host": "new.example.org", "from_path_prefix": "/", "to_path_prefix": "/moved/", "strip_trailing_slash": True}
    return pages.select("page_id", u.rewrite_url(F.col("url"), rule).alias("url"))


@query(
    "variation_urls",
    """SELECT p_partkey AS id, concat('https://w.example.com/product/x/', CASE WHEN p_partkey % 2 = 0 THEN '?b=&a=1&' ELSE '?' END, 'attribute_pa_size=', CAST(p_size AS STRING), '%20mg&attribute_pack-of=', lower(p_type)) AS url FROM part""",
)
def variation_urls(spark, sf):
    link = F.concat(F.lit("https://w.example.com/product/x/"), F.when(F.col("p_partkey") % 2 == 0, "?b=&a=1").otherwise(""))
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    pairs = F.array(pair("Size", F.concat(F.col("p_size").cast("string"), F.lit(" mg"))), pair("Pack of", F.lower("p_type")), pair("None", F.lit("")))
    parents = F.array(F.struct(F.lit("size").alias("name"), F.lit("pa_size").alias("taxonomy")))
    return Data(spark, sf).table("part").select(F.col("p_partkey").alias("id"), u.variation_url(link, pairs, parents).alias("url"))


@query("url_templates", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN concat('https://x.example/c/', replace(p_name, ' ', '%20'), '/', CAST(p_partkey AS STRING)) END AS url FROM part")
def url_templates(spark, sf):
    cols = {"name": F.col("p_name"), "id": F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string"))}
    return Data(spark, sf).table("part").select(F.col("p_partkey").alias("id"), u.fill_url_template("https://x.example/c/{name}/{id}", cols.__getitem__).alias("url"))
