"""Text rules: each case is a listing text and what must be read from it."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from pricebook.functions import amounts as a, attributes as at, dose, money, scan, text as t, urls as u


def rows(spark, cases, column):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string")
    return [r[0] for r in df.select("i", column.alias("v")).orderBy("i").select("v").collect()]


def test_entities_decode_twice_and_leave_the_unknown(spark):
    cases = {
        "A &#8211; B": "A – B",
        "A &amp;#8211; B": "A – B",
        "Tom &amp; Co &eacute;": "Tom & Co é",
        "&#x1F600;": "😀",
        "&nosuch; &#0; &#13;": "&nosuch; &#0; &#13;",
        "no semicolon &amp": "no semicolon &amp",
        "plain": "plain",
    }
    assert rows(spark, list(cases), t.decode_entities(F.col("x"))) == list(cases.values())


def test_titles_keep_codes_and_drop_doses(spark):
    cases = {
        "Alpha-7 20mg, 90 Tablets": "alpha7",
        "Beta   Root 2.5mg Liquid Drops": "beta root",
        "Red &amp; Blue": "red blue",
        "ÉTOILE 500 mcg": "toile",
        "60 ct": "",
    }
    assert rows(spark, list(cases), t.normalize_title(F.col("x"))) == list(cases.values())
    assert rows(spark, ["ab", "abc", "x " * 200], t.title_key(F.col("x"))) == ["", "abc", ("x " * 200).strip()]


def test_strength(spark):
    cases = [
        ("Gamma 250 mg 60 tablets", (250.0, "mg")),
        ("Gamma 9,000 mg total per bottle", None),
        ("500mg per capsule, 30,000 mg total per container", (500.0, "mg")),
        ("20 billion CFU plus 5mg", (20.0, "billion_cfu")),
        ("Molecular weight: 250.5 g", None),
        ("250.5 g/mol", None),
        ("4000 g tub", None),
        ("Vitamin 1000 iu", (1000.0, "IU")),
        ("three 25 micrograms", (25.0, "mcg")),
        ("0.5 g and 10 mg", (0.5, "g")),
        ("", None),
    ]
    got = rows(spark, [c for c, _ in cases], dose.extract_strength(F.col("x")))
    assert [None if g is None else (g["value"], g["unit"]) for g in got] == [w for _, w in cases]


def test_counts_are_not_dates_or_links(spark):
    cases = {"90 capsules": 90, "Best before 12/14/2030": None, "x60": 60, "2 x 10mg": None, "EX-60": None, "0 caps, 30 servings": 30, "9999 tabs": None, "× 15.5": None}
    assert rows(spark, list(cases), dose.extract_count(F.col("x"))) == list(cases.values())


def test_form_and_percentage(spark):
    assert rows(spark, ["Softgel caps", "gummies", "dropship", "tabs!", "soft   gel"], t.extract_form(F.col("x"))) == ["softgel", "gummy", None, "tablet", "softgel"]
    got = rows(spark, ["40% withanolides", "100% Vegan", "standardized to 10% Pure", "100% natural 5 % curcumin-x"], t.extract_standardization(F.col("x")))
    assert [None if g is None else (g["pct"], g["compound"]) for g in got] == [(40.0, "withanolides"), None, (10.0, None), (5.0, "curcumin-x")]


def test_amounts_and_packs(spark):
    got = rows(spark, ["12,000 mg and 1.5 µg, 3 g/mol, 5mgs"], a.scan_amounts(F.col("x")))[0]
    assert [(r["value"], r["unit"], r["at"], r["len"]) for r in got] == [(12000.0, "mg", 0, 9), (1.5, "mcg", 14, 6)]
    packs = rows(spark, ["3 x 10mg", "10 mg × 4", "1 x 10mg"], a.scan_packs(F.col("x")))
    assert [[r["value"] for r in p] for p in packs] == [[30.0], [40.0], []]
    counts = rows(spark, ["Ten-Pack", "pack of 5", "10mg x 10", "EX-1295 Kit", "200 vials", "3 vials 3 vials"], a.pack_counts(F.col("x")))
    assert counts == [[10], [5], [10], [], [], [3]]
    listed = rows(spark, ["13/3MG", "5mg & 5mg", "10mg (5mg each)", "1/2 price"], a.amount_list(F.col("x")))
    assert [[r["mg"] for r in x] for x in listed] == [[13.0, 3.0], [5.0, 5.0], [10.0], []]


def test_attributes(spark):
    doc = '{"options":[{"name":"Dose"}],"variant_options":{"option1":"5 mg"},"weight":{"value":9,"unitText":"g"},"amount":10,"amount_unit":"mg","flag":true,"n":7,"deep":[{"name":"Form","value":["Vial",2]}]}'
    assert rows(spark, [doc, "oops", None], at.flatten_attributes(F.col("x"))) == ["10 mg | Dose | 5 mg | Form | Vial", "", ""]
    pairs = rows(spark, [doc], at.attribute_pairs(F.col("x")))[0]
    assert [(p["label"], p["value"]) for p in pairs] == [("amount", "10 mg"), ("name", "Dose"), ("Dose", "5 mg"), ("value", "9 g"), ("Form", "Vial"), ("Form", "2")]
    s = rows(spark, [doc], at.split_attributes(F.col("x")))[0]
    assert s["variant"] == ["5 mg"] and s["product"] == ["10 mg", "Dose", "9 g", "Vial", "2"]


@pytest.mark.parametrize("raw,digits,want", [("1999", "2", "19.99"), ("7", "2", "0.07"), ("1999", "0", "1999"), ("12.345", "2", "12.35"), ("ask", "2", "ask"), ("", "2", "")])
def test_minor_units(spark, raw, digits, want):
    assert rows(spark, [raw], money.minor_unit_money(F.col("x"), F.lit(digits))) == [want]


def test_urls(spark):
    fill = lambda tpl: rows(spark, ["https://s.com/products/red-jar?x=1"], u.affiliate_url(F.lit(tpl), F.col("x")))[0]
    assert fill("{product_url}?aff=9") == "https://s.com/products/red-jar?x=1&aff=9"
    assert fill("https://go/?h={handle}&p={path}") == "https://go/?h=red-jar&p=/products/red-jar"
    assert fill("https://go/?u={url_encoded_product_url}") == "https://go/?u=https%3A%2F%2Fs.com%2Fproducts%2Fred-jar%3Fx%3D1"
    assert rows(spark, ["notaurl"], u.affiliate_url(F.lit("{product_url}"), F.col("x"))) == [None]
    assert rows(spark, ["https://s.com/a/b/", "https://s.com/product/q?z", "https://s.com"], u.handle_of(F.col("x"))) == ["b", "q", ""]
    gone = rows(spark, ["active", "rejected"], u.destination(F.lit("ftp://x/y"), F.lit(None).cast("string"), F.lit(""), F.col("x")))
    assert gone == [None, None]


def test_half_up_counts_binary_halves(spark):
    assert rows(spark, ["9519.99"], t.half_up(F.col("x").cast("double") / 120, 4)) == [79.3333]


def test_attributes_of_any_depth(spark):
    from pricebook.functions import attributes as a

    deep = 100_000
    lists = "[" * deep + '"5 mg"' + "]" * deep
    dicts = '{"a":' * deep + '{"name":"Size","value":[[["9 g"]],2]}' + "}" * deep
    df = spark.createDataFrame([(1, lists), (2, dicts), (3, lists[:-1]), (4, dicts + "x"), (5, '{"variation_attributes":' + lists + "}")], "id int, j string")
    got = {r["id"]: r for r in df.select("id", a.flatten_attributes(F.col("j")).alias("t"), a.attribute_pairs(F.col("j")).alias("p"), a.split_attributes(F.col("j")).alias("s")).collect()}
    assert got[1]["t"] == "5 mg" and [tuple(x) for x in got[1]["p"]] == [("", "5 mg")] and got[1]["s"]["product"] == ["5 mg"]
    assert got[2]["t"] == "Size | 9 g" and [tuple(x) for x in got[2]["p"]] == [("Size", "9 g"), ("Size", "2")]
    assert got[3]["t"] == got[4]["t"] == "" and got[5]["s"]["variant"] == ["5 mg"]


def test_deep_parser_agrees_with_the_library():
    import json

    from pricebook.functions.attributes import _parse_deep

    good = ["[]", "{}", '[1,-0.5e3,true,null,"a\\u00e9\\n",{"k":{"k":[[],{}]},"k":2}]', ' {"a" : [ ] } ', "3", '"x"']
    assert [_parse_deep(x) for x in good] == [json.loads(x) for x in good]
    for bad in ["", "[", "]", "[1,]", '{"a"}', '{"a":}', "{1:2}", "[1 2]", "[1]]", "01", "[1.]", "tru", '{"a":1,}', "[}", '["a'  ]:
        try:
            _parse_deep(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_places_of_terms_and_amounts_are_found_by_their_first_character():
    terms = ["total", "per bag", "1 scoop", "(net"]
    assert scan.any_of(terms).startswith("(?=[") and a.AMOUNT.startswith("(?iu)(?=[0-9])")
    for text in ["in total", "per bags", "1 scoops", "a (net", "tota l", "11 scop", ""]:
        plain = any(t in text for t in terms)
        assert bool(re.search(re.sub(r"\\Q(.*?)\\E", lambda m: re.escape(m[1]), scan.any_of(terms)), text)) == plain


def test_texts_without_a_times_sign_are_not_cast(spark):
    # A try_cast that fails costs an exception per text; the variant title's strength ends the search.
    df = spark.createDataFrame([("a 30 caps",), ("x 60",), ("red jar",), ("0 caps x 20",), (None,)], "x string")
    counts = df.select(dose.extract_count(F.col("x")).alias("n"))
    assert [r["n"] for r in counts.collect()] == [30, 60, None, 20, None]
    assert "filter(array(regexp_extract(" in counts._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.createDataFrame([("5 mg", "9 g"), ("red", "9 g"), (None, "7 iu"), ("", "")], "v string, w string")
    found = rows.select(dose.strength_of(F.col("v"), F.col("w")).alias("s"))
    assert [r["s"] and tuple(r["s"]) for r in found.collect()] == [(5.0, "mg"), (9.0, "g"), (7.0, "IU"), None]
