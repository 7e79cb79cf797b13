"""What a row of text rules costs: cheap paths that must not change a result."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricebook import session
from pricebook.functions import amounts as a, dose, scan, text as t

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_wide_tables_are_written_with_methods_that_are_compiled(spark):
    seen = []

    class Writer:
        def parquet(self, path):
            seen.append(spark.conf.get(LIMIT, None))

    class Frame:
        sparkSession, write, schema = spark, Writer(), "a int"

    for wide in (True, False):
        try:
            session.materialize(Frame(), wide=wide)
        except Exception:  # nothing was written, so nothing can be read
            pass
    assert seen == ["8000", None] and spark.conf.get(LIMIT, None) is None
    spark.conf.set(LIMIT, "5000")
    try:
        with session._compiled_methods(spark):
            assert spark.conf.get(LIMIT) == "5000"
        assert spark.conf.get(LIMIT) == "5000"
    finally:
        spark.conf.unset(LIMIT)


def test_rounding_needs_decimals_only_near_a_half(spark):
    values = [79.33324999999999, 0.5, -0.5, 2.5, 1.00005, -1.00005, 1234567.89125, 1e5, 123456789.123456, 1e12 + 0.5, 1e30, -0.0, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 2, 4, 6):
        plain = F.round(F.col("x").try_cast("decimal(38,12)"), digits).cast("double")
        rows = df.select(t.half_up(F.col("x"), digits).alias("got"), plain.alias("want"))
        assert [repr(r["got"]) for r in rows.collect()] == [repr(r["want"]) for r in rows.collect()]
        assert "rint(" in _plan(rows)


def test_lower_case_of_ascii_needs_no_look_up(spark):
    df = spark.createDataFrame([("ABC z",), ("ÀB İK",), ("",), (None,)], "x string")
    out = df.select(t.ascii_lower(F.col("x")).alias("y"))
    assert [r["y"] for r in out.collect()] == ["abc z", "Àb İk", "", None]
    assert "octet_length(" in _plan(out)


def test_positions_do_not_depend_on_the_number_of_matches(spark):
    texts = ["", "none", *["é " + "5mg, " * n for n in (1, 2, 16, 17, 40)]]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    out = df.select("x", scan.matches(F.col("x"), "[0-9]+mg").alias("m"))
    for r in out.collect():
        assert [(m["hit"], m["at"]) for m in r["m"]] == [("5mg", 2 + 5 * i) for i in range(r["x"].count("5mg"))]
    assert "slice(" in _plan(out)


def test_texts_without_the_sign_are_not_searched_for_packs(spark):
    df = spark.createDataFrame([("5mg x 10",), ("2 × 5 MG",), ("3X5mg",), ("5 mg",), (None,)], "x string")
    out = df.select(a.scan_packs(F.col("x")).alias("p"))
    assert [[(p["value"], p["unit"], p["at"], p["len"]) for p in r["p"]] for r in out.collect()] == [
        [(50.0, "mg", 0, 8)], [(10.0, "mg", 0, 8)], [(15.0, "mg", 0, 5)], [], [],
    ]
    assert ", [xX×])" in _plan(out)


def test_terms_near_a_dose_still_count(spark):
    cases = {
        "500 mg total, for all the days of one month, 5 mg per serving": (5.0, "mg"), "molecular weight: 403.9 g, 20mg": (20.0, "mg"), "M.W. 30 g": None, "2000 G": None, "2000 g 4 IU": (4.0, "IU"),
        "5 milligrams": (5.0, "mg"), "12 billion CFU": (12.0, "billion_cfu"), "no digits mg": None,
    }
    df = spark.createDataFrame([(x,) for x in cases], "x string")
    got = df.select(dose.extract_strength(F.col("x")).alias("s"))
    assert [r["s"] and tuple(r["s"]) for r in got.collect()] == list(cases.values())
    assert ", [0-9])" in _plan(got)
