"""Amounts written in listing text (AMT-1..5, 7, 8 and SET-3)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scan import matches
from .text import ascii_lower, half_up, let

# The grammar of an amount, the longest unit word first.
_SPACE = r"\p{IsWhite_Space}*"
_NUM = r"(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"
_NOT_MID_NUMBER = r"(?=[0-9])(?<![\d.,])"
_AMOUNT_UNITS = rf"billion{_SPACE}cfu|milligrams?|micrograms?|kilograms?|grams?|mcg|µg|ug|mg|kg|iu|g"
_PACK_UNITS = r"milligrams?|micrograms?|grams?|mcg|µg|ug|mg|iu|g"
_LIST_UNITS = r"mcg|µg|ug|mg|g|iu"
_NOT_MOLAR = r"(?!\p{IsWhite_Space}*(?:/|·|per\p{IsWhite_Space})\p{IsWhite_Space}*mol)"
AMOUNT = rf"(?iu){_NOT_MID_NUMBER}{_NUM}{_SPACE}(?:{_AMOUNT_UNITS})(?![a-z]){_NOT_MOLAR}"
PACK_COUNT_FIRST = rf"(?iu){_NOT_MID_NUMBER}\d{{1,3}}{_SPACE}[x×]{_SPACE}{_NUM}{_SPACE}(?:{_PACK_UNITS})(?![a-z])"
PACK_AMOUNT_FIRST = rf"(?iu){_NOT_MID_NUMBER}{_NUM}{_SPACE}(?:{_PACK_UNITS}){_SPACE}[x×]{_SPACE}\d{{1,3}}(?![\d.])"
SLASH_LIST = (
    rf"(?iu){_NOT_MID_NUMBER}{_NUM}(?:{_SPACE}(?:{_LIST_UNITS}))?"
    rf"(?:{_SPACE}/{_SPACE}{_NUM}(?:{_SPACE}(?:{_LIST_UNITS}))?)+(?![a-z])"
)

# Milligrams per mass unit.
MG_PER = {"mcg": 0.001, "mg": 1.0, "g": 1000.0, "kg": 1000000.0}

AMOUNT_TYPE = "array<struct<value:double,unit:string,at:int,len:int>>"


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).cast("double")


def canonical_unit(c: Column) -> Column:
    """AMT-3: mg, mcg, g, kg, IU or billion_cfu, else null."""

    def known(u: Column) -> Column:
        return (
            F.when(u.startswith("billion"), "billion_cfu")
            .when(u == "iu", "IU")
            .when(u.isin("mcg", "µg", "ug") | u.startswith("microgram"), "mcg")
            .when((u == "mg") | u.startswith("milligram"), "mg")
            .when((u == "kg") | u.startswith("kilogram"), "kg")
            .when((u == "g") | u.startswith("gram"), "g")
        )

    # White space inside a name changes none of these answers, so it is left as it is.
    return let(c, lambda u: F.when(u.isin("mg", "g", "mcg", "kg"), u).otherwise(let(ascii_lower(F.trim(u)), known)))


def _mg_factor(unit: Column) -> Column:
    return F.coalesce(*[F.when(unit == u, F.lit(f)) for u, f in MG_PER.items()])


def convert_unit(value: Column, source: Column, target: Column) -> Column:
    """AMT-4: mass units convert among themselves, others only to themselves, else null."""
    return F.when(source == target, value.cast("double")).otherwise(
        value.cast("double") * _mg_factor(source) / _mg_factor(target)
    )


def same_amount(a: Column, b: Column) -> Column:
    """AMT-5: equal within one percent of the second amount."""
    return F.when(b == 0, F.lit(False)).otherwise(F.abs(a - b) / F.abs(b) <= 0.01)


def scan_amounts(c: Column) -> Column:
    """AMT-1: every "number unit" with its offset and length."""

    def read(m: Column) -> Column:
        return F.struct(
            _number(F.regexp_extract(m["hit"], f"^({_NUM})", 1)).alias("value"),
            canonical_unit(F.regexp_replace(m["hit"], rf"^{_NUM}\p{{IsWhite_Space}}*", "")).alias("unit"),
            m["at"].alias("at"),
            F.length(m["hit"]).alias("len"),
        )

    found = F.filter(F.transform(matches(c, AMOUNT), read), lambda a: a["unit"].isNotNull())
    # Every one of them has a digit.
    return F.when(c.rlike("[0-9]"), found).otherwise(F.from_json(F.lit("[]"), AMOUNT_TYPE))


def scan_packs(c: Column) -> Column:
    """AMT-2: pack notation, "2 x 10mg" then "10mg x 2", as the product of both numbers."""

    def read(count: str, amount: str, unit: str):
        def inner(m: Column) -> Column:
            n = F.regexp_extract(m["hit"], count, 1).cast("int")
            return F.struct(
                (n * _number(F.regexp_extract(m["hit"], amount, 1))).alias("value"),
                canonical_unit(F.regexp_extract(m["hit"], unit, 1)).alias("unit"),
                m["at"].alias("at"),
                F.length(m["hit"]).alias("len"),
                n.alias("n"),
            )

        return inner

    first = F.transform(
        matches(c, PACK_COUNT_FIRST),
        read(r"^(\d{1,3})", rf"[xX×]\p{{IsWhite_Space}}*({_NUM})", rf"(?iu)({_PACK_UNITS})$"),
    )
    last = F.transform(
        matches(c, PACK_AMOUNT_FIRST),
        read(r"(\d{1,3})$", rf"^({_NUM})", rf"(?iu)^{_NUM}\p{{IsWhite_Space}}*({_PACK_UNITS})"),
    )
    usable = F.filter(F.concat(first, last), lambda a: a["unit"].isNotNull() & (a["n"] >= 2))
    packs = F.transform(usable, lambda a: F.struct(a["value"], a["unit"], a["at"], a["len"]))
    # Both shapes hold the sign, so a text without it is not searched.
    return F.when(c.rlike("[xX×]"), packs).otherwise(F.from_json(F.lit("[]"), AMOUNT_TYPE))


def _as_mg(a: Column) -> Column:
    mass = a["unit"].isin(list(MG_PER))
    return F.struct(
        F.when(mass, convert_unit(a["value"], a["unit"], F.lit("mg"))).otherwise(a["value"]).alias("mg"),
        F.when(a["unit"] == "kg", "g").otherwise(a["unit"]).alias("unit"),
        F.when(mass, "mass").otherwise(a["unit"]).alias("family"),
        a["value"].alias("value"),
    )


def amount_key(a: Column) -> Column:
    """One key per distinct amount, with mass folded to milligrams."""
    return F.concat_ws(":", a["family"], let(a["mg"], lambda v: half_up(v, 6)).cast("string"))


def distinct_amounts(amounts: Column) -> Column:
    """SET-3: one entry per distinct amount of :func:`scan_amounts`, in order of first mention."""

    def firsts(every: Column) -> Column:
        keys = F.transform(every, lambda a: a["key"])
        return F.filter(every, lambda a, i: F.array_position(keys, a["key"]) == i + 1)

    def distinct(every: Column) -> Column:
        folded = F.transform(every, lambda a: F.struct(a["value"], a["unit"], amount_key(_as_mg(a)).alias("key")))
        plain = F.transform(every, lambda a: F.struct(a["value"], a["unit"]))
        # One amount alone is compared with no other.
        return F.when(F.size(every) > 1, F.transform(let(folded, firsts), lambda a: F.struct(a["value"], a["unit"]))).otherwise(plain)

    return let(amounts, distinct)


def amount_list(c: Column) -> Column:
    """AMT-8: array<struct<mg, unit, family, value>>: every amount, duplicates kept.

    Slash lists share their last unit and come first; an amount followed by "each"
    belongs to one part and is left out.
    """
    item = F.lit(rf"(?iu)({_NUM})(?:\p{{IsWhite_Space}}*({_LIST_UNITS}))?")

    def read_list(m: Column) -> Column:
        units = F.regexp_extract_all(m["hit"], item, F.lit(2))
        shared = F.try_element_at(F.filter(units, lambda u: u != ""), F.lit(-1))
        return F.struct(
            F.zip_with(
                F.regexp_extract_all(m["hit"], item, F.lit(1)),
                units,
                lambda n, u: F.struct(
                    _number(n).alias("value"), canonical_unit(F.when(u != "", u).otherwise(shared)).alias("unit")
                ),
            ).alias("items"),
            m["at"].alias("start"),
            (m["at"] + F.length(m["hit"])).alias("stop"),
            (F.size(F.filter(units, lambda u: u != "")) > 0).alias("dosed"),
        )

    def all_amounts(lists: Column) -> Column:
        listed = F.filter(F.flatten(F.transform(lists, lambda s: s["items"])), lambda a: a["unit"].isNotNull())
        single = F.filter(
            scan_amounts(c),
            lambda a: ~F.exists(lists, lambda s: (a["at"] >= s["start"]) & (a["at"] < s["stop"]))
            & ~F.substring(c, a["at"] + a["len"] + 1, F.lit(2147483647)).rlike(r"(?i)^\s*each(?![A-Za-z0-9_])"),
        )
        return F.concat(listed, F.transform(single, lambda a: F.struct(a["value"], a["unit"])))

    lists = F.filter(F.transform(matches(c, SLASH_LIST), read_list), lambda s: s["dosed"])
    return F.transform(let(lists, all_amounts), lambda a: _as_mg(a))


def amounts_within(inner: Column, outer: Column) -> Column:
    """SET-2: every amount of one list is also in the other."""
    return F.size(F.array_except(F.transform(inner, amount_key), F.transform(outer, amount_key))) == 0


# Numbers written as words on pack labels, and the shapes of a container count.
WORD_NUMBERS = {
    "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "twelve": 12, "twenty": 20,
}
_WORDS = "|".join(WORD_NUMBERS)
PACK_COUNT_SHAPES = [
    rf"(?i)(?<![a-z0-9\-.,])(\d{{1,3}}|{_WORDS})\s*-?\s*(?:packs?|pk|vials?|kits?|bottles?|pcs|pieces)(?![A-Za-z0-9_])",
    rf"(?i)(?<![A-Za-z0-9_])pack\s+of\s+(\d{{1,3}}|{_WORDS})(?![A-Za-z0-9_])",
    r"(?i)(?:mg|mcg|µg|g|iu)\s*[x×]\s*(\d{1,3})(?![\d.])",
    r"(?i)(?<![a-z0-9\-])[x×]\s*(\d{1,3})\s*(?:vials?|pcs|pieces)(?![A-Za-z0-9_])",
    r"(?i)(?<![\d.,])(\d{1,2})\s*[x×]\s*\d",
]
#: Larger numbers are not counts of containers.
MAX_PACK = 100


def pack_counts(c: Column, most: int = MAX_PACK) -> Column:
    """AMT-7: the distinct container counts (2 to ``most``) a text states, in order of the shapes."""
    found = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in PACK_COUNT_SHAPES])
    words = F.create_map(*[F.lit(x) for kv in WORD_NUMBERS.items() for x in kv])
    counts = F.transform(found, lambda n: F.coalesce(F.element_at(words, ascii_lower(n)), n.try_cast("int")))
    return F.array_distinct(F.filter(counts, lambda n: (n > 1) & (n <= most)))
