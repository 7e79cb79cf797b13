"""Dose facts read from listing text: strength and count (TXT-6..8)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scan import any_of, around, matches
from .text import WORD_END, ascii_lower, let, mentions, numeric

# How numbers, units and molar masses are written on listings.
NUMBER = r"(?=[0-9])(?<![\d.,])(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"
NUMBER_PARTS = r"^(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(.*)$"
NOT_PER_MOLE = r"(?!\s*(?:/|·|per\s)\s*mol)"
SHORT_UNITS = "mg|mcg|g|iu"
LONG_UNITS = "milligrams?|micrograms?|grams?"
BILLION_CFU = r"(?i)(\d+(?:\.\d+)?)\s*billion\s*cfu"

# Labels of a molecular weight, and the phrases that mark a number
# as one dose or as the content of the whole container.
MOLAR_LABELS = ["molecular weight", "molecular mass", "molar mass", "mol. wt", "mol wt", "m.w.", "mw:", "mw "]
PER_DOSE_TERMS = [
    "per serving", "per dose", "per capsule", "per tablet", "per softgel", "per gummy", "per scoop",
    "each serving", "each capsule", "each tablet", "each softgel", "each gummy", "each scoop",
    "1 capsule", "1 tablet", "1 softgel", "1 scoop", "1 serving",
    "one capsule", "one tablet", "one softgel", "one scoop", "one serving",
]
CONTAINER_TERMS = [
    "total", "per bottle", "per container", "per package", "per jar", "per bag", "per box", "per tub", "per pouch",
    "net wt", "net weight", "net contents",
    "bottle contains", "container contains", "jar contains", "package contains",
]

_UNIT_OF_WORD = {"mg": "mg", "mcg": "mcg", "g": "g", "iu": "IU"}


def _unit(word: Column) -> Column:
    def named(w: Column) -> Column:
        short = F.coalesce(*[F.when(w == k, F.lit(v)) for k, v in _UNIT_OF_WORD.items()])
        return F.coalesce(
            short, F.when(w.startswith("micro"), "mcg").when(w.startswith("gram"), "g").when(w.startswith("milli"), "mg")
        )

    return let(ascii_lower(word), named)


def _best_dose(c: Column, units: str) -> Column:
    """struct<value, unit> of the amount most likely to be one dose, leftmost on ties."""

    def judge(m: Column) -> Column:
        lead = ascii_lower(F.substring(c, F.greatest(m["at"] - 20, F.lit(0)) + 1, F.least(m["at"], F.lit(20))))

        def weigh(w: Column) -> Column:
            score = F.when(w.rlike(any_of(PER_DOSE_TERMS)), 10).otherwise(0) - F.when(w.rlike(any_of(CONTAINER_TERMS)), 10).otherwise(0)
            weighed = F.struct(score.alias("score"), lead.rlike(any_of(MOLAR_LABELS)).alias("molar"))
            # The window holds the lead, so one look tells whether any term is near.
            plain = F.struct(F.lit(0).alias("score"), F.lit(False).alias("molar"))
            return F.when(w.rlike(any_of(PER_DOSE_TERMS + CONTAINER_TERMS + MOLAR_LABELS)), weighed).otherwise(plain)

        def described(seen: Column) -> Column:
            return F.struct(
                seen["score"].alias("score"),
                (-m["at"]).alias("left"),
                F.replace(F.regexp_extract(m["hit"], NUMBER_PARTS, 1), F.lit(","), F.lit("")).cast("double").alias("value"),
                F.regexp_extract(m["hit"], NUMBER_PARTS, 2).alias("word"),
                seen["molar"].alias("molar"),
            )

        return let(let(ascii_lower(around(c, m["at"], 25, 50)), weigh), described)

    found = F.transform(matches(c, rf"(?i){NUMBER}\s*(?:{units}){WORD_END}{NOT_PER_MOLE}"), judge)
    plausible = F.filter(
        found,
        lambda x: (x["score"] > -5) & ~x["molar"] & ~(x["word"].isin("g", "G") & (x["value"] > 1000)),
    )
    return let(
        F.array_max(plausible),
        lambda best: F.when(best.isNotNull(), F.struct(best["value"].alias("value"), _unit(best["word"]).alias("unit"))),
    )


def extract_strength(c: Column) -> Column:
    """TXT-6: struct<value double, unit string>, or null.

    Billions of CFU come first, then amounts with a short unit, then units spelled out.
    """
    billions = let(
        F.regexp_extract(c, BILLION_CFU, 1),
        lambda n: F.when(n != "", F.struct(n.cast("double").alias("value"), F.lit("billion_cfu").alias("unit"))),
    )
    cfu = F.when(mentions(c, ["billion"]), billions)
    # Every one of them has a digit.
    return F.when(c.rlike("[0-9]"), F.coalesce(cfu, _best_dose(c, SHORT_UNITS), _best_dose(c, LONG_UNITS)))


def strength_of(variant_title: Column, whole_text: Column) -> Column:
    """TXT-7: the variant title's own strength wins over the whole text's."""
    # The whole text is read only where the variant title says nothing.
    nothing = F.lit(None).cast("struct<value:double,unit:string>")
    return F.aggregate(F.array(variant_title, whole_text), nothing, lambda found, s: F.coalesce(found, extract_strength(s)))


# Words that follow a count of doses.
VESSELS = (
    "capsules?|caps?|tablets?|tabs?|softgels?|sgels?|servings?|servs?|gummies|count|ct|pieces|doses?|scoops?"
)
#: Each of them holds one of these parts.
VESSEL_PARTS = ["cap", "tab", "gel", "serv", "gummies", "count", "ct", "piece", "dose", "scoop"]
#: A number is read from its first digit and whole: what follows is no digit, so a part of it cannot match where it does not.
VESSEL_COUNT = rf"(?i)(?=[0-9])(?<![0-9])(\d++)[\s\-]*(?:{VESSELS}){WORD_END}"
TIMES_COUNT = r"(?iu)(?<![a-z0-9\-])[x×]\p{IsWhite_Space}*(\d{1,4})(?![\d.,/\-])(?!\p{IsWhite_Space}*(?:mg|mcg|µg|g|iu|ml)\b)"


#: Larger numbers are not counts of doses.
MOST_DOSES = 4999


def extract_count(c: Column, most: int = MOST_DOSES) -> Column:
    """TXT-8: doses per container, 1 to ``most``, or null (after "x" four digits at most are read)."""

    def ok(n: Column) -> Column:
        return (n > 0) & (n <= most)

    before_word = F.transform(F.regexp_extract_all(c, F.lit(VESSEL_COUNT), F.lit(1)), lambda n: n.try_cast("bigint"))
    # A try_cast that fails costs an exception, so texts without the sign are not cast.
    times = F.transform(F.filter(F.array(F.regexp_extract(c, TIMES_COUNT, 1)), lambda n: n != ""), lambda n: n.try_cast("bigint"))
    counted = F.when(mentions(c, VESSEL_PARTS), F.get(F.filter(before_word, ok), F.lit(0)))
    return F.coalesce(counted, F.when(mentions(c, ["x", "×"]), F.get(F.filter(times, ok), F.lit(0)))).cast("int")


def dose_number(c: Column) -> Column:
    """A stored dose field as a double."""
    return numeric(c)
