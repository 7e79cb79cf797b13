"""Text functions as Column expressions (TXT-1..4, 9..14)."""

from __future__ import annotations

import functools
import html.entities
import json
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# ASCII edges of a word, spelled out so that they do not depend on the JVM's idea of a word character.
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Use a value several times but compute it once: it is bound as the variable of a lambda."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, leaving every other character alone."""
    # ``translate`` looks every character up on its own; a text of ASCII alone (as many bytes as characters) needs no look-up.
    return let(
        c,
        lambda s: F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(
            F.translate(s, string.ascii_uppercase, string.ascii_lowercase)
        ),
    )


def hold(df: DataFrame, read: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The frame with the columns that a chain of rules does not read packed into one, and what puts them back in place.

    Every step of a chain copies its rows field by field; what is packed is copied as one piece.
    """
    rest = [c for c in df.columns if c not in read]
    if not rest:
        return df, lambda out: out
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_held"), *[c for c in read if c in df.columns])

    def back(out: DataFrame) -> DataFrame:
        more = [c for c in out.columns if c not in df.columns and c != "_held"]
        return out.select(*[F.col(f"_held.`{c}`").alias(c) if c in rest else F.col(f"`{c}`") for c in df.columns], *more)

    return packed, back


def mentions(c: Column, parts: list[str]) -> Column:
    """True if the text holds one of the lower-case parts, in any case: a cheap look before a pattern that needs one of them."""
    return let(F.lower(c), lambda s: functools.reduce(lambda a, b: a | b, [s.contains(p) for p in parts]))


def blank(c: Column) -> Column:
    """True for null and for the empty string."""
    return c.isNull() | (c == "")


def text(c: Column) -> Column:
    """The column as a string, null as the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def numeric(c: Column) -> Column:
    """A double, or null when the text is not a plain decimal number."""
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), s.try_cast("double"))


def half_up(c: Column, digits: int) -> Column:
    """Round half away from zero on the decimal form of a double.

    Twelve decimals come first, so that a half that binary arithmetic left a hair
    short (79.33324999999999) still counts as a half.  Plain casts only, to stay
    inside generated code; values of 1e26 and more, which no stored column can hold,
    give null.
    """
    value = c.cast("double")
    exact = F.round(value.try_cast("decimal(38,12)"), digits).cast("double")
    if not 0 <= digits <= 6:
        return exact
    # Where the scaled value is not near a half, no decimals are needed: neither its own error (under 3e-7) nor that of the
    # twelve decimals (5e-7) can reach the half, and a whole number over a power of ten is the double that the decimal gives.
    power = float(10**digits)
    scaled = value * power
    whole = F.rint(scaled)
    clear = (F.abs(scaled) < 1e9) & (F.abs(scaled - whole) < 0.49999)
    return F.when(clear, whole / power + 0.0).otherwise(exact)


def plain_number(c: Column, digits: int = 4) -> Column:
    """A number as text with at most ``digits`` decimals and no trailing zeros."""
    fixed = F.round(c.cast("double"), digits).cast(f"decimal(30,{digits})").cast("string")
    return F.regexp_replace(fixed, r"\.?0+$", "") if digits else fixed


@functools.cache
def _named_entities() -> str:
    """Entity names and their characters as one JSON object.

    These are the HTML 4 names plus every HTML5 name of an ASCII character.  HTML5's
    remaining names (mathematical signs, rare arrows) are left as they stand, so that
    the table stays a few kilobytes in the plan.
    """
    every = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
    common = html.entities.name2codepoint
    return json.dumps({k: v for k, v in every.items() if k in common or (len(v) == 1 and v.isascii())})


def _entity_char(body: Column, names: Column) -> Column:
    """The character(s) for the body of ``&body;``, or null when it is not one."""
    digits = F.regexp_extract(body, r"^#([0-9]{1,7})$", 1)
    hexits = F.regexp_extract(body, r"^#[xX]([0-9A-Fa-f]{1,6})$", 1)
    code = F.coalesce(F.nullif(digits, F.lit("")).cast("int"), F.conv(F.nullif(hexits, F.lit("")), 16, 10).cast("int"))
    # Code points that HTML5 allows to be written as a reference.
    allowed = (
        code.between(32, 126)
        | code.isin(9, 10, 12)
        | (
            code.between(160, 0x10FFFF)
            & ~code.between(0xD800, 0xDFFF)
            & ~code.between(0xFDD0, 0xFDEF)
            & ~(code.bitwiseAND(F.lit(0xFFFF)) >= 0xFFFE)
        )
    )
    char = F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")
    return F.when(body.startswith("#"), F.when(allowed, char)).otherwise(F.element_at(names, body))


def _decode_once(c: Column) -> Column:
    mark = "\u0001"

    def spell(piece: Column, i: Column) -> Column:
        names = F.from_json(F.lit(_named_entities()), "map<string,string>")
        char = F.coalesce(_entity_char(piece, names), F.concat(F.lit("&"), piece, F.lit(";")))
        return F.when(i % 2 == 0, piece).otherwise(char)

    def decode(s: Column) -> Column:
        marked = F.regexp_replace(s, r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", f"{mark}$1{mark}")
        return F.when(s.contains("&"), F.array_join(F.transform(F.split(marked, mark, -1), spell), "")).otherwise(s)

    return let(c, decode)


def decode_entities(c: Column) -> Column:
    """TXT-1: decode HTML entities twice, so that double-encoded text comes out clean.

    Only references that end in a semicolon count.  The control character U+0001
    is the splitter and is dropped from the input.
    """
    clean = F.replace(text(c), F.lit("\u0001"), F.lit(""))
    return let(clean, lambda s: F.when(s.contains("&"), _decode_once(_decode_once(s))).otherwise(s))


# Words that say how a product is packed or measured, not what it is.
TITLE_STOP_WORDS = [
    "capsules", "capsule", "caps", "cap", "tablets", "tablet", "tabs", "tab", "softgels", "softgel", "soft-gels", "powder", "powdered",
    "liquid", "tincture", "tinctures", "drops", "gummies", "gummy", "count", "ct", "serving", "servings", "pieces", "piece", "scoop",
    "scoops", "sublingual",
]
TITLE_UNITS = ["mg", "mgs", "mcg", "ug", "g", "kg", "iu", "ml"]


def normalize_title(c: Column) -> Column:
    """TXT-2: the words of a title that name the product, lower-cased and joined by one space."""
    s = ascii_lower(decode_entities(c))
    s = F.regexp_replace(s, r"([a-z])-([0-9])", "$1$2")
    s = F.regexp_replace(s, r"[^a-z0-9]+", " ")
    dose_or_digits = "^(?:[0-9]+(?:" + "|".join(TITLE_UNITS) + ")?)$"
    dropped = TITLE_STOP_WORDS + TITLE_UNITS
    return F.array_join(F.filter(F.split(s, " "), lambda w: (w != "") & ~w.isin(dropped) & ~w.rlike(dose_or_digits)), " ")


def title_key(c: Column) -> Column:
    """TXT-3: the memory key of a title, the whole normalized title; empty when too short to mean anything."""
    return let(normalize_title(c), lambda k: F.when(F.length(k) >= 3, k).otherwise(""))


def search_text(*parts: Column) -> Column:
    """TXT-4: the non-empty parts, entity-decoded and joined with a separator."""
    decoded = F.array(*[decode_entities(p) for p in parts])
    return F.array_join(F.filter(decoded, lambda p: p != ""), " | ")


# Keyword families of a product form, the most specific first, and the parts of which each keyword holds one.
FORM_WORDS = [
    ("softgel", r"softgels?|soft-gels?|soft\s+gel", ["soft"]),
    ("sublingual", r"sublinguals?|under-the-tongue|sub-lingual", ["lingual", "tongue"]),
    ("gummy", r"gummies|gummy", ["gumm"]),
    ("capsule", r"capsules?|caps?", ["cap"]),
    ("tablet", r"tablets?|tabs?", ["tab"]),
    ("powder", r"powders?|powdered", ["powder"]),
    ("liquid", r"liquids?|tinctures?|drops?|syrups?", ["liquid", "tincture", "drop", "syrup"]),
]


def extract_form(c: Column) -> Column:
    """TXT-9: the first keyword family the text mentions."""

    def named(s: Column) -> Column:
        def said(words: str, parts: list[str]) -> Column:
            held = functools.reduce(lambda a, b: a | b, [s["low"].contains(p) for p in parts])
            return held & s["text"].rlike(f"(?i){WORD_START}(?:{words}){WORD_END}")

        return F.coalesce(*[F.when(said(words, parts), F.lit(form)) for form, words, parts in FORM_WORDS])

    return let(F.struct(c.alias("text"), F.lower(c).alias("low")), named)


# A percentage of one of these is a purity claim.
PURITY_WORDS = """organic vegan natural pure gmo gluten soy dairy free allergen kosher halal vegetarian""".split()


def extract_standardization(c: Column) -> Column:
    """TXT-10: struct<pct, compound>, or null when the text makes no such claim."""
    said = r"(?i)standardized\s+to\s+(\d+(?:\.\d+)?)\s*%(?:\s+([a-zA-Z][\w-]+))?"
    pct = F.nullif(F.regexp_extract(c, said, 1), F.lit("")).cast("double")
    named = ascii_lower(F.regexp_extract(c, said, 2))
    explicit = F.when(
        pct.isNotNull(),
        F.struct(pct.alias("pct"), F.when((named != "") & ~named.isin(PURITY_WORDS), named).alias("compound")),
    )
    bare = F.lit(r"(?U)(\d+(?:\.\d+)?)\s*%\s+([a-zA-Z][\w-]+)")
    claims = F.zip_with(
        F.regexp_extract_all(c, bare, F.lit(1)),
        F.regexp_extract_all(c, bare, F.lit(2)),
        lambda p, w: F.struct(p.try_cast("double").alias("pct"), ascii_lower(w).alias("compound")),
    )
    implied = F.get(F.filter(claims, lambda x: ~x["compound"].isin(PURITY_WORDS)), F.lit(0))
    # Both shapes hold the sign.
    return F.when(c.contains("%"), F.coalesce(explicit, implied))


def strip_html(c: Column) -> Column:
    """TXT-11: tags become spaces, white space collapses."""
    return F.trim(F.regexp_replace(F.regexp_replace(text(c), r"<[^>]+>", " "), r"\s+", " "))


def stringify(c: Column) -> Column:
    """TXT-12: a JSON value as text: a scalar, a list joined with commas, an object by its name, @id or url."""

    def one(v: Column) -> Column:
        named = F.coalesce(*[F.get_json_object(v, f"$['{k}']") for k in ("name", "@id", "url")], F.lit(""))
        return F.when(v.startswith("{"), named).otherwise(text(v))

    # Elements of a JSON list arrive as strings; nested lists are one level deep in practice.
    items = F.transform(
        F.from_json(c, "array<string>"),
        lambda v: F.when(
            v.startswith("["),
            F.array_join(F.filter(F.transform(F.from_json(v, "array<string>"), one), lambda x: x != ""), ", "),
        ).otherwise(one(v)),
    )
    return F.when(c.startswith("["), F.array_join(F.filter(items, lambda x: x != ""), ", ")).otherwise(one(text(c)))


def slugify(c: Column) -> Column:
    """TXT-13: lower-case words joined with hyphens."""
    return F.regexp_replace(F.regexp_replace(ascii_lower(F.trim(text(c))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def salted_hash(c: Column, salt: str) -> Column:
    """TXT-14: SHA-256 of ``salt|value``."""
    return F.sha2(F.concat(F.lit(salt + "|"), text(c)), 256)


def client_ip(forwarded_for: Column, remote_addr: Column, trust_forwarded: bool = True) -> Column:
    """TXT-14: the first forwarded address when a proxy is trusted, else the peer's address."""
    if not trust_forwarded:
        return text(remote_addr)
    first = F.trim(F.get(F.split(text(forwarded_for), ","), F.lit(0)))
    return F.when(first != "", first).otherwise(text(remote_addr))


def json_list_or_words(c: Column) -> Column:
    """A list column given either as a JSON list or as words split at ``|``, ``;`` or ``,``."""
    words = F.split(text(c), r"\s*[|;,]\s*")
    raw = F.coalesce(F.when(F.trim(text(c)).startswith("["), F.from_json(c, "array<string>")), words)
    return F.filter(F.transform(raw, lambda w: F.trim(w)), lambda w: w.isNotNull() & (w != ""))


def json_value(value: Column) -> Column:
    """A cell of a parsed JSON object back as JSON: objects, lists, numbers and booleans bare, text quoted."""
    raw = value.rlike(r"^\s*[\[{]") | value.rlike(r"^-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?$") | value.isin("true", "false")
    quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'^\{"v":(.*)\}$', 1)
    return F.when(value.isNull(), "null").when(raw, value).otherwise(quoted)
