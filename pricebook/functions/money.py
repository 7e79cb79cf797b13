"""Prices as shops write them (PRI-1..3) and as readers see them (FMT-1)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import ascii_lower, half_up, numeric, text


def compare_at_pricing(price: Column, compare_at: Column) -> Column:
    """PRI-1: struct<regular, sale, on_sale>; a higher compare-at price means a sale."""
    p, c = text(price), text(compare_at)
    sale = numeric(c) > numeric(p)
    return F.when(
        sale, F.struct(c.alias("regular"), p.alias("sale"), F.lit("true").alias("on_sale"))
    ).otherwise(F.struct(p.alias("regular"), F.lit("").alias("sale"), F.lit("false").alias("on_sale")))


def minor_unit_money(raw: Column, digits: Column) -> Column:
    """PRI-2: a price in minor units as decimal text.

    Whole numbers are divided by a power of ten and cut off; text with a decimal
    point is rounded; anything that is no number passes through.
    """
    s = text(raw)
    n = F.greatest(F.coalesce(digits.try_cast("int"), F.lit(2)), F.lit(0))
    whole = s.try_cast("decimal(30,0)")
    sign = F.when(whole < 0, "-").otherwise("")
    padded = F.lpad(F.abs(whole).cast("string"), F.greatest(F.length(F.abs(whole).cast("string")), n + 1), F.lit("0"))
    head = F.substring(padded, F.lit(1), F.length(padded) - n)
    tail = F.substring(padded, F.length(padded) - n + 1, n)
    shifted = F.concat(sign, head, F.when(n > 0, F.concat(F.lit("."), tail)).otherwise(""))
    # Up to six decimals cover every currency in use.
    rounded = F.coalesce(
        *[F.when(n == k, F.round(numeric(s), k).cast(f"decimal(30,{k})").cast("string")) for k in range(7)]
    )
    return (
        F.when(s == "", "")
        .when(numeric(s).isNull(), s)
        .when(s.contains("."), rounded)
        .otherwise(F.coalesce(shifted, s))
    )


def sale_if_on_sale(on_sale: Column, sale: Column, regular: Column) -> Column:
    """PRI-3: the sale price only while on sale and different from the regular one."""
    return F.when(F.coalesce(on_sale, F.lit(False)) & (text(sale) != "") & (text(sale) != text(regular)), sale).otherwise("")


# Currency symbols and unit labels shown to readers.
SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥"}
UNIT_LABELS = {"billion_cfu": "B CFU"}
NO_VALUE = "—"


def format_price(value: Column, currency: Column) -> Column:
    """FMT-1: symbol or code, then two decimals; a dash for no price."""
    code = F.upper(text(currency))
    lead = F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in SYMBOLS.items()], F.when(code != "", F.concat(code, F.lit(" "))), F.lit(""))
    return F.when(value.isNull(), NO_VALUE).otherwise(
        F.concat(lead, half_up(value, 2).cast("decimal(30,2)").cast("string"))
    )


def display_unit(unit: Column) -> Column:
    """FMT-1: the unit as readers see it."""
    return F.coalesce(*[F.when(unit == k, F.lit(v)) for k, v in UNIT_LABELS.items()], text(unit))


def format_move(direction: Column, pct: Column) -> Column:
    """FMT-1: an arrow and a percentage; null when the move rounds to nothing."""
    shown = half_up(pct, 1)
    number = F.regexp_replace(shown.cast("decimal(20,1)").cast("string"), r"\.0$", "")
    arrow = F.when(ascii_lower(direction) == "down", "▼").when(ascii_lower(direction) == "up", "▲")
    return F.when(shown > 0, F.concat(arrow, F.lit(" "), number, F.lit("%")))
