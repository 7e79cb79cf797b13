"""Stock vocabularies (STK-1) and the named transforms of mapped feeds (STK-2, EXT-1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .text import ascii_lower, numeric, strip_html, text


def stock_from_shopify(available: Column, quantity: Column, policy: Column) -> Column:
    """STK-1: sold past zero under the "continue" policy is a back order."""
    past_zero = (numeric(quantity) <= 0) & (policy == "continue")
    return (
        F.when(available & F.coalesce(past_zero, F.lit(False)), "backorder")
        .when(available, "in_stock")
        .when(~available, "out_of_stock")
        .otherwise("unknown")
    )


def stock_from_woo(in_stock: Column, on_backorder: Column) -> Column:
    """STK-1 for Woo-style nodes."""
    return (
        F.when(in_stock & F.coalesce(on_backorder, F.lit(False)), "backorder")
        .when(in_stock, "in_stock")
        .when(~in_stock, "out_of_stock")
        .otherwise("unknown")
    )


def stock_from_jsonld(availability: Column) -> Column:
    """STK-1 for schema.org availability values."""
    a = ascii_lower(text(availability))
    return (
        F.when(a.contains("instock"), "in_stock")
        .when(a.contains("outofstock"), "out_of_stock")
        .when(a.contains("backorder"), "backorder")
        .otherwise("unknown")
    )


# Texts that mean "yes" in a mapped feed, and one shop system's stock words.
YES_WORDS = ["1", "true", "yes", "y", "in_stock", "instock", "available"]
SHOP_STOCK_WORDS = {"instock": "in_stock", "outofstock": "out_of_stock", "onbackorder": "backorder"}


def _truthy_to_status(c: Column) -> Column:
    n = numeric(c)
    yes = F.when(n.isNotNull(), n != 0).otherwise(ascii_lower(F.trim(c)).isin(YES_WORDS))
    return F.when(c.isNull(), "unknown").when(yes, "in_stock").otherwise("out_of_stock")


def _positive_to_status(c: Column) -> Column:
    n = numeric(c)
    return F.when(n.isNull(), "unknown").when(n > 0, "in_stock").otherwise("out_of_stock")


def _shop_words_to_status(c: Column) -> Column:
    w = ascii_lower(F.trim(text(c)))
    return F.coalesce(*[F.when(w == k, F.lit(v)) for k, v in SHOP_STOCK_WORDS.items()], F.lit("unknown"))


# STK-2: transforms a field map may name.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "as_string": lambda c: F.when(~F.coalesce(c, F.lit("")).rlike(r"^\s*[\[{]"), c),
    "strip_html": strip_html,
    "bool_to_status": _truthy_to_status,
    "truthy_to_status": _truthy_to_status,
    "gt_zero_to_status": _positive_to_status,
    "woo_stock_to_status": _shop_words_to_status,
}


def register_transform(name: str, fn: Callable[[Column], Column]) -> None:
    """EXT-1: make a Column function available to field maps under a name."""
    TRANSFORMS[name] = fn
