"""Unit-cost formulas (MTH-1..4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import half_up, plain_number, text


def _num(c: Column) -> Column:
    return c.cast("double")


def resolve_pct(offer_pct: Column, default_pct: Column, elemental_pct: Column) -> Column:
    """MTH-2: the share of active compound, or null for no scaling."""
    return F.coalesce(_num(offer_pct), _num(default_pct), _num(elemental_pct))


def derive_costs(df: DataFrame, pct: Column | None = None) -> DataFrame:
    """MTH-1: totals and unit costs of an offer, rounded at each step.

    A stated container total wins over strength times servings.  ``df`` holds the
    dose columns, ``current_price`` and, unless ``pct`` is given, the ingredient's
    ``standardization_default_pct`` and ``elemental_percentage``.
    """
    if pct is None:
        pct = resolve_pct(
            F.col("standardization_percentage"), F.col("standardization_default_pct"), F.col("elemental_percentage")
        )
    stated = _num(F.col("total_active_per_container"))
    strength = _num(F.col("strength_per_serving"))
    servings = F.when(F.col("servings_per_container") > 0, F.col("servings_per_container").cast("bigint"))
    price = _num(F.col("current_price"))
    share = F.coalesce(pct / 100, F.lit(1.0))
    by_total = stated > 0

    out = df.withColumns(
        {
            "total_strength": half_up(F.when(by_total, stated).otherwise(strength * servings), 4),
            "_per_container": half_up(F.when(by_total, stated * share), 4),
            "_per_serving": half_up(F.when(by_total.isNull() | ~by_total, strength * share), 4),
        }
    )
    per_container, per_serving = F.col("_per_container"), F.col("_per_serving")
    out = out.withColumns(
        {
            "active_compound_per_serving": F.coalesce(half_up(per_container / servings, 4), per_serving),
            "active_compound_total": F.coalesce(per_container, half_up(per_serving * servings, 4)),
            "cost_per_serving": half_up(price / servings, 4),
        }
    )
    total = F.col("active_compound_total")
    return out.withColumn("cost_per_active_unit", half_up(F.when(total > 0, price / total), 6)).drop(
        "_per_container", "_per_serving"
    )


def canonical_derived(canonicals: DataFrame, ingredients: DataFrame) -> DataFrame:
    """MTH-3: total strength, active compound per serving and the display name of catalog products."""
    ing = ingredients.select(
        F.col("id").alias("ingredient_id"),
        F.col("name").alias("_name"),
        F.col("default_unit").alias("_unit"),
        F.col("standardization_default_pct").alias("_default"),
        F.col("elemental_percentage").alias("_elemental"),
    )
    strength = _num(F.col("strength_per_serving"))
    share = F.coalesce(
        _num(F.col("standardization_percentage")) / 100, _num(F.col("_default")) / 100, _num(F.col("_elemental")) / 100
    )
    form = text(F.col("ingredient_form"))
    plural = form.isin("capsule", "tablet", "softgel", "gummy")
    label = F.concat(F.upper(F.substring(form, 1, 1)), F.expr("substring(ingredient_form, 2)"), F.when(plural, "s").otherwise(""))
    dose = F.concat(plain_number(strength), text(F.col("_unit")))
    return (
        canonicals.join(ing, "ingredient_id", "left")
        .withColumns(
            {
                "total_strength": F.when(
                    (strength > 0) & (F.col("servings_per_container") > 0),
                    half_up(strength * F.col("servings_per_container"), 4),
                ),
                "active_compound_per_serving": F.coalesce(half_up(strength * share, 4), F.when(strength > 0, strength)),
                "derived_name": F.trim(
                    F.concat_ws(" ", F.col("_name"), dose, F.when(form != "", label))
                ),
            }
        )
        .drop("_name", "_unit", "_default", "_elemental")
    )


def reconcile_totals(edits: DataFrame) -> DataFrame:
    """MTH-4: make total, servings and strength of a curator's edit agree.

    A total with servings sets the strength, a total alone clears it, and a total
    that is not positive is cleared.
    """
    total = _num(F.col("total_active_per_container"))
    servings = F.col("servings_per_container").cast("bigint")
    strength = _num(F.col("strength_per_serving"))
    given = total > 0
    return edits.withColumns(
        {
            "total_active_per_container": F.when(given, total),
            "strength_per_serving": F.when(given, F.when(servings > 0, total / servings)).otherwise(strength),
        }
    )


def seed_total(total: Column, total_strength: Column, strength: Column, servings: Column) -> Column:
    """MTH-4: the total to show first: the stated one, the derived one, else strength times servings."""
    return F.coalesce(
        F.when(total > 0, _num(total)),
        F.when(total_strength > 0, _num(total_strength)),
        F.when((strength > 0) & (servings > 0), _num(strength) * servings),
    )
