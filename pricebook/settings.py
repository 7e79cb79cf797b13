"""Settings (EXT-4) and the allowed values of every enumerated column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Allowed members of the enumerated columns.
MERCHANT_STATUSES = ["active", "paused", "dead"]
CATALOG_STATUSES = ["active", "draft", "retired"]
INGREDIENT_CATEGORIES = ["nootropic", "longevity", "sports", "mineral", "vitamin", "amino_acid", "other"]
PLATFORMS = ["shopify", "woocommerce", "generic", "wix", "manual"]
FORMS = ["capsule", "tablet", "softgel", "powder", "liquid", "sublingual", "gummy", "other"]
UNITS = ["mg", "mcg", "g", "IU", "billion_cfu"]
STOCK = ["in_stock", "out_of_stock", "backorder", "unavailable", "unknown"]
VISIBILITY = ["pending", "active", "paused", "rejected", "stale", "dead", "needs_review"]
VARIATION_STATUS = ["not_applicable", "retrieved", "failed", "fallback_parent_only"]
FEED_SOURCES = ["shopify", "woocommerce", "generic", "wix", "json"]
RUN_STATUSES = ["validating", "importing", "complete", "failed", "rolled_back"]
ATTEMPT_STATUSES = ["pending", "running", "complete", "failed", "canceled"]
COMPARE_VIEWS = ["cost_per_serving", "cost_per_active_unit"]

# States that the queue, and the stale detector, work on.
QUEUE = ["pending", "needs_review"]
TRACKED = ["pending", "active", "needs_review"]

# The dose fields whose ownership is tracked once a curator sets them.
OWNABLE = [
    "ingredient_id",
    "ingredient_form",
    "strength_per_serving",
    "strength_unit",
    "servings_per_container",
    "total_active_per_container",
    "standardization_percentage",
]


#: Days that a price move may be looked back for; 0 turns it off.
MOST_MOVE_DAYS = 3650


def _clamp(value: int, low: int, high: int) -> int:
    return min(high, max(low, value))


@dataclass(frozen=True)
class Settings:
    """Site-wide options with the defaults and the ranges of the admin form."""

    currency: str = "USD"
    warn_hours: int = 48
    hide_hours: int = 168
    price_move_days: int = 30
    min_offers_to_publish: int = 1
    stale_minutes: int = 30
    default_view: str = "cost_per_active_unit"

    def __post_init__(self) -> None:
        put = object.__setattr__
        put(self, "warn_hours", max(1, self.warn_hours))
        put(self, "hide_hours", max(1, self.hide_hours))
        put(self, "price_move_days", _clamp(self.price_move_days, 0, MOST_MOVE_DAYS))
        put(self, "min_offers_to_publish", _clamp(self.min_offers_to_publish, 1, 100))
        put(self, "stale_minutes", _clamp(self.stale_minutes, 5, 1440))
        if self.default_view not in COMPARE_VIEWS:
            put(self, "default_view", "cost_per_active_unit")


DEFAULTS = Settings()


def _whole(value: Column) -> Column:
    """The size of the whole number that a text starts with; 0 where there is none."""
    digits = F.regexp_extract(value, r"^\s*[+-]?0*(\d{1,18})", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0))


def site_settings(options: DataFrame) -> DataFrame:
    """EXT-4: one row of typed settings per ``site_id`` from stored options (site_id, name, value as text).

    Numbers are read from the start of the text and moved into their ranges, a currency is its first three letters in upper
    case, an unknown view is the default one.  An option that is not stored (or null) has its default; of several rows of
    one option the greatest text counts.  A site without any known option has all defaults.
    """
    d = DEFAULTS

    def stored(name: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col("value"))).alias(name)

    numbers = {"warn_hours": (1, None), "hide_hours": (1, None), "price_move_days": (0, MOST_MOVE_DAYS), "min_offers_to_publish": (1, 100), "stale_minutes": (5, 1440)}
    rows = options.groupBy("site_id").agg(stored("currency"), stored("default_view"), *(stored(n) for n in numbers))
    letters = F.substring(F.upper(F.regexp_replace("currency", "[^A-Za-z]", "")), 1, 3)
    view = F.regexp_replace(F.lower("default_view"), "[^a-z0-9_-]", "")
    typed = {
        "currency": F.when(letters != "", letters).otherwise(d.currency),
        "default_view": F.when(view.isin(COMPARE_VIEWS), view).otherwise(d.default_view),
    }
    for name, (low, high) in numbers.items():
        value = F.greatest(_whole(F.col(name)), F.lit(low).cast("bigint"))
        value = value if high is None else F.least(value, F.lit(high).cast("bigint"))
        typed[name] = F.coalesce(F.when(F.col(name).isNotNull(), value), F.lit(getattr(d, name)).cast("bigint"))
    return rows.select("site_id", *(c.alias(n) for n, c in typed.items()))
