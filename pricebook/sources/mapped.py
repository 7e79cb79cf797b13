"""JSON feeds read through a field map (SRC-9, EXT-1, URL-7, JOB-24)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stock import TRANSFORMS
from ..functions.text import json_value, numeric, text
from ..functions.urls import fill_url_template, rewrite_url
from ..schemas import FEED_COLUMNS
from ..settings import STOCK
from .shops import feed_rows

VARIANT = "@variant"


def _steps(path: str) -> list[str]:
    return [s for s in re.split(r"[.\[\]]+", path) if s]


def json_path(doc: Column, path: str) -> Column:
    """The value at ``a.b[0].c`` or ``a.b.0.c``; a number may be a list index or a key."""
    out = doc
    for step in _steps(path):
        by_key = F.get_json_object(out, f"$['{step}']")
        out = F.coalesce(F.get_json_object(out, f"$[{step}]"), by_key) if step.isdigit() else by_key
    return out


class FieldMap:
    """A mapping compiled to Columns over ``product`` and ``variant`` JSON text."""

    def __init__(self, mapping: dict, product: Column, variant: Column):
        self.mapping, self.product, self.variant = mapping, product, variant

    def at(self, path: str) -> Column:
        if path == VARIANT:
            return self.variant
        if path.startswith(VARIANT + "."):
            return json_path(self.variant, path[len(VARIANT) + 1 :])
        return json_path(self.product, path)

    def first(self, paths) -> Column:
        tried = [paths] if isinstance(paths, str) else list(paths)
        return F.coalesce(*[F.nullif(self.at(p), F.lit("")) for p in tried])

    def value(self, spec) -> Column:
        """A path, a list of paths, {from, transform} or {template}."""
        if isinstance(spec, str):
            return self.at(spec)
        if isinstance(spec, dict) and "template" in spec:
            return fill_url_template(spec["template"], self.at)
        if isinstance(spec, dict) and "from" in spec:
            found = self.first(spec["from"])
            transform = TRANSFORMS.get(spec.get("transform", ""))
            return transform(found) if transform else found
        if isinstance(spec, list):
            return self.first(spec)
        return F.lit(None).cast("string")


def mapping_errors(mapping: dict | None) -> list[str]:
    """JOB-24: what makes a mapping unusable."""
    if not mapping:
        return ["mapping is empty"]
    problems = []
    if not mapping.get("list_url"):
        problems.append("list_url is missing")
    if not mapping.get("fields"):
        problems.append("fields is missing")
    unknown = [f for f in mapping.get("fields", {}) if f not in FEED_COLUMNS]
    named = [s["transform"] for s in mapping.get("fields", {}).values() if isinstance(s, dict) and s.get("transform")]
    problems += [f"unknown field: {f}" for f in unknown]
    problems += [f"unknown transform: {t}" for t in named if t not in TRANSFORMS]
    return problems


def json_feed_to_offers(payloads: DataFrame, mapping: dict, site: str, run: dict[str, str], currency: str = "", col: str = "json") -> DataFrame:
    """SRC-9: offer rows of product JSON texts, one per element at ``variants_path``, else one per product."""
    doc = F.col(col)
    listed = F.lit(None).cast("array<string>")
    if mapping.get("variants_path"):
        at = json_path(doc, mapping["variants_path"])
        values = F.when(F.trim(at).startswith("{"), F.map_values(F.from_json(at, "map<string,string>")))
        listed = F.coalesce(values, F.from_json(at, "array<string>"))
    rows = payloads.where(F.get_json_object(doc, "$").isNotNull()).select(
        doc.alias("_product"), F.explode_outer(F.when(F.size(listed) > 0, listed)).alias("_element")
    )
    rows = rows.withColumn("_variant", F.when(F.trim(F.col("_element")).rlike(r"^[\[{]"), F.col("_element")))
    fm = FieldMap(mapping, F.col("_product"), F.col("_variant"))
    cells = {
        "source": F.lit("json"),
        "currency": F.lit(currency),
        "currency_minor_unit": F.lit("2"),
        "on_sale": F.lit("false"),
        "price_source": F.lit("json_field_map"),
        "variation_retrieval_status": F.when(F.col("_variant").isNotNull(), "retrieved").otherwise("not_applicable"),
    }
    for field, spec in mapping.get("fields", {}).items():
        if field not in FEED_COLUMNS:
            continue
        value = fm.value(spec)
        if field == "stock_status":
            value = F.when(value.isin(STOCK), value).when(value.isNotNull(), "unknown")
        cells[field] = F.coalesce(value, cells[field]) if field in cells else value
    regular, current = text(cells.get("regular_price", F.lit(""))), text(cells.get("current_price", F.lit("")))
    sale = text(cells.get("sale_price", F.lit("")))
    cells["regular_price"] = F.when(regular != "", regular).otherwise(current)
    cells["current_price"] = F.when(current != "", current).otherwise(regular)
    lower = F.coalesce(numeric(sale) < numeric(cells["regular_price"]), F.lit(False))
    cells["on_sale"] = F.when((cells["on_sale"] == "false") & lower, "true").otherwise(cells["on_sale"])
    stock = text(cells.get("stock_status", F.lit("")))
    cells["stock_status"] = F.when(stock != "", stock).otherwise("unknown")
    if mapping.get("currency_default"):
        cells["currency"] = F.when(text(cells["currency"]) != "", cells["currency"]).otherwise(mapping["currency_default"])
    keys = mapping.get("raw_attributes", [])
    if keys:
        labels = [k.replace(VARIANT + ".", "") or k for k in keys]
        # Values that are objects, lists, numbers or booleans go in as they are, text is quoted.
        parts = [
            F.when(fm.at(k).isNotNull(), F.concat(F.lit('"' + label.replace('"', '\\"') + '":'), json_value(fm.at(k))))
            for k, label in zip(keys, labels)
        ]
        body = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ",")
        cells["raw_attributes_json"] = F.when(body != "", F.concat(F.lit("{"), body, F.lit("}"))).otherwise("")
    return feed_rows(rows, cells, site, run)


def preview_mapping(payloads: DataFrame, mapping: dict, site: str, run: dict[str, str], rewrite: dict | None = None, n: int = 3) -> tuple[DataFrame, list[str]]:
    """JOB-24: the first rows a mapping gives, with rewritten URLs, and the mapping's problems."""
    rows = json_feed_to_offers(payloads, mapping, site, run)
    if rewrite:
        rows = rewrite_feed_urls(rows, rewrite)
    return rows.limit(n), mapping_errors(mapping)


def rewrite_feed_urls(rows: DataFrame, rule: dict) -> DataFrame:
    """EXT-2: apply a site's host rewrite to its feed rows."""
    return rows.withColumns({c: rewrite_url(F.col(c), rule) for c in ("source_product_url", "source_variant_url")})
