"""Changes to stored tables, each as a new version of the table (JOB-14, 16..22, AGG-12, AGG-20, STR-2, STR-3, JOIN-2, JOIN-3)."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.costs import derive_costs
from ..functions.text import blank, text
from ..schemas import KEY
from ..settings import OWNABLE, TRACKED, VISIBILITY
from .validate import changed_fields, owned_fields

NUMERIC_OWNABLE = {
    "ingredient_id",
    "strength_per_serving",
    "servings_per_container",
    "total_active_per_container",
    "standardization_percentage",
}


def drop_suppressed(feed: DataFrame, suppressions: DataFrame) -> DataFrame:
    """JOIN-3: rows whose key a curator has not banned."""
    return feed.join(suppressions.select(*KEY), KEY, "left_anti")


def suppressed_rows(feed: DataFrame, suppressions: DataFrame) -> DataFrame:
    """JOIN-3: the rows the ban removes."""
    return feed.join(suppressions.select(*KEY), KEY, "left_semi")


def split_insert_update(feed: DataFrame, offers: DataFrame) -> DataFrame:
    """JOIN-2: add offer_id and action (insert or update)."""
    known = offers.select(*KEY, F.col("id").alias("offer_id"))
    return feed.join(known, KEY, "left").withColumn("action", F.when(F.col("offer_id").isNull(), "insert").otherwise("update"))


def dry_run(feed: DataFrame, offers: DataFrame, suppressions: DataFrame | None = None) -> DataFrame:
    """JOB-21: inserts and updates a feed would cause.

    Suppressed rows are left out; pass no suppressions to count them as well.
    """
    rows = feed if suppressions is None else drop_suppressed(feed, suppressions)
    return split_insert_update(rows, offers).agg(
        F.count_if(F.col("action") == "insert").alias("inserted"), F.count_if(F.col("action") == "update").alias("updated")
    )


def restore_status(status: Column, prior: Column) -> Column:
    """STR-3: a stale offer that is seen again returns to the state it had, else to pending."""
    back = F.when(prior.isin(TRACKED), prior).otherwise("pending")
    return F.when(status == "stale", back).otherwise(status)


def mark_stale(offers: DataFrame, run_id: int, merchants: DataFrame, now: datetime | None = None) -> DataFrame:
    """STR-2: offers of participating merchants that the run did not see become stale and remember their state."""
    took_part = merchants.select(F.col("merchant_id")).distinct().withColumn("_part", F.lit(True))
    unseen = F.col("last_seen_import_run_id").isNull() | (F.col("last_seen_import_run_id") != run_id)
    goes = F.coalesce(F.col("_part") & unseen & F.col("visibility_status").isin(TRACKED), F.lit(False))
    out = offers.join(took_part, "merchant_id", "left").withColumn("_goes", goes)
    changes = {
        "pre_stale_status": F.when(F.col("_goes"), F.col("visibility_status")).otherwise(F.col("pre_stale_status")),
        "visibility_status": F.when(F.col("_goes"), "stale").otherwise(F.col("visibility_status")),
    }
    if now is not None and "updated_at" in offers.columns:
        changes["updated_at"] = F.when(F.col("_goes"), F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))
    return out.withColumns(changes).select(*offers.columns)


def run_counters(results: DataFrame) -> DataFrame:
    """AGG-12: rows per outcome of each run; ``results`` has run_id and outcome."""
    outcomes = ["inserted", "updated", "suppressed", "stale", "errored"]
    return results.groupBy("run_id").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in outcomes])


def set_visibility(offers: DataFrame, actions: DataFrame, now: datetime) -> DataFrame:
    """JOB-17: apply (id, visibility) actions; unknown states are ignored, the last action of an id wins."""
    valid = actions.where(F.col("visibility").isin(VISIBILITY))
    order = F.col("seq") if "seq" in actions.columns else F.lit(0)
    last = valid.groupBy("id").agg(F.max_by("visibility", F.struct(order, "visibility")).alias("_to"))
    return (
        offers.join(last, "id", "left")
        .withColumns(
            {
                "visibility_status": F.coalesce("_to", "visibility_status"),
                "updated_at": F.when(F.col("_to").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("updated_at")),
            }
        )
        .select(*offers.columns)
    )


def backfill_owned_fields(offers: DataFrame) -> DataFrame:
    """JOB-14: a stored total belongs to the curator where nothing was recorded yet."""
    none_yet = F.coalesce(F.size("operator_fields"), F.lit(0)) <= 0
    claim = F.col("total_active_per_container").isNotNull() & none_yet
    return offers.withColumn(
        "operator_fields", F.when(claim, F.array(F.lit("total_active_per_container"))).otherwise(F.col("operator_fields"))
    )


def curator_edit(offers: DataFrame, edits: DataFrame, ingredients: DataFrame, now: datetime) -> DataFrame:
    """JOB-16: apply cleaned edits (one row per offer id) and record who owns which field.

    A column that ``edits`` does not have is left alone; one it has is written, also
    as null.  A total that the curator changed loses its automatic label.  The
    columns ``changed`` and ``learns`` say what was changed and whether the edit is
    a decision about the catalog product.
    """
    fields = [c for c in edits.columns if c != "id" and c in offers.columns]
    tracked = [f for f in OWNABLE if f in fields]
    e = edits.select("id", F.lit(True).alias("_edited"), *[F.col(c).alias("e_" + c) for c in fields])
    joined = offers.join(e, "id", "left").withColumn("_edited", F.coalesce("_edited", F.lit(False)))
    before = joined.withColumns({"b_" + c: F.col(c) for c in fields})
    diff = changed_fields("b_", "e_", tracked, NUMERIC_OWNABLE) if tracked else F.array().cast("array<string>")
    out = before.withColumn("changed", F.when(F.col("_edited"), diff).otherwise(F.array().cast("array<string>")))
    moved = ~F.col("b_canonical_product_id").eqNullSafe(F.col("e_canonical_product_id")) if "canonical_product_id" in fields else F.lit(False)
    approved = (F.col("e_visibility_status") == "active") if "visibility_status" in fields else F.lit(False)
    sets = {c: F.when(F.col("_edited"), F.col("e_" + c).cast(offers.schema[c].dataType)).otherwise(F.col(c)) for c in fields}
    sets["operator_fields"] = F.when(F.size("changed") > 0, owned_fields(F.col("operator_fields"), F.col("changed"))).otherwise(F.col("operator_fields"))
    sets["total_active_source"] = F.when(~F.array_contains("changed", "total_active_per_container"), F.col("total_active_source"))
    sets["updated_at"] = F.when(F.col("_edited"), F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))
    sets["learns"] = F.col("_edited") & F.coalesce(moved | approved, F.lit(False))
    out = out.withColumns(sets)
    rates = ingredients.select(F.col("id").alias("ingredient_id"), "standardization_default_pct", "elemental_percentage")
    derived = ["total_strength", "active_compound_per_serving", "active_compound_total", "cost_per_serving", "cost_per_active_unit"]
    kept = out.withColumns({"k_" + c: F.col(c) for c in derived if c in offers.columns})
    again = derive_costs(kept.join(rates, "ingredient_id", "left"))
    again = again.withColumns(
        {c: F.when(F.col("_edited"), F.col(c).cast(offers.schema[c].dataType)).otherwise(F.col("k_" + c)) for c in derived if c in offers.columns}
    )
    return again.select(*offers.columns, "changed", "learns")


def suppress(suppressions: DataFrame, keys: DataFrame, reason: str, now: datetime) -> DataFrame:
    """JOB-19: add keys to the ban list; doing it twice changes nothing but the time."""
    optional = {"product_title": "string", "brand": "string", "source_offer_id": "bigint"}
    fresh = keys.select(
        *KEY,
        *[(F.col(c) if c in keys.columns else F.lit(None)).cast(t).alias(c) for c, t in optional.items()],
        F.lit(reason).alias("reason"),
        F.lit(now).cast("timestamp").alias("suppressed_at"),
    ).withColumn("source_variant_id", text(F.col("source_variant_id")))
    every = suppressions.unionByName(fresh, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in KEY]
    last = every.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("suppressed_at", F.coalesce("source_offer_id", F.lit(0)))).alias("_l"))
    return last.select(*KEY, "_l.*")


def lift(suppressions: DataFrame, keys: DataFrame) -> DataFrame:
    """JOB-19: take keys off the ban list."""
    return suppressions.join(keys.select(*KEY), KEY, "left_anti")


def delete_impact(kind: str, ids: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """AGG-20: per entity, how many dependent rows a deletion touches.

    Every table is first counted by its own key, so one entity with a third of the
    rows costs no more than any other.
    """
    keys = ids.select("id").distinct()

    def tally(table: str, column: str, name: str) -> DataFrame:
        return tables[table].where(F.col(column).isNotNull()).groupBy(F.col(column).alias("id")).agg(F.count(F.lit(1)).alias(name))

    if kind == "offer":
        raw = tables["raw"].groupBy(*KEY).agg(F.count(F.lit(1)).alias("raw_rows"))
        own = tables["offers"].select("id", *KEY).join(raw, KEY, "left").select("id", "raw_rows")
        parts = [tally("history", "offer_id", "history_rows"), own, tally("clicks", "offer_id", "clicks")]
    elif kind == "merchant":
        owner = tables["offers"].select(F.col("id").alias("offer_id"), "merchant_id")
        per_offer = tables["history"].groupBy("offer_id").agg(F.count(F.lit(1)).alias("_n"))
        history = per_offer.join(owner, "offer_id").groupBy(F.col("merchant_id").alias("id")).agg(F.sum("_n").alias("history_rows"))
        parts = [tally("offers", "merchant_id", "offers"), history, tally("raw", "merchant_id", "raw_rows"), tally("clicks", "merchant_id", "clicks")]
    elif kind == "ingredient":
        parts = [tally("canonicals", "ingredient_id", "canonicals"), tally("offers", "ingredient_id", "offers")]
    else:
        parts = [tally("offers", "canonical_product_id", "offers"), tally("clicks", "canonical_product_id", "clicks")]
    out = reduce(lambda a, b: a.join(b, "id", "left"), parts, keys)
    return out.na.fill(0)


def _null_ids(table: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """Null a reference to rows that no longer exist."""
    mark = gone.select(F.col("id").alias(column), F.lit(True).alias("_gone")).distinct()
    hit = table.join(mark, column, "left")
    kind = table.schema[column].dataType
    return hit.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column)).cast(kind)).select(*table.columns)


def delete_cascade(kind: str, ids: DataFrame, tables: dict[str, DataFrame], now: datetime, older_than_days: int = 0) -> dict[str, DataFrame]:
    """JOB-18: new versions of the tables after deleting what may be deleted.

    Offers must be rejected or dead, merchants dead, catalog rows retired and an
    ingredient unreferenced.  A rejected offer is first put on the ban list.
    History and raw rows go, clicks stay without their key, and mappings to a
    deleted product go.
    """
    t = dict(tables)
    wanted = ids.select("id").distinct()
    if kind in ("offer", "merchant"):
        if kind == "offer":
            gone = t["offers"].join(wanted, "id", "left_semi").where(F.col("visibility_status").isin("rejected", "dead"))
            if older_than_days > 0:
                gone = gone.where(F.col("updated_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(older_than_days)))
            banned = gone.where(F.col("visibility_status") == "rejected").withColumn("source_offer_id", F.col("id"))
            t["suppressions"] = suppress(t["suppressions"], banned, "rejected_cleanup", now)
            t["raw"] = t["raw"].join(gone.select(*KEY), KEY, "left_anti")
        else:
            dead = t["merchants"].join(wanted, "id", "left_semi").where(F.col("status") == "dead")
            shops = dead.select(F.col("id").alias("merchant_id"))
            gone = t["offers"].join(shops, "merchant_id", "left_semi")
            t["merchants"] = t["merchants"].join(dead.select("id"), "id", "left_anti")
            t["raw"] = t["raw"].join(shops, "merchant_id", "left_anti")
            t["clicks"] = _null_ids(t["clicks"], dead, "merchant_id")
        offer_ids = gone.select("id")
        t["history"] = t["history"].join(offer_ids.select(F.col("id").alias("offer_id")), "offer_id", "left_anti")
        t["clicks"] = _null_ids(t["clicks"], offer_ids, "offer_id")
        t["offers"] = t["offers"].join(offer_ids, "id", "left_anti")
    elif kind == "canonical":
        gone = t["canonicals"].join(wanted, "id", "left_semi").where(F.col("status") == "retired").select("id")
        t["canonicals"] = t["canonicals"].join(gone, "id", "left_anti")
        t["offers"] = _null_ids(t["offers"], gone, "canonical_product_id")
        t["clicks"] = _null_ids(t["clicks"], gone, "canonical_product_id")
        t["memory"] = t["memory"].join(gone.select(F.col("id").alias("canonical_product_id")), "canonical_product_id", "left_anti")
    else:
        used = t["canonicals"].select(F.col("ingredient_id").alias("id")).where("id is not null")
        gone = t["ingredients"].join(wanted, "id", "left_semi").where(F.col("status") == "retired").join(used, "id", "left_anti").select("id")
        t["ingredients"] = t["ingredients"].join(gone, "id", "left_anti")
        t["offers"] = _null_ids(t["offers"], gone, "ingredient_id")
    return t


def upsert_catalog(current: DataFrame, incoming: DataFrame, blanks_overwrite: bool = False) -> DataFrame:
    """JOB-20: upsert by slug; a blank cell keeps the stored value unless ``blanks_overwrite``.

    New rows get ids above the highest stored one, in slug order within a task.
    """
    fields = [c for c in current.columns if c not in ("id", "slug")]
    given = [c for c in fields if c in incoming.columns]
    new = incoming.where(~blank(F.col("slug"))).select("slug", F.lit(True).alias("_in"), *[F.col(c).alias("n_" + c) for c in given])
    rest = ["_in", *["n_" + c for c in given]]
    # The last row of a slug wins; which one is last is decided by the values themselves.
    new = new.groupBy("slug").agg(F.max(F.struct(*rest)).alias("_r")).select("slug", "_r.*")
    joined = current.join(new, "slug", "full_outer")

    def pick(c: str) -> Column:
        kind = current.schema[c].dataType
        fresh = F.col("n_" + c).cast(kind)
        if kind.simpleString() == "string":
            fresh = F.nullif(fresh, F.lit(""))
        return F.when(F.col("_in"), fresh).otherwise(F.col(c)) if blanks_overwrite else F.coalesce(fresh, F.col(c))

    top = current.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    new_id = F.lit(top + 1) + F.monotonically_increasing_id()
    return joined.select(
        F.coalesce("id", new_id).alias("id"), "slug", *[(pick(c) if c in given else F.col(c)).alias(c) for c in fields]
    ).select(*current.columns)


def potential_duplicates(offers: DataFrame) -> DataFrame:
    """JOB-22: products that a merchant lists both with and without variants, with a confidence of 1 or 2 signals."""
    variant = text(F.col("source_variant_id")) != ""
    mixed = (
        offers.where(text(F.col("source_product_id")) != "")
        .groupBy("merchant_id", "source_product_id")
        .agg(F.count_if(~variant).alias("blank_offers"), F.count_if(variant).alias("variant_offers"))
        .where((F.col("blank_offers") > 0) & (F.col("variant_offers") > 0))
    )
    url = F.regexp_replace(F.lower(F.regexp_replace(text(F.col("source_product_url")), r"[?#].*$", "")), r"/+$", "")
    same_url = (
        offers.where(url != "")
        .groupBy("merchant_id", "source_product_id", url.alias("_url"))
        .agg(F.count_if(~variant).alias("_b"), F.count_if(variant).alias("_v"))
        .where((F.col("_b") > 0) & (F.col("_v") > 0))
        .groupBy("merchant_id", "source_product_id")
        .agg(F.lit(True).alias("same_url"))
    )
    return mixed.join(same_url, ["merchant_id", "source_product_id"], "left").select(
        "merchant_id", "source_product_id", "blank_offers", "variant_offers",
        F.coalesce("same_url", F.lit(False)).alias("same_url"),
        (F.lit(1) + F.coalesce("same_url", F.lit(False)).cast("int")).alias("confidence"),
    )
