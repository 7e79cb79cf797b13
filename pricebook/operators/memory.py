"""Learned mappings from title keys to catalog products (AGG-14, WIN-4, JOB-4, 5, 13, 15, JOIN-24)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.costs import derive_costs
from ..functions.text import blank, decode_entities, title_key
from ..settings import QUEUE
from .match import live_peers, match_cascade, match_offers, normalize_offers

SLOT = ["merchant_id", "title_key"]


def memory_state(decisions: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """WIN-4: the mapping after all decisions.

    The latest decision of a slot wins; times_confirmed counts the unbroken run of
    equal decisions at the end.  ``decisions`` has the slot, canonical_product_id,
    sample_title, source, decided_at and id.  Only aggregates are used, so a slot
    may hold any number of decisions.
    """
    order = F.struct("decided_at", "id")
    per_choice = decisions.groupBy(*SLOT, "canonical_product_id").agg(F.max(order).alias("_last"))
    winner = per_choice.groupBy(*SLOT).agg(F.max_by("canonical_product_id", "_last").alias("_winner"))
    # The last decision for anything else marks where the final run starts.
    cut = (
        per_choice.join(winner, SLOT)
        .groupBy(*SLOT)
        .agg(
            F.first("_winner").alias("_winner"),
            F.max(F.when(F.col("canonical_product_id") != F.col("_winner"), F.col("_last"))).alias("_cut"),
        )
    )
    run = F.col("_cut").isNull() | (F.struct("decided_at", "id") > F.col("_cut"))
    state = (
        decisions.join(cut, SLOT)
        .groupBy(*SLOT)
        .agg(
            F.first("_winner").alias("canonical_product_id"),
            F.max_by("sample_title", order).alias("sample_title"),
            F.max_by("source", order).alias("source"),
            F.count_if(run).alias("times_confirmed"),
            F.max("decided_at").alias("last_confirmed_at"),
            F.first("_cut").alias("_cut"),
        )
    )
    if memory is None:
        return state.drop("_cut")
    old = memory.select(
        *SLOT, *[F.col(c).alias("_" + c) for c in ("canonical_product_id", "sample_title", "source", "times_confirmed", "last_confirmed_at")]
    )
    carried = F.when(
        F.col("_cut").isNull() & (F.col("canonical_product_id") == F.col("_canonical_product_id")), F.col("_times_confirmed")
    ).otherwise(0)
    merged = old.join(state, SLOT, "full_outer")
    return merged.select(
        *SLOT,
        F.coalesce("canonical_product_id", "_canonical_product_id").alias("canonical_product_id"),
        F.coalesce("sample_title", "_sample_title").alias("sample_title"),
        F.coalesce("source", "_source").alias("source"),
        F.coalesce(F.col("times_confirmed") + carried, F.col("_times_confirmed")).cast("bigint").alias("times_confirmed"),
        F.coalesce("last_confirmed_at", "_last_confirmed_at").alias("last_confirmed_at"),
    )


def decisions_from_offers(offers: DataFrame, canonicals: DataFrame, source: str = "approval") -> DataFrame:
    """Turn approved offers into memory decisions; unusable titles and retired products drop out."""
    usable = live_peers(offers, canonicals).withColumn("title_key", title_key(F.col("product_title")))
    return usable.where(F.col("merchant_id").isNotNull() & (F.col("title_key") != "")).select(
        *SLOT, "canonical_product_id", F.col("product_title").alias("sample_title"), F.lit(source).alias("source"),
        F.col("decided_at"), F.col("id"),
    )


def backfill_memory(offers: DataFrame, memory: DataFrame, canonicals: DataFrame) -> DataFrame:
    """AGG-14: new mappings from offers that passed the queue; the most common product wins, then the lowest id."""
    passed = live_peers(offers, canonicals).where(~F.col("visibility_status").isin("pending", "needs_review", "rejected"))
    tally = (
        passed.select("merchant_id", title_key(F.col("product_title")).alias("title_key"), "canonical_product_id", "product_title")
        .where(F.col("title_key") != "")
        .groupBy(*SLOT, "canonical_product_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("product_title").alias("sample_title"))
    )
    won = tally.groupBy(*SLOT).agg(
        F.max_by(F.struct("canonical_product_id", "sample_title", "_n"), F.struct(F.col("_n"), -F.col("canonical_product_id"))).alias("_w")
    )
    fresh = won.select(
        *SLOT,
        F.col("_w.canonical_product_id").alias("canonical_product_id"),
        F.col("_w.sample_title").alias("sample_title"),
        F.lit("backfill").alias("source"),
        F.col("_w._n").alias("times_confirmed"),
    )
    return fresh.join(memory.select(*SLOT), SLOT, "left_anti")


def rekey_memory(memory: DataFrame) -> DataFrame:
    """JOB-13: recompute the key of mappings whose sample title still holds entities.

    A new key that the merchant already uses, or that two rows would share, leaves
    all but the first row as they are.
    """
    fresh = F.when(F.col("sample_title").rlike("&.*;"), title_key(F.col("sample_title"))).otherwise(F.col("title_key"))
    moved = memory.withColumn("_new", fresh).withColumn("_moves", (F.col("_new") != "") & (F.col("_new") != F.col("title_key")))
    taken = memory.select("merchant_id", F.col("title_key").alias("_new"), F.lit(True).alias("_taken"))
    first = (
        moved.where("_moves")
        .groupBy("merchant_id", "_new")
        .agg(F.min("title_key").alias("_claim"))
    )
    out = moved.join(taken, ["merchant_id", "_new"], "left").join(first, ["merchant_id", "_new"], "left")
    wins = F.col("_moves") & (F.col("_taken").isNull()) & (F.col("_claim") == F.col("title_key"))
    return out.withColumns(
        {
            "rekeyed": F.coalesce(wins, F.lit(False)),
            "sample_title": F.when(wins, decode_entities(F.col("sample_title"))).otherwise(F.col("sample_title")),
            "title_key": F.when(wins, F.col("_new")).otherwise(F.col("title_key")),
        }
    ).drop("_new", "_moves", "_taken", "_claim")


def _owned(field: str):
    return F.array_contains(F.coalesce(F.col("operator_fields"), F.array().cast("array<string>")), field)


def waiting(offers: DataFrame) -> DataFrame:
    """The queue's offers that have no catalog product yet."""
    return offers.where(F.col("visibility_status").isin(QUEUE) & F.col("canonical_product_id").isNull())


def read_queue(offers: DataFrame, ingredients: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The queue's offers that have no catalog product yet, read for a match; stored values win over freshly read ones."""
    queue = waiting(offers)
    if ids is not None:
        queue = queue.join(ids.select("id").distinct(), "id", "left_semi")
    for c in ("description", "raw_attributes_json"):
        if c not in queue.columns:
            queue = queue.withColumn(c, F.lit(None).cast("string"))
    read = normalize_offers(queue, ingredients)
    stored = {
        "found_ingredient_id": "ingredient_id",
        "found_form": "ingredient_form",
        "found_strength": "strength_per_serving",
        "found_servings": "servings_per_container",
        "found_pct": "standardization_percentage",
    }
    return read.withColumns(
        {
            f: F.coalesce(F.nullif(F.col(c), F.lit("")) if f == "found_form" else F.col(c).cast(read.schema[f].dataType), F.col(f))
            for f, c in stored.items()
        }
    )


def match_queue(read: DataFrame, memory: DataFrame, canonicals: DataFrame, offers: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """(id, canonical_product_id, match_confidence, match_tier) of the read offers that have a match."""
    hits = match_cascade(read, offers, memory, canonicals, index)
    return hits.select("id", "canonical_product_id", F.col("confidence").alias("match_confidence"), F.col("tier").alias("match_tier"))


def rematch(
    offers: DataFrame,
    memory: DataFrame,
    canonicals: DataFrame,
    ingredients: DataFrame,
    raw: DataFrame | None = None,
    ids: DataFrame | None = None,
) -> DataFrame:
    """JOB-4: match the queue's offers that have no catalog product yet.

    Stored values win over freshly read ones.  A match fills ingredient, form,
    strength and percentage only where they are blank and not curator-owned, and the
    cost columns are derived again.  Returns the matched offers, complete.
    """
    read = read_queue(offers, ingredients, ids)
    hit = match_offers(read, offers, memory, canonicals).where(F.col("matched_canonical_id").isNotNull())
    dims = canonicals.select(
        F.col("id").alias("matched_canonical_id"),
        F.col("ingredient_id").alias("_ingredient_id"),
        F.col("ingredient_form").alias("_ingredient_form"),
        F.col("strength_per_serving").alias("_strength_per_serving"),
        F.col("standardization_percentage").alias("_standardization_percentage"),
    )
    joined = hit.join(dims, "matched_canonical_id")
    fills = {}
    for field in ("ingredient_id", "ingredient_form", "strength_per_serving", "standardization_percentage"):
        is_blank = blank(F.col(field)) if field == "ingredient_form" else F.col(field).isNull()
        fills[field] = F.when(is_blank & ~_owned(field), F.coalesce(F.col("_" + field).cast(offers.schema[field].dataType), F.col(field))).otherwise(F.col(field))
    filled = joined.withColumns({**fills, "canonical_product_id": F.col("matched_canonical_id")})
    rates = ingredients.select(
        F.col("id").alias("ingredient_id"), "standardization_default_pct", "elemental_percentage"
    )
    costed = derive_costs(filled.join(rates, "ingredient_id", "left"))
    return costed.select(*offers.columns, *([] if "match_confidence" in offers.columns else ["match_confidence"]), "match_tier")


def rematch_for_keys(offers: DataFrame, keys: DataFrame, memory: DataFrame, canonicals: DataFrame, ingredients: DataFrame) -> DataFrame:
    """JOB-5: rematch only offers whose title key is among ``keys`` (a title_key column)."""
    # Only the titles of the queue are read: no other offer is matched again.
    wanted = waiting(offers).select("id", title_key(F.col("product_title")).alias("title_key")).join(
        keys.select("title_key").where("title_key <> ''").distinct(), "title_key", "left_semi"
    )
    return rematch(offers, memory, canonicals, ingredients, ids=wanted.select("id"))


def learn_from_approvals(approvals: DataFrame, memory: DataFrame, canonicals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JOB-15: the new memory, and the title keys that were learned (input of JOB-5)."""
    decisions = decisions_from_offers(approvals, canonicals)
    return memory_state(decisions, memory), decisions.select("title_key").distinct()
