"""Matching listings to catalog products (JOIN-4..14, JOB-1..3).

Each tier is an inner join of narrow rows (offer id and key) with peers that were
first reduced to one row per key.  These joins carry a hint to shuffle: a planner that goes by
the size of compressed files would send the listings to the driver.  The cascade joins the keys of all tiers at once
with an index of the stored offers, and the first tier in cascade order wins, so no
wide row is shuffled and rows without a key never reach the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.attributes import flatten_attributes
from ..functions.dose import extract_count, strength_of
from ..functions.text import (
    ascii_lower,
    blank,
    decode_entities,
    extract_form,
    extract_standardization,
    normalize_title,
    search_text,
    text,
    title_key,
)
from ..session import discard, materialize

# The tiers in cascade order, with the confidence each one gives.
TIERS = [
    ("barcode", 1.00),
    ("brand_sku", 0.95),
    ("memory_own", 0.90),
    ("memory_others", 0.80),
    ("canonical_attrs", 0.85),
    ("brand_title", 0.85),
    ("brand_title_dose", 0.75),
    ("title_dose", 0.65),
    ("ingredient_only", 0.55),
]
_ORDER = {name: i for i, (name, _) in enumerate(TIERS)}
_CONFIDENCE = dict(TIERS)
STRENGTH_TOLERANCE = 0.0001

TOKEN = r"[a-z0-9]+|[^a-z0-9\s]"


#: As many names of ingredients are sent to every executor; more are shuffled.
MOST_NAMES = 50_000


#: As many listings' keys are sent to the index of stored offers; with more, both are shuffled.
MOST_PROBES = 5_000


def few(df: DataFrame, most: int) -> bool:
    """Whether a written table has at most so many rows: sizes of compressed files tell too little of what a broadcast holds."""
    return df.limit(most + 1).count() <= most


def dealt(df: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """A written table as one side of a join: broadcast if it has few rows, else never."""
    return F.broadcast(df) if few(df, most) else df.hint("merge")


def detect_ingredient(df: DataFrame, ingredients: DataFrame, text_col: str, id_col: str = "id", most_names: int = MOST_NAMES) -> DataFrame:
    """JOIN-4: add ``detected_ingredient_id``: the longest name or alias found as a whole token.

    A name can only occur where each of its tokens occurs, so names are looked up by
    their rarest token and only those candidates are tested in full.  Ties go to the
    name that comes first by ingredient name, then id.
    """
    names = (
        ingredients.where(F.col("status") != "retired")
        .select(F.col("id").alias("_ing"), F.col("name").alias("_scan"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array()))).alias("_n"))
        .where(~blank(F.col("_n")))
        .select("_ing", "_scan", ascii_lower(F.col("_n")).alias("_name"))
        .groupBy("_name")
        .agg(F.min(F.struct("_scan", "_ing")).alias("_first"))
    )
    tokens_of = F.array_distinct(F.regexp_extract_all(F.col("_name"), F.lit(TOKEN), F.lit(0)))
    exploded = names.select("_name", "_first", F.explode(tokens_of).alias("_token"))
    usage = exploded.groupBy("_token").agg(F.count(F.lit(1)).alias("_uses"))
    keyed = (
        exploded.join(usage, "_token")
        .groupBy("_name")
        .agg(
            F.first("_first").alias("_first"),
            F.min_by("_token", F.struct("_uses", -F.length("_token"), "_token")).alias("_token"),
        )
    )
    keyed = materialize(keyed, "names")
    lowered = df.select(F.col(id_col).alias("_id"), ascii_lower(text(F.col(text_col))).alias("_text"))
    tokens = F.array_distinct(F.regexp_extract_all(F.col("_text"), F.lit(TOKEN), F.lit(0)))
    whole = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.col("_name"), F.lit(r"\E(?![a-z0-9])"))
    # The listings never reach the driver, however small their files are: the names do if they are few, else both are shuffled.
    if few(keyed, most_names):
        candidates = lowered.select("_id", "_text", F.explode(tokens).alias("_token")).join(F.broadcast(keyed), "_token")
    else:
        found = lowered.select("_id", F.explode(tokens).alias("_token")).join(keyed.hint("merge"), "_token")
        candidates = found.select("_id", "_name", "_first").join(lowered.hint("merge"), "_id")
    best = (
        candidates.where(F.regexp(F.col("_text"), whole))
        .groupBy("_id")
        .agg(
            F.min_by(
                F.col("_first._ing"), F.struct(-F.octet_length("_name"), F.col("_first._scan"), F.col("_first._ing"))
            ).alias("detected_ingredient_id")
        )
    )
    best = best.hint("shuffle_hash")
    return df.join(best, df[id_col] == best["_id"], "left").drop("_id")


def normalize_offers(df: DataFrame, ingredients: DataFrame | None, id_col: str = "id") -> DataFrame:
    """JOB-1: read form, strength, unit, count, percentage and ingredient out of the listing text.

    Needs product_title, variant_title, description and raw_attributes_json; the
    results go to columns that start with ``found_``.  Without ingredients none is
    looked for.
    """
    staged = df.withColumn("_attributes", flatten_attributes(F.col("raw_attributes_json")))
    staged = staged.withColumn(
        "_search", search_text(*[F.col(c) for c in ("variant_title", "product_title", "description", "_attributes")])
    ).withColumn("_variant", decode_entities(F.col("variant_title")))
    # The search text is read three times from here on, so it is written once.
    searched = materialize(staged, "search")
    staged = searched.withColumns(
        {
            "_strength": strength_of(F.col("_variant"), F.col("_search")),
            "_standard": extract_standardization(F.col("_search")),
            "found_form": extract_form(F.col("_search")),
            "found_servings": extract_count(F.col("_search")),
        }
    )
    if ingredients is None:
        staged = staged.withColumn("detected_ingredient_id", F.lit(None).cast("bigint"))
    else:
        staged = detect_ingredient(staged, ingredients, "_search", id_col)
    read = staged.withColumns(
        {
            "found_strength": F.col("_strength.value"),
            "found_unit": F.col("_strength.unit"),
            "found_pct": F.col("_standard.pct"),
        }
    ).withColumnRenamed("detected_ingredient_id", "found_ingredient_id")
    # Written, so that a later filter on a found value does not run the text rules again.
    out = materialize(read.drop("_attributes", "_search", "_variant", "_strength", "_standard"), "read")
    discard(searched)
    return out


def live_peers(offers: DataFrame, canonicals: DataFrame) -> DataFrame:
    """Offers that already have a canonical product which is not retired."""
    live = canonicals.where(F.col("status") != "retired").select(F.col("id").alias("canonical_product_id"))
    return offers.where(F.col("canonical_product_id").isNotNull()).join(live, "canonical_product_id", "left_semi")


def _hit(df: DataFrame, tier: str) -> DataFrame:
    return df.select(
        "id",
        F.lit(_ORDER[tier]).alias("tier"),
        F.col("canonical_product_id").cast("bigint").alias("canonical_product_id"),
        F.lit(_CONFIDENCE[tier]).alias("confidence"),
    )


def _by_key(df: DataFrame, peers: DataFrame, keys: dict[str, Column], tier: str, peer_keys: dict[str, Column] | None = None) -> DataFrame:
    """Hits of an equality tier: the peer with the lowest id per key."""
    names = list(keys)
    probe = df.select("id", *[v.alias(k) for k, v in keys.items()])
    first = (
        peers.select("canonical_product_id", F.col("id").alias("_peer"), *[v.alias(k) for k, v in (peer_keys or keys).items()])
        .where(_all_filled(names))
        .groupBy(*names)
        .agg(F.min_by("canonical_product_id", "_peer").alias("canonical_product_id"))
    )
    return _hit(probe.where(_all_filled(names)).join(first.hint("merge"), names), tier)


def _all_filled(names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [~blank(F.col(n).cast("string")) for n in names])


def tier_barcode(df: DataFrame, peers: DataFrame) -> DataFrame:
    """JOIN-5."""
    return _by_key(df, peers, {"barcode": F.col("barcode")}, "barcode")


def tier_brand_sku(df: DataFrame, peers: DataFrame) -> DataFrame:
    """JOIN-6."""
    return _by_key(df, peers, {"brand": F.lower("brand"), "sku": F.col("sku")}, "brand_sku")


def _live_memory(memory: DataFrame, canonicals: DataFrame) -> DataFrame:
    return live_peers(memory.where(~blank(F.col("title_key"))), canonicals)


def tier_memory_own(df: DataFrame, memory: DataFrame, canonicals: DataFrame) -> DataFrame:
    """JOIN-7: a mapping learned at the same merchant."""
    own = _live_memory(memory, canonicals).groupBy("merchant_id", "title_key").agg(
        F.min("canonical_product_id").alias("canonical_product_id")
    )
    return _hit(df.select("id", "merchant_id", "title_key").join(own.hint("merge"), ["merchant_id", "title_key"]), "memory_own")


def tier_memory_others(df: DataFrame, memory: DataFrame, canonicals: DataFrame) -> DataFrame:
    """JOIN-8: mappings of other merchants, used only when all agree.

    An own mapping would have been taken by the tier before, so agreement over all
    merchants is the same question.
    """
    agreed = (
        _live_memory(memory, canonicals)
        .groupBy("title_key")
        .agg(F.min("canonical_product_id").alias("canonical_product_id"), F.max("canonical_product_id").alias("_max"))
        .where(F.col("canonical_product_id") == F.col("_max"))
    )
    return _hit(df.select("id", "title_key").join(agreed.hint("merge"), "title_key"), "memory_others")


def _cell(strength: Column) -> Column:
    return F.round(strength.cast("double") / STRENGTH_TOLERANCE).cast("bigint")


def _probe_cells(df: DataFrame, *cols: str) -> DataFrame:
    """One row per grid cell that a strength within the tolerance can lie in."""
    near = F.array(*[_cell(F.col("found_strength")) + d for d in (-1, 0, 1)])
    return df.where(F.col("found_strength").isNotNull()).select("id", *cols, "found_strength", F.explode(near).alias("_cell"))


def _close(strength: str) -> Column:
    return F.abs(F.col(strength).cast("double") - F.col("found_strength")) < STRENGTH_TOLERANCE


def tier_canonical_attrs(df: DataFrame, canonicals: DataFrame) -> DataFrame:
    """JOIN-9: exactly one catalog product with the same ingredient, form, strength and percentage."""
    dims = (
        canonicals.where((F.col("status") != "retired") & F.col("strength_per_serving").isNotNull())
        .groupBy(
            F.col("ingredient_id").alias("found_ingredient_id"),
            F.col("ingredient_form").alias("found_form"),
            F.col("strength_per_serving").cast("double").alias("_strength"),
            F.coalesce(F.col("standardization_percentage").cast("double"), F.lit(-1.0)).alias("_pct"),
        )
        .agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("canonical_product_id"))
        .withColumn("_cell", _cell(F.col("_strength")))
    )
    keys = ["found_ingredient_id", "found_form"]
    probe = _probe_cells(df.where(F.col("found_strength") != 0), *keys, "found_pct").where(_all_filled(keys))
    hits = (
        probe.join(dims.hint("merge"), keys + ["_cell"])
        .where(_close("_strength") & (F.col("found_pct").isNull() | (F.abs(F.col("_pct") - F.col("found_pct")) < 0.5)))
        .groupBy("id")
        .agg(F.sum("_n").alias("_n"), F.min("canonical_product_id").alias("canonical_product_id"))
        .where(F.col("_n") == 1)
    )
    return _hit(hits, "canonical_attrs")


def tier_brand_title(df: DataFrame, peers: DataFrame) -> DataFrame:
    """JOIN-10."""
    return _by_key(df, peers, {"brand": F.lower("brand"), "norm_title": F.col("norm_title")}, "brand_title")


def _dose_tier(df: DataFrame, peers: DataFrame, keys: dict[str, Column], tier: str) -> DataFrame:
    names = [*keys, "_count"]
    first = (
        peers.where(F.col("strength_per_serving").isNotNull())
        .select(
            "id",
            "canonical_product_id",
            *[v.alias(k) for k, v in keys.items()],
            F.col("servings_per_container").cast("bigint").alias("_count"),
            F.col("strength_per_serving").cast("double").alias("_strength"),
        )
        .where(_all_filled(names))
        .groupBy(*names, "_strength")
        .agg(F.min(F.struct("id", "canonical_product_id")).alias("_first"))
        .withColumn("_cell", _cell(F.col("_strength")))
    )
    keyed = df.withColumns({**keys, "_count": F.col("found_servings").cast("bigint")})
    hits = (
        _probe_cells(keyed, *names)
        .where(_all_filled(names))
        .join(first.hint("merge"), names + ["_cell"])
        .where(_close("_strength"))
        .groupBy("id")
        .agg(F.min("_first").alias("_first"))
        .select("id", F.col("_first.canonical_product_id").alias("canonical_product_id"))
    )
    return _hit(hits, tier)


def tier_brand_title_dose(df: DataFrame, peers: DataFrame) -> DataFrame:
    """JOIN-11.  Any hit is also a hit of the tier before it, so it never decides."""
    return _dose_tier(df, peers, {"brand": F.lower("brand"), "norm_title": F.col("norm_title")}, "brand_title_dose")


def tier_title_dose(df: DataFrame, peers: DataFrame) -> DataFrame:
    """JOIN-12."""
    return _dose_tier(df, peers, {"norm_title": F.col("norm_title")}, "title_dose")


def tier_ingredient_only(df: DataFrame, canonicals: DataFrame) -> DataFrame:
    """JOIN-13: the only catalog product of the ingredient that pins neither form nor strength."""
    single = (
        canonicals.where(
            (F.col("status") != "retired") & F.col("ingredient_form").isNull() & F.col("strength_per_serving").isNull()
        )
        .groupBy(F.col("ingredient_id").alias("found_ingredient_id"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("canonical_product_id"))
        .where(F.col("_n") == 1)
    )
    return _hit(df.select("id", "found_ingredient_id").join(single.hint("merge"), "found_ingredient_id"), "ingredient_only")


def with_title_keys(df: DataFrame) -> DataFrame:
    """Store the normalized title and the memory key, so that tiers join on plain columns; stored ones are kept."""
    rules = {"norm_title": normalize_title, "title_key": title_key}
    return df.withColumns({c: rule(F.col("product_title")) for c, rule in rules.items() if c not in df.columns})


_GAP = "\u0001"


def _key(*parts: Column) -> Column:
    """The parts as one key; null unless all are filled."""
    filled = reduce(lambda a, b: a & b, [~blank(p.cast("string")) for p in parts])
    return F.when(filled, F.concat_ws(_GAP, *[p.cast("string") for p in parts]))


def match_index(offers: DataFrame) -> DataFrame:
    """The keys by which matched offers are found: kind, a, b, strength, servings, canonical_product_id and peer (the lowest id).

    One row per key and catalog product, whatever the number of offers, so that whether a product is still live
    is asked when the index is read.  Offers are counted together by their titles as they are before a title is
    normalized, so each title is normalized once; offers that store ``norm_title`` are not normalized at all.
    """
    stored = "norm_title" in offers.columns
    brand = F.lower("brand")
    dose = [F.col("strength_per_serving").cast("double"), F.col("servings_per_container").cast("bigint")]

    def entry(kind: str, a: Column, b: Column, strength: Column, servings: Column) -> Column:
        values = {"kind": F.lit(kind), "a": a.cast("string"), "b": b.cast("string"), "strength": strength, "servings": servings}
        return F.struct(*[v.alias(k) for k, v in values.items()])

    none = [F.lit(None).cast("double"), F.lit(None).cast("bigint")]
    title = F.col("norm_title" if stored else "product_title")
    entries = F.array(
        entry("barcode", F.col("barcode"), F.lit("-"), *none), entry("sku", brand, F.col("sku"), *none), entry("title", F.coalesce(brand, F.lit("")), title, *dose)
    )
    keyed = (
        offers.where(F.col("canonical_product_id").isNotNull())
        .select("id", "canonical_product_id", F.explode(entries).alias("e"))
        .select("id", "canonical_product_id", "e.*")
        .where(~blank(F.col("b")) & ((F.col("kind") == "title") | ~blank(F.col("a"))))
    )
    group = ["kind", "a", "b", "strength", "servings", "canonical_product_id"]
    index = materialize(keyed.groupBy(*group).agg(F.min("id").alias("peer")), "index")
    if stored:
        return index
    titles = index.where(F.col("kind") == "title").groupBy("b").agg(F.lit(True).alias("_t"))
    titles = materialize(titles.select("b", normalize_title(F.col("b")).alias("_norm")), "titles")
    named = index.where(F.col("kind") == "title").join(titles.hint("merge"), "b").withColumn("b", F.col("_norm")).select(*index.columns)
    return index.where(F.col("kind") != "title").unionByName(named)


def _peer_keys(index: DataFrame) -> DataFrame:
    """tier, key, strength, canonical_product_id and peer of every row of an index; the strength only where the tier asks for it."""
    a, b, servings = F.col("a"), F.col("b"), F.col("servings")
    by_kind = {"brand_title": _key(a, b), "brand_title_dose": _key(a, b, servings), "title_dose": _key(b, servings)}
    doses = [F.when(F.col("strength").isNotNull(), by_kind[t]) if t.endswith("dose") else by_kind[t] for t in by_kind]
    titles = F.filter(F.array(*[F.struct(F.lit(_ORDER[t]).alias("tier"), k.alias("key")) for t, k in zip(by_kind, doses, strict=True)]), lambda e: e["key"].isNotNull())
    barcode = F.col("kind") == "barcode"
    plain = F.struct(F.when(barcode, _ORDER["barcode"]).otherwise(_ORDER["brand_sku"]).alias("tier"), F.when(barcode, a).otherwise(_key(a, b)).alias("key"))
    entries = F.explode(F.when(F.col("kind") == "title", titles).otherwise(F.array(plain)))
    rows = index.select("canonical_product_id", "peer", "strength", entries.alias("e")).select("canonical_product_id", "peer", "strength", "e.*")
    return rows.withColumn("strength", F.when(F.col("tier").isin(_ORDER["brand_title_dose"], _ORDER["title_dose"]), F.col("strength")))


def _targets(index: DataFrame, memory: DataFrame, canonicals: DataFrame) -> DataFrame:
    """What each key leads to: tier, key, cell, strength, pct, peer, canonical_product_id, n; ``cell`` is 0 where no strength counts."""
    usable = canonicals.where(F.col("status") != "retired")
    live = index.join(usable.select(F.col("id").alias("canonical_product_id")), "canonical_product_id", "left_semi")
    peers = _peer_keys(live).groupBy("tier", "key", "strength").agg(F.min(F.struct("peer", "canonical_product_id")).alias("f"), F.lit(1).cast("bigint").alias("n"))
    peers = peers.select("tier", "key", "strength", F.lit(None).cast("double").alias("pct"), "f.*", "n")

    known = _live_memory(memory, canonicals)

    def learned(tier: str, key: Column, agreed: bool) -> DataFrame:
        first = known.groupBy(key.alias("key")).agg(F.min("canonical_product_id").alias("canonical_product_id"), F.max("canonical_product_id").alias("_max"))
        first = first.where(F.col("canonical_product_id") == F.col("_max")) if agreed else first
        return _target(first, tier)

    pinned = (
        usable.where(F.col("strength_per_serving").isNotNull())
        .groupBy(
            _key(F.col("ingredient_id"), F.col("ingredient_form")).alias("key"), F.col("strength_per_serving").cast("double").alias("strength"),
            F.coalesce(F.col("standardization_percentage").cast("double"), F.lit(-1.0)).alias("pct"),
        )
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("canonical_product_id"))
    )
    open_ = usable.where(F.col("ingredient_form").isNull() & F.col("strength_per_serving").isNull()).groupBy(F.col("ingredient_id").cast("string").alias("key"))
    single = open_.agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("canonical_product_id")).where(F.col("_n") == 1)
    parts = [
        peers,
        learned("memory_own", _key(F.col("merchant_id"), F.col("title_key")), False),
        learned("memory_others", F.col("title_key"), True),
        _target(pinned, "canonical_attrs"),
        _target(single, "ingredient_only"),
    ]
    every = reduce(DataFrame.unionByName, parts).where(F.col("key").isNotNull())
    return every.withColumn("cell", F.coalesce(_cell(F.col("strength")), F.lit(0).cast("bigint")))


def catalog_keys(changed: DataFrame, index: DataFrame, memory: DataFrame) -> DataFrame:
    """(tier, key, cell): all keys by which catalog products, in any of their given versions, can have a part in a match."""
    ids = changed.select(F.col("id").alias("canonical_product_id")).distinct()
    peers = _peer_keys(index.join(ids, "canonical_product_id", "left_semi")).select("tier", "key", "strength")
    learned = memory.where(~blank(F.col("title_key"))).join(ids, "canonical_product_id", "left_semi")
    none = F.lit(None).cast("double").alias("strength")

    def rows(df: DataFrame, tier: str, key: Column, strength: Column = none) -> DataFrame:
        return df.select(F.lit(_ORDER[tier]).alias("tier"), key.alias("key"), strength.alias("strength"))

    pinned = changed.where(F.col("strength_per_serving").isNotNull())
    parts = [
        peers,
        rows(learned, "memory_own", _key(F.col("merchant_id"), F.col("title_key"))),
        rows(learned, "memory_others", F.col("title_key")),
        rows(pinned, "canonical_attrs", _key(F.col("ingredient_id"), F.col("ingredient_form")), F.col("strength_per_serving").cast("double")),
        rows(changed.where(F.col("ingredient_form").isNull() & F.col("strength_per_serving").isNull()), "ingredient_only", F.col("ingredient_id").cast("string")),
    ]
    every = reduce(DataFrame.unionByName, parts).where(F.col("key").isNotNull())
    return every.select("tier", "key", F.coalesce(_cell(F.col("strength")), F.lit(0).cast("bigint")).alias("cell")).distinct()


def _target(df: DataFrame, tier: str) -> DataFrame:
    have = {"strength": F.lit(None).cast("double"), "pct": F.lit(None).cast("double"), "n": F.lit(1).cast("bigint")}
    more = [F.col(c) if c in df.columns else v.alias(c) for c, v in have.items()]
    return df.select(F.lit(_ORDER[tier]).alias("tier"), "key", *more, F.lit(None).cast("bigint").alias("peer"), F.col("canonical_product_id").cast("bigint").alias("canonical_product_id"))


def probe_keys(probe: DataFrame) -> DataFrame:
    """Every key of a listing: id, found_strength, found_pct, tier, key, cell (three cells where a strength counts)."""
    brand, norm, key, servings = F.lower("brand"), F.col("norm_title"), F.col("title_key"), F.col("found_servings").cast("bigint")
    plain = {
        "barcode": _key(F.col("barcode")), "brand_sku": _key(brand, F.col("sku")), "memory_own": _key(F.col("merchant_id"), key), "memory_others": _key(key),
        "brand_title": _key(brand, norm), "ingredient_only": F.col("found_ingredient_id").cast("string"),
    }
    has_strength = F.col("found_strength").isNotNull()
    dosed = {
        "canonical_attrs": F.when(F.col("found_strength") != 0, _key(F.col("found_ingredient_id"), F.col("found_form"))),
        "brand_title_dose": F.when(has_strength, _key(brand, norm, servings)), "title_dose": F.when(has_strength, _key(norm, servings)),
    }

    def entry(tier: str, k: Column, cell: Column) -> Column:
        return F.struct(F.lit(_ORDER[tier]).alias("tier"), k.alias("key"), cell.alias("cell"))

    cells = [_cell(F.col("found_strength")) + d for d in (-1, 0, 1)]
    entries = [entry(t, k, F.lit(0).cast("bigint")) for t, k in plain.items()] + [entry(t, k, c) for t, k in dosed.items() for c in cells]
    rows = probe.select("id", "found_strength", "found_pct", F.explode(F.filter(F.array(*entries), lambda e: e["key"].isNotNull())).alias("e"))
    return rows.select("id", F.col("found_strength").cast("double").alias("found_strength"), F.col("found_pct").cast("double").alias("found_pct"), "e.*")


def match_cascade(df: DataFrame, offers: DataFrame | None, memory: DataFrame, canonicals: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """JOIN-14: (id, canonical_product_id, confidence, tier) of the first tier that hits.

    The order of the tiers decides, not the confidence.  ``df`` comes from :func:`normalize_offers`; ``offers`` is the
    table as of the start of the run, or ``index`` its :func:`match_index`.  All tiers are one equality join of narrow
    rows: a listing's keys with the one row that each key leads to.
    """
    found = ["found_ingredient_id", "found_form", "found_strength", "found_servings", "found_pct"]
    probe = with_title_keys(df).select("id", "merchant_id", "barcode", "brand", "sku", "norm_title", "title_key", *found)
    # The title rules ran once; every key reads their results.
    probe = materialize(probe, "probe")
    keys = probe_keys(probe)
    targets = _targets(match_index(offers) if index is None else index, memory, canonicals)
    # A stored index is not shuffled for a few listings; more of them never reach the driver, however small their files are.
    if index is not None and few(probe, MOST_PROBES):
        keys = F.broadcast(keys)
    else:
        targets = targets.hint("merge")
    attrs, dosed = _ORDER["canonical_attrs"], [_ORDER["brand_title_dose"], _ORDER["title_dose"]]
    close = F.abs(F.col("strength") - F.col("found_strength")) < STRENGTH_TOLERANCE
    same_pct = F.col("found_pct").isNull() | (F.abs(F.col("pct") - F.col("found_pct")) < 0.5)
    tier = F.col("tier")
    hits = keys.join(targets, ["tier", "key", "cell"]).where(
        F.when(tier == attrs, close & same_pct).when(tier.isin(dosed), close).otherwise(F.lit(True))
    )
    # A catalog product by its attributes counts only if it is the only one; the tiers before and after it just need a hit.
    choice = F.struct("tier", "peer", "canonical_product_id")
    best = hits.groupBy("id").agg(
        F.min(F.when(tier < attrs, choice)).alias("_before"),
        F.sum(F.when(tier == attrs, F.col("n"))).alias("_n"),
        F.min(F.when(tier == attrs, choice)).alias("_attrs"),
        F.min(F.when(tier > attrs, choice)).alias("_after"),
    )
    best = best.select("id", F.coalesce("_before", F.when(F.col("_n") == 1, F.col("_attrs")), "_after").alias("_b")).where(F.col("_b").isNotNull())
    at = F.col("_b.tier")
    names, sure = F.array(*[F.lit(n) for n, _ in TIERS]), F.array(*[F.lit(c) for _, c in TIERS])
    return best.select("id", F.col("_b.canonical_product_id").cast("bigint").alias("canonical_product_id"), F.get(sure, at).alias("confidence"), F.get(names, at).alias("tier"))


def match_offers(df: DataFrame, offers: DataFrame | None, memory: DataFrame, canonicals: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """JOB-2: add matched_canonical_id, match_confidence and match_tier to each listing."""
    hits = match_cascade(df, offers, memory, canonicals, index).select(
        "id",
        F.col("canonical_product_id").alias("matched_canonical_id"),
        F.col("confidence").alias("match_confidence"),
        F.col("tier").alias("match_tier"),
    )
    return df.drop("match_confidence").join(hits.hint("shuffle_hash"), "id", "left")


def apply_match(df: DataFrame, canonicals: DataFrame) -> DataFrame:
    """JOB-3: fill the dose columns of new offers.

    A matched catalog product overrides the ingredient always, the form where it has
    one, and strength and percentage where it pins them.
    """
    dims = canonicals.select(
        F.col("id").alias("matched_canonical_id"),
        F.col("ingredient_id").alias("_ing"),
        F.col("ingredient_form").alias("_form"),
        F.col("strength_per_serving").cast("double").alias("_strength"),
        F.col("standardization_percentage").cast("double").alias("_pct"),
    )
    return (
        df.join(dims, "matched_canonical_id", "left")
        .withColumns(
            {
                "canonical_product_id": F.col("matched_canonical_id"),
                "ingredient_id": F.coalesce("_ing", "found_ingredient_id"),
                "ingredient_form": F.coalesce(F.nullif(F.col("_form"), F.lit("")), F.col("found_form")),
                "strength_per_serving": F.coalesce("_strength", "found_strength"),
                "strength_unit": F.col("found_unit"),
                "servings_per_container": F.col("found_servings"),
                "standardization_percentage": F.coalesce("_pct", "found_pct"),
            }
        )
        .drop("_ing", "_form", "_strength", "_pct", "matched_canonical_id")
    )
