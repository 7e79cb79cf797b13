"""Price changes, moves and series (PRC-1..5, JOB-23)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import half_up, text
from ..plans.ordered import with_previous
from ..session import materialize

# Fixed value: prices closer than this are the same price.
SAME_PRICE = 0.00005
PRICES = ["regular_price", "sale_price", "current_price"]


def _price_differs(old: Column, new: Column) -> Column:
    one_missing = old.isNull() != new.isNull()
    return one_missing | F.coalesce(F.abs(old.cast("double") - new.cast("double")) > SAME_PRICE, F.lit(False))


def is_change(old: str, new: str) -> Column:
    """PRC-1: whether any price or the stock differs between two column prefixes."""
    prices = [_price_differs(F.col(old + p), F.col(new + p)) for p in PRICES]
    return prices[0] | prices[1] | prices[2] | (text(F.col(old + "stock_status")) != text(F.col(new + "stock_status")))


def _history_columns(old: str, new: str) -> list[Column]:
    pairs = [
        (F.col(side + p).cast("double").alias(f"{label}_{p}")) for p in PRICES for side, label in ((old, "old"), (new, "new"))
    ]
    return [*pairs, text(F.col(old + "stock_status")).alias("old_stock_status"), text(F.col(new + "stock_status")).alias("new_stock_status")]


def price_changes(before: DataFrame, after: DataFrame, run_id: int, now: datetime) -> DataFrame:
    """PRC-1, join form: change rows between two versions of the offer table.

    ``before`` and ``after`` hold id, the prices and stock_status.
    """
    fields = [*PRICES, "stock_status"]
    old = before.select("id", *[F.col(c).alias("o_" + c) for c in fields])
    new = after.select("id", *[F.col(c).alias("n_" + c) for c in fields])
    return (
        old.join(new, "id")
        .where(is_change("o_", "n_"))
        .select(
            F.col("id").alias("offer_id"),
            F.lit(run_id).cast("bigint").alias("import_run_id"),
            *_history_columns("o_", "n_"),
            F.lit(now).cast("timestamp").alias("changed_at"),
        )
    )


def price_changes_from_log(observations: DataFrame, keys: list[str], order: list[str], bucket: Column) -> DataFrame:
    """PRC-1, log form: change rows between consecutive observations of a key.

    ``bucket`` cuts the order into ranges (a month, say), so that a key with very
    many observations is spread over tasks.
    """
    fields = [*PRICES, "stock_status"]
    seen = with_previous(observations, keys, order, fields, bucket)
    wide = seen.where(F.col("prev").isNotNull()).withColumns(
        {**{"o_" + c: F.col("prev." + c) for c in fields}, **{"n_" + c: F.col(c) for c in fields}}
    )
    return wide.where(is_change("o_", "n_")).select(*keys, *order, *_history_columns("o_", "n_"))


def _since(now: datetime, days: int) -> Column:
    return F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))


def price_moves(history: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """PRC-2: (offer_id, dir, pct) of each offer's last effective-price move inside the window."""
    if days <= 0:
        return history.select("offer_id", F.lit("").alias("dir"), F.lit(0.0).alias("pct")).limit(0)
    old, new = F.col("old_current_price"), F.col("new_current_price")
    moved = history.where((F.col("changed_at") >= _since(now, days)) & (old > 0) & (F.abs(new - old) > SAME_PRICE))
    last = moved.groupBy("offer_id").agg(F.max_by(F.struct(old.alias("old"), new.alias("new")), F.struct("changed_at", "id")).alias("m"))
    old, new = F.col("m.old").cast("double"), F.col("m.new").cast("double")
    return last.select(
        "offer_id", F.when(new > old, "up").otherwise("down").alias("dir"), half_up(F.abs((new - old) / old) * 100, 2).alias("pct")
    )


def offer_history(history: DataFrame, offer_id: int, limit: int = 50) -> DataFrame:
    """PRC-3: the newest change rows of one offer."""
    return history.where(F.col("offer_id") == offer_id).orderBy(F.desc("changed_at"), F.desc("id")).limit(limit)


def _intervals(offers: DataFrame, history: DataFrame, now: datetime, days: int) -> DataFrame:
    """(canonical_product_id, start, stop, price): the levels of each offer in the window, in days from its first one.

    An offer is a step function of its change rows: the price before the first row is that row's old price, and an
    offer without rows is flat.  The rows before the window shrink to one state per offer, those of a day to its last.
    """
    today = F.to_date(F.lit(now).cast("timestamp"))
    start = F.date_sub(today, days - 1)
    rows = history.where(F.col("new_current_price").isNotNull() & (F.to_date("changed_at") <= today)).select(
        "offer_id", F.struct("changed_at", "id").alias("_at"), F.to_date("changed_at").alias("_day"),
        F.col("old_current_price").cast("double").alias("_old"), F.col("new_current_price").cast("double").alias("_new"),
    )
    # Days before the window fold into the slot -1.
    slot = F.when(F.col("_day") < start, F.lit(-1)).otherwise(F.date_diff(F.col("_day"), start))
    daily = rows.groupBy("offer_id", slot.alias("_slot")).agg(F.max_by("_new", "_at").alias("_price"), F.min(F.struct("_at", "_old")).alias("_first"))
    per_offer = daily.groupBy("offer_id").agg(
        F.array_sort(F.collect_list(F.struct("_slot", "_price"))).alias("_steps"), F.min_by(F.col("_first._old"), F.col("_first._at")).alias("_seed")
    )
    priced = offers.where(F.col("canonical_product_id").isNotNull()).select(
        F.col("id").alias("offer_id"), "canonical_product_id", F.col("current_price").cast("double").alias("_now")
    )
    level = F.when(F.col("_steps").isNull(), F.col("_now")).otherwise(F.col("_seed"))
    seed = F.array(F.struct(F.lit(0).alias("at"), level.alias("price")))
    steps = F.transform(F.coalesce("_steps", F.array().cast("array<struct<_slot:int,_price:double>>")), lambda s: F.struct(F.greatest(s["_slot"], F.lit(0)).alias("at"), s["_price"].alias("price")))
    joined = priced.join(per_offer, "offer_id", "left").select("canonical_product_id", F.concat(seed, steps).alias("_l"))
    spans = F.transform("_l", lambda x, i: F.struct(x["at"].alias("start"), F.coalesce(F.get("_l", i + 1)["at"], F.lit(days)).alias("stop"), x["price"].alias("price")))
    spans = F.filter(spans, lambda x: (x["start"] < x["stop"]) & x["price"].isNotNull())
    return joined.select("canonical_product_id", F.inline(spans))


def _dyadic(days: int) -> Column:
    """The aligned ranges of 2, 4, 8, ... days that make up [start, stop): array of (width, node), a few for each interval."""

    def at(k: int) -> list[Column]:
        low, high = F.ceil(F.col("start") / (1 << k)).cast("int"), F.floor(F.col("stop") / (1 << k)).cast("int")
        inside = low < high
        return [
            F.when(inside & (low % 2 == 1), F.struct(F.lit(1 << k).alias("width"), low.alias("node"))),
            F.when(inside & (high % 2 == 1), F.struct(F.lit(1 << k).alias("width"), (high - 1).alias("node"))),
        ]

    return F.array_compact(F.array(*[n for k in range(days.bit_length()) for n in at(k)]))


def price_series(offers: DataFrame, history: DataFrame, now: datetime, days: int = 90) -> DataFrame:
    """PRC-4: (canonical_product_id, day, avg_price, low_price, offers) for each day of the window.

    A sweep over change points: an interval of an offer's level adds to its product's sum and count on its first day and
    takes the same away on the day after its last, and running totals give every day.  The lowest price cannot be taken
    away again, so an interval leaves its price at the few aligned ranges of days that make it up, and a day asks the
    ranges it lies in.  So offers leave a few rows each, whatever the window, and a product keeps some rows per day,
    whatever the number of its offers.
    """
    start = F.date_sub(F.to_date(F.lit(now).cast("timestamp")), days - 1)
    spans = materialize(_intervals(offers, history, now, days), "spans")
    exact = F.col("price").cast("decimal(20,4)")
    edges = F.array(
        F.struct(F.col("start").alias("d"), exact.alias("price"), F.lit(1).alias("n")), F.struct(F.col("stop").alias("d"), (-exact).alias("price"), F.lit(-1).alias("n"))
    )
    deltas = spans.select("canonical_product_id", F.inline(edges)).groupBy("canonical_product_id", "d").agg(F.sum("price").alias("price"), F.sum("n").alias("n"))
    # At most one row per product and day from here on.
    run = W.partitionBy("canonical_product_id").orderBy("d")
    levels = deltas.select(
        "canonical_product_id", "d", F.sum("price").over(run.rowsBetween(W.unboundedPreceding, 0)).alias("price"), F.sum("n").over(run.rowsBetween(W.unboundedPreceding, 0)).alias("n"),
        F.coalesce(F.lead("d").over(run), F.lit(days)).alias("until"),
    )
    totals = levels.where((F.col("n") > 0) & (F.col("d") < F.col("until"))).select(
        "canonical_product_id", F.explode(F.sequence(F.col("d"), F.col("until") - 1)).alias("d"), half_up(F.col("price").cast("double") / F.col("n"), 4).alias("avg_price"), F.col("n").alias("offers")
    )
    nodes = spans.select("canonical_product_id", "price", F.inline(_dyadic(days))).groupBy("canonical_product_id", "width", "node").agg(F.min("price").alias("price"))
    first = F.col("width") * F.col("node")
    covered = nodes.select("canonical_product_id", "price", F.explode(F.sequence(first, first + F.col("width") - 1)).alias("d"))
    lows = covered.groupBy("canonical_product_id", "d").agg(F.min("price").alias("low_price"))
    return totals.join(lows, ["canonical_product_id", "d"]).select("canonical_product_id", F.date_add(start, F.col("d")).alias("day"), "avg_price", "low_price", "offers")


def move_counts(offers: DataFrame, history: DataFrame, now: datetime, days: int = 90) -> DataFrame:
    """PRC-4: price moves per canonical in the window; below two the series is called sparse."""
    moved = history.where(
        (F.col("changed_at") >= _since(now, days)) & _price_differs(F.col("old_current_price"), F.col("new_current_price"))
    )
    per_offer = moved.groupBy("offer_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        offers.where(F.col("canonical_product_id").isNotNull())
        .join(per_offer, offers["id"] == per_offer["offer_id"], "left")
        .groupBy("canonical_product_id")
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("moves"))
        .withColumn("sparse", F.col("moves") < 2)
    )


def window_low(series: DataFrame) -> DataFrame:
    """PRC-5: the lowest price in the window against the last day's lowest price."""
    return (
        series.groupBy("canonical_product_id")
        .agg(F.min("low_price").alias("window_low"), F.max_by("low_price", "day").alias("current_low"))
        .withColumn("at_low", F.col("current_low") <= F.col("window_low") + SAME_PRICE)
    )


def revert_run_prices(offers: DataFrame, history: DataFrame, run_id: int, now: datetime) -> tuple[DataFrame, DataFrame]:
    """JOB-23: (offers with a run's price and stock changes put back, the compensating history rows)."""
    olds = [*["old_" + p for p in PRICES], "old_stock_status"]
    first = (
        history.where(F.col("import_run_id") == run_id)
        .groupBy(F.col("offer_id").alias("id"))
        .agg(F.min_by(F.struct(*olds), "id").alias("_old"))
    )
    joined = offers.join(first, "id", "left").withColumn("_hit", F.col("_old").isNotNull())
    fields = [*PRICES, "stock_status"]
    put_back = {
        c: F.when(F.col("_hit"), F.col(f"_old.old_{c}").cast(offers.schema[c].dataType)).otherwise(F.col(c)) for c in fields
    }
    reverted = joined.withColumns(put_back).select(*offers.columns)
    wide = joined.where("_hit").withColumns(
        {**{"o_" + c: F.col(c) for c in fields}, **{"n_" + c: F.col(f"_old.old_{c}") for c in fields}}
    )
    rows = wide.where(is_change("o_", "n_")).select(
        F.col("id").alias("offer_id"), F.lit(run_id).cast("bigint").alias("import_run_id"), *_history_columns("o_", "n_"),
        F.lit(now).cast("timestamp").alias("changed_at"),
    )
    return reverted, rows
