"""Click analytics (AGG-7..9, WIN-2, JOIN-22, FIL-13, ORD-7)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import text
from ..plans.ordered import top_n

# Fixed value: user agents of programs.
BOT_WORDS = (
    r"(?i)bot|crawler|spider|scraper|wget|curl|libwww|python-?(?:requests|urllib)|node-fetch|axios|java/|go-http-client"
    r"|headless|phantom|puppeteer|playwright|googlebot|bingbot|slurp|duckduckbot|baiduspider|yandex|facebookexternalhit"
    r"|twitterbot|linkedinbot|whatsapp|telegrambot|preview"
)


def is_bot_ua(c: Column) -> Column:
    """FIL-13: no user agent, or one that names a program."""
    return (text(c) == "") | text(c).rlike(BOT_WORDS)


def window_start(name: str, now: datetime) -> datetime | None:
    """AGG-9: the start of today, 7d or 30d; None for all."""
    if name == "today":
        return now.replace(hour=0, minute=0, second=0, microsecond=0)
    days = {"7d": 7, "30d": 30}.get(name)
    return now - timedelta(days=days) if days else None


def in_window(clicks: DataFrame, since: datetime | None) -> DataFrame:
    return clicks if since is None else clicks.where(F.col("clicked_at") >= F.lit(since).cast("timestamp"))


def click_totals(clicks: DataFrame, since: datetime | None = None) -> DataFrame:
    """AGG-7: all, human and bot clicks."""
    bot = F.coalesce(F.col("is_bot_suspected"), F.lit(False))
    return in_window(clicks, since).agg(
        F.count(F.lit(1)).alias("clicks"), F.count_if(~bot).alias("human"), F.count_if(bot).alias("bot")
    )


def top_clicks(clicks: DataFrame, by: str, since: datetime | None = None, n: int = 10, include_bots: bool = False) -> DataFrame:
    """AGG-8: the most clicked offers, merchants or canonical products (``by`` is the id column)."""
    rows = in_window(clicks, since)
    if not include_bots:
        rows = rows.where(~F.coalesce(F.col("is_bot_suspected"), F.lit(False)))
    if by == "canonical_product_id":
        rows = rows.where(F.col(by).isNotNull())
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("clicks")).orderBy(F.desc("clicks"), F.asc_nulls_last(by)).limit(n)


def clicks_with_names(counted: DataFrame, by: str, dim: DataFrame, names: dict[str, str]) -> DataFrame:
    """JOIN-22: names for counted clicks; clicks of deleted entities stay.

    ``names`` maps columns of ``dim`` to output names.
    """
    d = dim.select(F.col("id").alias(by), *[F.col(k).alias(v) for k, v in names.items()])
    return counted.join(d, by, "left")


def flag_rapid_fire(clicks: DataFrame, seconds: int = 60, threshold: int = 10, by: str = "ip_hash", earlier: DataFrame | None = None) -> DataFrame:
    """WIN-2: add rapid_fire: at least ``threshold`` earlier clicks of the same visitor within ``seconds``.

    Clicks first shrink to counts per visitor and second; these are cut into time
    ranges, so the sliding sum never sees a visitor's whole history.  Inside one
    second the click ids decide who came earlier, and only the first ``threshold``
    ids of a second are needed for that.  A click without a visitor is nobody's and
    never flagged.  ``earlier`` (the visitor column, second, n) counts clicks that
    arrived before all of these.
    """
    second = F.unix_timestamp("clicked_at")
    keyed = clicks.withColumn("_s", second)
    known = keyed.where(F.col(by).isNotNull())
    zero = F.lit(0).cast("bigint")
    per_second = known.groupBy(by, "_s").agg(F.count(F.lit(1)).alias("_n"), zero.alias("_old"))
    if earlier is not None:
        old = earlier.where(F.col(by).isNotNull()).select(by, F.col("second").alias("_s"), zero.alias("_n"), F.col("n").alias("_old"))
        per_second = per_second.unionByName(old).groupBy(by, "_s").agg(F.sum("_n").alias("_n"), F.sum("_old").alias("_old"))
    span = max(seconds, 1) * 16
    # Each second also takes part in the ranges that look back on it.
    home = F.floor(F.col("_s") / span)
    last_seen_from = F.floor((F.col("_s") + seconds) / span)
    copies = per_second.withColumn("_home", home).withColumn("_range", F.explode(F.sequence(home, last_seen_from)))
    back = W.partitionBy(by, "_range").orderBy("_s").rangeBetween(-seconds, -1)
    before = (
        copies.withColumn("_before", F.coalesce(F.sum(F.col("_n") + F.col("_old")).over(back), F.lit(0)) + F.col("_old"))
        .where((F.col("_range") == F.col("_home")) & (F.col("_n") > 0))
        .select(by, "_s", "_before")
    )
    first_ids = (
        top_n(known.select(by, "_s", "id"), [by, "_s"], [F.col("id")], threshold)
        .groupBy(by, "_s")
        .agg(F.array_sort(F.collect_list("id")).alias("_ids"))
    )
    # How many clicks of its own second may pass before the limit is reached.
    room = F.lit(threshold) - F.col("_before")
    limits = before.join(first_ids, [by, "_s"]).select(
        by,
        "_s",
        F.when(room <= 0, F.lit(True)).otherwise(F.lit(False)).alias("_all"),
        F.when(room > 0, F.get("_ids", (room - 1).cast("int"))).alias("_after_id"),
    )
    flagged = F.coalesce(F.col("_all"), F.lit(False)) | F.coalesce(F.col("id") > F.col("_after_id"), F.lit(False))
    return keyed.join(limits, [by, "_s"], "left").withColumn("rapid_fire", flagged).select(*clicks.columns, "rapid_fire")


def mark_bots(clicks: DataFrame, seconds: int = 60, threshold: int = 10) -> DataFrame:
    """The bot flag as the click log stores it: a program's user agent, or rapid fire."""
    flagged = flag_rapid_fire(clicks, seconds, threshold)
    return flagged.withColumn("is_bot_suspected", is_bot_ua(F.col("user_agent")) | F.col("rapid_fire")).drop("rapid_fire")


def recent(df: DataFrame, n: int = 50, order: str = "id") -> DataFrame:
    """ORD-7: the newest rows."""
    return df.orderBy(F.desc(order)).limit(n)
