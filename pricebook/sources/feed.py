"""Offer feeds and catalog files in CSV form (SRC-1..4, SET-6)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import blank, json_list_or_words, text
from ..operators.validate import clean_canonicals, clean_ingredients, missing_columns
from ..schemas import FEED_REQUIRED


@dataclass
class FeedReport:
    """What a feed file looks like as a whole; ``fatal`` is set when it cannot be imported."""

    header: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    fatal: str | None = None


def _read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, list[str]]:
    """Every cell as text, cells trimmed of nothing, short lines padded, unnamed columns dropped.

    Several files must have one header, without unnamed columns: another order or other
    names are an error when the rows are read, as cells would land in wrong columns.
    Without line breaks in cells ``multi_line=False`` lets large files be split.
    """
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("encoding", "UTF-8")
    )
    raw = reader.csv(path)
    if len(raw.inputFiles()) > 1:
        raw = reader.option("enforceSchema", False).csv(path)
    names = [c.lstrip("﻿").strip() for c in raw.columns]
    kept = [(old, new) for i, (old, new) in enumerate(zip(raw.columns, names)) if new and new != f"_c{i}"]
    # Rows of a file sit in one task in file order, so the row id minus the file's first id numbers them.
    tagged = raw.select(
        *[text(F.col(f"`{old}`")).alias(new) for old, new in kept],
        F.col("_metadata.file_path").alias("_file"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return tagged, [new for _, new in kept]


def _numbered(df: DataFrame) -> DataFrame:
    """Add row_num per file, the header being row 1; blank lines are not counted."""
    # One row per file is sent to the rows; dealt out by file, a file's rows would all go to one task again.
    firsts = df.groupBy("_file").agg(F.min("_row").alias("_first"))
    return (
        df.join(F.broadcast(firsts), "_file")
        .withColumn("row_num", (F.col("_row") - F.col("_first") + 2).cast("bigint"))
        .drop("_file", "_row", "_first")
    )


def read_offer_feed(spark: SparkSession, path: str, max_rows: int | None = None) -> tuple[DataFrame, FeedReport]:
    """SRC-1: (rows with row_num, report).  ``max_rows`` makes a longer feed fatal instead of cutting it."""
    df, header = _read_csv(spark, path)
    report = FeedReport(header, missing_columns(header, FEED_REQUIRED))
    if report.missing:
        report.fatal = "missing required column(s): " + ", ".join(report.missing)
    elif max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        report.fatal = f"more than {max_rows} data rows"
    return _numbered(df), report


def feed_metadata(df: DataFrame) -> DataFrame:
    """SRC-2: one row: the first non-empty export_run_id and exported_at."""

    def first(name: str):
        value = F.trim(text(F.col(name)))
        return F.min(F.when(value != "", F.struct(F.col("row_num"), value.alias("v"))))

    found = df.agg(first("export_run_id").alias("_r"), first("exported_at").alias("_e"))
    return found.select(
        F.col("_r.v").alias("export_run_id"), F.try_to_timestamp(F.col("_e.v")).alias("exported_at")
    )


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """SET-6: rows of several sources as one feed; columns a source lacks are blank."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds).na.fill("")


def read_ingredients(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: cleaned ingredient rows, ready for an upsert by slug."""
    df, header = _read_csv(spark, path)
    if "slug" not in header:
        raise ValueError("required column slug is missing")
    df = _numbered(df)
    if "aliases" in header:
        df = df.withColumn("aliases", json_list_or_words(F.col("aliases")))
    return clean_ingredients(df).where(~blank(F.col("slug")))


def read_canonicals(spark: SparkSession, path: str, ingredients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-4: (good rows with ingredient_id, rows whose ingredient slug is unknown)."""
    df, header = _read_csv(spark, path)
    if "slug" not in header or "ingredient_slug" not in header:
        raise ValueError("required column slug or ingredient_slug is missing")
    dims = ingredients.select(F.col("slug").alias("ingredient_slug"), F.col("id").alias("ingredient_id"))
    joined = clean_canonicals(_numbered(df)).join(dims, "ingredient_slug", "left").where(~blank(F.col("slug")))
    bad = joined.where(F.col("ingredient_id").isNull()).select(
        "row_num", "slug", F.concat(F.lit("unknown ingredient: "), F.col("ingredient_slug")).alias("error")
    )
    return joined.where(F.col("ingredient_id").isNotNull()), bad
