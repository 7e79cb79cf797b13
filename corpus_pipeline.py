"""The corpus pipeline: toxicity, near duplicates, secrets, mixing, packing."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pricebook.llm.base import WORD, documents, tokenizer  # noqa: E402
from pricebook.llm.mixing import mix  # noqa: E402
from pricebook.llm.near import near_sets  # noqa: E402
from pricebook.llm.packing import pack  # noqa: E402
from pricebook.llm.secrets import scan  # noqa: E402
from pricebook.llm.toxicity import fit, score  # noqa: E402
from pricebook.llm.toxicity_queries import labels  # noqa: E402
from pricebook.session import materialize  # noqa: E402

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: What takes the place of a secret.
REDACTED = "[secret]"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer calls toxic go; it learns from the labelled documents of the training folds."""
    told = score(docs, fit(docs, labels(spark, sf_dir)))
    return told.filter("toxicity < 0.5").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that of the smallest id (five-word shingles, similarity 0.8).

    A row is known by its id and a hash of its text, so rows with one id and different texts are judged each for itself, and
    rows without an id take part like others (and stay only where their whole group has no id).  Rows without words stay.
    """
    text = F.xxhash64("text")
    groups = near_sets(docs, width=5, percent=80, keep={"content": text}).filter("root IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "content"))
    stay = materialize(groups.groupBy("root").agg(first.alias("f")).select(F.col("f.doc_id").alias("s_id"), F.col("f.content").alias("s_content")), "stay")
    wordy = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("doc_id").alias("k_id"), text.alias("k_content"), wordy.alias("wordy"))
    named = rows.filter("wordy").join(stay, F.col("k_id").eqNullSafe(F.col("s_id")) & (F.col("k_content") == F.col("s_content")))
    # Repeated rows of the one that stays are one document.
    return named.dropDuplicates(["k_id", "k_content"]).select("row.*").union(rows.filter("NOT wordy").select("row.*"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the secrets in them are blotted out."""
    clean = scan(docs, redact=REDACTED).select(*docs.columns)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: 0 to 3 times."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 tokens of what is left; the last stage returns the pieces with their ids."""
    return pack(docs, tokenizer(), size=1024)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: Models and tokenizer ids are beyond SQL; a small fixture is held against a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else materialize(out, f"pipeline-{name}")
    return docs
