"""Quality rules: fixed counts, and robust multivariate outliers by minimum-covariance-determinant estimates.

All of it is DataFrame and SQL functions.  Each document gets a vector of transformed statistics.  Per language and
source a centre and a covariance are fitted to the ``share`` of documents that lie closest: starting from medians and
median absolute deviations, each concentration step keeps the documents up to that quantile of the Mahalanobis
distance and fits again, until the covariance's determinant stops falling.  A document beyond ``cut`` is rejected.

Every step is an aggregate that combines before the shuffle, over a narrow table of statistics written once, joined
with one small row per group; a language or source of any size is summed up in parts.  Groups of fewer than ``least``
documents are fitted together per language, and what is still too small over all languages.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from pricebook.session import materialize

SPACES = r"[\x20\x09-\x0D]+"
#: Statistic -> the spread that counts as none: it is added to the fitted one, so that a statistic that is zero in
#: nearly all documents does not make every other value an outlier.
STATISTICS = {"log_words": 0.3, "log_word_chars": 0.08, "root_symbols": 0.03, "root_upper": 0.05, "root_dup_lines": 0.15}
DIMENSIONS = list(STATISTICS)


def chi_square(p: int, z: float) -> float:
    """The quantile of a chi-square law of ``p`` degrees at a normal deviate ``z`` (Wilson and Hilferty)."""
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


#: The 0.999 quantile.
CUT = chi_square(len(DIMENSIONS), 3.0902)
#: A fit goes on while a step lowers the logarithm of the covariance's determinant by more than this.
STILL = 1e-3
#: Groups whose fits (a few hundred bytes each) are broadcast.
GROUPS = 10_000


def with_counts(rows: DataFrame, width: int = 5) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_upper of the column ``text`` (null: all 0)."""
    text = F.coalesce("text", F.lit(""))
    rows = rows.withColumn("words", F.array_remove(F.split(text, SPACES), ""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        *(c for c in rows.columns if c not in ("words", "text")),
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    window = F.transform(F.sequence(F.lit(0), F.size("hashes") - width), lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(width))))
    rows = rows.withColumn("windows", F.when(F.size("hashes") >= width, window).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines", "hashes")
    # Only texts with a window found twice have their windows sorted.
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.when(twice, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("placed", placed).drop("windows")

    def repeated(p: Column, i: Column) -> Column:
        same = (F.get("placed", i - 1)["h"] == p["h"]) | (F.get("placed", i + 1)["h"] == p["h"])
        return F.when(same, p["i"])

    rows = rows.withColumn("found", F.array_sort(F.array_compact(F.transform("placed", repeated)))).drop("placed")
    # A repeated window adds the words up to the next one.
    steps = F.transform("found", lambda i, k: F.least(F.lit(width), F.coalesce(F.get("found", k + 1) - i, F.lit(width))))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("found")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vector() -> list[Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log1p("n_words").alias("log_words"),
        F.log(chars / words).alias("log_word_chars"),
        F.sqrt(F.col("n_symbols") / chars).alias("root_symbols"),
        F.sqrt(F.col("n_upper") / chars).alias("root_upper"),
        F.sqrt(F.least(F.lit(1.0), 10 * F.col("n_dup_lines") / words)).alias("root_dup_lines"),
    ]


def _named(prefix: str, *at: int) -> str:
    return "_".join([prefix, *map(str, at)])


def _cholesky(rows: DataFrame) -> DataFrame:
    """From columns s_i_j (lower triangle) to the columns l_i_j of the triangular root."""
    p = len(DIMENSIONS)
    for j in range(p):
        for i in range(j, p):
            rest = F.col(_named("s", i, j))
            for k in range(j):
                rest = rest - F.col(_named("l", i, k)) * F.col(_named("l", j, k))
            rows = rows.withColumn(_named("l", i, j), F.sqrt(rest) if i == j else rest / F.col(_named("l", j, j)))
    return rows.select("g", *(_named("m", i) for i in range(p)), *(_named("l", i, j) for i in range(p) for j in range(i + 1)))


def _distance() -> Column:
    """The squared Mahalanobis distance by forward substitution."""
    solved: list[Column] = []
    for i, name in enumerate(DIMENSIONS):
        rest = F.col(name) - F.col(_named("m", i))
        for k in range(i):
            rest = rest - F.col(_named("l", i, k)) * solved[k]
        solved.append(rest / F.col(_named("l", i, i)))
    return sum((y * y for y in solved[1:]), solved[0] * solved[0])


def _with_fit(rows: DataFrame, fit: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the fit of their group.  A written fit has one row per group and is broadcast if there are few groups, so
    that a large group is not gathered by its join; beyond ``GROUPS`` of them Spark joins and splits as it sees fit."""
    return rows.join(F.broadcast(fit) if fit.count() <= GROUPS else fit, "g", how)


def _start(rows: DataFrame) -> DataFrame:
    """Medians, and median absolute deviations as a diagonal covariance."""
    p = len(DIMENSIONS)
    medians = materialize(rows.groupBy("g").agg(*(F.percentile_approx(d, 0.5).alias(_named("m", i)) for i, d in enumerate(DIMENSIONS))), "fit")
    spread = _with_fit(rows, medians).groupBy("g").agg(
        *(F.first(_named("m", i)).alias(_named("m", i)) for i in range(p)),
        *(F.percentile_approx(F.abs(F.col(d) - F.col(_named("m", i))), 0.5).alias(_named("d", i)) for i, d in enumerate(DIMENSIONS)),
    )
    cells = []
    for i, name in enumerate(DIMENSIONS):
        for j in range(i + 1):
            cells.append((F.pow(1.4826 * F.col(_named("d", i)), 2) + STATISTICS[name] ** 2 if i == j else F.lit(0.0)).alias(_named("s", i, j)))
    return _cholesky(spread.select("g", *(_named("m", i) for i in range(p)), *cells))


def _step(rows: DataFrame, fit: DataFrame, share: float) -> DataFrame:
    """One concentration step: the closest documents of each group, fitted again."""
    p = len(DIMENSIONS)
    near = _with_fit(rows, fit).select("g", *DIMENSIONS, _distance().alias("d2"))
    bound = materialize(near.groupBy("g").agg(F.percentile_approx("d2", share).alias("bound")), "fit")
    near = _with_fit(near, bound).filter("d2 <= bound")
    fitted = near.groupBy("g").agg(
        *(F.avg(d).alias(_named("m", i)) for i, d in enumerate(DIMENSIONS)),
        *(F.covar_pop(DIMENSIONS[i], DIMENSIONS[j]).alias(_named("c", i, j)) for i in range(p) for j in range(i + 1)),
    )
    cells = []
    for i, name in enumerate(DIMENSIONS):
        for j in range(i + 1):
            cells.append((F.col(_named("c", i, j)) + (STATISTICS[name] ** 2 if i == j else 0.0)).alias(_named("s", i, j)))
    return _cholesky(fitted.select("g", *(_named("m", i) for i in range(p)), *cells))


def _fitted(rows: DataFrame, share: float) -> DataFrame:
    """Concentration steps until no group's determinant falls; a group whose own has stopped takes no further part.

    The floors bound the determinants from below, so the steps end.
    """
    p = len(DIMENSIONS)
    names = ["g", *(_named("m", i) for i in range(p)), *(_named("l", i, j) for i in range(p) for j in range(i + 1))]
    size = sum((F.log(_named("l", i, i)) for i in range(1, p)), F.log(_named("l", 0, 0))) * 2
    # The start's covariance is not of a share of the documents; the first step is always taken.
    going = materialize(_step(rows, materialize(_start(rows), "fit"), share), "fit")
    done: DataFrame | None = None
    while True:
        new = _step(rows, going, share).withColumn("size", size)
        old = going.select("g", size.alias("before"))
        new = materialize(new.join(old, "g").withColumn("falls", F.col("size") < F.col("before") - STILL), "fit")
        stopped = going.join(new.filter("NOT falls").select("g"), "g", "left_semi")
        done = materialize(stopped if done is None else done.union(stopped.select(*done.columns)), "fit")
        going = materialize(new.filter("falls").select(*names), "fit")
        if going.isEmpty():
            return done.select(*names)


def judge(docs: DataFrame, share: float = 0.75, cut: float = CUT, least: int = 100, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row: doc_id, lang, source, the counts, base_failed, distance (squared, robust) and kept.

    A null text has no words and fails.  Null languages and sources are groups of their own.  Documents that fail the
    base rules are not fitted and have no say in the estimates.  Repeated rows count as often as they occur; no rows
    give no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    told = materialize(with_counts(rows).withColumn("base_failed", base_failed()), "counts")
    size = told.filter("NOT base_failed").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    # Which fit a group has part in: its own, its language's, or the one of all that is left.
    by_lang = size.withColumn("few", F.when(F.col("n") < least, F.col("n")).otherwise(0)).groupBy("lang").agg(F.sum("few").alias("few"))
    null = F.lit("\x00")
    own = F.concat_ws("\x1f", F.lit("own"), F.coalesce("lang", null), F.coalesce("source", null))
    groups = size.withColumnRenamed("lang", "g_lang").withColumnRenamed("source", "g_source")
    langs = by_lang.withColumnRenamed("lang", "l_lang")
    told = told.join(groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    told = told.join(langs, F.col("lang").eqNullSafe(F.col("l_lang")), "left")
    g = F.when(F.col("n") >= least, own).when(F.col("few") >= least, F.concat_ws("\x1f", F.lit("lang"), F.coalesce("lang", null))).otherwise(F.lit("rest"))
    columns = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    told = materialize(told.select(*columns, *_vector(), g.alias("g")), "statistics")
    good = told.filter("NOT base_failed")
    fit = materialize(_fitted(good, share), "fit")
    measured = _with_fit(told, fit, "left").withColumn("distance", _distance())
    # The fit covers the closest part of a group: its scale is mended so that the median is at most that of a normal
    # law. It may be less, as a statistic that hardly varies beside its floor adds nothing.
    middle = _with_fit(good, fit).groupBy("g").agg(F.percentile_approx(_distance(), 0.5).alias("middle"))
    scale = F.greatest(F.lit(1.0), F.coalesce("middle", F.lit(0.0)) / chi_square(len(DIMENSIONS), 0.0))
    measured = _with_fit(measured, materialize(middle, "fit"), "left").withColumn("distance", F.col("distance") / scale)
    return measured.select(*columns, "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)).alias("kept"))
