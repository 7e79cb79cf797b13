"""Spelling variants: words that differ by exactly one inserted, deleted or replaced code point, by asymmetric q-chunks.

Of two such words the longer one (either, if they are as long) contributes two disjoint chunks, its first and its second
half; the other contributes its positional grams as long as those.  One edit leaves one chunk as it is: the first at its
place, the second moved by at most one.  So only the grams within shift one of a chunk are made, and an equality join
of chunks and grams finds every pair; candidates are then verified.

Scale: what two words share is a key of 64 bits.  A key with many words is not paired.  Its words agree in one
chunk, so the edit lies in the rest, and the rest is cut into two chunks again, and so on until it is one code point
long, where all words of a key are near each other and their number is bounded by the alphabet.  So the candidates
stay in proportion to words and links, no key is gathered in one task, and no link is lost.  Counts combine before the
shuffle.  Between rounds the rows are a written table, and one count reaches the driver; there are as many rounds as
halvings of the longest word, at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pricebook.session import materialize

#: Pairs of a key that are compared at once; beyond it the rest is cut again.
FEW = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def typos(doc_id: Column, run: Column, every: int = 31) -> Column:
    """The run without one code point if ``every`` divides the crc32 of ``<doc_id>:<run>``, else the run (a null id counts as '')."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, every: int = 31, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the distinct words of all texts with their occurrences, lower-cased in A-Z, after ``typos``."""
    # Shorter runs cannot become words, so they are not taken out of the text.
    runs = F.regexp_extract_all(F.translate(F.col(text).cast("string"), UPPER, LOWER), F.lit(rf"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(runs).alias("run"))
    words = rows.select(typos(F.col("doc_id"), F.col("run"), every).alias("word")).filter(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Each row once for each half of its rest [lo, hi): the half in which the edit may lie; the key is all beside it.

    ``size`` is the length of the longer word of a pair; a row of a word that is one shorter ends its rest one earlier.
    """
    mid = F.expr("(lo + hi) div 2").cast("int")
    halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))
    rows = rows.withColumn("half", F.explode(halves)).select("word", "n", "size", F.col("half.lo").alias("lo"), F.col("half.hi").alias("hi"))
    before = F.substring("word", F.lit(1), F.col("lo"))
    after = F.substring("word", F.char_length("word") - F.col("size") + F.col("hi") + 1, F.col("size"))
    return rows.filter("hi > lo").withColumn("key", F.xxhash64("size", "lo", "hi", before, after))


def near_words(words: DataFrame, few: int = FEW) -> DataFrame:
    """(a, n_a, b, n_b): every pair of words of (word, n) at distance one, once; a is the longer or smaller one.

    The words are distinct and not empty; null words are left out.
    """
    word = words.filter("length(word) > 0").select("word", "n", F.char_length("word").alias("len"))
    long = word.select("word", "n", F.col("len").alias("size"), F.lit(0).alias("lo"), F.col("len").alias("hi"))
    short = word.select("word", "n", (F.col("len") + 1).alias("size"), F.lit(0).alias("lo"), (F.col("len") + 1).alias("hi"))
    rows, found = long.union(short), []
    while True:
        full = F.char_length("word") == F.col("size")
        keyed = _keyed(rows)
        count = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("all_rows"), F.count(F.when(full, 1)).alias("full_rows")).filter("all_rows > 1 AND full_rows > 0")
        met = materialize(keyed.join(count, "key").withColumn("full", full), "chunks")
        many = (F.col("all_rows") * F.col("full_rows") > few) & (F.col("hi") - F.col("lo") > 1)
        small = met.filter(~many)
        a = small.filter("full").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"), "size", "lo", "hi")
        b = small.select(F.col("key").alias("b_key"), F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("size").alias("b_size"), "full")
        pairs = a.join(b, (F.col("key") == F.col("b_key")) & (F.col("size") == F.col("b_size")) & (~F.col("full") | (F.col("a") < F.col("b"))))
        # A pair may share several keys, if a letter of a run is left out: the place of the first difference decides.
        first = F.substring("a", F.lit(1), F.col("hi")) != F.substring("b", F.lit(1), F.col("hi"))
        same = F.substring("a", F.lit(1), F.col("lo")) == F.substring("b", F.lit(1), F.col("lo"))
        found.append(pairs.filter(first & same & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b"))
        rows = met.filter(many).select("word", "n", "size", "lo", "hi")
        if rows.isEmpty():
            return reduce(DataFrame.union, found)


def variants(words: DataFrame, times: int = 10, few: int = FEW) -> DataFrame:
    """word, n, n_near, form, form_n, root for each row of (word, n).

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if that n is at least ``times`` the
    word's own, else null; ``root`` is the last word reached by following forms, the word itself without any.
    ``times`` is 2 or more: n grows with each step, so there is no circle and a chain has fewer steps than n has bits.
    No words give no rows.
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    pairs = materialize(near_words(words, few), "near-words")
    both = pairs.select(F.col("a").alias("of"), F.col("b").alias("other"), F.col("n_b").alias("other_n"))
    both = both.union(pairs.select(F.col("b"), F.col("a"), F.col("n_a")))
    best = both.groupBy("of").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    rows = words.join(best, words.word == best.of, "left").select(
        words.word, words.n, F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n")
    )
    formed = F.col("other_n") >= times * F.col("n")
    rows = rows.select("word", "n", "n_near", F.when(formed, F.col("other")).alias("form"), F.when(formed, F.col("other_n")).alias("form_n"))
    rows = materialize(rows, "forms")
    # Pointers are doubled until no one can be followed further: 64 bits of n allow six doublings at most.
    roots = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = roots.select(F.col("word").alias("via"), F.col("root").alias("next"))
        step = roots.join(on, F.col("root") == F.col("via"), "left")
        step = materialize(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    roots = roots.select(F.col("word").alias("r_word"), "root")
    return rows.join(roots, F.col("word") == F.col("r_word"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
