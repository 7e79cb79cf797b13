"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from pricebook.llm.spelling import near_words, variants, word_counts

from .data import ODD, ODD_IDS, frame, prose


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(words, times=10):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return out


def vocabulary(seed=5, size=300):
    """Words of few letters, so that many are near each other, with repeated letters, long ones and chains of counts."""
    r = random.Random(seed)
    words = {}
    for _ in range(size):
        w = "".join(r.choice("abé") for _ in range(r.randint(1, 7)))
        words[w] = r.choice([1, 2, 3, 20, 40, 500, 9000])
        i = r.randrange(len(w))
        words[w[:i] + r.choice("abcé") + w[i:]] = r.choice([1, 2, 30, 400])
    words |= {"z" * 5000: 2, "z" * 4999: 70, "z" * 5001: 700, "z" * 2500 + "y" + "z" * 2499: 1}
    words |= {"chainchain" + "x" * k: 10**k for k in range(7)}
    return words


@pytest.mark.parametrize("few", [1, 64, 10**9])
def test_all_pairs_and_forms(spark, few):
    words = vocabulary()
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = [(r.a, r.b) for r in near_words(df, few).collect()]
    want = {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
    assert len(pairs) == len(want) and {frozenset(p) for p in pairs} == want
    got = {tuple(r) for r in variants(df, few=few).collect()}
    assert got == plain(words)


def test_crowded_key(spark):
    """One half shared by thousands of words, hardly any two of them near each other."""
    r = random.Random(1)
    words = {"prefix" + "".join(r.choice("abcdefghij") for _ in range(6)): r.randint(1, 50) for _ in range(1500)}
    words |= {"prefix" + "".join(r.choice("abcdefghij") for _ in range(5)): r.randint(1, 50) for _ in range(500)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    less = {}
    for w in words:
        for i in range(len(w)):
            less.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    want = {frozenset((a, b)) for group in less.values() for a in group for b in group if a != b}
    want |= {frozenset((w, x)) for (_, x), group in less.items() if x in words for w in group if w != x}
    assert {frozenset((p.a, p.b)) for p in near_words(df).collect()} == want


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def test_counts_of_words(spark):
    texts = [*ODD, "Éclairage Éclairage éclairage ECLAIRAGES", "wordsix, seventy seventy SEVENTY × ÷×÷×÷×÷ ÷×÷×÷×÷", prose(11, 4000, 60)]
    ids = [*ODD_IDS, 62, None, 100]
    count = Counter()
    for i, t in zip(ids, texts, strict=True):
        for run in RUN.findall(t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 3 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    got = {r.word: r.n for r in word_counts(frame(spark, texts, ids=ids), every=3).collect()}
    assert got == {w: n for w, n in count.items() if n >= 2}


def test_empty_tables(spark):
    assert word_counts(frame(spark, ODD).limit(0)).collect() == []
    assert word_counts(frame(spark, [None, "", "a b c"])).collect() == []
    none = spark.createDataFrame([], "word string, n long")
    assert variants(none).collect() == []
    alone = spark.createDataFrame([("alone", 3)], "word string, n long")
    assert [tuple(r) for r in variants(alone).collect()] == [("alone", 3, 0, None, None, "alone")]
    with pytest.raises(ValueError):
        variants(alone, times=1)
