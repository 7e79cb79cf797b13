"""Benchmark passages against a plain search for word sequences."""

from __future__ import annotations

import re

import pytest

from pricebook.llm import decontaminate as d

from .data import ODD, ODD_IDS, frame, prose

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(text, items, width):
    """n_words, spans and items of one text by looking for every window everywhere."""
    words = WORDS.findall(lower(text))
    hit, named = [False] * len(words), set()
    for item, other in items:
        own = WORDS.findall(lower(other))
        size = min(width, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    hit[j : j + size] = [True] * size
                    if item is not None:
                        named.add(str(item))
    spans, at = [], 0
    while at < len(hit):
        to = at
        while to < len(hit) and hit[to]:
            to += 1
        if to > at:
            spans.append((at, to))
        at = max(to, at + 1)
    return len(words), spans, sorted(named)


ITEM = "Which of the Eleven answers, given in THIS long question, is the right one? Say 1 or 2."
ITEMS = [
    (2, ITEM), (10, "short one"), (11, ITEM[10:] + " more words that follow it here"), (None, "nameless item of six words"),
    (4, None), (5, " ?! "), (2, "another text of item two, which has more words than ten of them"), (12, "Zwei Wörter"), (10, "short one"), (13, "漢字"),
]
TEXTS = [
    *[t for t in ODD if t is None or len(t) < 20_000], ITEM, "before " + ITEM.upper().replace(" ", "--") + " after", ITEM[:60], "a SHORT\none. short one short",
    "x nameless item of six words y", ITEM + " " + ITEM, prose(7, 80) + ITEM[6:] + "\n" + prose(8, 80), "shortone", "short, one 漢字", "zwei Wörter, zwei wörter", "zwei WÖRTER",
]


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, spans string")


@pytest.mark.parametrize("most", [d.MOST, 60])
def test_marks(spark, most):
    got = d.mark(frame(spark, TEXTS), benchmark(spark), width=10, most=most).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        told = (r.n_words, [(s.start, s.end) for s in r.spans], list(r["items"]))
        assert told == plain(r.row.text, ITEMS, 10), r.row.text[:50]
        assert r.row.key == "k" and r.row.start == 7


def test_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    """Hashes that all fall on a few values: what is compared byte by byte decides."""
    real = d.Words.windows
    monkeypatch.setattr(d.Words, "windows", lambda self, w: ((x := real(self, w))[0], x[1] & d.np.uint64(3)))
    test = d.Benchmark.of([str(i) if i is not None else None for i, _ in ITEMS], [t for _, t in ITEMS], 10)
    assert test.ties > 3
    words = d.Words(d.pa.array([t or "" for t in TEXTS]), lower=True, space=d.APART)
    at, window = test.hits(words)
    for k, text in enumerate(TEXTS):
        own = window[words.doc[at] == k]
        named = {test.names[i] for w in own for i in test.item[test.first[w] : test.first[w + 1]]}
        assert sorted(named) == plain(text, ITEMS, 10)[2]


def test_spans_are_cut_and_documents_go(spark):
    docs = frame(spark, TEXTS)
    cut = d.decontaminate(docs, benchmark(spark))
    assert cut.columns == docs.columns
    rows = {r.doc_id: r for r in cut.collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        spans = plain(text, ITEMS, 10)[1]
        if not spans:
            assert rows[i].text == text
            continue
        at = [m.span() for m in WORDS.finditer(lower(text))]
        left, to = "", 0
        for a, b in spans:
            left += text[to : at[a][0]]
            to = at[b - 1][1]
        assert rows[i].text == left + text[to:]
    kept = {r.doc_id for r in d.decontaminate(docs, benchmark(spark), remove="documents").collect()}
    assert kept == {i for i, t in enumerate(TEXTS) if not plain(t, ITEMS, 10)[1]}


def test_empty_tables_nulls_and_repeated_ids(spark):
    docs = frame(spark, ODD, ids=ODD_IDS)
    none = d.mark(docs, benchmark(spark, []).limit(0)).collect()
    assert len(none) == len(ODD) and all(not r.spans and not r["items"] for r in none)
    assert [r.n_words for r in none] == [len(WORDS.findall(lower(r.row.text))) for r in none]
    assert sorted(str(r.row.doc_id) for r in none) == sorted(map(str, ODD_IDS))
    assert d.decontaminate(docs.limit(0), benchmark(spark)).collect() == []
    # A very long text, of which the last words are an item.
    long = ODD[8] + " " + ITEM
    (got,) = d.mark(frame(spark, [long]), benchmark(spark)).collect()
    assert got["items"] == ["11", "2"] and len(got.spans) >= 1 and got.spans[-1].end == got.n_words
