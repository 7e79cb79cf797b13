"""Rows with nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""

from __future__ import annotations

import random
import re

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, start long, n long, v long, key string, "
    "row string, hashes string, bucket long, words long, kept boolean, copies long, l_id long, label long, margin double"
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(texts, langs=("en", "de", None), sources=("b", "a", None), ids=None):
    """Documents of the given texts with every further column filled with something of another meaning."""
    ids = list(range(len(texts))) if ids is None else ids
    return [
        (i, t, langs[k % len(langs)], sources[k % len(sources)], len(t or ""), 7, 7, 7, 7, "k", "r", "h", 7, 7, True, 7, 7, 7, 0.5)
        for k, (i, t) in enumerate(zip(ids, texts, strict=True))
    ]


def frame(spark, texts, **named):
    return spark.createDataFrame(rows(texts, **named), SCHEMA)


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(2 + k % 7)) for k in range(vocabulary)]
    out = []
    for k in range(n):
        out.append(r.choice(words))
        out.append("\n" if r.random() < 0.03 else " " if r.random() < 0.99 else " \t ")
    return "".join(out)


LONG = prose(1, 30_000, 5_000)
#: Every kind of row that the operators must take.
ODD = [None, "", " \n\t ", "one", "Zwei Wörter", prose(2, 60), prose(2, 60), "a" * 5_000, LONG, "é ñ ß 漢字 🙂 x", "x " * 300, prose(3, 200)]
ODD_IDS = [4, 3, 9, 1, 1, 12, 30, None, 7, 8, None, 2]
