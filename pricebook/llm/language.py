"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  A trigram's vector binds the letters'
vectors, each permuted (rotated) by its place, by multiplying them; a text's profile bundles (adds up) the vectors of
its trigrams.  A language's prototype bundles the profiles of its labelled texts, each text weighing by the root of
its length.  A text gets the language whose prototype has the largest cosine with its profile, prototypes being
centred on their mean.

Two map-only passes over the texts.  Tasks add up one vector per language; only these, dimension by dimension, are
shuffled and added.  What reaches the driver and goes out to the tasks is one vector per language of ``DIM`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .tokens import slices

DIM = 512
#: Bytes of text bundled at once.
RUN_BYTES = 400_000
#: Trigrams multiplied at once: bounds the memory where an alphabet is large.
BLOCK = 4096


def letter_vectors(letters: np.ndarray, dim: int) -> np.ndarray:
    """The vectors of code points: bits of a mixed counter, the same in every task."""
    words = np.arange(dim // 64, dtype=np.uint64)[None, :]
    x = letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (words + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    bits = np.unpackbits(x.view(np.uint8), axis=1)
    return bits.astype(np.float32) * 2 - 1


class Trigrams:
    """The trigrams of a run of texts: distinct ones, and how often each text has each of them."""

    def __init__(self, texts: pa.Array):
        low = pc.utf8_lower(pc.fill_null(texts, ""))
        points = np.frombuffer("".join(f"\n{t}\n" for t in low.to_pylist()).encode("utf-32-le"), "<u4")
        length = pc.utf8_length(low).to_numpy().astype(np.int64) + 2
        doc = np.repeat(np.arange(len(length)), length)
        # All that is no letter is one space; several of them in a row are one.
        top = int(points.max(initial=32)) + 1
        present = np.flatnonzero(np.bincount(points, minlength=top)) if top < 1 << 21 else np.unique(points)
        letter = np.array([chr(c).isalpha() for c in present.tolist()], bool)
        self.letters = np.concatenate([[32], present[letter]]).astype(np.int64)
        code = np.zeros(top, np.int64)
        code[present[letter]] = np.arange(1, len(self.letters))
        code = code[points]
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] > 0) | (code[:-1] > 0) | (doc[1:] != doc[:-1])
        code, doc = code[keep], doc[keep]
        self.has_letter = np.bincount(doc[code > 0], minlength=len(length)) > 0
        n = len(self.letters)
        same = doc[2:] == doc[:-2] if len(doc) > 2 else np.zeros(0, bool)
        key = ((code[:-2] * n + code[1:-1]) * n + code[2:])[same] if len(doc) > 2 else np.zeros(0, np.int64)
        self.doc = doc[2:][same] if len(doc) > 2 else np.zeros(0, np.int64)
        if n**3 <= 1 << 20:
            there = np.bincount(key, minlength=1)
            self.keys = np.flatnonzero(there)
            at = np.zeros(len(there), np.int64)
            at[self.keys] = np.arange(len(self.keys))
            self.index = at[key]
        else:
            self.keys, self.index = np.unique(key, return_inverse=True)
        self.rows = len(length)

    def profiles(self, dim: int) -> np.ndarray:
        """One bundled vector per text."""
        n = len(self.letters)
        v = letter_vectors(self.letters, dim)
        first, second = np.roll(v, 2, axis=1), np.roll(v, 1, axis=1)
        out = np.zeros((self.rows, dim), np.float32)
        order = np.argsort(self.index, kind="stable") if len(self.keys) > BLOCK else None
        index, doc = (self.index, self.doc) if order is None else (self.index[order], self.doc[order])
        for a in range(0, len(self.keys), BLOCK):
            keys = self.keys[a : a + BLOCK]
            if order is None:
                i, d = index, doc
            else:
                x, y = np.searchsorted(index, [a, a + BLOCK])
                i, d = index[x:y] - a, doc[x:y]
            counts = np.bincount(d * len(keys) + i, minlength=self.rows * len(keys)).reshape(self.rows, len(keys))
            out += counts.astype(np.float32) @ (first[keys // (n * n)] * second[keys // n % n] * v[keys % n])
        return out


def train(docs: DataFrame, dim: int = DIM, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by language of all rows with a language and a text; empty if there are none."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, "text", RUN_BYTES):
                grams = Trigrams(batch.column("text"))
                p = grams.profiles(dim).astype(np.float64)
                size = np.maximum(1, np.bincount(grams.doc, minlength=grams.rows)) ** 0.5
                p /= size[:, None]
                langs = np.array(batch.column("lang").to_pylist())
                for name in set(langs.tolist()):
                    total[name] = total.get(name, 0) + p[langs == name].sum(0)
        names = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[n].tolist() for n in names], pa.list_(pa.float64()))], ["lang", "v"])

    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    parts = rows.mapInArrow(bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("at", "x"))
    sums = parts.groupBy("lang", "at").agg(F.sum("x").alias("x"))
    vectors = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("v"))
    return {r["lang"]: np.array(r["v"]) for r in vectors.collect()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``lang_score`` (0 to 1: the cosine, below 0 taken as 0) to all rows.

    A null text or one without a letter gets ``und`` and 0, as does every row if there are no prototypes.  Ties go to
    the first language by name.  Columns with these two names are replaced.
    """
    carried = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    names = sorted(prototypes)
    dim = len(prototypes[names[0]]) if names else DIM
    matrix = np.array([prototypes[n] for n in names]).reshape(len(names), dim)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    if len(names) > 1:
        matrix = matrix - matrix.mean(0)
    matrix = (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)).astype(np.float32)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, where, RUN_BYTES):
                grams = Trigrams(batch.column(where))
                known = grams.has_letter & bool(names)
                best, score = np.zeros(grams.rows, np.int64), np.zeros(grams.rows)
                if names:
                    p = grams.profiles(dim)
                    cosine = (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-30)) @ matrix.T
                    best = cosine.argmax(1)
                    score = np.clip(cosine[np.arange(grams.rows), best], 0, 1).astype(np.float64)
                told = pa.array([names[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, told, pa.array(np.where(known, score, 0.0))], names=[*batch.schema.names, "lang_pred", "lang_score"])

    where = carried.index(text)
    fields = [docs.schema[c] for c in carried]
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, lang_score double"
    return docs.select(*(docs[c] for c in carried)).mapInArrow(tell, schema)
