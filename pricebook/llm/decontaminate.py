"""Benchmark decontamination: words of training texts that lie in a window of a benchmark item are found and removed.

The windows of all items (``width`` consecutive words, lower-cased in A-Z; an item of fewer words is one window) go to
every task as a sorted array of hashes with the items' words.  A task hashes all windows of its texts, looks them up,
and compares each hit with the item's words byte by byte.

Scale: the texts are not shuffled, a map over the documents does all.  What is broadcast has a checked size: the
benchmark's bytes are counted first, and one of more than ``most`` bytes is dealt to blocks of about that size; the
documents then pass the blocks one after the other, written between them, and their hits add up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from pricebook.session import materialize

from .tokens import ranges, slices
from .words import Words

#: Bytes of benchmark text broadcast at once; its windows take about eight times as much.
MOST = 16_000_000
#: Bytes of documents scanned at once inside a task.
RUN_BYTES = 4_000_000

#: Words are runs of digits, letters a-z and whatever is not ASCII.
APART = np.ones(256, bool)
APART[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: Bits of the table that tells most windows apart from all of a benchmark's.
_BITS = 22


@dataclass
class Benchmark:
    """The distinct windows of some items, by hash, and the items that hold them."""

    widths: list[int]
    hash: np.ndarray  # of each window, ascending
    width: np.ndarray
    word: np.ndarray  # its first word
    ties: int  # the most windows of one hash
    first: np.ndarray  # of each window, where its items start in ``item``
    item: np.ndarray  # numbers into ``names``
    names: list[str]  # item_ids as strings, in order
    data: np.ndarray  # the words' bytes
    start: np.ndarray
    length: np.ndarray
    table: np.ndarray

    @classmethod
    def of(cls, ids: list[str | None], texts: list[str | None], width: int) -> Benchmark:
        words = Words(pa.array(texts, pa.string()), lower=True, space=APART)
        count = np.diff(words.first)
        lengths = np.minimum(count, width)
        widths = np.unique(lengths[lengths > 0]).tolist()
        names = sorted({i for i in ids if i is not None})
        number = {n: k for k, n in enumerate(names)}
        named = np.array([number.get(i, -1) for i in ids], np.int64)
        parts = []
        for w in widths:
            at, h = words.windows(w)
            own = lengths[words.doc[at]] == w
            parts.append((h[own], np.full(int(own.sum()), w), at[own]))
        h, wide, at = (np.concatenate(x) if parts else np.zeros(0, t) for x, t in zip(zip(*parts, strict=True) if parts else [()] * 3, (np.uint64, np.int64, np.int64), strict=True))
        made = cls(widths, h, wide, at, 1, np.zeros(1, np.int64), np.zeros(0, np.int64), names, words.data, words.start, words.end - words.start, np.zeros(1 << _BITS, bool))
        if not len(h):
            return made
        # Equal windows become one; windows of one hash that differ stay apart.
        order = np.lexsort((at, wide, h))
        h, wide, at = h[order], wide[order], at[order]
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (wide[1:] == wide[:-1])])
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
        equal = made.equal(words.data, words.start, made.length, at, at[lead], wide)
        alone = ~equal
        alone[lead[~alone]] = True
        kept = np.flatnonzero(alone)
        cls_of = np.searchsorted(kept, np.where(equal, lead, np.arange(len(h))))
        owner = named[words.doc[at]]
        known = owner >= 0
        both = np.unique(np.stack([cls_of[known], owner[known]], 1), axis=0).reshape(-1, 2)
        made.hash, made.width, made.word = h[kept], wide[kept], at[kept]
        made.ties = int(np.unique(made.hash, return_counts=True)[1].max())
        made.first = np.searchsorted(both[:, 0], np.arange(len(kept) + 1))
        made.item = both[:, 1]
        made.table[made.hash >> np.uint64(64 - _BITS)] = True
        return made

    def equal(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray, own: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Whether the windows at the words ``at`` of some data are the windows at the own words ``own``, byte by byte."""
        left, right = ranges(at, width), ranges(own, width)
        # Windows overlap; a pair of words is compared once.
        pairs, back = np.unique(left * (len(self.start) + 1) + right, return_inverse=True)
        left, right = np.divmod(pairs, len(self.start) + 1)
        good = length[left] == self.length[right]
        like = np.flatnonzero(good)
        for run in np.array_split(like, max(1, len(like) // 200_000)):
            n = length[left[run]]
            differ = data[ranges(start[left[run]], n)] != self.data[ranges(self.start[right[run]], n)]
            good[run[np.repeat(np.arange(len(run)), n)[differ]]] = False
        ends = np.cumsum(width)
        return np.add.reduceat(good[back].astype(np.int64), ends - width) == width if len(width) else np.zeros(0, bool)

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First words and windows (numbers of this benchmark's) of all windows that occur."""
        length = words.end - words.start
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for w in self.widths:
            at, h = words.windows(w)
            maybe = np.flatnonzero(self.table[h >> np.uint64(64 - _BITS)])
            at, h = at[maybe], h[maybe]
            place = np.searchsorted(self.hash, h)
            for k in range(self.ties):
                here = np.minimum(place + k, len(self.hash) - 1)
                ok = np.flatnonzero((self.hash[here] == h) & (self.width[here] == w) & (place + k < len(self.hash)))
                a, b = at[ok], here[ok]
                good = self.equal(words.data, words.start, length, a, self.word[b], self.width[b])
                found.append((a[good], b[good]))
        a, b = zip(*found, strict=True)
        return np.concatenate(a), np.concatenate(b)


_MARKED = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _parts(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of the items, in blocks of about ``most`` bytes; rows of one id and text are one."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.filter("length(text) > 0").distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // most))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        got = part.toArrow()
        yield got.column("id").to_pylist(), got.column("text").to_pylist()


def _scan(rows: DataFrame, index: int, items) -> DataFrame:
    """Adds the hits of one block of items, a broadcast ``Benchmark``, to those that the rows carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test: Benchmark = items.value
        for whole in batches:
            whole = whole.append_column("text", pc.cast(pc.struct_field(whole.column("row"), [index]), pa.string()))
            for batch in slices(whole, "text", RUN_BYTES):
                words = Words(batch.column("text"), lower=True, space=APART)
                at, window = test.hits(words)
                before = batch.column("spans").to_pylist()
                named = batch.column("items").to_pylist()
                step = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + test.width[window], -1)
                docs = np.unique(words.doc[at])
                order = np.argsort(words.doc[at], kind="stable")
                cuts = np.searchsorted(words.doc[at][order], [docs, docs + 1]).T.tolist()
                covered = np.cumsum(step)[:-1] > 0
                for d, (a, b) in zip(docs.tolist(), cuts, strict=True):
                    own = covered[words.first[d] : words.first[d + 1]].copy()
                    for span in before[d]:
                        own[span["start"] : span["end"]] = True
                    flips = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                    before[d] = [{"start": x, "end": y} for x, y in flips.reshape(-1, 2).tolist()]
                    w = np.unique(window[order[a:b]])
                    found = test.item[ranges(test.first[w], test.first[w + 1] - test.first[w])]
                    named[d] = sorted({*named[d], *(test.names[i] for i in np.unique(found).tolist())})
                columns = [batch.column("row"), pa.array(np.diff(words.first)), pa.array(before, _SPANS), pa.array(named, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "n_words", "spans", "items"])

    return rows.mapInArrow(run, StructType([rows.schema["row"], *StructType.fromDDL(_MARKED).fields]))


def mark(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = MOST) -> DataFrame:
    """row (all columns of the document), n_words, spans and items of every row of ``docs``.

    ``spans`` are the maximal intervals of words that lie in an occurring window, end exclusive; ``items`` the ids of the
    items with occurring windows, as ascending strings.  A null text has no words.  Items without words have no windows;
    items without an id hit words but are not named; rows of one id are one item.  An empty benchmark marks nothing.
    """
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() AS array<struct<start:bigint,end:bigint>>)").alias("spans"), F.expr("cast(array() AS array<string>)").alias("items"))
    out = None
    for ids, texts in _parts(benchmark, item_id, item_text, most):
        rows = rows if out is None else materialize(out, "marked")
        out = _scan(rows, docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(Benchmark.of(ids, texts, width)))
    return out


def _cut(text: str, spans: list[dict]) -> str:
    words = Words(pa.array([text], pa.string()), lower=True, space=APART)
    raw, out, at = text.encode(), [], 0
    for s in spans:
        out.append(raw[at : words.start[s["start"]]])
        at = words.end[s["end"] - 1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, remove: str = "spans", text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = MOST) -> DataFrame:
    """``docs`` without what ``mark`` finds: its columns, and either no document with a hit (``remove="documents"``) or
    texts from which every span is cut, first to last character, the rest left as it is (``remove="spans"``)."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    marked = mark(docs, benchmark, width, text, item_id, item_text, most)
    if remove == "documents":
        return marked.filter(F.size("spans") == 0).select("row.*")
    index = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            spans = batch.column("spans")
            hit = np.flatnonzero(pc.list_value_length(spans).to_numpy(zero_copy_only=False))
            if len(hit):
                texts = pc.struct_field(row, [index])
                new = texts.to_pylist()
                for i in hit.tolist():
                    new[i] = _cut(new[i], spans[i].as_py())
                fields = [pc.struct_field(row, [k]) for k in range(row.type.num_fields)]
                fields[index] = pa.array(new, texts.type)
                row = pa.StructArray.from_arrays(fields, fields=list(row.type))
            yield pa.RecordBatch.from_arrays([row], ["row"])

    kept = marked.select("row", "spans").mapInArrow(run, StructType([marked.schema["row"]]))
    return kept.select("row.*")
