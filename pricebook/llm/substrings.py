"""Substring dedup: passages that occur earlier in the corpus are removed.

Every window of ``width`` words gets a Rabin-Karp hash.  A window is removed from a document if the same words also
start in a document with a smaller id; the removed windows of a document merge into maximal intervals of words.

Scale: a task first settles the windows of its own rows, keeping one pair (hash, smallest doc_id) per hash, so that a
passage in every document leaves one pair per run of rows.  The pairs are dealt to buckets by hash, packed, a bucket
standing for a few MB of text however large the corpus is.  What buckets find is dealt back by document, packed too.
Windows are compared by 64-bit hashes of whole words' bytes: two different windows meet with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import slices
from .words import Words, bucket_bits, dealt, gathered, mixed, planes, unplanes

#: Bytes of text settled at once inside a task.
RUN_BYTES = 8_000_000

_PACKED = "bucket long, hashes binary, values binary, found boolean"
_REMOVED = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"


def _later(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs by ascending hash: where each hash starts, and which pairs have a smaller doc_id beside them."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    least = np.minimum.reduceat(docs, starts)
    return starts, docs > np.repeat(least, np.diff(np.append(starts, len(hashes))))


def _home(doc_ids: np.ndarray, bits: int) -> np.ndarray:
    """A 64-bit number by document whose highest bits name its bucket."""
    return mixed(doc_ids.astype(np.int64).view(np.uint64))


def _back(hashes: np.ndarray, docs: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows (bucket of the document, its hashes, its id) of windows to remove."""
    home = _home(docs, bits) >> np.uint64(64 - bits)
    order = np.argsort(home, kind="stable")
    buckets, starts = np.unique(home[order], return_index=True)
    cuts = [*starts.tolist(), len(order)]
    hs = [planes(hashes[order[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
    ds = [planes(docs[order[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int64)), pa.array(hs, pa.binary()), pa.array(ds, pa.binary())], ["bucket", "hashes", "values"])


def _with(batch: pa.RecordBatch, found: bool) -> pa.RecordBatch:
    return batch.append_column("found", pa.array([found] * batch.num_rows))


def repeated_windows(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """Windows to remove, packed by document bucket: bucket, hashes, values (doc_ids)."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", RUN_BYTES):
                words = Words(batch.column("text"))
                at, h = words.windows(width)
                d = batch.column("doc_id").to_numpy()[words.doc[at]]
                order = np.argsort(h)
                h, d = h[order], d[order]
                starts, later = _later(h, d)
                if later.any():
                    yield _with(_back(h[later], d[later], bits), True)
                if len(h):
                    yield _with(dealt(h[starts], np.minimum.reduceat(d, starts), bits), False)

    def meet(table: pa.Table) -> pa.Table:
        found = table.column("found").to_numpy()
        out = [b for b in table.filter(pa.array(found)).select(["bucket", "hashes", "values"]).to_batches() if b.num_rows]
        if not found.all():
            h, d = gathered(table.filter(pa.array(~found)))
            later = _later(h, d)[1]
            if later.any():
                out.append(_back(h[later], d[later], bits))
        return pa.Table.from_batches(out, pa.schema([("bucket", pa.int64()), ("hashes", pa.binary()), ("values", pa.binary())]))

    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(settle, _PACKED)
    return rows.groupBy("bucket").applyInArrow(meet, "bucket long, hashes binary, values binary")


def remove_repeats(docs: DataFrame, width: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, removed (intervals of words, end exclusive) and kept_text of every row.

    Windows are judged on the given texts, not on what is left.  kept_text joins the words left by one space.  A null
    text has no words and kept_text ''.  A null doc_id is neither smaller nor larger than others: its row stays whole.
    Rows with the same doc_id are judged alike.  No rows give no rows; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    bits = bucket_bits(rows, F.col("text"))
    found = repeated_windows(rows, width, bits)

    def cut(texts: pa.Table, marks: pa.Table) -> pa.Table:
        column = texts.column("text").combine_chunks()
        key = texts.column("doc_id").combine_chunks()
        ids, known = key.fill_null(0).to_numpy(), ~np.asarray(key.is_null())
        words = Words(column)
        covered = np.zeros(len(words.hash) + 1, np.int64)
        if marks.num_rows:
            # A window of a document is found if the pair of its hash and that document is.
            pairs = [unplanes(h, np.uint64) ^ _home(unplanes(d, np.int64), bits) for h, d in zip(marks.column("hashes").to_pylist(), marks.column("values").to_pylist(), strict=True)]
            wanted = np.unique(np.concatenate(pairs))
            at, h = words.windows(width)
            own = h ^ _home(ids, bits)[words.doc[at]]
            near = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
            hit = at[(wanted[near] == own) & known[words.doc[at]]]
            covered += np.bincount(hit, minlength=len(covered))
            covered -= np.bincount(hit + width, minlength=len(covered))[: len(covered)]
        gone = np.cumsum(covered)[:-1] > 0
        n_words = np.diff(words.first)
        n_gone = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
        removed, kept = [], []
        for i, t in enumerate(column.to_pylist()):
            own = t.encode().split() if t else []
            spans: list[dict] = []
            if n_gone[i]:
                a, b = words.first[i], words.first[i + 1]
                flips = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8)))
                spans = [{"start": x, "end": y} for x, y in flips.reshape(-1, 2).tolist()]
                own = list(compress(own, (~gone[a:b]).tolist()))
            removed.append(spans)
            kept.append(b" ".join(own).decode())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [key, pa.array(n_words), pa.array(n_gone), pa.array(removed, span), pa.array(kept, pa.string())]
        return pa.Table.from_arrays(columns, ["doc_id", "n_words", "n_removed", "removed", "kept_text"])

    def by_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("doc_id")
            # Rows without an id are dealt by their place.
            ids = np.where(np.asarray(key.is_null()), np.arange(batch.num_rows), key.fill_null(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array((_home(ids, bits) >> np.uint64(64 - bits)).astype(np.int64)), *batch.columns], ["bucket", "doc_id", "text"])

    homes = rows.mapInArrow(by_home, "bucket long, doc_id long, text string")
    out = homes.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(lambda t, m: cut(t, m), _REMOVED)
    return out
