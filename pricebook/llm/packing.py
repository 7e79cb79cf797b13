"""Packing of documents into training windows: best-fit decreasing over a segment tree of remaining capacities.

Every text becomes ids of a tokenizer file plus one end id.  A document longer than a window is first cut into
full windows; what is left of each document goes, longest first, into the open window with the least room that
still takes it.  Open windows are found by a segment tree indexed by remaining capacity.

Packing is a map-only job: each task packs the rows it reads, in runs of bounded size, and its open windows stay
open from run to run.  Nothing is shuffled, no key can be hot, and a task that is run again gives its rows the
same sequence ids, as these are made of the partition's number and a counter.  A task leaves a few windows partly
filled, so padding is small once a task reads a few hundred documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .tokens import BATCH_BYTES, TextEncoder, ranges, slices

PIECES = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree over 1..size that counts them."""

    def __init__(self, size: int):
        self.size = size
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, window: int, used: int) -> None:
        if room:
            heapq.heappush(self.at[room], (window, used))
            self._add(room, 1)

    def tightest(self, length: int) -> int | None:
        """The least capacity of at least ``length`` that an open window has."""
        node = length + self.leaves
        if self.count[node]:
            return length
        while node > 1:
            if node & 1 == 0 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None

    def take(self, room: int) -> tuple[int, int]:
        self._add(room, -1)
        return heapq.heappop(self.at[room])


class Packer:
    """Gives pieces their window and offset; windows are numbered from ``first``."""

    def __init__(self, size: int, first: int):
        self.size, self.next, self.open = size, first, OpenWindows(size)

    def place(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and offset of each piece (1..size long); longest first, equal ones in the given order."""
        window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for i in np.argsort(-lengths, kind="stable").tolist():
            n = int(lengths[i])
            room = None if n == self.size else self.open.tightest(n)
            if room is None:
                at, used, room = self.next, 0, self.size
                self.next += 1
            else:
                at, used = self.open.take(room)
            window[i], offset[i] = at, used
            self.open.put(room - n, at, used + n)
        return window, offset


def _pieces(ids: np.ndarray, counts: np.ndarray, end_id: int, packer: Packer) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids with end ids as 32-bit numbers; document, start, length, doc_tokens, window and offset of each piece."""
    size = packer.size
    total = counts + 1
    all_ids = np.full(int(total.sum()), end_id, "<u4")
    starts = np.cumsum(total) - total
    all_ids[ranges(starts, counts)] = ids
    pieces = -(-total // size)
    doc = np.repeat(np.arange(len(total)), pieces)
    start = ranges(np.zeros(len(total), np.int64), pieces) * size
    length = np.minimum(size, total[doc] - start)
    window, offset = packer.place(length)
    return all_ids, [doc, start, length, total[doc], window, offset]


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their ids and their place: see ``PIECES``; ids are little-endian 32-bit numbers.

    A null or empty text is the end id alone.  Null and repeated doc_ids are kept as they are, each row being a
    document of its own.  No rows give no pieces.  Other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder.of(tokenizer)
        packer = Packer(size, TaskContext.get().partitionId() << 33)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                ids, counts = encoder.encode(batch.column("text"))
                all_ids, (doc, start, length, doc_tokens, window, offset) = _pieces(ids, counts, end_id, packer)
                ends = np.concatenate([[0], np.cumsum(length)]) * 4
                data = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(all_ids)])
                columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), data, pa.array(doc_tokens), pa.array(window), pa.array(offset)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES.format(id=kind))


def sequences(pieces: DataFrame, size: int = 1024, pad_id: int = 0) -> DataFrame:
    """The padded windows: sequence_id, n_tokens and ids (little-endian 32-bit numbers, ``size`` of them)."""
    pad: Column = F.unhex(F.lit(pad_id.to_bytes(4, "little").hex() * size))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))), lambda p: p["ids"]), "")
    used = F.sum("length")
    rows = pieces.groupBy("sequence_id").agg(used.alias("n_tokens"), F.unhex(joined).alias("used"))
    return rows.select("sequence_id", "n_tokens", F.concat("used", F.substring(pad, F.lit(1), ((size - F.col("n_tokens")) * 4).cast("int"))).alias("ids"))
