"""Token files: a wavelet matrix per shard, written and read through Spark.

A shard is one file image (``blob``): a table of its documents and, for each bit of the ids from the highest
down, a plane of packed bits with ranks at every ``BLOCK`` bits.  From the image alone a token can be accessed,
counted in a prefix, and its k-th occurrence found, without decoding the rest.

Documents are put in ascending id order by a range partitioning; each partition writes shards of about
``SHARD_TOKENS`` tokens, cut at ends of documents, as rows of a compressed table, so that writing is atomic and a
lost task is run again.  Only one number per partition (its tokens) is summed up to give global starts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pricebook.session import shared_dir

from .tokens import TextEncoder, ranges, slices

#: Bits between two stored ranks.
BLOCK = 512
#: Tokens of a shard, about; a longer document is a shard of its own.
SHARD_TOKENS = 1 << 19
#: Bytes of text encoded at once.
SHARD_BYTES = 6_000_000
_MAGIC = b"WMX1"
_HEAD = struct.Struct("<4sBQQI")


class WaveletMatrix:
    """Rank and select over bit planes, read in place."""

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.ranks, self.zeros = n, planes, ranks, zeros

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        levels = max(1, int(ids.max()).bit_length()) if n else 1
        a = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, ranks, zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (a & a.dtype.type(1 << level)) != 0
            packed = np.packbits(bit, bitorder="little")
            pad = np.zeros(-(-n // BLOCK) * BLOCK // 8, np.uint8)
            pad[: len(packed)] = packed
            ones = np.bitwise_count(pad.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64)
            planes.append(packed)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype("<u4"))
            low = a.take(np.flatnonzero(~bit))
            zeros.append(len(low))
            a = np.concatenate([low, a.take(np.flatnonzero(bit))])
        return cls(n, planes, ranks, zeros)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i."""
        block = i // BLOCK
        part = self.planes[level][block * BLOCK // 8 : i >> 3]
        extra = int(self.planes[level][i >> 3]) & ((1 << (i & 7)) - 1) if i & 7 else 0
        return int(self.ranks[level][block]) + int(np.bitwise_count(part).sum()) + extra.bit_count()

    def access(self, i: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = 2 * value + bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, to: int) -> tuple[int, int]:
        """Where the occurrences of a token before place ``to`` stand below the last plane."""
        a, b = 0, to
        if token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            x, y = self._ones(level, a), self._ones(level, b)
            bit = token >> (len(self.planes) - 1 - level) & 1
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if bit else (a - x, b - y)
        return a, b

    def rank(self, token: int, to: int) -> int:
        """Occurrences of a token before place ``to``."""
        a, b = self._range(token, to)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence, from 0; -1 if there are fewer."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            return -1
        i = a + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            want = i - self.zeros[level] if bit else i
            i = self._find(level, bit, want)
        return i

    def _find(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th one (or zero) of a plane."""
        ranks = self.ranks[level].astype(np.int64)
        if not bit:
            ranks = np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(ranks, k, "right")) - 1
        block = min(block, (self.n - 1) // BLOCK)
        part = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(part == bit)[k - int(ranks[block])])

    def ids(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        levels = len(self.planes)
        kind = np.uint16 if levels <= 16 else np.uint32
        a = np.zeros(self.n, kind)
        for level in range(levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~bit)] = a[: self.zeros[level]]
            up[np.flatnonzero(bit)] = a[self.zeros[level] :] | kind(1 << (levels - 1 - level))
            a = up
        return a

    def to_bytes(self) -> bytes:
        parts = []
        for p, r, z in zip(self.planes, self.ranks, self.zeros, strict=True):
            parts += [struct.pack("<Q", z), r.tobytes(), p.tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, n: int, levels: int, raw: memoryview) -> WaveletMatrix:
        nr, np_ = (-(-n // BLOCK) + 1) * 4, -(-n // 8)
        planes, ranks, zeros, at = [], [], [], 0
        for _ in range(levels):
            zeros.append(struct.unpack_from("<Q", raw, at)[0])
            ranks.append(np.frombuffer(raw, "<u4", nr // 4, at + 8))
            planes.append(np.frombuffer(raw, np.uint8, np_, at + 8 + nr))
            at += 8 + nr + np_
        return cls(n, planes, ranks, zeros)


def to_blob(doc_ids: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The file image of a shard: its planes hold places in the ascending list of the ids that occur."""
    used = np.flatnonzero(np.bincount(ids))
    place = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.uint16 if len(used) <= 1 << 16 else np.uint32)
    place[used] = np.arange(len(used))
    m = WaveletMatrix.build(place[ids])
    table = doc_ids.astype("<i8").tobytes() + np.packbits(null).tobytes() + counts.astype("<u4").tobytes() + used.astype("<u4").tobytes()
    return _HEAD.pack(_MAGIC, len(m.planes), len(ids), len(counts), len(used)) + table + m.to_bytes()


class Shard:
    """A file image opened in place: tokens by access, rank, count and select, or all of them."""

    def __init__(self, blob: bytes):
        self.doc_ids, self.null, self.counts, self.used, self.matrix = from_blob(blob)

    def _place(self, token: int) -> int:
        i = int(np.searchsorted(self.used, token))
        return i if i < len(self.used) and self.used[i] == token else -1

    def access(self, i: int) -> int:
        return int(self.used[self.matrix.access(i)])

    def rank(self, token: int, to: int) -> int:
        """Occurrences of a token before place ``to``."""
        place = self._place(token)
        return self.matrix.rank(place, to) if place >= 0 else 0

    def count(self, token: int) -> int:
        return self.rank(token, self.matrix.n)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence, from 0; -1 if there are fewer."""
        place = self._place(token)
        return self.matrix.select(place, k) if place >= 0 else -1

    def ids(self) -> np.ndarray:
        return self.used[self.matrix.ids()]


def from_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, WaveletMatrix]:
    """doc_ids, which of them are null, tokens of each document, the ids in use, and the wavelet matrix of a file image."""
    magic, levels, n, docs, kinds = _HEAD.unpack_from(blob)
    if magic != _MAGIC:
        raise ValueError("not a token shard")
    at, raw = _HEAD.size, memoryview(blob)
    doc_ids = np.frombuffer(raw, "<i8", docs, at)
    at += 8 * docs
    null = np.unpackbits(np.frombuffer(raw, np.uint8, -(-docs // 8), at), count=docs).view(bool)
    at += -(-docs // 8)
    counts = np.frombuffer(raw, "<u4", docs, at).astype(np.int64)
    at += 4 * docs
    used = np.frombuffer(raw, "<u4", kinds, at)
    return doc_ids, null, counts, used, WaveletMatrix.from_bytes(n, levels, raw[at + 4 * kinds :])


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> str:
    """Writes the token files of all documents and returns their folder.

    Documents stand in ascending doc_id (an integer; null first), equal ids by their text.  A null text is empty:
    its end id alone.  Without documents there is a table without shards.  Other columns are not read.
    """
    path = path or shared_dir(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard, before = TextEncoder.of(tokenizer), TaskContext.get().partitionId(), 0, 0
        for whole in batches:
            for batch in slices(whole, "text", SHARD_BYTES):
                flat, counts = encoder.encode(batch.column("text"))
                total = counts + 1
                ids = np.full(int(total.sum()), end_id, encoder.dtype)
                starts = np.cumsum(total) - total
                ids[ranges(starts, counts)] = flat
                key = batch.column("doc_id")
                doc_ids, null = key.fill_null(0).to_numpy(), np.asarray(key.is_null())
                a = 0
                while a < len(total):
                    b = max(a + 1, int(np.searchsorted(starts + total, starts[a] + SHARD_TOKENS, "right")))
                    own = ids[starts[a] : starts[b - 1] + total[b - 1]]
                    blob = to_blob(doc_ids[a:b], null[a:b], total[a:b], own)
                    yield pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "before": [before], "n_tokens": [len(own)], "blob": pa.array([blob], pa.binary())})
                    shard, before, a = shard + 1, before + len(own), b

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = rows.mapInArrow(run, "part long, shard long, before long, n_tokens long, blob binary")
    made.write.option("compression", "zstd").mode("errorifexists").parquet(path)
    return path


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with the number of all tokens before them (first)."""
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    # One number per partition that wrote: bounded by the partitions of one job, whatever the rows.
    return files.join(F.broadcast(parts), "part").withColumn("first", F.col("base") + F.col("before"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the token files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, blob in zip(batch.column("first").to_pylist(), batch.column("blob"), strict=True):
                shard = Shard(blob.as_py())
                counts, ends = shard.counts, np.cumsum(shard.counts)
                data = shard.ids()
                cuts = np.concatenate([[0], ends * 4]).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, mask=shard.null), pa.array(first + ends - counts), pa.array(counts), ids], ["doc_id", "start", "n_tokens", "ids"])

    return _shards(spark, path).select("first", "blob").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Per shard that has a token: first (tokens before the shard), n (its occurrences), places (global, ascending).

    Answered by rank and select on the planes; the ids are not decoded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, blob in zip(batch.column("first").to_pylist(), batch.column("blob"), strict=True):
                shard = Shard(blob.as_py())
                if n := shard.count(token):
                    yield pa.RecordBatch.from_pydict({"first": [first], "n": [n], "places": [[first + shard.select(token, k) for k in range(n)]]})

    return _shards(spark, path).select("first", "blob").mapInArrow(run, "first long, n long, places array<long>")
