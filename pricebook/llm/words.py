"""Words of many texts at once as arrays: hashes, windows, and packed rows dealt out by hash.

Works on the UTF-8 bytes of an Arrow string column without making a Python object per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

#: An odd base for hashes of windows, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of a string column: ``start``/``end`` (bytes in ``data``), ``doc`` (row), ``hash``; ``first`` word of each row.

    ``space`` says of each byte whether it parts words (of the ASCII ones only, so that no character is cut).
    """

    def __init__(self, texts: pa.Array, lower: bool = False, space: np.ndarray = _SPACE):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        at, n = at - at[0], int(at[-1] - at[0])
        data = np.zeros(n + 8, np.uint8)
        data[:n] = _LOWER[raw] if lower else raw
        word = ~space[data[:n]]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        start = word & edge[:n]
        start[1:] |= word[1:] & ~word[:-1]
        end = word & edge[1:]
        end[:-1] |= word[:-1] & ~word[1:]
        self.data, self.at = data, at
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, at)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """Each word's bytes, eight at a time, mixed into 64 bits."""
        loads = np.ndarray(max(0, len(self.data) - 7), "<u8", self.data, strides=(1,))
        left = self.end - self.start
        h = left.astype(np.uint64) * np.uint64(BASE)
        at, live = self.start, np.arange(len(left))
        while len(live):
            keep = np.minimum(left, 8).astype(np.uint64)
            part = loads[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - keep * np.uint64(8)))
            h[live] = mixed(h[live] ^ part) + np.uint64(1)
            more = np.flatnonzero(left > 8)
            live, at, left = live[more], at[more] + 8, left[more] - 8
        return h

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and rolling hash of every window of ``width`` words that lies in one row.

        Rabin-Karp: a window's hash is a polynomial in ``BASE`` over its word hashes modulo 2**64, taken from prefix sums.
        """
        n = len(self.hash)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        down = np.full(n, INVERSE, np.uint64)
        down[0] = 1
        np.multiply.accumulate(down, out=down)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * down, dtype=np.uint64)])
        up = np.full(n, BASE, np.uint64)
        up[0] = 1
        np.multiply.accumulate(up, out=up)
        at = np.flatnonzero(self.doc[: n - width + 1] == self.doc[width - 1 :])
        return at, mixed((sums[at + width] - sums[at]) * up[at + width - 1])


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, all lowest bytes first: even bytes compress away."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(raw: bytes, dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(dtype).ravel()


def dealt(hashes: np.ndarray, values: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows (bucket, hashes, values) of pairs dealt by the highest bits of their hash; ascending hashes as differences."""
    order = np.argsort(hashes)
    h, v = hashes[order], values[order]
    buckets, starts = np.unique(h >> np.uint64(64 - bits), return_index=True)
    cuts = [*starts.tolist(), len(h)]
    hs = [planes(np.diff(h[a:b], prepend=np.uint64(0))) for a, b in zip(cuts, cuts[1:], strict=False)]
    vs = [planes(v[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int64)), pa.array(hs, pa.binary()), pa.array(vs, pa.binary())], ["bucket", "hashes", "values"])


def gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a bucket, by hash."""
    parts = [(np.cumsum(unplanes(h, np.uint64), dtype=np.uint64), unplanes(v, np.int64)) for h, v in zip(table.column("hashes").to_pylist(), table.column("values").to_pylist(), strict=True)]
    h, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    return h[order], v[order]


def bucket_bits(docs: DataFrame, text: Column, bytes_each: int = 1 << 22, least: int = 6) -> int:
    """Bits of hash for buckets that stand for about ``bytes_each`` bytes of text: one number reaches the driver."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return max(least, (int(total) // bytes_each).bit_length())
