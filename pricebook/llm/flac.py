"""Media columns: FLAC streams of 8-bit mono samples, written and decoded many frames at a time.

A stream is ``fLaC``, STREAMINFO (with the MD5 of its samples), SEEKTABLE (one point per frame: first sample, byte
offset, samples) and frames of ``BLOCK`` samples.  The decoder reads constant, verbatim, fixed-predictor and
linear-predictor subframes with Rice-coded residuals of any partitioning, and checks CRC-8 of every header, CRC-16 of
every frame, and the MD5.

Bytes become samples by a fixed companding table: frequent bytes of text get small amplitudes, so that Rice codes are
short.  It is a bijection, so nothing is lost.

Both directions are map-only.  Within a task the frames of many documents are lanes of one array: step i of the Rice
decoder reads the i-th residual of all frames at once.  Memory is bounded by the bytes of a run of rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import ranges, slices

#: Samples of a frame.
BLOCK = 1024
SAMPLE_RATE = 8000
#: Payloads are padded with zero bytes to a positive multiple of this.
PAD = 64
#: Payload bytes handled at once.
RUN_BYTES = 3_000_000

#: Frequent bytes of text first; the rest follow in ascending order.
_FREQUENT = b" etaoinshrdlcumwfgypbvkjxqz.,\n\xc3\xa9\xa8\xbc\xa4\xb6\x9f\xb1\xb3\xad\xa7\xaa" + bytes(range(65, 91)) + b"0123456789"
_ORDER = np.array([*_FREQUENT, *(b for b in range(256) if b not in _FREQUENT)], np.uint8)
_RANK = np.argsort(_ORDER)
#: Byte -> sample (0, -1, 1, -2, ...) and back.
SAMPLE_OF = np.where(_RANK % 2, -(_RANK + 1) // 2, _RANK // 2).astype(np.int16)
BYTE_OF = np.zeros(256, np.uint8)
BYTE_OF[SAMPLE_OF + 128] = np.arange(256)


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
        table.append(c)
    return np.array(table, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of many stretches at once; leading zeros do not count, so all are aligned at their ends."""
    crc = np.zeros(len(starts), np.uint16)
    width = int((ends - starts).max(initial=0))
    for j in range(width, 0, -1):
        at = ends - j
        byte = np.where(at >= starts, data[np.maximum(at, 0)], 0)
        crc = (crc << np.uint16(8)) ^ _CRC16[(crc >> np.uint16(8)) ^ byte]
    return crc


def _utf8(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    k = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    lead = (0xFF00 >> k & 0xFF) | n >> 6 * (k - 1)
    return bytes([lead, *(0x80 | n >> 6 * i & 0x3F for i in range(k - 2, -1, -1))])


def _header(number: int, samples: int) -> bytes:
    if samples == BLOCK:
        code, extra = 8 + (BLOCK // 256).bit_length() - 1, b""
    elif samples <= 256:
        code, extra = 6, bytes([samples - 1])
    else:
        code, extra = 7, struct.pack(">H", samples - 1)
    head = bytes([0xFF, 0xF8, code << 4, 0x02]) + _utf8(number) + extra
    return head + bytes([crc8(head)])


def _metadata(samples: int, frame_bytes: list[int], blocks: list[int], md5: bytes) -> bytes:
    info = struct.pack(">HH", max(16, min(BLOCK, samples)), max(16, min(BLOCK, samples))) + min(frame_bytes).to_bytes(3, "big") + max(frame_bytes).to_bytes(3, "big")
    info += (SAMPLE_RATE << 44 | 0 << 41 | 7 << 36 | samples).to_bytes(8, "big") + md5
    points = np.zeros(len(blocks), [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
    points["n"] = blocks
    points["sample"] = np.cumsum(blocks) - blocks
    points["offset"] = np.cumsum(frame_bytes) - frame_bytes
    return b"fLaC" + b"\x00" + (34).to_bytes(3, "big") + info + b"\x83" + (18 * len(blocks)).to_bytes(3, "big") + points.tobytes()


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload (none of them empty)."""
    size = np.array([len(p) for p in payloads], np.int64)
    samples = SAMPLE_OF[np.frombuffer(b"".join(payloads), np.uint8)]
    frames = -(-size // BLOCK)
    doc = np.repeat(np.arange(len(size)), frames)
    number = ranges(np.zeros(len(size), np.int64), frames)
    n = np.minimum(BLOCK, size[doc] - number * BLOCK)
    starts = np.cumsum(n) - n
    x = np.zeros((len(n), BLOCK), np.int16)
    inside = np.arange(BLOCK) < n[:, None]
    x[inside] = samples
    # The fixed predictor with the least residuals, then the Rice parameter with the fewest bits.
    residuals = [x, np.diff(x, prepend=np.int16(0)), np.diff(x, n=2, prepend=np.zeros((len(n), 2), np.int16))]
    folded = []
    for order, r in enumerate(residuals):
        u = ((r << 1) ^ (r >> 15)).astype(np.uint16)
        u[:, :order] = 0
        u[~inside] = 0
        folded.append(u)
    order = np.argmin([u.sum(1, dtype=np.int64) + 8 * o for o, u in enumerate(folded)], axis=0)
    order = np.where(n > 2, order, 0)
    u = folded[0]
    for o in (1, 2):
        u[order == o] = folded[o][order == o]
    count = n - order
    most = u.max(1).astype(np.int64)
    bits = np.array([np.where((most >> k) + 1 + k <= 32, (u >> np.uint16(k)).sum(1, dtype=np.int64) + count * (1 + k), 1 << 40) for k in range(12)])
    k = bits.argmin(0)
    rice_bits = 8 + 8 * order + 10 + bits.min(0)
    flat = (np.where(inside, x, x[:, :1]) == x[:, :1]).all(1)
    kind = np.where(flat, 0, np.where(rice_bits >= 8 + 8 * n, 1, 2))  # constant, verbatim, Rice
    body = np.where(kind == 0, 2, np.where(kind == 1, 1 + n, -(-rice_bits // 8)))
    heads: dict[tuple[int, int], bytes] = {}
    head = [heads.get(f) or heads.setdefault(f, _header(*f)) for f in zip(number.tolist(), n.tolist(), strict=True)]
    head_len = np.fromiter(map(len, head), np.int64, len(head))
    frame_bytes = head_len + body + 2
    ends = np.cumsum(frame_bytes)
    at = ends - frame_bytes
    out = np.zeros(int(ends[-1]) // 4 + 3, np.uint32)
    # Rice frames: one item for the coding method, partition order and parameter, then the codes.
    rows = np.flatnonzero(kind == 2)
    if len(rows):
        items = np.arange(BLOCK + 1)
        live = (items[None, :] == 0) | ((items[None, :] > order[rows, None]) & (items[None, :] <= n[rows, None]))
        kk = np.broadcast_to(k[rows, None].astype(np.uint64), live.shape)
        v = np.concatenate([np.zeros((len(rows), 1), np.uint16), u[rows]], axis=1).astype(np.uint64)
        length = (v >> kk) + kk + np.uint64(1)
        code = (v & ((np.uint64(1) << kk) - np.uint64(1))) | (np.uint64(1) << kk)
        length[:, 0], code[:, 0] = 10, k[rows]
        length, code = length[live].astype(np.int64), code[live]
        per = live.sum(1)
        first = np.cumsum(per) - per
        before = np.cumsum(length) - length
        base = (at[rows] + head_len[rows] + 1 + order[rows]) * 8 - before[first]
        pos = before + np.repeat(base, per)
        value = code << (64 - (pos & 31) - length).astype(np.uint64)
        word = pos >> 5
        group = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[group]] |= np.bitwise_or.reduceat((value >> np.uint64(32)).astype(np.uint32), group)
        low = np.bitwise_or.reduceat((value & np.uint64(0xFFFFFFFF)).astype(np.uint32), group)
        out[word[group] + 1] |= low
    stream = out.byteswap().view(np.uint8)
    raw = np.frombuffer(b"".join(head), np.uint8)
    stream[ranges(at, head_len)] = raw
    sub = at + head_len
    stream[sub] = np.select([kind == 0, kind == 1], [0, 2], (8 + order) << 1)
    as_byte = x.astype(np.uint8)  # the low eight bits: samples in two's complement
    some = kind == 0
    stream[sub[some] + 1] = as_byte[some, 0]
    for j in (0, 1):
        some = (kind == 2) & (order > j)
        stream[sub[some] + 1 + j] = as_byte[some, j]
    some = np.flatnonzero(kind == 1)
    if len(some):
        stream[ranges(sub[some] + 1, n[some])] = as_byte[some][inside[some]]
    crc = crc16(stream, at, ends - 2)
    stream[ends - 2], stream[ends - 1] = crc >> 8, crc & 0xFF
    done = stream.tobytes()
    cut = np.concatenate([[0], np.cumsum(frames)])
    signed = samples.astype(np.int8)
    byte_ends = np.cumsum(size)
    made = []
    for d, total in enumerate(size.tolist()):
        a, b = cut[d], cut[d + 1]
        md5 = hashlib.md5(signed[byte_ends[d] - total : byte_ends[d]].tobytes()).digest()
        made.append(_metadata(total, frame_bytes[a:b].tolist(), n[a:b].tolist(), md5) + done[at[a] : ends[b - 1]])
    return made


class _Bits:
    """Reads numbers of many lanes from one stream, each lane at its own bit."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        view = np.ndarray(len(data) + 8, ">u8", padded, strides=(1,))
        self.at_byte = view.astype(np.uint64)

    def window(self, p: np.ndarray) -> np.ndarray:
        """At least 57 bits from each place on, at the top."""
        return self.at_byte[p >> 3] << (p & 7).astype(np.uint64)

    def number(self, p: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
        bits = np.asarray(bits, np.int64)
        return ((self.window(p) >> np.uint64(1)) >> (63 - bits).astype(np.uint64)).astype(np.int64)


_ZEROS = np.array([16 - int(i).bit_length() for i in range(1 << 16)], np.int64)


def _signed(x: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    half = np.int64(1) << (np.asarray(bits, np.int64) - 1)
    return (x ^ half) - half


def _rice(bits: _Bits, p: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One residual of each lane, and where the lanes are then."""
    w = bits.window(p)
    q = _ZEROS[(w >> np.uint64(48)).astype(np.int64)]
    if (q == 16).any():
        far = np.flatnonzero(q == 16)
        extra = np.zeros(len(p), np.int64)
        while len(far):
            extra[far] += 16
            q[far] = _ZEROS[(bits.window(p[far] + extra[far]) >> np.uint64(48)).astype(np.int64)]
            far = far[q[far] == 16]
        p = p + extra
        w = bits.window(p)
        high = q + extra
    else:
        high = q
    rest = ((w << (q + 1).astype(np.uint64)) >> np.uint64(1)) >> (63 - k).astype(np.uint64)
    v = (high << k) | rest.astype(np.int64)
    return (v >> 1) ^ -(v & 1), p + q + 1 + k


def _frames(stream: bytes, base: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """Frame starts and ends in a joined buffer where the stream begins at ``base``, and what its metadata say."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, points = 4, False, None, None
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            info = {"bits": (packed >> 36 & 31) + 1, "channels": (packed >> 41 & 7) + 1, "samples": packed & (1 << 36) - 1, "md5": block[18:34]}
        elif kind == 3:
            points = np.frombuffer(block, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        at += 4 + size
    if info is None or points is None or info["channels"] != 1 or info["bits"] != 8:
        raise ValueError("8-bit mono with a seek table is asked for")
    starts = base + at + points["offset"].astype(np.int64)
    return starts, np.append(starts[1:], base + len(stream)), info | {"first": points["sample"].astype(np.int64), "n": points["n"].astype(np.int64)}


def _head_size(data: np.ndarray, at: int, end: int, known: dict[bytes, int]) -> tuple[int, int]:
    """The checked header of a frame: its length and its number of samples."""
    raw = data[at : min(at + 16, end)].tobytes()
    code, lead = raw[2] >> 4, raw[4]
    k = 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    size = 4 + k + (1 if code == 6 else 2 if code == 7 else 0) + 1
    head = raw[:size]
    if head not in known:
        if raw[:2] != b"\xff\xf8" or crc8(head[:-1]) != head[-1]:
            raise ValueError("a frame header's checksum differs")
        known[head] = head[4 + k] + 1 if code == 6 else struct.unpack_from(">H", head, 4 + k)[0] + 1 if code == 7 else 192 if code == 1 else 576 << code - 2 if code < 6 else 256 << code - 8
    return size, known[head]


def decode(streams: list[bytes]) -> list[tuple[np.ndarray, dict]]:
    """The samples of each stream and its metadata; an error if a checksum differs."""
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.cumsum([0, *map(len, streams)])
    found = [_frames(s, int(b)) for s, b in zip(streams, base, strict=False)]
    starts, ends = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    if (crc16(data, starts, ends - 2) != (data[ends - 2].astype(np.uint16) << 8 | data[ends - 1])).any():
        raise ValueError("a frame's checksum differs")
    known: dict[bytes, int] = {}
    heads = np.array([_head_size(data, a, b, known) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64).reshape(-1, 2)
    n, sub = heads[:, 1], starts + heads[:, 0]
    kind = (data[sub] >> 1 & 63).astype(np.int64)
    if (data[sub] & 0x81).any():
        raise ValueError("a subframe with wasted bits or padding")
    out = np.zeros((len(n), int(n.max(initial=0))), np.int32)
    some = np.flatnonzero(kind == 0)
    out[some] = data[sub[some] + 1].view(np.int8)[:, None]
    for i in np.flatnonzero(kind == 1):
        out[i, : n[i]] = data[sub[i] + 1 : sub[i] + 1 + n[i]].view(np.int8)
    linear = kind >= 32
    order = np.where(linear, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, -1)).astype(np.int64)
    if ((order < 0) & (kind > 1)).any():
        raise ValueError("an unknown kind of subframe")
    lanes = np.flatnonzero(order >= 0)
    if len(lanes):
        lanes = lanes[np.argsort(-n[lanes], kind="stable")]
        out[lanes] = _subframes(data, sub[lanes], n[lanes], order[lanes], linear[lanes], out.shape[1])
    flat = out[np.arange(out.shape[1]) < n[:, None]]
    ends_of = np.cumsum([f[2]["n"].sum() for f in found])
    results = []
    for (_, _, info), samples in zip(found, np.split(flat, ends_of[:-1]), strict=True):
        if hashlib.md5(samples.astype(np.int8).tobytes()).digest() != info["md5"]:
            raise ValueError("the samples' MD5 differs")
        results.append((samples, info))
    return results


def _subframes(data: np.ndarray, sub: np.ndarray, n: np.ndarray, order: np.ndarray, linear: np.ndarray, width: int) -> np.ndarray:
    """Samples of fixed and linear predictor subframes, longest frames first."""
    bits, lanes = _Bits(data), len(n)
    p = (sub + 1) * 8
    x = np.zeros((width, lanes), np.int64)
    for j in range(int(order.max())):
        has = order > j
        x[j, has] = _signed(bits.number(p[has], 8), 8)
        p = p + 8 * has
    shift, weights = np.zeros(lanes, np.int64), np.zeros((32, lanes), np.int64)
    if linear.any():
        at = np.flatnonzero(linear)
        precision = bits.number(p[at], 4) + 1
        shift[at] = _signed(bits.number(p[at] + 4, 5), 5)
        p[at] += 9
        for j in range(int(order[at].max())):
            has = order[at] > j
            weights[j, at[has]] = _signed(bits.number(p[at[has]], precision[has]), precision[has])
            p[at[has]] += precision[has]
    method, parts = bits.number(p, 2), bits.number(p + 2, 4)
    if (method > 1).any():
        raise ValueError("an unknown residual coding")
    size = 4 + method
    p = p + 6
    step = n >> parts
    bound, k = order.copy(), np.zeros(lanes, np.int64)
    next_part = np.where(step > 0, step, n)
    for i in range(width):
        live = int(np.searchsorted(-n, -i, "left"))  # lanes with more than i samples
        if not live:
            break
        new = np.flatnonzero(bound[:live] == i)
        if len(new):
            k[new] = bits.number(p[new], size[new])
            if (k[new] == (1 << size[new]) - 1).any():
                raise ValueError("escaped partitions are not written here")
            p[new] += size[new]
            bound[new] = next_part[new]
            next_part[new] += step[new]
        if i >= order[:live].max():
            x[i, :live], p[:live] = _rice(bits, p[:live], k[:live])
        else:
            own = np.flatnonzero(order[:live] <= i)
            x[i, own], p[own] = _rice(bits, p[own], k[own])
    y = x.T
    for o in (1, 2, 3, 4):
        at = np.flatnonzero((order == o) & ~linear)
        if len(at):
            y[at] = _integrate(y[at], o)
    at = np.flatnonzero(linear)
    for i in range(1, width if len(at) else 0):
        use = at[(order[at] <= i) & (n[at] > i)]
        if len(use):
            total = np.zeros(len(use), np.int64)
            for j in range(int(order[use].max())):
                if i - 1 - j >= 0:
                    total += weights[j, use] * np.where(order[use] > j, y[use, i - 1 - j], 0)
            y[use, i] += total >> shift[use]
    return y


def _integrate(r: np.ndarray, order: int) -> np.ndarray:
    """Samples from ``order`` warm-up samples and the residuals of a fixed predictor."""
    levels = [r[:, :order]]
    for _ in range(order - 1):
        levels.append(np.diff(levels[-1], axis=1))
    d = r[:, order:]
    for level in range(order - 1, -1, -1):
        d = np.cumsum(np.concatenate([levels[level][:, -1:], d], axis=1), axis=1)[:, 1:]
    return np.concatenate([r[:, :order], d], axis=1)


def to_flac(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (a FLAC stream of the padded UTF-8 bytes) of every row.

    A null or empty text is one pad of zero bytes.  Rows are kept as they are, repeated ones too; no rows give no
    rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", RUN_BYTES):
                raw = [t.encode() if t else b"" for t in batch.column("text").to_pylist()]
                media = encode([r + bytes(-len(r) % PAD if r else PAD) for r in raw])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def from_flac(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, payload (the padded bytes) and feature (of the samples) of every stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media", RUN_BYTES // 2):
                payload, feature = [], []
                for samples, info in decode(batch.column("media").to_pylist()):
                    payload.append(BYTE_OF[samples + 128].tobytes())
                    turns = int(np.count_nonzero(np.diff(np.signbit(samples))))
                    energy, peak = int(np.dot(samples.astype(np.int64), samples)), int(np.abs(samples).max(initial=0))
                    feature.append(f"blocks={len(info['n'])};energy={energy};peak={peak};crossings={turns}")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payload, pa.binary()), pa.array(feature, pa.string())], ["doc_id", "n_bytes", "media", "payload", "feature"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary, payload binary, feature string")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """The PCM blocks of every stream: doc_id, sample_offset, n_samples and pcm (signed 8-bit samples)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media", RUN_BYTES // 2):
                doc, first, count, pcm = [], [], [], []
                for d, (samples, info) in enumerate(decode(batch.column("media").to_pylist())):
                    for a, k in zip(info["first"].tolist(), info["n"].tolist(), strict=True):
                        doc.append(d)
                        first.append(a)
                        count.append(k)
                        pcm.append(samples[a : a + k].astype(np.int8).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(first, pa.int64()), pa.array(count, pa.int64()), pa.array(pcm, pa.binary())], ["doc_id", "sample_offset", "n_samples", "pcm"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, sample_offset long, n_samples long, pcm binary")
