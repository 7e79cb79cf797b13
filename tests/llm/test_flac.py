from __future__ import annotations

import hashlib
import random
import struct

import numpy as np
import pytest

from pricebook.llm import flac

from .data import ODD, ODD_IDS, frame


def test_round_trip():
    r = random.Random(3)
    payloads = [bytes(64), bytes(range(256)) * 40, r.randbytes(6_400), "é ñ ß".encode() * 64, b"a" * 1024 + b"b" * 64, b"the cat sat on the mat. " * 400]
    payloads = [p + bytes(-len(p) % 64) for p in payloads]
    streams = flac.encode(payloads)
    for p, (samples, info), s in zip(payloads, flac.decode(streams), streams, strict=True):
        assert flac.BYTE_OF[samples + 128].tobytes() == p
        assert info["n"].sum() == len(p) and info["first"].tolist() == list(range(0, len(p), flac.BLOCK))
        assert flac.encode([p]) == [s]
    assert len(streams[-1]) < 0.75 * len(payloads[-1])


def test_damage_is_found():
    stream = bytearray(flac.encode([b"some text to store " * 64])[0])
    for at in (len(stream) - 1, len(stream) - 300, 64 + 18, 30):
        bad = bytes(stream[:at]) + bytes([stream[at] ^ 4]) + bytes(stream[at + 1 :])
        with pytest.raises(ValueError):
            flac.decode([bad])


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def bytes(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))


def by_hand(samples, order, weights, shift, partition_bits, k, wide=False):
    """A stream of one frame with a linear or fixed predictor, written bit by bit."""
    n = len(samples)
    b = Bits()
    b.put((31 + order if weights else 8 + order) << 1, 8)
    for s in samples[:order]:
        b.put(s & 0xFF, 8)
    if weights:
        b.put(12 - 1, 4)
        b.put(shift & 31, 5)
        for w in weights:
            b.put(w & 0xFFF, 12)
    fixed = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
    use = weights or fixed[order]
    b.put(int(wide), 2)
    b.put(partition_bits, 4)
    size = n >> partition_bits
    for part in range(1 << partition_bits):
        b.put(k + part % 2, 5 if wide else 4)
        for i in range(max(order, part * size), (part + 1) * size):
            guess = sum(w * samples[i - 1 - j] for j, w in enumerate(use)) >> (shift if weights else 0)
            r = samples[i] - guess
            u = 2 * r if r >= 0 else -2 * r - 1
            kk = k + part % 2
            for _ in range(u >> kk):
                b.put(0, 1)
            b.put(1, 1)
            b.put(u & ((1 << kk) - 1), kk)
    head = bytes([0xFF, 0xF8, 7 << 4, 2, 0]) + struct.pack(">H", n - 1)
    frame_ = head + bytes([flac.crc8(head)]) + b.bytes()
    data = np.frombuffer(frame_, np.uint8)
    frame_ += int(flac.crc16(data, np.array([0]), np.array([len(data)]))[0]).to_bytes(2, "big")
    md5 = hashlib.md5(np.array(samples, np.int8).tobytes()).digest()
    return flac._metadata(n, [len(frame_)], [n], md5) + frame_


def test_predictors_partitions_and_long_codes():
    r = random.Random(5)
    wave = [int(60 * np.sin(i / 9) + r.randint(-3, 3)) for i in range(320)]
    streams = [by_hand(wave, o, None, 0, 2, 2) for o in range(5)]
    streams += [by_hand(wave, 2, [1900, -900], 10, 3, 2), by_hand(wave, 1, [1000], 10, 0, 0, wide=True), by_hand(wave, 8, [900, 80, 10, -5, 3, 2, 1, 1], 10, 1, 3)]
    for samples, _ in flac.decode(streams):
        assert samples.tolist() == wave


def test_frame_numbers():
    for n in (127, 128, 2047, 2048, 65_535, 65_536, 1_000_000):
        assert flac._utf8(n) == chr(n).encode()
    assert flac._utf8((1 << 31) - 1) == bytes([0xFD] + [0xBF] * 5)


def test_media_columns(spark):
    df = frame(spark, ODD, ids=ODD_IDS)
    media = flac.to_flac(df)
    got = flac.from_flac(media).collect()
    want = sorted((t or "").encode() for t in ODD)
    assert sorted(r["payload"][: r["n_bytes"]] for r in got) == want
    assert all(len(r["payload"]) % 64 == 0 and len(r["payload"]) >= 64 and not any(r["payload"][r["n_bytes"] :]) for r in got)
    blocks = flac.pcm_blocks(media).filter("doc_id = 7").orderBy("sample_offset").collect()
    pcm = b"".join(b["pcm"] for b in blocks)
    own = next(r for r in got if r["doc_id"] == 7)
    assert flac.BYTE_OF[np.frombuffer(pcm, np.int8).astype(int) + 128].tobytes() == own["payload"]
    assert [b["sample_offset"] for b in blocks] == list(range(0, len(pcm), flac.BLOCK))
    assert flac.from_flac(flac.to_flac(df.limit(0))).count() == 0
