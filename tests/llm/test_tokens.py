from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from pricebook.llm.base import tokenizer
from pricebook.llm.packing import OpenWindows, pack, sequences
from pricebook.llm.tokens import TextEncoder, slices
from pricebook.llm.wavelet import Shard, WaveletMatrix, occurrences, read_tokens, to_blob, write_tokens

from .data import ODD, ODD_IDS, frame, prose

PATH = tokenizer()


def plain(texts):
    return [e.ids for e in TextEncoder.of(PATH).tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def encoded(texts):
    ids, n = TextEncoder.of(PATH).encode(pa.array(texts, pa.string()))
    return [list(map(int, x)) for x in np.split(ids, np.cumsum(n)[:-1])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab's.,é漢 \n\t 　<|>1", max_size=40), st.text(max_size=30)), min_size=1, max_size=6))
def test_encoding_is_the_librarys(texts):
    assert encoded(texts) == plain(texts)


def test_encoding_of_odd_texts():
    assert encoded(ODD) == plain(ODD)
    assert encoded(["<|endoftext|> it's", " a  b ", "a\u0085b c", "x.y, z!!"]) == plain(["<|endoftext|> it's", " a  b ", "a\u0085b c", "x.y, z!!"])


def test_added_tokens_are_the_librarys():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    texts = ["<|endoftext|>", "a <|endoftext|> b", "it's<|endoftext|>x", "<|endoftext|> it's  b", "<|endof text|> c", "plain words"]
    want = [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    assert encoded(texts) == want and want[0] == [50256]


def test_a_full_memory_starts_anew(monkeypatch):
    from pricebook.llm import tokens

    monkeypatch.setattr(tokens, "MEMORY", 50)
    texts = [prose(40 + k, 60, 30 + k) + " été, <b> 1.5 naïve. x" for k in range(6)]
    own = TextEncoder(PATH)
    got = [own.encode(pa.array([t])) for t in texts]
    assert [list(map(int, ids)) for ids, _ in got] == plain(texts) and len(own.slot) < 200


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 50, None, "b" * 10_000, "", "c"]})
    parts = list(slices(batch, "t", 600))
    assert pa.Table.from_batches(parts).column("t").to_pylist() == batch.column("t").to_pylist()
    assert len(parts) > 2


def test_wavelet_matrix():
    ids = np.random.default_rng(0).zipf(1.4, 3_000) % 700
    m = WaveletMatrix.build(ids)
    assert (m.ids() == ids).all()
    for i in (0, 1, 511, 512, 2_999):
        assert m.access(i) == ids[i]
    for token in {*ids[:20].tolist(), 699, 5_000}:
        where = np.flatnonzero(ids == token)
        assert m.count(token) == len(where)
        assert m.rank(token, 1_000) == (where < 1_000).sum()
        for k in {0, len(where) // 2, len(where) - 1} - {-1}:
            assert m.select(token, k) == (where[k] if k < len(where) else -1)
        assert m.select(token, len(where)) == -1


def test_shard_image():
    ids = np.array([70_000, 5, 5, 9, 70_000], np.uint32)
    s = Shard(to_blob(np.array([4, 0]), np.array([False, True]), np.array([2, 3]), ids))
    assert s.ids().tolist() == ids.tolist() and s.doc_ids.tolist() == [4, 0] and s.null.tolist() == [False, True] and s.counts.tolist() == [2, 3]
    assert s.access(3) == 9 and s.count(5) == 2 and s.select(70_000, 1) == 4 and s.count(6) == 0 and s.select(6, 0) == -1
    with pytest.raises(ValueError):
        Shard(b"????" + bytes(60))


def test_token_files(spark):
    df = frame(spark, ODD, ids=ODD_IDS)
    path = write_tokens(df, PATH)
    got = sorted(read_tokens(spark, path).collect(), key=lambda r: r["start"])
    order = sorted(range(len(ODD)), key=lambda k: (ODD_IDS[k] is not None, ODD_IDS[k] or 0, ODD[k] is not None, ODD[k] or ""))
    at = 0
    for r, k in zip(got, order, strict=True):
        ids = [*plain([ODD[k]])[0], 0]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (ODD_IDS[k], at, len(ids))
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        at += len(ids)
    every = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in got])
    found = [p for r in occurrences(spark, path, 0).collect() for p in r["places"]]
    assert sorted(found) == np.flatnonzero(every == 0).tolist()


def test_token_files_of_no_rows(spark):
    assert read_tokens(spark, write_tokens(frame(spark, ["x"]).limit(0), PATH)).count() == 0


def test_tightest_window():
    w = OpenWindows(16)
    for room, at in ((3, 0), (7, 1), (7, 2), (12, 3)):
        w.put(room, at, 16 - room)
    assert [w.tightest(n) for n in (1, 3, 4, 7, 8, 12, 13)] == [3, 3, 7, 7, 12, 12, None]
    assert w.take(7) == (1, 9) and w.take(7) == (2, 9) and w.tightest(4) == 12


@pytest.mark.parametrize("size", [16, 1024])
def test_packing(spark, size):
    texts = [*ODD, *(prose(k, 1 + 7 * k % 60) for k in range(40))]
    ids = [*ODD_IDS, *range(100, 140)]
    df = frame(spark, texts, ids=ids).repartition(3)
    got = pack(df, PATH, size=size).collect()
    by_doc, by_window = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append(r)
        assert 1 <= r["length"] <= size and len(r["ids"]) == 4 * r["length"]
    want = {}
    for i, t in zip(ids, texts, strict=True):
        want.setdefault(i, []).append([*plain([t])[0], 0])
    for i, pieces in by_doc.items():
        assert sum(r["length"] for r in pieces) == sum(map(len, want[i]))
        if len(want[i]) == 1:
            pieces.sort(key=lambda r: r["start"])
            assert [x for r in pieces for x in np.frombuffer(r["ids"], "<u4").tolist()] == want[i][0]
            assert {r["doc_tokens"] for r in pieces} == {len(want[i][0])}
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    total = sum(r["length"] for r in got)
    assert len(by_window) <= total / size * 1.02 + 6
    whole = sequences(pack(df, PATH, size=size), size).collect()
    assert len(whole) == len(by_window) and all(len(r["ids"]) == 4 * size for r in whole)


def test_packing_of_no_rows(spark):
    assert pack(frame(spark, ["x"]).limit(0), PATH).count() == 0
