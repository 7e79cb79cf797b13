from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pricebook.llm import components as parts, near
from pricebook.llm.components import components
from pricebook.llm.near import near_groups
from pricebook.llm.substrings import remove_repeats
from pricebook.llm.words import Words

from .data import LONG, ODD, ODD_IDS, WORD, frame, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(t):
    return WORD.findall(t or "")


def test_words_match_the_pattern():
    texts = [*ODD, "a\x1cb\x85c\xa0d", "\x0b\x0cx\r\n", "tail "]
    w = Words(pa.array(texts))
    data = w.data.tobytes()
    got = [data[a:b].decode() for a, b in zip(w.start, w.end, strict=True)]
    assert got == [x for t in texts for x in words_of(t)]
    assert Counter(w.doc.tolist()) == Counter(k for k, t in enumerate(texts) for _ in words_of(t))
    same = {}
    for x, h in zip(got, w.hash.tolist(), strict=True):
        assert same.setdefault(x, h) == h
    assert len(set(same.values())) == len(same)
    part = Words(pa.array(["skipped", *texts]).slice(1))
    assert (part.hash == w.hash).all()


def test_windows_roll():
    t = prose(4, 300, 20)
    w = Words(pa.array([t, t, None, "short"]))
    at, h = w.windows(5)
    seen = {}
    own = words_of(t) * 2 + ["short"]
    for i, x in zip(at.tolist(), h.tolist(), strict=True):
        assert seen.setdefault(tuple(own[i : i + 5]), x) == x
    assert len(set(seen.values())) == len(seen) and len(at) == 2 * (len(words_of(t)) - 4)


def removed_by_hand(texts, ids, width):
    first = {}
    for i, t in zip(ids, texts, strict=True):
        w = words_of(t)
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in zip(ids, texts, strict=True):
        w = words_of(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_repeats_against_brute_force(spark):
    r = random.Random(7)
    passages = [prose(50 + k, 20 + k) for k in range(4)]
    texts = [" ".join(r.choice([prose(100 + k, 30), r.choice(passages)]) for _ in range(4)) for k in range(120)]
    texts += [*ODD, LONG + " " + passages[0]]
    ids = [*range(1_000, 1_120), *ODD_IDS, 5_000]
    df = frame(spark, texts, ids=ids).repartition(5)
    got = remove_repeats(df, width=13).collect()
    key = repr
    assert sorted(((g["doc_id"], g["n_words"], g["n_removed"], g["kept_text"]) for g in got), key=key) == sorted(removed_by_hand(texts, ids, 13), key=key)
    for g in got:
        spans = [(s["start"], s["end"]) for s in g["removed"]]
        assert sum(b - a for a, b in spans) == g["n_removed"] and all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_repeats_of_no_rows(spark):
    assert remove_repeats(frame(spark, ["x"]).limit(0)).count() == 0


def groups_by_hand(texts, ids, width, percent):
    sets = []
    for t in texts:
        w = words_of((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least.get(find(k), i) if sets[k] else i) for k, i in enumerate(ids)]


def edited(text, n, seed):
    r = random.Random(seed)
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def near_texts():
    bases = [prose(200 + k, 8 + 30 * k) for k in range(14)]
    texts = [edited(b, e, 31 * k + e) for k, b in enumerate(bases) for e in (0, 0, 1, 1, 2, 4, 8, 16)]
    texts += [t.upper() for t in texts[::9]]
    # One crowd of near copies, and a passage that fills most of many short texts.
    crowd = prose(300, 120)
    texts += [edited(crowd, k % 7, 1_000 + k) for k in range(90)]
    passage = prose(301, 40)
    texts += [passage + " " + prose(400 + k, 1 + k % 12) for k in range(90)]
    return texts + ODD


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_near_copies_against_brute_force(spark, width, percent):
    texts = near_texts()
    ids = [*range(100, 100 + len(texts) - len(ODD)), *ODD_IDS]
    df = frame(spark, texts, ids=ids).repartition(4)
    got = [tuple(r) for r in near_groups(df, width, percent).collect()]
    assert sorted(got, key=repr) == sorted(groups_by_hand(texts, ids, width, percent), key=repr)


def test_near_copies_without_ids_and_with_shared_ids(spark):
    """Links through rows without an id count, and an id that stands for several texts is no text's name."""
    base, other, third = prose(900, 50), prose(901, 70), prose(902, 90)
    rows = [(1, base), (None, edited(base, 1, 1)), (2, edited(base, 2, 2)), (7, other), (7, third), (8, edited(third, 1, 3)), (9, edited(other, 1, 4))]
    # A chain that hangs together only by a text without an id, in a group without any id, and copies of it.
    chain = [prose(903, 100)]
    for k in range(5):
        chain.append(edited(chain[-1], 2, 50 + k))
    rows += [(20, chain[0]), *((None, t) for t in chain[1:5]), (21, chain[5]), *[(None, chain[3])] * 40]
    rows += [(None, prose(904, 60)), (None, edited(prose(904, 60), 1, 9))]
    ids, texts = [i for i, _ in rows], [t for _, t in rows]
    got = [tuple(r) for r in near_groups(frame(spark, texts, ids=ids).repartition(3), 5, 80).collect()]
    assert sorted(got, key=repr) == sorted(groups_by_hand(texts, ids, 5, 80), key=repr)


def test_every_key_crowded(spark, monkeypatch):
    # With all keys crowded only centres and blocks find links; none may be lost.
    monkeypatch.setattr(near, "CENTRES", 1)
    rows = [(t,) for t in near_texts()[:150]]
    sets = near.Sets(pa.array([t for (t,) in rows]), 4)
    key, value, entry, slack = near.keys(sets, np.flatnonzero(sets.n), 85)
    assert (slack > 0).all() and len(entry) == len(slack) and len(key) == len(value)
    linked = {}
    for k, v in zip(key.tolist(), (value.view(np.uint64) >> np.uint64(1)).tolist(), strict=True):
        linked.setdefault(k, set()).add(v)
    together = {(a, b) for s in linked.values() for a in s for b in s}
    found = [set(sets.hash[sets.first[i] : sets.first[i + 1]].tolist()) for i in range(len(sets.n))]
    for a in range(len(found)):
        for b in range(a):
            both = len(found[a] & found[b])
            if both and 100 * both >= 85 * (len(found[a]) + len(found[b]) - both):
                assert sets.number[a] == sets.number[b] or (int(sets.number[a]), int(sets.number[b])) in together
                assert np.bitwise_count(np.bitwise_xor(*sets.sketches()[[a, b]]).view(np.uint64)).sum() <= len(found[a] ^ found[b])


def test_hub_cut_again(spark):
    # All shingles of the hub fall in one part, so it is cut again; its copies are linked with nothing but the hub.
    for seed in range(10_000):
        hub = " ".join(f"w{seed}x{k}" for k in range(8))
        own = near.Sets(pa.array([hub]), 5)
        bands = near.Bands(4, 80)
        filled = [len(near._parts(own, np.array([0]), bands.of(own.n), bands, cut)[0]) for cut in (1, 2)]
        if filled[0] == 1 and filled[1] > 2:
            break
    texts = [hub, *(f"{hub} own{k}" for k in range(80))]
    ids = list(range(100, 181))
    got = [tuple(r) for r in near_groups(frame(spark, texts, ids=ids), 5, 80).collect()]
    assert sorted(got) == sorted(groups_by_hand(texts, ids, 5, 80)) and {c for _, _, c in got} == {100}


def test_blocks_find_all(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 8)
    texts = near_texts()[:100]
    sets = near.Sets(pa.array(texts), 4)
    rows = [(int(v), int(v), int(n), s.tolist()) for v, n, s in zip(sets.number, sets.n, sets.sketches(), strict=True) if n]
    df = spark.createDataFrame(list({r[0]: r for r in rows}.values()), "v long, root long, n long, sketch array<long>")
    got = {frozenset((r["x"], r["y"])) for r in near._in_blocks(df, 85).collect()}
    for a in rows:
        for b in rows:
            apart = sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(a[3], b[3], strict=True))
            if a[0] < b[0] and apart <= near.most_different(a[2] + b[2], 85) and 100 * min(a[2], b[2]) >= 85 * max(a[2], b[2]):
                assert frozenset((a[0], b[0])) in got


def test_near_copies_of_no_rows(spark):
    assert near_groups(frame(spark, ["x"]).limit(0)).count() == 0
    assert sorted(tuple(r) for r in near_groups(frame(spark, [None, "", None])).collect()) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("block", [8, 500_000])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(parts, "BLOCK", block)
    r = random.Random(2)
    links = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(50)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(80)] + [(7, 7)]
    got = {x["v"]: x["root"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {v: v for e in links for v in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {v: x for v, x in got.items()} == {v: root[v] for v in got}
    assert set(got) >= {v for a, b in links if a != b for v in (a, b)}
