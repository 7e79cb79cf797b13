from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricebook.llm import language, quality
from pricebook.llm.language import DIM, Trigrams, identify, letter_vectors, train
from pricebook.llm.quality import judge
from pricebook.llm.toxicity import SYMBOLS, Restorer, character_model, fit, restore, score

from .data import ODD, ODD_IDS, WORD, frame, prose

VILE = ["moron", "scum", "pathetic", "worthless"]


def toxic_corpus():
    r = random.Random(11)
    texts, labels = [], []
    for k in range(400):
        t = prose(600 + k, 30).split()
        bad = k % 4 == 0
        if bad:
            for _ in range(2):
                t.insert(r.randrange(len(t)), r.choice(VILE))
        texts.append(" ".join(t))
        labels.append(int(bad))
    return texts, labels


@pytest.fixture(scope="module")
def scorer(spark):
    texts, labels = toxic_corpus()
    df = frame(spark, texts)
    marks = spark.createDataFrame([*enumerate(labels), (None, 1), (5, None)], "doc_id long, toxic int")
    return fit(df, marks)


def test_disguised_words_are_restored(scorer):
    r = Restorer(scorer.model)
    assert r.words("m0r0n") == ("moron",)
    assert r.words("path3tic!!") == ("pathetic",)
    assert r.words("mooooron") == ("moron",)
    assert r.words("s.c.u.m") == ("scum",)
    assert r.words("Plain,") == ("plain",) and r.words("2024") == () and r.words("don't") == ("don", "t")


def test_viterbi_finds_the_best_path():
    r = random.Random(4)
    model = np.log(np.array([r.random() for _ in range(SYMBOLS**3)]))
    restorer = Restorer(model)

    def all_paths(options):
        paths = [("", 0.0)]
        for o in options:
            paths = [(p + x, s + c) for p, s in paths for x, c in o]
        return paths

    def likelihood(text):
        a = b = 0
        total = 0.0
        for c in [*text, " "]:
            z = 0 if c == " " else ord(c) - 96
            if z == 0 and b == 0:
                continue
            total += model[(a * SYMBOLS + b) * SYMBOLS + z]
            a, b = b, z
        return total

    for text in ("m0r0n", "b1tt3r", "s(um", "a55e77", "l00000k"):
        paths = all_paths(restorer._options(text, False))
        best = max(s + likelihood(p) for p, s in paths)
        got = restorer.decode(text)
        assert any(p.strip() == got and s + likelihood(p) == pytest.approx(best) for p, s in paths)


def test_scores(spark, scorer):
    clean, toxic = prose(9_001, 40), prose(9_002, 30) + " you m0r0n"
    texts = [clean, toxic, "s c u m of " + prose(9_003, 20), prose(9_004, 10) + " worthlessss", *ODD]
    df = frame(spark, texts, ids=[101, 102, 103, 104, *ODD_IDS])
    got = score(df, scorer).collect()
    assert len(got) == len(texts) and list(got[0].asDict()) == [c for c in df.columns if c != "margin"] + ["toxicity"]
    by = {r["doc_id"]: r["toxicity"] for r in got if r["doc_id"] and r["doc_id"] > 100}
    assert by[101] < 0.5 and min(by[102], by[103], by[104]) >= 0.5
    assert all(0 <= r["toxicity"] <= 1 for r in got)
    same = {}
    for r in got:
        assert same.setdefault(r["text"], r["toxicity"]) == r["toxicity"]
    told = restore(df, scorer.model).filter("doc_id = 102").first()["restored"]
    assert told.endswith("you moron")


def test_held_out_accuracy(spark, scorer):
    texts = [prose(7_000 + k, 30) + (f" {VILE[k % 4]}" if k % 3 == 0 else "") for k in range(60)]
    got = score(frame(spark, texts), scorer).collect()
    assert sum((r["toxicity"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in got) >= 57


def test_no_labels_and_no_rows(spark, scorer):
    df = frame(spark, ["some words", None])
    none = fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert len({r["toxicity"] for r in score(df, none).collect()}) == 1 and score(df, none).first()["toxicity"] < 0.5
    assert score(df.limit(0), scorer).count() == 0
    assert np.allclose(np.exp(character_model(df.limit(0))), 1 / SYMBOLS)


def test_profiles_are_bundles_of_bound_trigrams():
    texts = ["ab ba", "é1é", "", "  A,b  "]
    grams = Trigrams(pa.array([*texts, None]))
    got = grams.profiles(DIM)
    assert grams.has_letter.tolist() == [True, True, False, True, False]
    for t, p in zip(texts, got, strict=False):
        plain = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        want = np.zeros(DIM)
        for k in range(len(plain) - 2):
            a, b, c = (letter_vectors(np.array([ord(x)]), DIM)[0] for x in plain[k : k + 3])
            want += np.roll(a, 2) * np.roll(b, 1) * c
        assert (p == want).all() or not any(c.isalpha() for c in t)


def test_large_alphabets(monkeypatch):
    texts = ["".join(chr(0x4E00 + (k * 7 + j) % 300) for j in range(400)) for k in range(3)]
    whole = Trigrams(pa.array(texts)).profiles(DIM)
    monkeypatch.setattr(language, "BLOCK", 64)
    assert (Trigrams(pa.array(texts)).profiles(DIM) == whole).all()


def test_languages(spark):
    def text(lang, k):
        r = random.Random(f"{lang}{k}")
        parts = {"en": ["the", "ing", "tion", "er", "wh"], "fr": ["eau", "é", "que", "ou", "ch"], "xx": ["zz", "kq", "vw"]}[lang]
        return " ".join("".join(r.choice(parts) for _ in range(1 + k % 3)) for _ in range(30))

    train_texts = [text(lang, k) for k in range(20) for lang in ("en", "fr", "xx")]
    known = train(frame(spark, [*train_texts, None, "zzz"], langs=("en", "fr", "xx"), ids=range(62)).withColumn("lang", F.expr("CASE WHEN doc_id < 60 THEN lang END")))
    assert set(known) == {"en", "fr", "xx"}
    df = frame(spark, [*(text(lang, 100 + k) for k in range(10) for lang in ("en", "fr", "xx")), *ODD], ids=[*range(100, 130), *ODD_IDS], langs=("en", "fr", "xx"))
    got = identify(df, known).collect()
    assert len(got) == 30 + len(ODD)
    assert all(r["lang_pred"] == r["lang"] for r in got if r["doc_id"] and r["doc_id"] >= 100)
    assert all(0 <= r["lang_score"] <= 1 for r in got)
    assert all((r["lang_pred"], r["lang_score"]) == ("und", 0.0) for r in got if not any(c.isalpha() for c in r["text"] or ""))
    assert {r["lang_pred"] for r in identify(df, {}).collect()} == {"und"}
    assert train(df.limit(0)) == {} and identify(df.limit(0), known).count() == 0


def counts_by_hand(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    twice = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice)


def test_quality_counts_and_outliers(spark):
    good = [prose(800 + k, 60 + k) for k in range(260)]
    junk = [" ".join(w + "###" for w in prose(900 + k, 60).split()) for k in range(6)] + [prose(950 + k, 60).upper() for k in range(6)]
    repeated = ["a b c d e f\n" * 9 + prose(990, 20), "one two three four five " * 6]
    texts = [*good, *junk, *repeated, *ODD]
    ids = [*range(100, 100 + len(texts) - len(ODD)), *ODD_IDS]
    df = frame(spark, texts, ids=ids, langs=("en",), sources=("a",))
    got = judge(df).collect()
    key = repr
    assert sorted(((r["doc_id"], *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in got), key=key) == sorted(((i, *counts_by_hand(t)) for i, t in zip(ids, texts, strict=True)), key=key)
    by = {r["doc_id"]: r for r in got if r["doc_id"] and r["doc_id"] >= 100}
    assert all(by[100 + k]["kept"] for k in range(len(good)))
    assert not any(by[100 + len(good) + k]["kept"] for k in range(len(junk)))
    assert all(by[100 + len(good) + len(junk) + k]["base_failed"] for k in range(2))
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_repeated_short_lines_are_rejected(spark):
    # Lines of three words between own paragraphs: no window of five words is found twice.
    good = [prose(2_000 + k, 80) for k in range(150)]
    junk = [("\n".join(f"more about this\n{prose(3_000 + 50 * k + i, 4)}{i}" for i in range(12))) for k in range(3)]
    df = frame(spark, [*good, *junk], langs=("en",), sources=("a",))
    got = judge(df).collect()
    assert not any(r["base_failed"] for r in got)
    assert not any(r["kept"] for r in got if r["doc_id"] >= 150)
    assert sum(r["kept"] for r in got if r["doc_id"] < 150) >= 145


def test_distance_is_mahalanobis(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 5)) @ r.normal(size=(5, 5))
    rows = [("g", *map(float, v)) for v in x]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"{d} double" for d in quality.DIMENSIONS))
    fit_ = quality._start(df)

    def measured(fit_):
        got = df.join(fit_, "g").select(*quality.DIMENSIONS, quality._distance().alias("d2")).collect()
        return np.array([list(d)[:-1] for d in got]), np.array([d["d2"] for d in got])

    for _ in range(2):
        x, before = measured(fit_)
        near = before <= np.sort(before)[int(np.ceil(0.75 * 300)) - 1]
        centre = x[near].mean(0)
        cov = np.cov(x[near].T, bias=True) + np.diag([v**2 for v in quality.STATISTICS.values()])
        fit_ = quality._step(df, fit_, 0.75)
        x, after = measured(fit_)
        assert np.allclose(after, np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre))


def test_quality_of_few_and_no_rows(spark):
    df = frame(spark, ODD, ids=ODD_IDS)
    assert judge(df).count() == len(ODD)
    assert judge(df.limit(0)).count() == 0
    assert not any(r["kept"] for r in judge(frame(spark, [None, ""])).collect())
