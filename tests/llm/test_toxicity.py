from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from pricebook.llm import toxicity
from pricebook.llm.toxicity import ASCII, LOOKS_LIKE, Restorer, alphabet, character_model, fit, restore, score

from .data import ODD, ODD_IDS, frame

VILE = ["stupid", "idiot", "scum", "moron", "evil", "ass", "fuck", "cunt"]


#: Words with the letters and pairs of a language, as random letters say nothing about what is likely.
ENGLISH = """the of and to in is was for that with as his on be at by had it are but from or have an they which one you were all her she
there would their we him been has when who will no more if out so up said what its about than into them can only other time new some
could these two may first then do any like my now over such our man me even most made after also did many off before must well back
through years much where your way down should because long each just those people how too little state good very make world still see
men work long here get both between life being under never day same another know while last might us great old year come since against
go came right used take three letter apple happy difference better small school book need feel street tell call follow""".split()


def english(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(ENGLISH) for _ in range(n))


def corpus():
    r = random.Random(3)
    texts, labels = [], []
    for k in range(300):
        words = english(k, 60).split()
        if k % 3 == 0:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(VILE))
        texts.append(" ".join(words))
        labels.append(int(k % 3 == 0))
    return texts, labels


@pytest.fixture(scope="module")
def scorer(spark):
    texts, labels = corpus()
    return fit(frame(spark, texts), spark.createDataFrame([*enumerate(labels)], "doc_id long, toxic int"))


#: Each disguise at the start, in the middle and at the end of a word.
DISGUISES = {
    "idiot": ["!diot", "id!ot", "idi0t", "idio7", "idio+", "iidiot", "idioot", "idiott", "i-diot", "idi.ot", "idio/t", "id*ot"],
    "stupid": ["stu.pid", "stu-pid", "s/t/u/p/i/d", "s,t,u,p,i,d", "$tupid", "stup!d", "5tupid", "sstupid", "stuppid", "stupidd", "s.tupid", "stupi_d", "st*pid"],
    "scum": ["s--c--u--m", "sscumm", "s(um", "$cum", "sc*m", "s-cum", "scu-m"],
    "moron": ["moorron", "m0r0n", "mo.ron", "m*ron", "mmoron", "moronn", "m.o.r.o.n"],
    "evil": ["€vil", "ev!l", "evi|", "3vil", "evi1"],
    "ass": ["a55", "a$$", "a$s", "a5s"],
    "fuck": ["f*ck", "fuc*k", "f-u-c-k"],
    "cunt": ["cun+", "c*nt", "c.unt"],
}


def test_each_disguise_is_restored(scorer):
    r = Restorer(scorer.model, scorer.letters)
    got = {(word, d): r.words(d) for word, forms in DISGUISES.items() for d in forms}
    assert {k: v for k, v in got.items() if v != (k[0],)} == {}


def test_untouched_words_stay(scorer):
    r = Restorer(scorer.model, scorer.letters)
    for t in ENGLISH:
        for shape in ("{}", "({})", "({}", "“{}”,", "{}!", "{}?!", "{}.", "¡{}!", "...{}"):
            assert r.words(shape.format(t)) == (t,)
    assert r.words("don't") == ("don", "t") and r.words("1,000") == () and r.words("--") == () and r.words("") == ()


def test_repeated_letters_are_settled_as_decoded():
    r = random.Random(8)
    model = np.log(np.array([r.random() for _ in range(29**3)]))
    restorer = Restorer(model, ASCII + "é")
    words = ["".join(r.choice("abé") for _ in range(r.randrange(1, 9))) for _ in range(3_000)] + ["xx", "aaaa", "ññ", "ñññab", "aabbbcc"]
    assert restorer.settled(words) == [restorer.decode(w) for w in words]
    assert restorer.settled([]) == [] and restorer.settled(["ab"]) == ["ab"]


def test_paths_of_all_kinds_of_steps():
    r = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzé"
    model = np.log(np.array([r.random() for _ in range(29**3)]))
    restorer = Restorer(model, letters)

    def likelihood(text):
        a = b = 0
        total = 0.0
        for c in [*text, " "]:
            z = letters.find(c) + 1 if c in letters else 28 if c.isalpha() else 0
            if z or b:
                total += model[(a * 29 + b) * 29 + z]
                a, b = b, z
        return total

    for text in ("!d!!", "a55", "a.b-c", "(éé", "f*k", "ssß", "x--y..zz", "ñ3ñ", "don't", "abcd.efgh"):
        paths = [("".join(x for x, _ in path), sum(c for _, c in path)) for path in itertools.product(*restorer._options(text, False))]
        best = max(c + likelihood(p) for p, c in paths)
        got = restorer.decode(text)
        assert any(p.strip() == got and c + likelihood(p) == pytest.approx(best) for p, c in paths), text


def test_letters_of_the_corpus(spark):
    texts = ["Über uns", "überall ÜBER", "ñandú", None, "", "1234 __ ×", "ñ"]
    df = frame(spark, texts, ids=range(len(texts)))
    assert alphabet(df) == ASCII + "".join(sorted("úüñ"))
    assert alphabet(df, most=27) == ASCII + "ü" and alphabet(df.limit(0)) == ASCII
    letters = alphabet(df)
    size = len(letters) + 2
    n = np.zeros((size, size, size))
    code = {c: i for i, c in enumerate(letters, 1)}
    # The run of all texts, as one task counts them.
    signs = [0, 0]
    for c in "\n".join(t for t in texts if t).lower() + " ":
        z = code.get(c, size - 1 if c.isalpha() else 0)
        if z or signs[-1]:
            signs.append(z)
    for a, b, c in zip(signs, signs[1:], signs[2:], strict=False):
        n[a, b, c] += 1
    bi, uni = n.sum(0), n.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + size)
    p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
    p3 = (n + 20 * p2[None]) / (n.sum(2, keepdims=True) + 20)
    assert np.allclose(character_model(df.coalesce(1), letters=letters), np.log(p3).ravel())


def test_accented_words_are_told_apart(spark):
    texts = ["el niño pequeño soñaba mañana"] * 30 + ["über grün müde"] * 30
    df = frame(spark, texts)
    letters = alphabet(df)
    r = Restorer(character_model(df, letters=letters), letters)
    assert r.words("n!ño") == ("niño",) and r.words("peque.ño") == ("pequeño",) and r.words("gr*n") == ("grün",)


def plain_words(restorer, text):
    """The restored words of a text, token by token."""
    tokens = (text or "").split()
    single = [len(t) <= 2 and sum(c.isalnum() or c in LOOKS_LIKE for c in t.lower()) == 1 for t in tokens]
    words, i = [], 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and single[j]:
            j += 1
        if j - i >= 3:
            words += regex.findall(r"\p{L}+", restorer.decode(" ".join(tokens[i:j]).lower(), True))
            i = j
        else:
            words += restorer.words(tokens[i])
            i += 1
    return words


def test_scores_by_brute_force(spark, scorer):
    texts = [*(f"{english(42_000 + k, 12)} {d}" for k, d in enumerate(itertools.chain(*DISGUISES.values()))), "a s s c l o w n", "x y", "s c u m", *ODD]
    df = frame(spark, texts, ids=[*range(100, 100 + len(texts) - len(ODD)), *ODD_IDS])
    r = Restorer(scorer.model, scorer.letters)
    for row in score(df, scorer).select("text", "toxicity").collect():
        found = {f for w in plain_words(r, row["text"]) if len(w) > 2 for f in [f"={w}", *(f"{n}{w[:n]}" for n in (4, 5) if len(w) >= n)]}
        margin = sum(scorer.weights.get(f, 0.0) for f in found)
        assert row["toxicity"] == pytest.approx(1 / (1 + math.exp(scorer.line - margin)))
    told = restore(df, scorer.model, letters=scorer.letters).select("text", "restored").collect()
    assert all(sorted(row["restored"].split()) == sorted(plain_words(r, row["text"])) for row in told)


def test_memory_runs_out(scorer, monkeypatch):
    monkeypatch.setattr(toxicity, "MEMORY", 3)
    r = Restorer(scorer.model, scorer.letters)
    forms = [d for d in itertools.chain(*DISGUISES.values())]
    fresh = [Restorer(scorer.model, scorer.letters).words(d) for d in forms]
    assert [r.words(d) for d in forms] == fresh and len(r.seen) <= 3


def test_another_text_column(spark, scorer):
    df = frame(spark, [english(43_000, 20), None]).withColumn("body", F.lit("stup!d idi0t m0r0n scum evil a55"))
    got = score(df, scorer, text="body")
    assert got.columns == [*(c for c in df.columns if c != "margin"), "toxicity"]
    assert sorted(r["text"] or "" for r in got.collect()) == sorted(["", english(43_000, 20)]) and all(r["toxicity"] >= 0.5 for r in got.collect())
