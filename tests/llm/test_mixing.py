from __future__ import annotations

import pytest

from pricebook.llm.mixing import cyclic_weights, mix, mix_plan

from .data import ODD, ODD_IDS, WORD, frame, prose


def plan_of(df):
    return [r.asDict() for r in mix_plan(df).collect()]


def test_targets_and_copies(spark):
    texts = [prose(k, 5 + k % 40) for k in range(600)]
    df = frame(spark, texts, sources=("b", "a", "a", "a", None, "c"))
    got = plan_of(df)
    size = {k: len(WORD.findall(t)) for k, t in enumerate(texts)}
    own = {}
    for k in size:
        s = ("b", "a", "a", "a", None, "c")[k % 6]
        own[s] = own.get(s, 0) + size[k]
    weight = {"a": 5, "b": 2, "c": 1, None: 5}
    total, target, open_ = sum(own.values()), {}, set(own)
    left = float(total)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * own[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * own[s]
            left -= target[s]
        open_ -= over
    assert {r["source"]: pytest.approx(r["target"]) for r in got} == target
    for s, want in target.items():
        mine = [r for r in got if r["source"] == s]
        taken = sum(r["copies"] * r["size"] for r in mine)
        assert abs(taken - want) <= 2 * max(r["size"] for r in mine)
        rate = want / own[s]
        assert all(int(rate) <= r["copies"] <= int(rate) + 1 for r in mine)
    # Reruns agree, however the rows are dealt out.
    again = plan_of(df.repartition(7))
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) > 0


def test_odd_rows(spark):
    df = frame(spark, ODD, ids=ODD_IDS)
    got = plan_of(df)
    assert sum(r["rows"] for r in got) == len(ODD)
    assert all(0 <= r["copies"] <= 3 for r in got)
    out = mix(df)
    assert out.columns == df.columns
    assert out.count() == sum(r["rows"] * r["copies"] for r in got)


def test_repeated_rows_get_the_same_copies(spark):
    df = frame(spark, ["a b c"] * 5 + ["d e"], ids=[1] * 5 + [2], sources=("s",))
    assert sorted((r["doc_id"], r["rows"], r["copies"]) for r in plan_of(df)) == [(1, 5, 1), (2, 1, 1)]


def test_no_rows_and_no_words(spark):
    df = frame(spark, ["x"])
    assert plan_of(df.limit(0)) == [] and mix(df.limit(0)).count() == 0
    assert [r["copies"] for r in plan_of(frame(spark, [None, ""]))] == [0, 0]


def test_own_weights(spark):
    df = frame(spark, ["a b"] * 30, sources=("x", "y", "z"))
    weights = spark.createDataFrame([("x", 1), ("y", 3)], "source string, weight long")
    got = [r.asDict() for r in mix_plan(df, weights).collect()]
    assert {(r["source"], r["target"]) for r in got} == {("x", 10.0), ("y", 30.0)}
    assert cyclic_weights(df.select("source")).count() == 3
