"""The pipeline on a small fixture, stage by stage, against plain versions of what a stage must do."""

from __future__ import annotations

import random

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pricebook.llm.registry import ORACLE, QUERIES

from .data import WORD, prose
from .test_dedup import edited, groups_by_hand
from .test_tokens import plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(1)
    texts = [prose(3_000 + k, 40 + k % 50) for k in range(200)]
    texts += [edited(texts[k], 1, k) for k in range(0, 40, 2)] + [texts[k] for k in range(41, 61, 2)]
    labels = []
    for k in range(len(texts)):
        bad = k % 5 == 3
        labels.append((k, int(bad)))
        if bad:
            w = texts[k].split(" ")
            w.insert(r.randrange(len(w)), "vermin")
            w.insert(r.randrange(len(w)), "imbecile")
            texts[k] = " ".join(w)
    texts[7] += " password=hunter2hunter2"
    rows = [(k, t, ("en", "de")[k % 2], ("a", "b", "c", None)[k % 4], len(t)) for k, t in enumerate(texts)]
    rows += [(None, None, None, None, None), (len(rows), "", "en", "a", 0)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "near_copies", "secrets", "mixing", "packing"]

    clean = stage["toxicity"](spark, docs, folder)
    assert clean.columns == COLUMNS
    kept = clean.collect()
    want = [r for r in docs.collect() if not {"vermin", "imbecile"} & set((r["text"] or "").split())]
    assert sorted(map(repr, kept)) == sorted(map(repr, want))

    single = stage["near_copies"](spark, spark.createDataFrame(kept, SCHEMA), folder).collect()
    groups = groups_by_hand([r["text"] for r in kept], [r["doc_id"] for r in kept], 5, 80)
    assert sorted(repr(r) for r in single) == sorted(repr(r) for r, g in zip(kept, groups, strict=True) if g[0] == g[2])
    assert len(single) < len(kept)

    safe = stage["secrets"](spark, spark.createDataFrame(single, SCHEMA), folder)
    assert safe.columns == COLUMNS
    safe = safe.collect()
    changed = [r for r in safe if "[secret]" in (r["text"] or "")]
    assert [r["doc_id"] for r in changed] == [7] and changed[0]["n_chars"] == len(changed[0]["text"]) and len(safe) == len(single)

    mixed = stage["mixing"](spark, spark.createDataFrame(safe, SCHEMA), folder)
    assert mixed.columns == COLUMNS
    mixed = mixed.collect()
    size = {s: sum(len(WORD.findall(r["text"] or "")) for r in mixed if r["source"] == s) for s in ("a", "b", "c", None)}
    total = sum(len(WORD.findall(r["text"] or "")) for r in safe)
    assert size["a"] == pytest.approx(total * 5 / 13, rel=0.1) and size["c"] == pytest.approx(total * 1 / 13, rel=0.2)

    pieces = stage["packing"](spark, spark.createDataFrame(mixed, SCHEMA), folder).collect()
    assert sum(p["length"] for p in pieces) == sum(len(x) + 1 for x in plain([r["text"] for r in mixed]))
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in mixed}
    assert all(np.frombuffer(p["ids"], "<u4")[-1] == 0 for p in pieces if p["start"] + p["length"] == p["doc_tokens"])


def test_near_copies_without_ids_and_with_shared_ids(spark):
    a, b, c = prose(50, 60), prose(51, 60), prose(52, 60)
    rows = [(None, a), (1, edited(a, 1, 1)), (2, edited(a, 1, 2)), (3, b), (3, c), (3, c), (None, c), (None, edited(prose(53, 60), 0, 0)), (None, prose(53, 60)), (4, None), (4, None), (5, " "), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, "")
    assert got.columns == COLUMNS
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    want = [(1, edited(a, 1, 1)), (3, b), (3, c), (None, prose(53, 60)), (4, None), (4, None), (5, " "), (None, "")]
    assert kept == sorted(want, key=repr)


def test_run_and_registration(spark, folder):
    assert corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and "sequence_id" in out.columns
    names = entry.queries()
    assert names["pipeline"] is corpus_pipeline.run and set(QUERIES) <= set(names) and set(ORACLE) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
