from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from pricebook.llm import secrets
from pricebook.llm.scan_queries import op7_secret_scan
from pricebook.llm.secrets import Scanner, entropies, scan

from .data import ODD, ODD_IDS, frame

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEY = "AKIA" + "Q7ZK3M1P" * 2
HEX = "0123456789abcdef" * 2
MIXED = "aG7kQ2xZ9pLm4VtR8sWd1Yc"


def by_hand(t):
    spans = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[0], s[2]))


PIECES = st.sampled_from(["password", "SECRET", "api_key", "apikey", "token", ":", "=", " ", "  ", '"', "abc", "abcdef", "x1", KEY, HEX, "AKIA", "ſecret", "toKen", "é", "\n", "passwd="])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_spans(text):
    got = [s for s in Scanner(secrets.CLASSES, secrets.ALLOW).spans(text) if s[2] < 3]
    assert got == by_hand(text)


def test_entropy_by_increments():
    run = MIXED + "aaaaaaaaaaaaaaaaaaaaaaaaaa" + HEX
    for i, e in enumerate(entropies(run, 20)):
        c = Counter(run[i : i + 20])
        assert e == pytest.approx(-sum(n / 20 * math.log2(n / 20) for n in c.values()))
    assert list(entropies("short", 20)) == []


def kinds(text):
    return [secrets.KINDS[k] for _, _, k in Scanner(secrets.CLASSES, secrets.ALLOW).spans(text)]


def test_high_entropy_and_the_allow_list():
    assert kinds(f"see {MIXED} there") == ["entropy"]
    assert kinds(f"see https://example.com/{MIXED} there") == []
    assert kinds("id 123e4567-e89b-12d3-a456-426614174000 there") == []
    assert kinds("ThisIsAVeryLongCamelCaseWordOfProse and antidisestablishmentarianism") == []
    assert kinds("4587121519400672 458712151940067245871215") == ["hex"]
    assert kinds(f"token={MIXED}") == ["assign", "entropy"]


@pytest.mark.parametrize("secret", ["k3x9q7m2v8t4z1w6", "k3x9q7m2v8t4z1w6p5r0", "JBSWY3DPEHPK3PXPQX2R", "GEZDGNBVGY3TQOJQ"])
def test_secrets_of_one_case(secret):
    assert kinds(f"see {secret} there") == ["entropy"]
    assert kinds("internationalization INTERNATIONALIZATION 1234567890123456") == []


def test_secrets_in_urls():
    for url in (f"https://example.com/a?key={MIXED}", f"https://example.com/a#t={MIXED}", f"https://me:{MIXED}@example.com/a", f"postgres://me:{MIXED}@db.example.com/a"):
        assert kinds(f"see {url} there") == ["entropy"]
    assert kinds(f"see https://me@example.com/{MIXED}?a=b there") == []
    assert kinds(f"write to {MIXED}@example.com") == []


def test_odd_rows_and_redaction(spark):
    df = frame(spark, [*ODD, f"é token = '{MIXED}' and {KEY}", f"é token = '{MIXED}' and {KEY}"], ids=[*ODD_IDS, 50, 50])
    got = scan(df, redact="[secret]").collect()
    assert len(got) == len(ODD) + 2 and list(got[0].asDict()) == [*df.columns, "secret_spans"]
    hit = [r for r in got if r["doc_id"] == 50]
    assert [r["text"] for r in hit] == ["é [secret]' and [secret]"] * 2
    assert [s["kind"] for s in hit[0]["secret_spans"]][:3] == ["assign", "entropy", "access"]
    assert sorted((r["text"] or "") for r in got if r["doc_id"] != 50) == sorted("[secret]" if t == "a" * 5_000 else t or "" for t in ODD)
    assert scan(df.limit(0)).count() == 0
    assert scan(scan(df)).columns == [*df.columns, "secret_spans"]


def test_query_digest(spark, tmp_path):
    text = f"é password: hunter22 {KEY} {HEX}"
    frame(spark, [text, None]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op7_secret_scan(spark, str(tmp_path)).collect()}
    want = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, b, k in by_hand(text))
    assert (got[0]["n_assign"], got[0]["n_access"], got[0]["n_hex"]) == (1, 1, 1)
    assert got[0]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert got[1]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
