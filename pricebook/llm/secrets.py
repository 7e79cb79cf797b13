"""Secret scans: three fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a maximal run of a character class.  Over windows of a fixed width the entropy of the characters is
kept by incremental counts: one character comes in, one goes out.  Windows at or above the class's threshold, with
letters and digits, merge into spans.  Runs of letters of one case and digits have classes of their own, which look for
letters and digits in the whole run.  Spans inside text on the allow list (addresses, hosts and paths of URLs, UUIDs,
alphabet sequences) are suppressed; spans of the fixed patterns always stay.

Map-only: each row is scanned by itself, so nothing is shuffled and no group can be hot.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .tokens import BATCH_BYTES, slices

#: The kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "entropy")

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(r"\S{16,}")
#: The user part of a URL.
_USER = re.compile(r"(?i:[a-z][a-z0-9+.-]*)://([^\s/?#\"'<>]*)@")


@dataclass(frozen=True)
class EntropyClass:
    """Runs of ``chars``; ``width`` characters with at least ``bits`` of entropy are a secret's."""

    name: str
    chars: str
    width: int
    bits: float
    #: What a window must hold besides.
    needs: tuple[str, ...]
    #: It is enough that the run holds it.
    by_run: bool = False


CLASSES = (
    EntropyClass("hex", "0-9A-Fa-f", 24, 3.0, ("0-9", "A-Fa-f")),
    EntropyClass("base64", "A-Za-z0-9+/_=-", 20, 3.6, ("0-9", "A-Z", "a-z")),
    EntropyClass("lower", "a-z0-9", 16, 3.25, ("0-9", "a-z"), True),
    EntropyClass("upper", "A-Z0-9", 16, 3.25, ("0-9", "A-Z"), True),
)

#: Of a pattern with a group ``clean`` only that group is allowed: a URL's host and path, not its user part or parameters.
ALLOW = (
    r"(?i:https?|ftp)://(?:[^\s/?#\"'<>]*@)?(?P<clean>[^\s?#\"'<>]+)",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})",
    r"(?i:abcdefghijklmnop[a-z]*(?:0123456789)?)",
)


def entropies(run: str, width: int) -> Iterator[float]:
    """The Shannon entropy of each window of a run, in bits, by incremental counts."""
    xlog = [0.0] + [c * math.log2(c) for c in range(1, width + 2)]
    counts: dict[str, int] = {}
    total = 0.0
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += xlog[n + 1] - xlog[n]
        if i >= width:
            old = run[i - width]
            n = counts[old]
            counts[old] = n - 1
            total += xlog[n - 1] - xlog[n]
        if i >= width - 1:
            yield math.log2(width) - total / width


class Scanner:
    """The patterns of a scan, compiled once per task."""

    def __init__(self, classes: tuple[EntropyClass, ...], allow: tuple[str, ...]):
        self.classes = [(c, re.compile(f"[{c.chars}]{{{c.width},}}"), [re.compile(f"[{n}]") for n in c.needs]) for c in classes]
        self.allow = [re.compile(a) for a in allow]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, place of the kind) in code points, in order."""
        found = []
        if ":" in text or "=" in text:
            low = text.lower()
            if any(w in low for w in _ASSIGN_WORDS):
                found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
        high: list[tuple[int, int]] = []
        for long in _LONG.finditer(text):
            a, b = long.span()
            found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text, a, b) if m.end() - m.start() >= 20]
            found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text, a, b)]
            for c, run, needs in self.classes:
                for m in run.finditer(text, a, b):
                    if all(n.search(m[0]) for n in needs):
                        high += self._high(m[0], m.start(), c, needs)
        if high:
            users = [m.span(1) for m in _USER.finditer(text)]
            allowed = [m.span("clean" if "clean" in a.groupindex else 0) for a in self.allow for m in a.finditer(text)]
            # A password before a host is no address.
            allowed = [(x, y) for x, y in allowed if not any(x < v and u < y for u, v in users)]
            found += [(a, b, 3) for a, b in _merge(high) if not any(x <= a and b <= y for x, y in allowed)]
        return sorted(found, key=lambda s: (s[0], s[2]))

    def _high(self, run: str, at: int, c: EntropyClass, needs: list[re.Pattern]) -> list[tuple[int, int]]:
        return [(at + i, at + i + c.width) for i, bits in enumerate(entropies(run, c.width)) if bits >= c.bits and (c.by_run or all(n.search(run, i, i + c.width) for n in needs))]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = "array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame, classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW, text: str = "text", redact: str | None = None) -> DataFrame:
    """Adds ``secret_spans`` to all rows: kind, start and end (code points, end exclusive), by start, then kind.

    A null or empty text has no spans.  Rows are kept as they are, repeated ones too; no rows stay no rows.  A column
    of the name ``secret_spans`` that was there before is replaced.  With ``redact``, that string also takes the place
    of every stretch of text that spans cover.
    """
    carried = [c for c in docs.columns if c != "secret_spans"]
    where = carried.index(text)
    fields = [docs.schema[c] for c in carried]
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields) + f", secret_spans {SPANS}"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allow)
        for whole in batches:
            for batch in slices(whole, where, BATCH_BYTES):
                texts = batch.column(where).to_pylist()
                spans = [scanner.spans(t) if t else [] for t in texts]
                columns = list(batch.columns)
                if redact is not None and any(spans):
                    columns[where] = pa.array([_redacted(t, s, redact) if s else t for t, s in zip(texts, spans, strict=True)], pa.string())
                told = pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in s] for s in spans], kind)
                yield pa.RecordBatch.from_arrays([*columns, told], names=[*batch.schema.names, "secret_spans"])

    return docs.select(*(docs[c] for c in carried)).mapInArrow(run, schema)


def _redacted(text: str, spans: list[tuple[int, int, int]], by: str) -> str:
    out, at = [], 0
    for a, b in _merge([s[:2] for s in spans]):
        out += [text[at:a], by]
        at = b
    return "".join([*out, text[at:]])


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
