"""Toxicity: noisy-channel restoration of disguised words, then a score of the restored text.

Writers disguise words by look-alike signs, by signs put between or in place of letters, by spacing letters out and by
repeating them.  Every token with such a place is a lattice of what its signs may stand for, the untouched reading being
one path; Viterbi decoding finds the likeliest letters under a character trigram model of the corpus and a channel model.
Words of letters alone have choices only where a letter is repeated, and these do not depend on each other, so they are
worked out for all words at once.

The character model counts trigrams over a boundary, the letters of the corpus (a-z and the most frequent others,
``MOST_LETTERS`` together) and one sign for letters beyond, in all documents: a table of bounded size that is summed up
across tasks.  The scorer weighs features of restored words (the word, and its first four and five letters), those whose
frequency in toxic and clean training texts differs beyond chance, by a sparse logistic regression; it is fitted on at
most ``TRAIN_ROWS`` labelled rows, which bounds what goes out to the tasks.  Scoring is map-only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from pricebook.session import materialize

from .tokens import ranges, slices

ASCII = "abcdefghijklmnopqrstuvwxyz"
#: Signs of a model over a-z: a boundary, the letters, any other letter.
SYMBOLS = len(ASCII) + 2
#: Letters that a character model tells apart at most.
MOST_LETTERS = 94
#: Labelled rows that a fit reads at most, taken by a hash of their id.
TRAIN_ROWS = 20_000
#: Disguised words remembered by a worker.
MEMORY = 50_000
#: Bytes of text taken apart at once.
RUN_BYTES = 1_000_000
#: Bytes of text whose letters are counted at once.
COUNT_BYTES = 500_000

#: What signs may stand for besides themselves.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "ß": "b"}
#: Look-alikes that are common punctuation before a word (with what closes them) and after it.
_OPENING, _CLOSING = {"(": ")", "¡": "!"}, "!(¡"
#: Punctuation at the ends of words that is cut off at once; what is left there is cut off by the lattice.
_BEFORE, _AFTER = "\"'“”‘’«»„[{<-–—*_¿…/", "\"'“”‘’«»,.;:?)]}>-–—*_…/"
_APOSTROPHES = "'’"

_SAME, _LOOKS, _SIGN = math.log(0.9), math.log(0.09), math.log(0.01)
_ONE, _TWO, _ALL = math.log(0.6), math.log(0.35), math.log(0.05)
_DOUBLE, _SINGLE = math.log(0.97), math.log(0.03)
#: (joined, apart) for the signs between single letters, between short pieces, and between two pieces of four letters and more.
_SPELLED, _SHORT, _PIECES = (math.log(0.7), math.log(0.3)), (math.log(0.5), math.log(0.5)), (math.log(0.1), math.log(0.9))
#: An opening sign whose closing one is not in the token, and a sign that is not written before a letter.
_UNCLOSED, _STRANGE = math.log(0.3), math.log(0.001)
_NEVER_BEFORE = "!|$€£"

_LETTERS = regex.compile(r"\p{L}+")
_SIGNS = regex.compile(r"[\p{L}0-9@$!|+(€£¡]+")


class Restorer:
    """Restores words under a character model (trigram log-probabilities over ``letters``)."""

    def __init__(self, model: np.ndarray, letters: str = ASCII):
        self.size = len(letters) + 2
        self.table = np.asarray(model, float)
        self.model = self.table.tolist()
        self.code = {c: i for i, c in enumerate(letters, 1)}
        self.seen: dict[str, tuple[str, ...]] = {}

    def _sign(self, c: str) -> int:
        return self.code.get(c) or (self.size - 1 if c.isalpha() else 0)

    def _options(self, text: str, spelled: bool) -> list[list[tuple[str, float]]]:
        """For each place what may have been meant (letters, none or more) and how likely it shows like this."""
        alike = [c.isalpha() or c in LOOKS_LIKE for c in text]
        alpha = [i for i, c in enumerate(text) if c.isalpha()]
        first, last = (alpha[0], alpha[-1]) if alpha else (len(text), -1)
        steps: list[list[tuple[str, float]]] = []
        i = before = 0
        while i < len(text):
            c = text[i]
            j = i + 1
            if alike[i]:
                before += 1
                while j < len(text) and text[j] == c:
                    j += 1
                n = j - i
                times = [(1, 0.0)] if n == 1 else [(2, _DOUBLE), (1, _SINGLE)] if n == 2 else [(1, _ONE), (2, _TWO), (n, _ALL)]
                meant = LOOKS_LIKE.get(c, "")
                if c.isalpha():
                    readings = [(c, _SAME if n == 1 else 0.0), *((m, _SINGLE) for m in meant)]
                else:
                    readings = [(m, _LOOKS - math.log(len(meant))) for m in meant]
                steps.append([(m * k, cost + more) for m, cost in readings for k, more in times])
                if not c.isalpha():
                    # Three and more of a sign are one sign, as for letters; two are two.
                    kept = _SIGN * (2 if n == 2 else 1)
                    if i > last and c in _CLOSING:
                        kept = _SAME
                    elif i < first and c in _OPENING:
                        kept = _SAME if _OPENING[c] in text[last:] else _UNCLOSED
                    elif j == first and c in _NEVER_BEFORE:
                        kept = _STRANGE
                    steps[-1].append((" ", kept))
                before += n - 1
                i = j
                continue
            while j < len(text) and not alike[j]:
                j += 1
            between = text[i:j]
            after = 0
            while after < 4 and j + after < len(text) and alike[j + after]:
                after += 1
            if not before or not after or not spelled and between in _APOSTROPHES:
                steps.append([(" ", _SAME)])
            elif between in ("*", "**") and not spelled:
                # One or two stars hide as many letters, any letter being as likely to be hidden.
                steps.extend([*((m, _LOOKS) for m in self.code), ("", _SIGN), (" ", _SIGN)] for _ in between)
            else:
                join, gap = _SPELLED if spelled else _PIECES if before >= 4 and after >= 4 else _SHORT
                steps.append([("", join), (" ", gap)])
            before = 0
            i = j
        return steps

    def decode(self, text: str, spelled: bool = False) -> str:
        """The likeliest restored text, by Viterbi over the last two letters."""
        model, size = self.model, self.size
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for options in [*self._options(text, spelled), [(" ", 0.0)]]:
            ahead: dict[tuple[int, int], tuple[float, tuple]] = {}
            coded = [(letters, cost, [self._sign(c) for c in letters]) for letters, cost in options]
            for (a, b), (score, path) in best.items():
                for letters, cost, signs in coded:
                    x, y, s = a, b, score + cost
                    for z in signs:
                        if z == 0 and y == 0:
                            continue
                        s += model[(x * size + y) * size + z]
                        x, y = y, z
                    if (x, y) not in ahead or s > ahead[x, y][0]:
                        ahead[x, y] = (s, (path, letters))
            best = ahead
        path = max(best.values(), key=lambda v: v[0])[1]
        parts = []
        while path:
            path, letters = path
            parts.append(letters)
        return "".join(reversed(parts)).strip()

    def words(self, token: str) -> tuple[str, ...]:
        """The restored words of a token between white space; none for one without letters."""
        known = self.seen.get(token)
        if known is not None:
            return known
        low = token.lower()
        words: tuple[str, ...] = ()
        if _LETTERS.search(low):
            runs = _SIGNS.findall(low)
            words = tuple(_LETTERS.findall(self.decode(low, len(runs) >= 3 and all(len(r) == 1 for r in runs))))
        if len(self.seen) >= MEMORY:
            self.seen.clear()
        self.seen[token] = words
        return words

    def settled(self, words: list[str]) -> list[str]:
        """Words of letters alone with their repeated letters settled: what ``decode`` gives, for all at once.

        How often a repeated letter was meant changes the trigrams up to the letter after it only, and that letter and the one
        before are the same in all readings; so every choice stands for itself.
        """
        sign = np.frombuffer("\n".join(["", *words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        same = sign[1:] == sign[:-1]
        if len(same) == 0 or not same[1:-1].any():
            return words
        same[0] = same[-1] = False
        start = np.flatnonzero(same & ~np.concatenate([[False], same[:-1]]))
        end = np.flatnonzero(same & ~np.concatenate([same[1:], [False]])) + 1
        n = end - start + 1
        letters, at = np.unique(np.concatenate([sign[start - 1], sign[start], sign[end + 1]]), return_inverse=True)
        y, c, z = np.array([self._sign(chr(v)) for v in letters.tolist()])[at].reshape(3, -1)
        p, size = self.table, self.size
        again, thrice = p[(y * size + c) * size + c], p[(c * size + c) * size + c]
        on, on_again = p[(y * size + c) * size + z], p[(c * size + c) * size + z]
        one = on + np.where(n == 2, _SINGLE, _ONE)
        two = again + on_again + np.where(n == 2, _DOUBLE, _TWO)
        whole = np.where(n == 2, -np.inf, again + (n - 2) * thrice + on_again + _ALL)
        meant = np.where((two > one) | (n == 2) & (two == one), np.where(whole > two, n, 2), np.where(whole > one, n, 1))
        keep = np.ones(len(sign), bool)
        keep[ranges(start + meant, n - meant)] = False
        return sign[keep].tobytes().decode("utf-32-le", "surrogatepass").split("\n")[1:-1]


def _numbers(found: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)


class Restored:
    """The restored words of a run of texts: ``doc`` and ``word`` (a place in ``names``) for each of them."""

    def __init__(self, texts: pa.Array, restorer: Restorer):
        split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        at = split.offsets.to_numpy().astype(np.int64)
        at, tokens = at - at[0], split.flatten()
        coded = tokens.dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        distinct = pc.utf8_lower(coded.dictionary)
        core = pc.utf8_rtrim(pc.utf8_ltrim(distinct, _BEFORE), _AFTER)
        # No word starts with ß, which is a look-alike too.
        plain = pc.and_not(pc.utf8_is_alpha(core), pc.starts_with(core, "ß")).to_numpy(zero_copy_only=False)
        odd = ~plain
        names = restorer.settled(core.filter(pa.array(plain)).to_pylist())
        length, first = plain.astype(np.int64), np.cumsum(plain) - plain
        for i, token in zip(np.flatnonzero(odd).tolist(), distinct.filter(pa.array(odd)).to_pylist(), strict=True):
            words = restorer.words(token)
            first[i], length[i] = len(names), len(words)
            names.extend(words)
        # Runs of three and more single signs are one spelled-out stretch.
        short = np.flatnonzero(pc.less_equal(pc.utf8_length(distinct), 2).to_numpy(zero_copy_only=False))
        signs = {i: distinct[i].as_py() for i in short.tolist()}
        single = np.zeros(len(distinct), bool)
        single[short] = [sum(c.isalnum() or c in LOOKS_LIKE for c in t) == 1 for t in signs.values()]
        alone = single[index]
        joined = alone[1:] & alone[:-1] & (doc[1:] == doc[:-1])
        starts = np.flatnonzero(alone & ~np.concatenate([[False], joined])) if len(alone) else np.zeros(0, np.int64)
        ends = np.flatnonzero(alone & ~np.concatenate([joined, [False]])) + 1 if len(alone) else starts
        long = ends - starts >= 3
        extra_doc, extra_word, gone = [], [], np.zeros(len(index), bool)
        for x, y in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            gone[x:y] = True
            for w in _LETTERS.findall(restorer.decode(" ".join(signs[i] for i in index[x:y].tolist()), True)):
                extra_doc.append(doc[x])
                extra_word.append(len(names))
                names.append(w)
        keep = index[~gone]
        times = length[keep]
        self.doc = np.concatenate([np.repeat(doc[~gone], times), np.array(extra_doc, np.int64)])
        self.word = np.concatenate([ranges(first[keep], times), np.array(extra_word, np.int64)])
        self.names = pa.array(names, pa.string())
        self.rows = len(texts)

    def distinct(self, features: list[np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature) of the words' features: arrays by place in ``names``, -1 for none."""
        both = []
        for number in features:
            of = number[self.word]
            both.append(self.doc[of >= 0] * top + of[of >= 0])
        cells = np.unique(np.concatenate(both))
        return cells // top, cells % top

    def found(self, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature) of the known features."""
        features = []
        for kind, names in (("=", self.names), ("4", pc.utf8_slice_codeunits(self.names, 0, 4)), ("5", pc.utf8_slice_codeunits(self.names, 0, 5))):
            own = [(f[1:], i) for f, i in known.items() if f[0] == kind]
            place = _numbers(pc.index_in(names, value_set=pa.array([f for f, _ in own], pa.string())))
            features.append(np.array([*(i for _, i in own), -1], np.int64)[place])
        return self.distinct(features, max(1, len(known)))

    def counted(self) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Distinct (row, feature) of all features, and these by number: the word, its first four and its first five letters."""
        length, missing = pc.utf8_length(self.names), pa.scalar(None, pa.string())
        kinds = [pc.if_else(pc.greater_equal(length, least), pc.binary_join_element_wise(kind, part, ""), missing) for kind, least, part in (("=", 3, self.names), ("4", 4, pc.utf8_slice_codeunits(self.names, 0, 4)), ("5", 5, pc.utf8_slice_codeunits(self.names, 0, 5)))]
        coded = pa.concat_arrays(kinds).dictionary_encode()
        names = coded.dictionary.to_pylist()
        return *self.distinct(np.split(_numbers(coded.indices), 3), max(1, len(names))), names


def _signs(texts: list[str | None]) -> np.ndarray:
    """The code points of texts in lower case, a line break between them."""
    return np.frombuffer("\n".join(t for t in texts if t).lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def alphabet(docs: DataFrame, text: str = "text", most: int = MOST_LETTERS) -> str:
    """a-z and the most frequent other letters of all texts, ``most`` together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", COUNT_BYTES):
                n = np.bincount(_signs(batch.column(0).to_pylist()))
                total[: len(n)] += n
        some = np.array([v for v in np.flatnonzero(total).tolist() if v > 127 and chr(v).isalpha()], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["sign", "n"])

    rows = docs.filter(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInArrow(count, "sign long, n long")
    others = rows.groupBy("sign").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "sign").limit(most - len(ASCII))
    return ASCII + "".join(sorted(chr(r["sign"]) for r in others.collect()))


def character_model(docs: DataFrame, text: str = "text", letters: str = ASCII) -> np.ndarray:
    """Trigram log-probabilities over all texts; without any, all signs are alike."""
    size = len(letters) + 2
    cells = size**3

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.fromiter((size - 1 if chr(v).isalpha() else 0 for v in range(0x110000)), np.uint8, 0x110000)
        table[[ord(c) for c in letters]] = np.arange(1, size - 1)
        total = np.zeros(cells, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", COUNT_BYTES):
                code = table[_signs(batch.column(0).to_pylist())]
                code = np.concatenate([[0, 0], code, [0]], dtype=np.int32)
                twice = (code[1:] == 0) & (code[:-1] == 0)
                code = np.concatenate([[0, 0], code[1:][~twice]], dtype=np.int32)
                total += np.bincount((code[:-2] * size + code[1:-1]) * size + code[2:], minlength=cells)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    rows = docs.filter(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInArrow(count, "cell long, n long")
    n = np.zeros(cells)
    # At most one row per cell of the table.
    for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        n[r["cell"]] = r["n"]
    tri = n.reshape(size, size, size)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + size)
    p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
    p3 = (tri + 20 * p2[None]) / (tri.sum(2, keepdims=True) + 20)
    return np.log(p3).ravel()


@dataclass
class Scorer:
    """A fitted scorer: weights by feature, and the line between clean and toxic."""

    model: np.ndarray
    weights: dict[str, float]
    line: float
    letters: str = ASCII

    def margins(self, words: Restored, known: dict[str, int], weight: np.ndarray) -> np.ndarray:
        doc, feature = words.found(known)
        return np.bincount(doc, weights=weight[feature] if len(feature) else None, minlength=words.rows)


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", corpus: DataFrame | None = None) -> Scorer:
    """A scorer from labelled rows (``labels``: id and label; null labels are left out); the character model from ``corpus`` (default ``docs``).

    Features whose log-likelihood ratio beats 2 ln(number of features) are kept, those that speak for the label.
    Without labelled rows of both kinds there are no features, and every text is scored alike.
    """
    corpus = docs if corpus is None else corpus
    letters = alphabet(corpus, text)
    model = character_model(corpus, text, letters)
    some = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("l_id"), (F.col(label) > 0).cast("long").alias("label"))
    # At most ``most`` narrow rows: small by construction.
    some = F.broadcast(some.dropDuplicates(["l_id"]).orderBy(F.xxhash64("l_id"), "l_id").limit(most))
    train = docs.select(F.col(doc_id).alias("l_id"), F.col(text).alias("text")).filter("text IS NOT NULL").join(some, "l_id").select("text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model, letters)
        for whole in batches:
            for batch in slices(whole, "text", RUN_BYTES):
                words = Restored(batch.column("text"), restorer)
                doc, feature, names = words.counted()
                toxic = batch.column("label").to_numpy()[doc]
                t = np.bincount(feature, weights=toxic, minlength=len(names)).astype(np.int64)
                n = np.bincount(feature, minlength=len(names))
                own = batch.column("label").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(["", *names], pa.string()), pa.array([int(own.sum()), *t.tolist()], pa.int64()), pa.array([len(own), *n.tolist()], pa.int64())], ["feature", "t", "n"])

    counted = train.mapInArrow(count, "feature string, t long, n long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    counted = materialize(counted.filter("n >= 3 OR feature = ''"), "features")
    whole = counted.filter("feature = ''").first()
    toxic, total = (whole["t"], whole["n"]) if whole else (0, 0)
    names: list[str] = []
    if 0 < toxic < total:
        share = toxic / total
        t, n = F.col("t"), F.col("n")

        def part(x, y):
            return F.when(x > 0, x * F.log(x / y)).otherwise(0.0)

        ratio = 2 * (part(t, n * share) + part(n - t, n * (1 - share)) + part(toxic - t, (total - n) * share) + part(total - n - (toxic - t), (total - n) * (1 - share)))
        tests = counted.count()
        good = counted.filter("feature <> ''").filter(t > 2 * n * share).withColumn("g", ratio).filter(F.col("g") > 2 * math.log(max(2, tests)))
        names = [r["feature"] for r in good.orderBy(F.desc("g"), "feature").select("feature").collect()]
    if not names:
        return Scorer(model, {}, 1.0, letters)
    known = {f: i for i, f in enumerate(names)}

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model, letters)
        for whole in batches:
            for batch in slices(whole, "text", RUN_BYTES):
                words = Restored(batch.column("text"), restorer)
                doc, feature = words.found(known)
                cuts = np.searchsorted(doc, np.arange(words.rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature))], ["label", "found"])

    # At most ``most`` rows reach the driver, each with the few kept features that its text has.
    rows = train.mapInArrow(mark, "label long, found array<long>").collect()
    row = np.repeat(np.arange(len(rows)), [len(r["found"]) for r in rows])
    col = np.array([f for r in rows for f in r["found"]], np.int64)
    weight, line = _logistic(row, col, np.array([r["label"] for r in rows], float), len(names))
    return Scorer(model, {f: float(w) for f, w in zip(names, weight, strict=True) if w > 0}, line, letters)


def _logistic(row: np.ndarray, col: np.ndarray, label: np.ndarray, n_features: int, l1: float = 1e-4, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights (none below 0) and line of a sparse logistic regression, by accelerated proximal steps.

    Of features that come together the one that explains most labels takes the weight: words that only happen to stand
    in copies of one toxic text are left at 0.
    """
    n = len(label)
    v = np.full(n_features + 1, 1.0)
    for _ in range(20):
        v /= np.linalg.norm(v)
        x = np.bincount(row, weights=v[col], minlength=n) + v[-1]
        v = np.append(np.bincount(col, weights=x[row], minlength=n_features), x.sum())
    step = 4 * n / (1.05 * np.linalg.norm(v))
    w = np.zeros(n_features + 1)
    ahead, speed = w, 1.0
    for _ in range(steps):
        margin = np.bincount(row, weights=ahead[col], minlength=n) + ahead[-1]
        slope = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - label) / n
        new = ahead - step * np.append(np.bincount(col, weights=slope[row], minlength=n_features) + l1, slope.sum())
        new[:-1] = np.maximum(new[:-1], 0)
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        ahead = new + (speed - 1) / faster * (new - w)
        w, speed = new, faster
    return w[:-1], -float(w[-1])


def _margins(docs: DataFrame, scorer: Scorer, carried: list[str], text: str) -> DataFrame:
    known = {f: i for i, f in enumerate(scorer.weights)}
    weight = np.array(list(scorer.weights.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(scorer.model, scorer.letters)
        for whole in batches:
            for batch in slices(whole, len(carried), RUN_BYTES):
                margin = scorer.margins(Restored(batch.column(len(carried)), restorer), known, weight)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(margin.astype(np.float64))], names=[*carried, "margin"])

    fields = [docs.schema[c] for c in carried]
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields) + ", margin double"
    return docs.select(*(docs[c] for c in carried), docs[text].alias("scored text")).mapInArrow(run, schema)


def score(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """Adds ``toxicity`` (0 to 1, 0.5 and more: toxic) to all rows.

    A null or empty text has no words and gets the score of a text without any feature.  Rows are kept as they are;
    a column ``toxicity`` or ``margin`` that was there before is replaced.
    """
    carried = [c for c in docs.columns if c not in ("toxicity", "margin")]
    told = _margins(docs, scorer, carried, text)
    value = 1 / (1 + F.exp(-(F.col("margin") - scorer.line)))
    return told.select(*carried, value.alias("toxicity"))


def restore(docs: DataFrame, model: np.ndarray, text: str = "text", letters: str = ASCII) -> DataFrame:
    """Adds ``restored``: the restored words of every text joined by spaces (spelled-out stretches last; null: empty)."""
    carried = [c for c in docs.columns if c != "restored"]
    where = carried.index(text)
    fields = [docs.schema[c] for c in carried]
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields) + ", restored string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model, letters)
        for whole in batches:
            for batch in slices(whole, where, RUN_BYTES):
                words = Restored(batch.column(where), restorer)
                order = np.argsort(words.doc, kind="stable")
                cuts = np.searchsorted(words.doc[order], np.arange(words.rows + 1))
                names = words.names.take(pa.array(words.word[order])).to_pylist()
                told = [" ".join(names[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.string())], names=[*batch.schema.names, "restored"])

    return docs.select(*(docs[c] for c in carried)).mapInArrow(run, schema)
