"""Token ids of whole texts by a byte-level tokenizer file, inside tasks.

A byte-level tokenizer cuts a text at every single space between two characters that are not white space: no
token crosses such a cut.  So a text's ids are the ids of its pieces, and each distinct piece of a batch is
encoded once: words of letters by the library's merge model, other pieces by one call of the library for thousands of
them, whose ids are dealt back by their byte lengths, which are checked.  Texts with other white space next to a space, or with an added token of the file, are encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units remembered by one Python worker; beyond it they are learned anew (a matter of speed only).
MEMORY = 800_000
#: Bytes of text encoded at once.
BATCH_BYTES = 6_000_000


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all given ranges, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


#: What a row counts for besides its bytes.
ROW_BYTES = 256


def slices(batch: pa.RecordBatch, column: str | int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of a string or binary column; a longer row stands alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES
    at, n = 0, len(size)
    ends = np.cumsum(size)
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


class TextEncoder:
    """Encodes texts to ids; one per worker and tokenizer file."""

    _open: dict[str, TextEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # A byte-level token spells each byte as one letter.
        letters = set(ByteLevel.alphabet())
        self.width = np.zeros(size, np.int64)
        for token, i in self.tok.get_vocab().items():
            self.width[i] = len(token) if set(token) <= letters else len(token.encode())
        #: Units known so far: their places in one array of ids; -1 for those that a text must not be cut at.
        self.slot: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.blob = np.zeros(0, self.dtype)
        # A text that holds an added token is encoded whole: the library cuts it there before anything else.
        contents = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = contents
        self.spaced = [c for c in contents if " " in c]
        # The library's byte-level cutting makes a space and letters one word, and the punctuation after it another.
        cutting = json.loads(self.tok.to_str())
        self.by_words = cutting["normalizer"] is None and cutting["pre_tokenizer"].get("type") == "ByteLevel" and cutting["pre_tokenizer"].get("use_regex", False) and not cutting["pre_tokenizer"].get("add_prefix_space", True)
        # How it spells bytes: printable ones as themselves, the others as the letters from U+0100 on.
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = [b for b in range(256) if b not in plain]
        self.spelling = {b: chr(0x100 + i) for i, b in enumerate(others)}

    @classmethod
    def of(cls, path: str) -> TextEncoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def _spelled(self, words: list[str]) -> list[str]:
        """Words of letters after a space, as the library's byte-level step spells them."""
        # No letter holds a line break, so all words are spelled as one text.
        whole = "\n".join(words).encode().decode("latin-1").translate(self.spelling)
        return [self.spelling[0x20] + w for w in whole.split(self.spelling[0x0A])]

    def _remember(self, names: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        at, n = len(self.starts), len(self.blob)
        self.starts = np.concatenate([self.starts, n + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.blob = np.concatenate([self.blob, ids])
        self.slot.update(zip(names, range(at, at + len(names)), strict=True))

    def _learn(self, new: list[str], ends: list[str]) -> None:
        """Remembers the ids of new units: words of letters and other pieces, both after a space, and the signs at words' ends."""
        found: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        names: list[str] = []
        words = [w for w in new if w.isalpha()] if self.by_words else []
        if words:
            # The letters of ASCII are spelled as themselves.
            plain = [w for w in words if w.isascii()]
            words = [w for w in words if not w.isascii()]
            spelled = [self.spelling[0x20] + w for w in plain] + (self._spelled(words) if words else [])
            words = plain + words
            # Some at a time: the library's tokens are objects of a hundred bytes and more.
            for at in range(0, len(spelled), 8192):
                tokens = list(map(self.tok.model.tokenize, spelled[at : at + 8192]))
                found.append(np.array([t.id for own in tokens for t in own], self.dtype))
                counts.append(np.fromiter(map(len, tokens), np.int64, len(tokens)))
            names += words
        other = [w for w in new if not w.isalpha()] if self.by_words else new
        bad = [w for w in other if not w or w[:1].isspace() or w[-1:].isspace()]
        self.slot.update(dict.fromkeys(bad, -1))
        good = [w for w in other if w and not w[:1].isspace() and not w[-1:].isspace()]
        for at in range(0, len(good), 1024):
            part = good[at : at + 1024]
            ids = self._ids(" " + " ".join(part))
            tops = np.cumsum(self.width[ids])
            cuts = np.cumsum(pc.binary_length(pa.array(part, pa.string())).to_numpy() + 1)
            to = np.searchsorted(tops, cuts) + 1
            if len(tops) != to[-1] or not np.array_equal(tops[to - 1], cuts):
                raise ValueError("this tokenizer's tokens cross a space; use a byte-level one")
            found.append(ids)
            counts.append(np.diff(to, prepend=0))
            names += part
        for end in ends:
            ids = self._ids(end) if end else np.zeros(0, self.dtype)
            found.append(ids)
            counts.append(np.array([len(ids)]))
            names.append(f" {end}")  # no unit holds a space
        if names:
            self._remember(names, np.concatenate(found), np.concatenate(counts))

    def _slots(self, units: list[str], ends: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The places of units and of words' ends among those remembered, new ones learned."""
        keys = [f" {e}" for e in ends]
        fresh = [u for u in units if u not in self.slot]
        if len(self.slot) + len(fresh) > MEMORY:
            self.slot, self.starts, self.lengths, self.blob = {}, self.starts[:0], self.lengths[:0], self.blob[:0]
            fresh = units
        self._learn(fresh, [e for e, k in zip(ends, keys, strict=True) if k not in self.slot])
        get = self.slot.__getitem__
        return np.fromiter(map(get, units), np.int64, len(units)), np.fromiter(map(get, keys), np.int64, len(keys))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and the number of ids of each (none for a null)."""
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        split = pc.split_pattern(pc.fill_null(texts, ""), " ")
        at = split.offsets.to_numpy().astype(np.int64)
        at, pieces = at - at[0], split.flatten()
        coded = pieces.dictionary_encode()
        index = coded.indices.to_numpy()
        pieces = coded.dictionary
        # A piece is a word of letters and the signs at its end, or one unit as it is.
        unit, end = pieces, pa.nulls(len(pieces), pa.string()).fill_null("")
        if self.by_words:
            bare = pc.utf8_rtrim(pieces, ".,;:!?")
            worded = np.fromiter(map(str.isalpha, bare.to_numpy(zero_copy_only=False).tolist()), bool, len(bare))
            unit = pc.if_else(pa.array(worded), bare, pieces)
            size = pc.binary_length(pieces).to_numpy().astype(np.int64)
            # The signs that are cut off are single bytes.
            cut = np.where(worded, size - pc.binary_length(bare).to_numpy(), 0)
            some = np.flatnonzero(cut)
            tails = [p[-n:] for p, n in zip(pieces.take(pa.array(some)).to_numpy(zero_copy_only=False).tolist(), cut[some].tolist(), strict=True)]
            every = np.full(len(pieces), "", object)
            every[some] = tails
            end = pa.array(every, pa.string())
        units, ends = unit.dictionary_encode(), end.dictionary_encode()
        u, e = self._slots(units.dictionary.to_numpy(zero_copy_only=False).tolist(), ends.dictionary.to_numpy(zero_copy_only=False).tolist())
        u, e = u[units.indices.to_numpy()], e[ends.indices.to_numpy()]
        whole = u < 0
        for c in self.added:
            whole |= pc.match_substring(pieces, c).to_numpy(zero_copy_only=False)
        # The ids of each distinct piece, one piece after the other.
        u = np.maximum(u, 0)
        lengths = np.where(whole, 0, np.stack([self.lengths[u], self.lengths[e]]))
        starts = np.stack([self.starts[u], self.starts[e]])
        table = self.blob[ranges(starts.T.ravel(), lengths.T.ravel())]
        length = lengths.sum(0)
        count = np.diff(at)
        # A text with an odd piece is encoded whole; in the others the first piece has no space before it.
        odd = np.add.reduceat(whole[index].astype(np.int64), at[:-1]) > 0
        for c in self.spaced:
            odd |= pc.match_substring(pc.fill_null(texts, ""), c).to_numpy(zero_copy_only=False)
        heads: dict[int, np.ndarray] = {}
        first = []
        for i, (o, k) in enumerate(zip(odd.tolist(), index[at[:-1]].tolist(), strict=True)):
            if o:
                first.append(self._ids(texts[i].as_py() or ""))
            else:
                if k not in heads:
                    heads[k] = self._ids(pieces[k].as_py())
                first.append(heads[k])
        blob = np.concatenate([table, *first])
        # The pieces of all texts as places in the blob; a first piece takes the place of its entry.
        lengths = length[index]
        starts = (np.cumsum(length) - length)[index]
        if odd.any():
            lengths[np.repeat(odd, count)] = 0
        own = np.fromiter(map(len, first), np.int64, len(first))
        lengths[at[:-1]] = own
        starts[at[:-1]] = int(length.sum()) + np.cumsum(own) - own
        return blob[ranges(starts, lengths)], np.add.reduceat(lengths, at[:-1])
