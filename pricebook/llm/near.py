"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct shingles (hashes of ``width`` lower-cased words).  Each shingle flips one bit
of a sparse bit sketch, so the Hamming distance of two sketches is at most the size of the symmetric difference.
Two sets linked by a Jaccard similarity of ``percent`` or more differ in at most D shingles, where D follows from
their sizes.  So a sketch that is cut into more than D parts has a part alike in both.

Bands.  Sizes are cut into bands such that linked sets lie in one band or in two neighbours.  For each pair of
neighbours D is that of the largest sets that can be linked there, and the sketch has somewhat more than D parts.
A set with more than D non-empty parts shares a non-empty one with every set that it is linked with.  The few sets
with fewer of them are cut again by another hash, and so on; two such sets meet there.  So no link is lost and
empty parts need no rows.

Rows.  A part's key (hash of its parity bits, place and band) goes with the set's number, packed by hash bucket.
Copies are one number (a hash of the whole set), so they meet as one.  Keys shared by up to ``FEW`` sets give all
pairs.  A key shared by more gives pairs with one set only, its centre.  When these are checked, a set is done if a link
of it cannot hang on crowded keys alone: crowded keys whose sets are all connected do not count, and with every set
that it is linked with it shares more keys than there are others.  (Of a set that was cut again one shared key is sure,
so any other puts it among those that are not done.)  Sets that are not done (passages that many
documents share, crowds of not quite near copies) are compared by dense sketches in blocks.  So a crowd of near copies
costs a few checks each, and nothing is dropped.

Checks.  Pairs pass the sizes, then the Hamming distance of a dense sketch of 1024 bits, then the exact overlap of
the sets, made again from one text for each set.  First one pair for each set is checked; pairs connected by then
are not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from pricebook.session import materialize

from .components import components
from .tokens import slices
from .words import BASE, Words, bucket_bits, dealt, gathered, mixed, planes, unplanes

#: Bytes of text made into sets at once.
RUN_BYTES = 2_000_000
#: Pairs made at once.
PAIRS_AT_ONCE = 500_000
#: A key of more sets than this gives pairs with its smallest one first.
FEW = 32
#: A crowded key ties its sets to a centre that is the least by one of so many orders: most near copies are linked
#: with some centre.
CENTRES = 4
SKETCH = 1024
#: Sets checked against one centre in one group.
GROUP = 128
#: Bits of the filter of documents whose texts are wanted: 1 MB.
FILTER_BITS = 1 << 23
#: Sets of a block where sets are compared in blocks.
BLOCK = 512

_U = np.uint64


class Sets:
    """The shingle sets of a run of texts: ``doc`` and ``hash`` of distinct shingles by document, ``n``, ``number``."""

    def __init__(self, texts: pa.Array, width: int):
        words = Words(texts, lower=True)
        rows = len(words.at) - 1
        at, h = words.windows(width)
        doc = words.doc[at]
        count = np.diff(words.first)
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            # Fewer words: the whole sequence, with its length, is one shingle.
            own = np.zeros(len(short), _U)
            for k in range(width - 1):
                has = count[short] > k
                own[has] = own[has] * _U(BASE) + words.hash[words.first[short[has]] + k]
            doc = np.concatenate([doc, short])
            h = np.concatenate([h, mixed(own + count[short].astype(_U) * _U(0xA0761D6478BD642F))])
        order = np.argsort(h)
        order = order[np.argsort(doc[order].astype(np.uint16) if rows <= 1 << 16 else doc[order], kind="stable")]
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.doc, self.hash = doc[new], h[new]
        self.n = np.bincount(self.doc, minlength=rows)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.number = np.zeros(rows, np.int64)
        some = np.flatnonzero(self.n)
        if len(some):
            a = np.bitwise_xor.reduceat(mixed(self.hash ^ _U(0x5851F42D4C957F2D)), self.first[some])
            b = np.add.reduceat(self.hash, self.first[some])
            self.number[some] = (mixed(a ^ mixed(b + self.n[some].astype(_U))) >> _U(1)).astype(np.int64)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and hash of the shingles of some rows."""
        wanted = np.zeros(len(self.n), bool)
        wanted[rows] = True
        take = wanted[self.doc]
        return self.doc[take], self.hash[take]

    def sketches(self) -> np.ndarray:
        """Dense parity sketches, as rows of 64-bit numbers."""
        cell = self.doc * SKETCH + (mixed(self.hash ^ _U(0x2545F4914F6CDD1D)) >> _U(54)).astype(np.int64)
        odd = np.bincount(cell, minlength=len(self.n) * SKETCH).astype(np.uint8) & 1
        return np.packbits(odd.reshape(-1, SKETCH), axis=1).view(np.int64)


def most_different(total: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The largest symmetric difference of linked sets whose sizes add up to ``total``."""
    overlap = -(-percent * total // (100 + percent))
    return total - 2 * overlap


class Bands:
    """Bands of sizes; for band p with the next one: D (``most``) and the number of parts."""

    def __init__(self, largest: int, percent: int):
        starts = [1]
        while starts[-1] <= largest:
            starts.append(starts[-1] * 100 // percent + 1)
        self.starts = np.array(starts)
        low = self.starts[1:] - 1
        self.most = np.array([max(most_different(a + b, percent) for b in (a * 100 // percent, max(a, a * 100 // percent - 1))) for a in low.tolist()] or [0])
        self.parts = np.where(self.most > 0, self.most + 4 + self.most // 8, 0)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, n, "right") - 1


def _parts(sets: Sets, rows: np.ndarray, band: np.ndarray, bands: Bands, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of every non-empty part of the sketches of some rows, cut for ``band`` (by row of the run)."""
    doc, h = sets.of(rows)
    h = mixed(h ^ _U(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    parts = bands.parts[band[doc]].astype(_U)
    part = ((h >> _U(32)) * parts >> _U(32)).astype(np.int64)
    cell = doc * int(bands.parts.max()) + part
    order = np.argsort(cell)
    cell = cell[order]
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    # The parity bits of a part as the XOR of images of the flipped places.
    image = np.bitwise_xor.reduceat(mixed(h[order] + _U(0x632BE59BD9B4E019)), starts) if len(cell) else np.zeros(0, _U)
    at = order[starts]
    place = (band[doc[at]].astype(_U) << _U(40)) + part[at].astype(_U) + _U(seed << 52 & 0xFFFFFFFFFFFFFFFF)
    return doc[at], mixed(image ^ mixed(place))


def keys(sets: Sets, rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the sets of some rows, each with its entry: the set's number twice, plus 1 where its band is the larger one.

    Also each entry once with its slack: with every set that it is linked with it shares at least so many keys.
    """
    bands = Bands(int(sets.n.max(initial=0)), percent)
    own = bands.of(np.maximum(sets.n, 1))
    found, values, entries, slack = [], [], [], []
    for upper in (0, 1):
        band = np.maximum(own - upper, 0)
        live = rows[(own[rows] >= upper) & (bands.parts[band[rows]] > 0)]
        again = 0
        while len(live):
            doc, key = _parts(sets, live, band, bands, 1 + again)
            found.append(key)
            values.append((sets.number[doc].astype(_U) << _U(1)) + _U(upper))
            filled = np.bincount(doc, minlength=len(sets.n))
            spare = filled[live] - bands.most[band[live]]
            entries.append((sets.number[live[spare > 0]].astype(_U) << _U(1)) + _U(upper))
            # A partner that stopped at an earlier cut has no keys of this one: with it one key is sure.
            slack.append(np.minimum(spare[spare > 0], 1) if again else spare[spare > 0])
            live = live[spare <= 0]
            again += 1
    if not found:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(values).view(np.int64), np.concatenate(entries).view(np.int64), np.concatenate(slack)


def _centres(key: np.ndarray, number: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each run of a key the place of its centre: by ``CENTRES`` orders of the sets, one for each key."""
    rank = mixed(number.astype(_U) ^ mixed(key % _U(CENTRES) + _U(1)))
    least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(key))))
    at = np.flatnonzero(rank == least)
    return at[np.searchsorted(at, starts)]


def _meet(key: np.ndarray, value: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From entries by ascending key: pairs (a, b) and the entries of crowded keys (key, entry)."""
    order = np.lexsort((value, key))
    key, value = key[order], value[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (value[1:] != value[:-1])
    key, value = key[new], value[new]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, len(key)))
    number, upper = (value.view(_U) >> _U(1)).astype(np.int64), (value & 1).astype(bool)
    pairs = []
    crowd = size > few
    for g in range(2, int(size[~crowd].max(initial=0)) + 1):
        own = starts[(size == g) & ~crowd]
        if len(own):
            i, j = np.triu_indices(g, 1)
            for block in range(0, len(own), max(1, PAIRS_AT_ONCE // len(i))):
                base = own[block : block + max(1, PAIRS_AT_ONCE // len(i)), None]
                a, b = (base + i).ravel(), (base + j).ravel()
                keep = ~(upper[a] & upper[b])
                pairs.append((number[a[keep]], number[b[keep]]))
    inside = np.repeat(crowd, size)
    if inside.any():
        centre = np.repeat(_centres(key, number, starts), size)[inside]
        pairs.append((number[centre], number[inside]))
    if not pairs:
        pairs.append((number[:0], number[:0]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    a, b = np.minimum(a, b), np.maximum(a, b)
    return a[a < b], b[a < b], key[inside], value[inside]


def _packed(bucket: int, kind: int, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([planes(x)], pa.binary()), pa.array([planes(y)], pa.binary()), pa.array([kind])], _NAMES)


_NAMES = ["bucket", "hashes", "values", "kind"]
_ROW = "bucket long, hashes binary, values binary, kind long"
_ENTRIES, _PAIRS, _CROWD, _SLACK = 0, 1, 2, 3


def _candidates(texts: DataFrame, width: int, percent: int, bits: int, few: int = FEW) -> DataFrame:
    """Packed pairs and crowded entries of all texts."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for whole in batches:
            for batch in slices(whole, "text", RUN_BYTES):
                sets = Sets(batch.column("text"), width)
                # Copies in the run are one set.
                rows = np.unique(sets.number, return_index=True)[1]
                rows = rows[sets.n[rows] > 0]
                key, value, entry, slack = keys(sets, rows, percent)
                if not len(key):
                    continue
                turn += 1
                yield _packed(turn % (1 << bits), _SLACK, entry, slack)
                order = np.argsort(key)
                key, value = key[order], value[order]
                # Of a key with many sets in this run the centre and some others go on; all are tied to the centre here.
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                size = np.diff(np.append(starts, len(key)))
                if size.max() > few + 2:
                    number = (value.view(_U) >> _U(1)).astype(np.int64)
                    centre = np.repeat(_centres(key, number, starts), size)
                    rank = np.arange(len(key)) - np.repeat(starts, size)
                    stay = (rank > few) & (number != number[centre])
                    a, b = np.minimum(number[centre[stay]], number[stay]), np.maximum(number[centre[stay]], number[stay])
                    yield _packed(turn % (1 << bits), _PAIRS, a, b)
                    yield _packed(turn % (1 << bits), _CROWD, key[stay], value[stay])
                    key, value = key[~stay], value[~stay]
                out = dealt(key, value, bits)
                yield out.append_column("kind", pa.array([_ENTRIES] * out.num_rows, pa.int64()))

    def meet(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        out = table.filter(pa.array(kind != _ENTRIES)).select(_NAMES).to_batches()
        if (kind == _ENTRIES).any():
            a, b, key, entry = _meet(*gathered(table.filter(pa.array(kind == _ENTRIES))), few)
            if len(a):
                out.append(_packed(0, _PAIRS, a, b))
            if len(key):
                out.append(_packed(0, _CROWD, key, entry))
        return pa.Table.from_batches(out, pa.schema([("bucket", pa.int64()), ("hashes", pa.binary()), ("values", pa.binary()), ("kind", pa.int64())]))

    return texts.mapInArrow(deal, _ROW).groupBy("bucket").applyInArrow(meet, _ROW)


def _unpacked(rows: DataFrame, kind: int) -> DataFrame:
    """(x, y) of packed rows of one kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unplanes(h, np.int64)), pa.array(unplanes(v, np.int64))], ["x", "y"])

    return rows.filter(F.col("kind") == kind).select("hashes", "values").mapInArrow(run, "x long, y long")


def _checked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked; ``texts`` has one text for each number v."""
    per = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    salted = pairs.join(per, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.floor(F.col("n") / GROUP) + 1)).select("a", "b", "salt")
    members = salted.join(texts.withColumnRenamed("v", "b"), "b").select("a", "salt", "b", "text").toDF("m_a", "m_salt", "b", "m_text")
    centres = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("v", "a"), "a").select("a", "salt", "text").toDF("c_a", "c_salt", "c_text")

    def check(key: tuple, centre: pa.Table, others: pa.Table) -> pa.Table:
        texts = pa.concat_arrays([*centre.column("c_text").chunks, *others.column("m_text").chunks])
        sets = Sets(texts, width)
        own = sets.hash[: sets.n[0]]
        near = np.minimum(np.searchsorted(own, sets.hash), len(own) - 1)
        both = np.bincount(sets.doc, weights=own[near] == sets.hash, minlength=len(sets.n)).astype(np.int64)[1:]
        linked = 100 * both >= percent * (sets.n[0] + sets.n[1:] - both)
        b = others.column("b").combine_chunks().filter(pa.array(linked))
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(b), pa.int64()), b], ["a", "b"])

    return centres.groupBy("c_a", "c_salt").cogroup(members.groupBy("m_a", "m_salt")).applyInArrow(check, "a long, b long")


def _is_near(x: str, y: str, percent: int) -> Column:
    """Sizes and dense sketches of two sets allow a link."""
    total = F.col(f"{x}.n") + F.col(f"{y}.n")
    most = total - 2 * F.ceil(percent * total / (100 + percent))
    apart = sum((F.bit_count(F.get(f"{x}.sketch", i).bitwiseXOR(F.get(f"{y}.sketch", i))) for i in range(1, SKETCH // 64)), F.bit_count(F.get(f"{x}.sketch", 0).bitwiseXOR(F.get(f"{y}.sketch", 0))))
    sizes = 100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n")
    return sizes & (apart <= most)


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id that links lead to, its own included.

    A null text, or one without words, has no shingles and is linked with nothing; fewer words than ``width`` are
    one shingle.  Equal sets are linked.  Rows with the same doc_id are rows of their own, also with different texts; a
    null doc_id is never the smallest, and links through rows without an id count.  No rows give no rows; other columns
    are not read.  Sets and shingles are compared by 64-bit hashes.
    """
    return near_sets(docs, width, percent, doc_id, text).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def near_sets(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """Per row: doc_id, the ``keep`` columns, n (shingles), root (a number of the row's group; null without shingles) and component_id."""
    kept = list(keep or {})
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *[c.alias(k) for k, c in (keep or {}).items()])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", RUN_BYTES):
                sets = Sets(batch.column("text"), width)
                sketch = sets.sketches()
                at = pa.array(np.arange(len(sketch) + 1, dtype=np.int32) * sketch.shape[1])
                columns = [batch.column("doc_id"), *[batch.column(k) for k in kept], pa.array(sets.number), pa.array(sets.n), pa.ListArray.from_arrays(at, pa.array(sketch.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *kept, "v", "n", "sketch"])

    schema = StructType([rows.schema["doc_id"], *[rows.schema[k] for k in kept], *StructType.fromDDL("v long, n long, sketch array<long>").fields])
    told = materialize(rows.mapInArrow(tell, schema), "sets")
    some = told.filter("n > 0")
    # One document stands for all with the same set.
    sets = materialize(some.groupBy("v").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sets")
    bits = bucket_bits(rows, F.col("text"))
    texts = rows.filter("text IS NOT NULL").select("text")
    found = materialize(_candidates(texts, width, percent, bits), "candidates")
    links, roots = _linked(_unpacked(found, _PAIRS).toDF("x", "y"), sets, rows, None, width, percent)
    # Crowded keys whose sets are not all connected are open.  A set with fewer open keys than its slack shares another
    # key with every set that it is linked with; the others are compared in blocks.
    number = F.shiftrightunsigned("entry", 1)
    crowd = _unpacked(found, _CROWD).toDF("key", "entry").distinct().withColumn("v", number)
    crowd = crowd.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    open_keys = crowd.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    held = crowd.join(open_keys, "key").groupBy("entry").agg(F.count(F.lit(1)).alias("n"))
    slack = _unpacked(found, _SLACK).toDF("entry", "slack").groupBy("entry").agg(F.min("slack").alias("slack"))
    left = materialize(held.join(slack, "entry").filter("n >= slack").select(number.alias("v")).distinct(), "left")
    near = materialize(_in_blocks(left.join(sets, "v").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v")), percent), "near")
    links, roots = _linked(near, sets, rows, links, width, percent)
    # Groups are worked out by set, written, and joined with the rows once: plain joins, which Spark can split where a
    # group or a set is large.
    grouped = sets.select("v", "rep").join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("root"), "rep")
    grouped = materialize(grouped, "grouped")
    least = materialize(grouped.groupBy("root").agg(F.min("rep").alias("least")), "least")
    of_set = materialize(grouped.select("v", "root").join(least, "root"), "named")
    some = told.filter("n > 0").select("doc_id", *kept, "n", "v").join(of_set, "v")
    none = told.filter("n = 0").select("doc_id", *kept, "n", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return some.select("doc_id", *kept, "n", "root", F.col("least").alias("component_id")).union(none)


def _in_blocks(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of sets (v, root, n, sketch) of different roots whose sizes and dense sketches allow a link.

    Sets are put in bands of sizes and in blocks of about ``BLOCK``; a group of the comparison is two blocks of one band
    or of neighbours.
    """
    band = F.floor(F.log("n") / (math.log(100 / percent) * 1.0001)).cast("long")
    sets = sets.select("v", "root", "n", "sketch", band.alias("band"))
    size = materialize(sets.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "blocks")
    above = size.select((F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = size.select((F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    sets = sets.join(size, "band").join(above, "band", "left").join(below, "band", "left")
    sets = sets.withColumn("block", F.pmod(F.xxhash64("v"), "blocks"))

    def to(blocks: str, x: Column, other: Column, ours_first: bool) -> Column:
        """The groups of a block with each block of a band."""
        count = F.coalesce(blocks, F.lit(0)).cast("int")

        def group(i: Column) -> Column:
            i = (i - 1).cast("long")
            first, second = (F.col("block"), i) if ours_first else (i, F.col("block"))
            return F.struct(x.alias("p"), other.alias("q"), first.alias("i"), second.alias("j"))

        return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), group)).otherwise(F.array().cast("array<struct<p:bigint,q:bigint,i:bigint,j:bigint>>"))

    own = F.col("band")
    same = F.transform(to("blocks", own, own, True), lambda g: F.struct(g["p"].alias("p"), g["q"].alias("q"), F.least(g["i"], g["j"]).alias("i"), F.greatest(g["i"], g["j"]).alias("j")))
    groups = F.concat(same, to("above", own, own + 1, True), to("below", own - 1, own, False))
    dealt_out = sets.select("v", "root", "n", "sketch", "band", "block", F.explode(groups).alias("g")).select("g.*", "v", "root", "n", "sketch", "band", "block")

    def compare(table: pa.Table) -> pa.Table:
        p, q, i, j, band, block = (table.column(c).to_numpy() for c in ("p", "q", "i", "j", "band", "block"))
        v, root, n = (table.column(c).to_numpy() for c in ("v", "root", "n"))
        sketch = np.array(table.column("sketch").to_pylist(), np.int64).view(_U).reshape(len(v), -1)
        one = np.flatnonzero((band == p) & (block == i))
        two = np.flatnonzero((band == q) & (block == j))
        xs, ys = [], []
        for k in one.tolist():
            some = two[(root[two] != root[k]) & (100 * np.minimum(n[two], n[k]) >= percent * np.maximum(n[two], n[k]))]
            apart = np.bitwise_count(sketch[some] ^ sketch[k]).sum(1, dtype=np.int64)
            some = some[apart <= most_different(n[some] + n[k], percent)]
            xs.append(np.full(len(some), v[k]))
            ys.append(v[some])
        none = [np.zeros(0, np.int64)]
        return pa.table({"x": np.concatenate(xs or none), "y": np.concatenate(ys or none)})

    return dealt_out.groupBy("p", "q", "i", "j").applyInArrow(compare, "x long, y long")


def _linked(found: DataFrame, sets: DataFrame, rows: DataFrame, links: DataFrame | None, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All links known after checking the found pairs (x, y), and the roots of the sets that have links."""
    pairs = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    left, right = sets.alias("l"), sets.alias("r")
    pairs = pairs.join(left, F.col("a") == F.col("l.v")).join(right, F.col("b") == F.col("r.v")).filter(_is_near("l", "r", percent))
    pairs = materialize(pairs.select("a", "b", F.col("l.rep").alias("rep_a"), F.col("r.rep").alias("rep_b")), "pairs")
    wanted = pairs.select(F.col("a").alias("v"), F.col("rep_a").alias("rep")).union(pairs.select(F.col("b").alias("v"), F.col("rep_b").alias("rep"))).distinct()
    own = _picked(rows, wanted, width).groupBy("v").agg(F.first("text").alias("text"))
    own = materialize(own, "texts")
    # First every set with its smallest neighbour, then what that leaves unconnected: a text goes out once or twice.
    pairs = pairs.select("a", "b")
    first = materialize(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    sure = _checked(first, own, width, percent)
    links = materialize(sure if links is None else links.union(sure), "links")
    roots = materialize(components(links), "roots")
    x = roots.select(F.col("v").alias("a"), F.col("root").alias("ra"))
    y = roots.select(F.col("v").alias("b"), F.col("root").alias("rb"))
    rest = pairs.join(x, "a", "left").join(y, "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    rest = materialize(rest.join(first, ["a", "b"], "left_anti"), "pairs")
    links = materialize(links.union(_checked(rest, own, width, percent)), "links")
    return links, materialize(components(links), "roots")


def _picked(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(v, text) of the wanted sets (v, rep): a Bloom filter of fixed size over their documents spares most others the shuffle.

    A row is known by its set, not by its id: ids may be null (all such rows pass the filter if a wanted set has no
    other) and one id may stand for several texts.  So the sets of rows that pass are made again, one row of each goes on.
    """
    bit = F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS))
    words = wanted.select(F.shiftright(bit, 6).alias("word"), F.pmod(bit, F.lit(64)).cast("int").alias("at")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"))
    table = np.zeros(FILTER_BITS // 64, np.int64)
    # At most one number for each word of the filter.
    for r in words.collect():
        table[r["word"]] = r["bits"]

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            bit = whole.column("bit").to_numpy()
            there = table[bit >> 6].view(_U) >> (bit & 63).astype(_U) & _U(1)
            for batch in slices(whole.select(["text"]).filter(pa.array(there.astype(bool))), "text", RUN_BYTES):
                sets = Sets(batch.column("text"), width)
                one = np.unique(sets.number, return_index=True)[1]
                one = one[sets.n[one] > 0]
                if len(one):
                    yield pa.RecordBatch.from_arrays([pa.array(sets.number[one]), batch.column("text").take(pa.array(one))], ["v", "text"])

    texts = rows.filter("text IS NOT NULL").select(F.col("doc_id").alias("rep"), "text").withColumn("bit", bit)
    return texts.select("text", "bit").mapInArrow(sift, "v long, text string").join(wanted.select("v").distinct(), "v")
