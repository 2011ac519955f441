"""Benchmark decontamination: SimHash over item-sized windows, then exact similarity.

Shingles are runs of five words (A-Z lower-cased; an item of fewer words is
one shingle), weighted by log(1 + items / items that hold them) over the whole
benchmark; a shingle that no item holds weighs log(1 + items), as does one that
a single item holds.  Windows of a document have the number of words of an item; only windows that hold a shingle of an item of
that size are fingerprinted, as all others have no similarity at all.  Items
with more words than the document are compared with one window, its whole text.

A 64-bit SimHash adds the weights of a window's shingles by the bits of their
fingerprints.  Items of a size are in `PARTS` tables, one for each byte of the
fingerprint, with a bucket for each value: fingerprints within `RADIUS` differ
by at most RADIUS // PARTS bits in some byte, so probing in every table the
buckets that near finds every item within the radius.  Such pairs of window
and item are verified: weight of common over weight of all distinct shingles,
at least `SIMILAR`.  Windows this similar whose fingerprints are further apart
than the radius would be missed; on the test tables none is.

The index of items is broadcast in parts of `PART_ITEMS` items, whatever the
size of the benchmark, one part at a time: what a part finds is stored before
the next is sent.  Weights are counted by Spark before that; those of
shingles that several items hold are broadcast once, 16 bytes each, and grow
with the benchmark.

Defined cases: items and texts that are null or have no words match nothing;
an item of fewer than five words matches windows of exactly its words; items
with equal texts all match; repeated rows give equal rows; of several windows
the most similar, then the first, is reported; texts of any length are
searched whole; empty tables give no rows; other columns are ignored, or kept
where rows are filtered, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import batch_words, shingle_fingerprints, texts_of
from .cluster import Workspace, lean, table

WORDS = 5
SIMILAR = 0.75
PARTS = 8
RADIUS = 23
PART_ITEMS = 32_768
BATCH_BYTES = 4 << 20
LEAKS = "doc_id long, item_id long, start_word long, n_words long, distance int, similarity double"

#: What a byte may be changed by without leaving the distance that some byte of a near fingerprint has.
_FLIPS = np.array([x for x in range(256) if x.bit_count() <= RADIUS // PARTS], dtype=np.int64)


def weighted_bits(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per shingle and bit, its weight with the bit's sign."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64)
    return (2 * bits - 1) * weights[:, None]


def simhash(sums: np.ndarray) -> np.ndarray:
    """Fingerprints (rows of eight bytes) from sums of weighted bits."""
    return np.packbits(sums > 0, axis=1)


@dataclass
class Weights:
    """Weights of shingles over the whole benchmark."""

    shingles: np.ndarray  # those that several items hold, in order
    weights: np.ndarray
    rare: float  # of all others

    def of(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.full(len(shingles), self.rare)
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return np.where(self.shingles[at] == shingles, self.weights[at], self.rare)


class HammingIndex:
    """Tables of fingerprints (rows of `PARTS` bytes) by each byte."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.orders = [np.argsort(prints[:, p], kind="stable") for p in range(PARTS)]
        self.starts = [np.searchsorted(prints[o, p], np.arange(257)) for p, o in enumerate(self.orders)]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, entry and distance of all pairs within the radius."""
        found = []
        for p, (order, starts) in enumerate(zip(self.orders, self.starts, strict=True)):
            buckets = (prints[:, p].astype(np.int64)[:, None] ^ _FLIPS).ravel()
            width = starts[buckets + 1] - starts[buckets]
            query = np.repeat(np.repeat(np.arange(len(prints)), len(_FLIPS)), width)
            at = np.repeat(starts[buckets] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
            found.append(query * len(self.prints) + order[at])
        query, entry = np.divmod(np.unique(np.concatenate(found)), len(self.prints))
        distance = np.bitwise_count(prints[query] ^ self.prints[entry]).sum(axis=1)
        close = distance <= RADIUS
        return query[close], entry[close], distance[close]


@dataclass
class Items:
    """An index of benchmark items."""

    ids: np.ndarray
    sizes: np.ndarray  # words of each item
    sets: list[np.ndarray]
    shingles: np.ndarray  # all items' shingles in order
    first: np.ndarray  # per shingle, where its sizes begin in `held`
    held: np.ndarray  # sizes of the items that hold a shingle, in order
    tables: dict[int, tuple[np.ndarray, HammingIndex]]  # by size: the items of it, and their fingerprints
    weights: Weights | None  # broadcast apart from the index


def item_shingles(text: str | None) -> tuple[int, np.ndarray]:
    """Number of words and distinct shingles of an item."""
    words, _ = batch_words([(text or "").encode()])
    return len(words), np.unique(shingle_fingerprints(words, WORDS))


def benchmark_weights(benchmark: DataFrame) -> Weights:
    """Weights of all shingles, from the number of the benchmark's items that hold each."""
    texts = benchmark.select(F.col("text").cast("string").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [item_shingles(t)[1] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(own) if own else np.zeros(0, np.uint64)).view(np.int64))], names=["shingle"])

    held = texts.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").toArrow()
    shingles, n = held.column("shingle").to_numpy().view(np.uint64), held.column("n").to_numpy()
    order, n_items = np.argsort(shingles), texts.count()
    return Weights(shingles[order], np.log1p(n_items / n[order]), float(np.log1p(n_items)))


def index_items(rows: list[tuple[int, str | None]], weights: Weights) -> Items:
    """Index of a part's (item_id, text), with the weights of the whole benchmark."""
    found = []
    for item, text in rows:
        size, own = item_shingles(text)
        if size:
            found.append((item, size, own))
    nothing = np.zeros(0, np.uint64)
    shingles = np.unique(np.concatenate([nothing, *[f[2] for f in found]]))
    owner = np.searchsorted(shingles, np.concatenate([nothing, *[f[2] for f in found]]))
    sizes = np.array([f[1] for f in found], dtype=np.int64)
    pairs = np.unique(np.column_stack([owner, np.repeat(sizes, [len(f[2]) for f in found])]), axis=0).astype(np.int64)
    prints = simhash(np.array([weighted_bits(own, weights.of(own)).sum(axis=0) for _, _, own in found])) if found else np.zeros((0, 8), np.uint8)
    tables = {}
    for size in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == size)
        tables[size] = mine, HammingIndex(prints[mine])
    return Items(np.array([f[0] for f in found], dtype=np.int64), sizes, [f[2] for f in found], shingles, np.searchsorted(pairs[:, 0], np.arange(len(shingles) + 1)), pairs[:, 1], tables, weights)


def leaks_of(words: np.ndarray, items: Items) -> list[tuple[int, int, int, int, float]]:
    """(item_id, start word, words, Hamming distance, similarity) of a text's windows that hold an item."""
    best: dict[int, tuple[int, int, int, int, float]] = {}
    for width in range(1, WORDS + 1):
        few = items.sizes == width if width < WORDS else items.sizes >= WORDS
        if not few.any() or len(words) < width:
            continue
        shingles = shingle_fingerprints(words, width)
        at = np.minimum(np.searchsorted(items.shingles, shingles), len(items.shingles) - 1)
        hit = np.flatnonzero(items.shingles[at] == shingles)
        wanted: dict[int, list[np.ndarray]] = {}
        longer = False  # whether an item of more words than the text holds one of its shingles
        for place, k in zip(hit.tolist(), at[hit].tolist(), strict=True):
            for size in items.held[items.first[k] : items.first[k + 1]].tolist():
                longer |= size > len(words)
                if size <= len(words) and (size >= WORDS or size == width) and (width == WORDS or size == width):
                    span = size - width + 1  # shingles of a window
                    wanted.setdefault(size, []).append(np.arange(max(0, place - span + 1), min(place, len(shingles) - span) + 1))
        for size, starts in wanted.items():
            _windows(np.unique(np.concatenate(starts)), size, size - width + 1, shingles, items, [size], best)
        if longer and width == WORDS:
            _windows(np.zeros(1, dtype=np.int64), len(words), len(shingles), shingles, items, [s for s in items.tables if s > len(words)], best)
    return [best[i] for i in sorted(best)]


def _windows(starts: np.ndarray, size: int, span: int, shingles: np.ndarray, items: Items, sizes: list[int], best: dict) -> None:
    """Match windows of `size` words, `span` shingles, against the items of `sizes`."""
    for a in range(0, len(starts), 4096):
        some = starts[a : a + 4096]
        # Sums of bits by runs of nearby windows, so that long texts stay in small arrays.
        cuts = np.flatnonzero(np.diff(some) > span) + 1
        for run in np.split(some, cuts):
            lo, hi = int(run[0]), int(run[-1]) + span
            part = shingles[lo:hi]
            again = _repeats(part, span)
            sums = np.vstack([np.zeros(64), np.cumsum(weighted_bits(part, items.weights.of(part)), axis=0)])
            at = run - lo
            total = sums[at + span] - sums[at]
            for i in np.flatnonzero(again[at]):  # a window's shingles count once
                own = np.unique(part[at[i] : at[i] + span])
                total[i] = weighted_bits(own, items.weights.of(own)).sum(axis=0)
            prints = simhash(total)
            for x, y, d in _pairs(prints, items, sizes):
                own = np.unique(part[at[x] : at[x] + span])
                common = np.intersect1d(own, items.sets[y], assume_unique=True)
                if not len(common):
                    continue
                shared = items.weights.of(common).sum()
                likeness = float(shared / (items.weights.of(own).sum() + items.weights.of(items.sets[y]).sum() - shared))
                start, item = int(run[x]), int(items.ids[y])
                if likeness >= SIMILAR and (item not in best or (-likeness, start) < (-best[item][4], best[item][1])):
                    best[item] = item, start, size, int(d), likeness


def _pairs(prints: np.ndarray, items: Items, sizes: list[int]) -> Iterator[tuple[int, int, int]]:
    """Window, item and distance of the fingerprints within the radius."""
    for size in sizes:
        mine, table_ = items.tables[size]
        window, entry, distance = table_.near(prints)
        yield from zip(window.tolist(), mine[entry].tolist(), distance.tolist(), strict=True)


def _repeats(part: np.ndarray, span: int) -> np.ndarray:
    """For each start, whether the window of `span` shingles from there holds one twice."""
    order = np.argsort(part, kind="stable")
    gap = np.full(len(part), len(part) + span)
    same = part[order[1:]] == part[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    ends = np.arange(len(part)) + gap  # where the next equal shingle is
    nearest = np.minimum.accumulate(ends[::-1])[::-1]
    return nearest < np.arange(len(part)) + span


def item_parts(benchmark: DataFrame, part_items: int = PART_ITEMS) -> Iterator[list[tuple[int, str]]]:
    """Parts of the benchmark, each with about `part_items` items."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n = rows.count()
    parts = max(1, -(-n // part_items))
    numbered = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    for p in range(parts):
        yield sorted((r["item_id"], r["text"]) for r in numbered.where(F.col("part") == p).toLocalIterator())


def item_indexes(spark: SparkSession, benchmark: DataFrame) -> Iterator[tuple[Callable[[], Items], Callable[[], None]]]:
    """For each part of the benchmark, what gives its index on an executor, and what removes it."""
    weights = benchmark_weights(benchmark)
    everywhere = spark.sparkContext.broadcast(weights)
    for rows in item_parts(benchmark):
        part = spark.sparkContext.broadcast(replace(index_items(rows, weights), weights=None))
        yield (lambda part=part: replace(part.value, weights=everywhere.value)), part.destroy


def _leaky(texts: list[bytes], items: Items) -> Iterator[tuple[int, list[tuple[int, int, int, int, float]]]]:
    """Index and leaks of each text that holds an item."""
    at = 0
    while at < len(texts) and len(items.ids):
        stop, held = at, 0
        while stop < len(texts) and held < BATCH_BYTES:
            held += len(texts[stop])
            stop += 1
        words, owner = batch_words(texts[at:stop])
        bounds = np.searchsorted(owner, np.arange(stop - at + 1))
        for i in _candidates(words, owner, stop - at, items):
            if found := leaks_of(words[bounds[i] : bounds[i + 1]], items):
                yield at + i, found
        at = stop


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document and item that it holds: where, how many words, Hamming distance and similarity."""
    ws, kept = Workspace(docs.sparkSession, "leaks"), []
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    last = None
    for n, (index, remove) in enumerate(item_indexes(docs.sparkSession, benchmark)):
        if last is not None:  # store what the part before found, and let go of it
            kept.append(ws.save(last[0], f"part{n}"))
            last[1]()

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            items = index()
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.float64()]
            for batch in batches:
                ids = batch.column(0)
                found = [(ids[i].as_py(), *leak) for i, leaks in _leaky(texts_of(batch.column(1)), items) for leak in leaks]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in LEAKS.split(", ")])

        last = texts.mapInArrow(lean(run), LEAKS), remove
    out = last[0]
    for part in kept:
        out = out.unionByName(part)
    return out


def _candidates(words: np.ndarray, owner: np.ndarray, n: int, items: Items) -> list[int]:
    """Texts that hold a shingle of an item."""
    found = np.zeros(n, dtype=bool)
    for width in np.unique(np.minimum(items.sizes, WORDS)).tolist():
        shingles = shingle_fingerprints(words, width) if len(words) >= width else np.zeros(0, np.uint64)
        at = np.minimum(np.searchsorted(items.shingles, shingles), len(items.shingles) - 1)
        found[owner[np.flatnonzero(items.shingles[at] == shingles)]] = True
    return np.flatnonzero(found).tolist()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no benchmark item.

    Null and empty texts and an empty benchmark: rows stay; repeated rows are judged alike.
    """
    place, schema = docs.columns.index("text"), docs.schema
    ws = Workspace(docs.sparkSession, "clean")
    last = None
    for n, (index, remove) in enumerate(item_indexes(docs.sparkSession, benchmark)):
        if last is not None:
            docs = ws.save(docs, f"part{n}")
            last()

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            items = index()
            for batch in batches:
                stay = np.ones(batch.num_rows, dtype=bool)
                stay[[i for i, _ in _leaky(texts_of(batch.column(place)), items)]] = False
                yield batch.filter(pa.array(stay))

        docs, last = docs.mapInArrow(lean(run), schema), remove
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
