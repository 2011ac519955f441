"""Repeated passages by blockwise suffix sorting with difference covers.

Two suffixes repeat if their first `LENGTH` bytes agree.  A suffix counts as
repeated where an earlier one (smaller doc_id, then smaller start) agrees.
Documents are packed into blocks in doc_id order.

1. Buckets.  A suffix is dealt by the least of the grams (`GRAM` bytes, ordered
   by a hash) in its first LENGTH bytes, so equal suffixes meet.  Neighbours
   mostly share it and make one stretch of text.  Blocks first send the names of
   their grams, and then the stretches (each different one once) whose gram has
   more than one place.  A bucket is sorted one slice at a time.
2. Candidates.  Stretches that are whole copies of an earlier one are settled,
   as are those that share their gram with no other one that differs.  Of the rest,
   residues `COVER` modulo `PERIOD` hit every difference, so any two suffixes
   i, j have an offset d < PERIOD at which both i + d and j + d are sampled.  If
   no sampled string of `NAME` bytes among a suffix's first PERIOD offsets
   occurs twice, the suffix is alone.
3. Ranks.  A second, denser cover (`RESIDUES` modulo `STEP`) samples the
   candidates.  A sample's first LENGTH - STEP + 1 bytes are a chain of pieces,
   at places that are samples, too; the pieces are sorted by their bytes and get
   the ranks of this order.
4. Suffixes.  A suffix compares with another by its first d < STEP bytes, by
   the ranks of the chain at offset d, where both are sampled, and by the few
   bytes behind it up to LENGTH; this is exact.  For each d the earliest of each
   group of equal suffixes is found.
5. Blocks get a bit for each suffix they sent, and blank out what is covered.

Nothing rests on fingerprints agreeing: hashes deal suffixes and choose
candidates, which may only keep one too many; where they order rows, neighbours
are compared byte by byte.  A passage that many documents share costs at most
one entry a block inside; the suffixes at its ends, which differ, would all be
dealt by the same few grams, so grams with very many places (`HOT`) come last
in the order.  A bucket is bounded by the text it is made for (`BUCKET_BYTES`).

Defined cases: null text is empty; texts under LENGTH bytes stay as they are;
copies of a whole text are removed but for the first; rows with equal doc_id
are ordered by the MD5 of their text, and of equal rows one counts as first; a
null doc_id comes before all others; texts of any length are one piece; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, PACKED, PIECE, mix, packed_row, prefix_sums, span_fingerprints, texts_of, unpack
from .cluster import Workspace, parts_for, table

LENGTH = 100
PERIOD = 57
#: A perfect difference set modulo 57.
COVER = (0, 1, 6, 15, 22, 26, 45, 55)
NAME = LENGTH - PERIOD + 1
STEP = 13
#: A perfect difference set modulo 13.
RESIDUES = (0, 1, 3, 9)
SIDE = STEP - 1
LINKS = 6
PIECE_BYTES = LENGTH - SIDE - STEP * (LINKS - 1)
GRAM = 24
SPAN = LENGTH - GRAM + 1
BUCKET_BYTES = 16 << 20
SLICES = 16
MIN_BUCKETS = 6
#: Places a gram has at least, in all and in a block that tells of it, to come last.
HOT = 4096
HOT_IN_BLOCK = 16
PART_BYTES = 64 << 20
SALTS = 64
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
FIRST = -(1 << 63)
MESSAGE = "block long, bucket int, kind int, data binary"
NAMES, SUFFIXES = 0, 1

assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
assert {(a - b) % STEP for a in RESIDUES for b in RESIDUES} == set(range(STEP))
_SAMPLED = np.isin(np.arange(PERIOD), COVER)
_RANKED = np.isin(np.arange(STEP), RESIDUES)


def fingerprints(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of data[p:p+length] for ascending places p, computed in small pieces."""
    out = np.empty(len(at), dtype=np.uint64)
    i = 0
    while i < len(at):
        j = int(np.searchsorted(at, at[i] + PIECE, side="right"))
        lo = int(at[i])
        out[i:j] = span_fingerprints(prefix_sums(data[lo : int(at[j - 1]) + length]), at[i:j] - lo, length)
        i = j
    return out


def _buckets(prints: np.ndarray, n: int) -> np.ndarray:
    return ((prints >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


class Block:
    """Texts of a block, and what is asked of them."""

    def __init__(self, lens: np.ndarray, data: bytes | np.ndarray):
        self.data = data if isinstance(data, np.ndarray) else unpack(data)
        self.lens = np.asarray(lens, dtype=np.int64)
        self.start = np.cumsum(self.lens) - self.lens

    def samples(self) -> np.ndarray:
        """Places of the cover's suffixes that have a whole name."""
        inside = np.arange(len(self.data)) - np.repeat(self.start, self.lens)
        left = np.repeat(self.lens, self.lens) - inside
        return np.flatnonzero(_SAMPLED[inside % PERIOD] & (left >= NAME))

    def names(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of samples and their names: bucket and 32 bits."""
        at = self.samples()
        prints = fingerprints(self.data, at, NAME)
        return at, (_buckets(prints, buckets) << np.uint64(32)) | (prints & np.uint64(0xFFFFFFFF))

    def ties(self, buckets: int, repeated: np.ndarray) -> np.ndarray:
        """Places of suffixes that have a repeated name among the samples of their first bytes."""
        at, names = self.names(buckets)
        at = at[_isin(names, repeated)]
        near = np.zeros(len(self.data) + 1, dtype=np.int32)
        np.add.at(near, np.maximum(at - PERIOD + 1, 0), 1)
        np.add.at(near, at + 1, -1)
        return np.flatnonzero((np.cumsum(near)[:-1] > 0) & self.whole())

    def whole(self) -> np.ndarray:
        """Which places begin a suffix of `LENGTH` bytes."""
        edge = np.zeros(len(self.data) + 1, dtype=np.int32)
        has = self.lens >= LENGTH
        np.add.at(edge, self.start[has], 1)
        np.add.at(edge, (self.start + self.lens - LENGTH + 1)[has], -1)
        return np.cumsum(edge)[:-1] > 0


CHUNK = 1 << 16
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64)
LAST = np.uint64(1 << 63)


class Grams:
    """The order of grams: by a hash, those with very many places behind all others."""

    def __init__(self, hot: np.ndarray):
        self.hot = np.sort(hot.astype(np.uint64))
        self.size = np.uint64(1 << min(24, 16 + len(hot).bit_length()))
        self.maybe = np.zeros(int(self.size), dtype=bool)
        self.maybe[self.hot & (self.size - np.uint64(1))] = True

    def of(self, data: np.ndarray) -> np.ndarray:
        """The number in this order of the gram at each place that has a whole one."""
        out = np.empty(max(0, len(data) - GRAM + 1), np.uint64)
        for lo in range(0, len(out), CHUNK):
            n = min(CHUNK, len(out) - lo)
            words = np.ndarray((n + GRAM - 8,), "<u8", np.ascontiguousarray(data[lo : lo + n + GRAM - 1]), 0, (1,)).astype(np.uint64)
            h = words[:n] * _ODD[0]
            for i in range(8, GRAM, 8):
                h ^= h >> np.uint64(29)
                h += words[i : i + n]
                h *= _ODD[i // 8]
            h = mix(h) >> np.uint64(1)
            if len(self.hot):
                some = np.flatnonzero(self.maybe[h & (self.size - np.uint64(1))])
                h[some[_isin(h[some], self.hot)]] |= LAST
            out[lo : lo + n] = h
        return out


def least_of(every: np.ndarray) -> np.ndarray:
    """The least gram of each suffix of `LENGTH` bytes."""
    out = np.empty(max(0, len(every) - SPAN + 1), np.uint64)
    for lo in range(0, len(out), CHUNK):
        low, width = every[lo : lo + CHUNK + SPAN - 1], 1
        while 2 * width <= SPAN:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        n = len(out[lo : lo + CHUNK])
        out[lo : lo + n] = np.minimum(low[:n], low[SPAN - width : SPAN - width + n])
    return out


def places(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of `count` numbers each, one after the other."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Stretches:
    """Runs of a block's suffixes that have the same least gram, in the order of a hash of that gram and then of their places."""

    def __init__(self, block: Block, grams: Grams, buckets: int):
        self.block, self.buckets, every = block, buckets, grams.of(block.data)
        least = least_of(every)
        whole = block.whole()[: len(least)]
        begin, stop = whole.copy(), ~whole
        begin[1:] &= ~whole[:-1] | (least[1:] != least[:-1])
        stop[1:] &= whole[:-1]
        edges = np.flatnonzero(begin | stop)
        begins = begin[edges]
        start, count = edges[begins], np.diff(np.append(edges, len(least)))[begins]
        key = mix(least[start] + np.uint64(1))
        order = np.argsort(key, kind="stable")
        self.every, self.key, self.start, self.count = every, key[order], start[order], count[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = self.key[1:] != self.key[:-1]
        self.heads = np.flatnonzero(new)  # of the stretches of each gram
        self.held = np.diff(np.append(self.heads, len(key)))
        self.name_cut = self._cut(self.key[self.heads], buckets)

    @staticmethod
    def _cut(keys: np.ndarray, parts: int) -> np.ndarray:
        return np.searchsorted(_buckets(keys, parts), np.arange(parts + 1, dtype=np.uint64))

    def at_two_places(self) -> np.ndarray:
        """Which stretches hold their least gram more than once."""
        out = np.empty(len(self.start), dtype=bool)
        rows = np.lib.stride_tricks.sliding_window_view(self.every, SPAN) if len(out) else None
        for lo in range(0, len(out), CHUNK // 8):
            first, last = self.start[lo : lo + CHUNK // 8], self.count[lo : lo + CHUNK // 8] - 1
            out[lo : lo + CHUNK // 8] = rows[first].argmin(axis=1) != last + SPAN - 1 - rows[first + last][:, ::-1].argmin(axis=1)
        return out

    def names(self) -> list[tuple[int, bytes]]:
        """For each bucket: 32 bits of each of its grams, and a bit for those that more than one place here has."""
        names = (self.key[self.heads] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        often = (self.held > 1) | (np.logical_or.reduceat(self.at_two_places(), self.heads) if len(names) else False)
        return [(b, names[lo:hi].tobytes() + np.packbits(often[lo:hi]).tobytes()) for b, (lo, hi) in enumerate(zip(self.name_cut, self.name_cut[1:], strict=False)) if lo < hi]

    def choose(self, told: list[tuple[int, bytes]]) -> Chosen:
        """The stretches of the grams that more than one place has."""
        shared = np.zeros(len(self.heads), dtype=bool)
        for b, data in told:
            lo, hi = int(self.name_cut[b]), int(self.name_cut[b + 1])
            shared[lo:hi] = np.unpackbits(np.frombuffer(data, np.uint8), count=hi - lo)
        some = np.repeat(shared, self.held)
        start, count, raw = self.start[some], self.count[some], self.block.data.tobytes()
        first: dict[bytes, int] = {}
        leads = np.array([first.setdefault(raw[a:b], i) == i for i, (a, b) in enumerate(zip(start.tolist(), (start + count + LENGTH - 1).tolist(), strict=True))], dtype=bool)
        return Chosen(list(first), start[leads], count[leads], start[~leads], count[~leads], self._cut(self.key[some][leads], self.buckets * SLICES))


@dataclass
class Chosen:
    """Stretches that a block sends, of those with equal bytes the first."""

    texts: list[bytes]
    start: np.ndarray
    count: np.ndarray
    copy_start: np.ndarray
    copy_count: np.ndarray
    cut: np.ndarray  # where each slice begins

    def messages(self) -> list[tuple[int, bytes]]:
        """For each bucket: the number of stretches in each slice, of suffixes in each stretch, and the stretches."""
        squeeze, out = zstandard.ZstdCompressor(level=3), []
        for b in range(0, len(self.cut) // SLICES):
            cut = self.cut[b * SLICES : (b + 1) * SLICES + 1]
            if (mine := slice(int(cut[0]), int(cut[-1]))).start < mine.stop:
                out.append((b, squeeze.compress(np.diff(cut).astype(np.int32).tobytes() + self.count[mine].astype(np.int32).tobytes() + b"".join(self.texts[mine]))))
        return out

    def repeated(self, told: list[tuple[int, bytes]]) -> np.ndarray:
        """Places of suffixes that an earlier one equals."""
        ends = np.concatenate([[0], np.cumsum(self.count)])
        bits = np.zeros(int(ends[-1]), dtype=bool)
        for b, data in told:
            lo, hi = ends[self.cut[b * SLICES]], ends[self.cut[(b + 1) * SLICES]]
            bits[lo:hi] = np.unpackbits(unpack(data), count=int(hi - lo))
        return np.concatenate([places(self.start, self.count)[bits], places(self.copy_start, self.copy_count)])


def shared_names(messages: list[bytes]) -> list[bytes]:
    """For each message of a bucket: a bit for each of its grams that another block, or more than one place in a block, has."""
    sizes = [8 * len(m) // 33 for m in messages]
    names = np.concatenate([np.frombuffer(m, np.uint32, n) for m, n in zip(messages, sizes, strict=True)])
    often = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8, offset=4 * n), count=n) for m, n in zip(messages, sizes, strict=True)])
    _, which, times = np.unique(names, return_inverse=True, return_counts=True)
    shared = (np.bincount(which, weights=often) > 0) | (times > 1)
    return [np.packbits(x).tobytes() for x in np.split(shared[which], np.cumsum(sizes)[:-1])]


def settled(messages: list[bytes], grams: Grams) -> list[bytes]:
    """For each message of a bucket, in the order of blocks: a bit for each of its suffixes that an earlier one equals."""
    held = []
    for data in messages:
        raw = unpack(data).tobytes()
        per = np.frombuffer(raw, np.int32, SLICES)
        count = np.frombuffer(raw, np.int32, int(per.sum()), 4 * SLICES).astype(np.int64)
        begin = 4 * (SLICES + len(count)) + np.concatenate([[0], np.cumsum(count + LENGTH - 1)])
        held.append((raw, np.concatenate([[0], np.cumsum(per)]), count, begin))
    bits: list[list[np.ndarray]] = [[] for _ in held]
    for s in range(SLICES):
        first: dict[bytes, int] = {}
        leads, counts = [], []
        for raw, cut, count, begin in held:
            ends = begin[cut[s] : cut[s + 1] + 1].tolist()
            base = len(leads)
            leads += [first.setdefault(raw[a:b], base + i) == base + i for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
            counts.append(count[cut[s] : cut[s + 1]])
        count, lead = np.concatenate(counts), np.array(leads, dtype=bool)
        again = np.ones(int(count.sum()), dtype=bool)  # stretches that an earlier one equals are repeated
        again[places((np.cumsum(count) - count)[lead], count[lead])] = repeats_among(list(first), grams)
        ends = np.cumsum([0] + [int(c.sum()) for c in counts])
        for mine, lo, hi in zip(bits, ends, ends[1:], strict=False):
            mine.append(again[lo:hi])
    squeeze = zstandard.ZstdCompressor(level=1)
    return [squeeze.compress(np.packbits(np.concatenate(mine)).tobytes()) for mine in bits]


def repeats_among(texts: list[bytes], grams: Grams) -> np.ndarray:
    """Which suffixes of different stretches, in their order, an earlier one equals."""
    lens = np.array([len(t) for t in texts], np.int64)
    out = np.zeros(int((lens - LENGTH + 1).sum()), dtype=bool)
    if not len(lens):
        return out
    data, start = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lens) - lens
    every = np.concatenate([grams.of(data), np.zeros(GRAM - 1, np.uint64)])
    every[((start + lens)[:, None] - np.arange(1, GRAM)).ravel()] = np.iinfo(np.uint64).max
    least = np.minimum.reduceat(every, start)
    times = np.add.reduceat((every == np.repeat(least, lens)).astype(np.int32), start)
    _, which, shared = np.unique(least, return_inverse=True, return_counts=True)
    some = np.flatnonzero((shared[which] > 1) | (times > 1))  # a gram at one place of one stretch is in no two suffixes at the same offset
    block = Block(lens[some], data[places(start[some], lens[some])])
    names, often = np.unique(block.names(1)[1], return_counts=True)
    tied = np.zeros(len(block.data), dtype=bool)
    tied[block.ties(1, names[often > 1])] = True
    if not tied.any():
        return out
    samples = Samples(block, tied)
    told = [(b, piece_ranks(np.frombuffer(m, np.uint8).reshape(-1, PIECE_BYTES)).tobytes()) for b, m in samples.piece_messages(1)]
    again = np.zeros(len(block.data), dtype=bool)
    again[samples.records(samples.ranks(1, told, np.uint32), 1).repeated([])] = True
    out[places((start - np.arange(len(lens)) * (LENGTH - 1))[some], lens[some] - LENGTH + 1)] = again[block.whole()]
    return out


def piece_ranks(pieces: np.ndarray) -> np.ndarray:
    """Ranks of pieces by their bytes; equal ones have equal ranks."""
    words = as_words(pieces)
    order = np.lexsort(words[::-1])
    new = np.zeros(len(order), dtype=bool)
    for w in words:
        ranked = w[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    ranks = np.empty(len(order), np.uint32)
    ranks[order] = np.cumsum(new)
    return ranks

def grouped(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal rows of the columns (uint64) lie side by side, and where each group starts.

    Rows are ordered by a fingerprint, and by their values if different rows share one.
    """
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    prints = mixed(columns)
    order = np.argsort(prints)
    differ = np.zeros(n - 1, dtype=bool)
    for c in columns:
        ranked = c[order]
        differ |= ranked[1:] != ranked[:-1]
    if (differ & (prints[order[1:]] == prints[order[:-1]])).any():
        order = np.lexsort(columns[::-1])
        differ = np.zeros(n - 1, dtype=bool)
        for c in columns:
            ranked = c[order]
            differ |= ranked[1:] != ranked[:-1]
    return order, np.flatnonzero(np.concatenate([[True], differ]))


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A fingerprint of each row of the columns."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = mix((out ^ c) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return out


def numbers(order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of each row's group."""
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    return out


def as_words(rows: np.ndarray) -> list[np.ndarray]:
    """Columns of uint64 that order like the rows' bytes (n x k uint8)."""
    n, k = rows.shape
    padded = np.zeros((n, -(-k // 8) * 8), np.uint8)
    padded[:, :k] = rows
    return list(np.ascontiguousarray(padded).view(">u8").astype(np.uint64).T)


class Samples:
    """The ranked cover's samples of a block's candidates, and the pieces of their chains."""

    def __init__(self, block: Block, tied: np.ndarray):
        self.block = block
        inside = np.arange(len(block.data)) - np.repeat(block.start, block.lens)
        before = np.concatenate([np.zeros(STEP, np.int32), np.cumsum(tied, dtype=np.int32)])
        self.at = np.flatnonzero((before[STEP:] > before[:-STEP]) & _RANKED[inside % STEP])
        # Offsets at which a sample stands for a suffix within its text, `low` to `high`.
        left = np.repeat(block.start + block.lens, block.lens)[self.at] - self.at
        self.low, self.high = np.maximum(0, LENGTH - left), np.minimum(SIDE, inside[self.at])
        asked = np.zeros(len(block.data) + STEP * LINKS, dtype=bool)
        for t in range(LINKS):
            asked[self.at + STEP * t] = True
        self.pieces = np.flatnonzero(asked)

    def cut_pieces(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different pieces by bucket, where each bucket begins, and the number of the piece at each place."""
        rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.block.data, np.zeros(LENGTH, np.uint8)]), PIECE_BYTES)[self.pieces]
        words = as_words(rows)
        order, starts = grouped(words)
        first = order[starts]
        unique, turn, cut = _dealt(_buckets(mixed([w[first] for w in words]), buckets), buckets)
        return rows[first[unique]], cut, turn[numbers(order, starts)]

    def piece_messages(self, buckets: int) -> list[tuple[int, bytes]]:
        unique, cut, _ = self.cut_pieces(buckets)
        return [(b, unique[cut[b] : cut[b + 1]].tobytes()) for b in range(buckets) if cut[b] < cut[b + 1]]

    def ranks(self, buckets: int, told: list[tuple[int, bytes]], kind: type) -> np.ndarray:
        """The rank of the piece at each of its places, as one number with its bucket."""
        unique, cut, number = self.cut_pieces(buckets)
        ranks = np.zeros(len(unique), np.uint64)
        for b, data in told:
            ranks[cut[b] : cut[b + 1]] = np.frombuffer(data, np.uint32).astype(np.uint64) * np.uint64(buckets) + np.uint64(b)
        if len(ranks) and ranks.max() > np.iinfo(kind).max:
            raise OverflowError("ranks need wider numbers")
        return ranks[number].astype(kind)

    def records(self, ranks: np.ndarray, buckets: int, turn: tuple[int, int] = (0, 1)) -> Records:
        """Different samples by bucket, of the buckets that are `turn[0]` modulo `turn[1]`."""
        place = np.zeros(int(self.pieces[-1]) + 1 if len(self.pieces) else 0, np.int64)
        place[self.pieces] = np.arange(len(self.pieces))
        link = lambda some, t: ranks[place[self.at[some] + STEP * t]]
        every = slice(None)
        bucket = _buckets(mixed([link(every, t).astype(np.uint64) for t in (0, LINKS - 1)]), buckets)  # equal chains have equal ends
        mine = np.flatnonzero(bucket % np.uint64(turn[1]) == turn[0])
        chain = np.column_stack([link(mine, t) for t in range(LINKS)])
        wide = np.concatenate([np.zeros(SIDE, np.uint8), self.block.data, np.zeros(LENGTH, np.uint8)])
        around = np.lib.stride_tricks.sliding_window_view(wide, SIDE)
        sides = [around[self.at[mine]], around[self.at[mine] + LENGTH]]
        rows = np.concatenate([np.ascontiguousarray(chain).view(np.uint8).reshape(len(mine), LINKS * ranks.itemsize), *sides, np.column_stack([self.low[mine], self.high[mine]]).astype(np.uint8)], axis=1)
        order, starts = grouped(as_words(rows))
        lead = np.minimum.reduceat(order, starts) if len(order) else order  # samples lie in the order of their places
        unique, turned, cut = _dealt(bucket[mine][lead], buckets)
        return Records(self.at[mine], self.low[mine], self.high[mine], rows[lead[unique]], turned[numbers(order, starts)], self.at[mine][lead[unique]], cut)


def _dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket, each row's place in it, and where each bucket begins."""
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return order, place, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


@dataclass
class Records:
    """Samples of a block, with those of the same chain, sides and offsets as one record."""

    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    number: np.ndarray  # each sample's record
    first: np.ndarray  # each record's first sample
    cut: np.ndarray  # where each bucket's records begin

    def repeated(self, told: list[tuple[int, bytes]]) -> np.ndarray:
        """Places of suffixes that an earlier one equals, in this block or (as told) in one before it."""
        earlier = np.zeros(len(self.rows), np.uint16)
        for b, data in told:
            earlier[self.cut[b] : self.cut[b + 1]] = np.frombuffer(data, np.uint16)
        out = [np.zeros(0, np.int64)]
        for d, rows, order, starts in equal_suffixes(self.rows):
            least = np.empty(len(self.rows), np.int64)
            least[rows[order]] = np.repeat(np.minimum.reduceat(self.first[rows[order]], starts), np.diff(np.append(starts, len(order))))
            mine = np.flatnonzero((self.low <= d) & (d <= self.high))
            own = self.number[mine]
            out.append(self.at[mine][(self.at[mine] > least[own]) | ((earlier[own] >> np.uint16(d)) & np.uint16(1) > 0)] - d)
        return np.concatenate(out)


def equal_suffixes(records: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each offset, the records that stand for a suffix there, an order of them by suffix, and where each group starts.

    A suffix is a record's chain with `SIDE` bytes around it, of which so many stand before.
    """
    chain = numbers(*grouped(as_words(records[:, : -2 * SIDE - 2]))).astype(np.uint64)
    sides, low, high = records[:, -2 * SIDE - 2 : -2], records[:, -2], records[:, -1]
    for d in range(STEP):
        rows = np.flatnonzero((low <= d) & (d <= high))
        if len(rows):
            yield d, rows, *grouped([chain[rows], *as_words(sides[rows, SIDE - d : 2 * SIDE - d])])


def _isin(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _rows(block: int, kind: int, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * len(parts), pa.int64()), pa.array([p[0] for p in parts], pa.int32()), pa.array([kind] * len(parts), pa.int32()), pa.array([p[1] for p in parts], pa.binary())],
        names=["block", "bucket", "kind", "data"],
    )


def text_keys(docs: DataFrame) -> DataFrame:
    """One row per doc_id and text: its copies, bytes, MD5, whether an earlier row has the text, hash of short texts.

    Rows of one text are numbered within salted groups, and only each group's
    first meets the others': no task has all copies of a text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    length = F.octet_length(text)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc_id"), F.md5(text).alias("md5"), length.cast("long").alias("n_bytes"), F.when(length < LENGTH, F.sha2(text, 256)).alias("sha"))
    keys = rows.groupBy("doc_id", "md5", "n_bytes", "sha").agg(F.count("*").alias("copies")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    salted = Window.partitionBy("md5", "n_bytes", "salt")
    keys = keys.withColumn("group_first", F.min("doc_id").over(salted))
    leads = keys.where(F.col("doc_id") == F.col("group_first")).select("md5", "n_bytes", "salt", F.col("doc_id").alias("lead"))  # at most SALTS a text
    firsts = leads.withColumn("first", F.min("lead").over(Window.partitionBy("md5", "n_bytes"))).where("lead > first").select("md5", "n_bytes", "salt", F.lit(True).alias("later"))
    joined = keys.join(firsts, ["md5", "n_bytes", "salt"], "left")
    repeats = (F.col("n_bytes") >= LENGTH) & ((F.col("doc_id") > F.col("group_first")) | F.coalesce("later", F.lit(False)))
    return joined.select("md5", "n_bytes", "doc_id", "sha", "copies", repeats.alias("repeats"))


def pack_firsts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Blocks, in doc_id order, of the texts that are the first of their kind and long enough to repeat."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc_id"), F.md5(text).alias("md5"), F.lit(1).alias("kind"), text.alias("text")).where(F.octet_length("text") >= LENGTH)
    marks = keys.where("repeats").select("doc_id", "md5", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"))
    parts = parts_for(docs, PART_BYTES)
    ordered = rows.unionByName(marks).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "md5", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, last = TaskContext.get().partitionId() << 24, None
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0
        for batch in batches:
            for doc, md5, kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts_of(batch.column(3)), strict=True):
                if (doc, md5) != last and kind:
                    ids.append(doc)
                    texts.append(text)
                    held += len(text)
                    if held >= BLOCK_BYTES:
                        yield packed_row(block, ids, texts)
                        block, ids, texts, held = block + 1, [], [], 0
                last = doc, md5
        if ids:
            yield packed_row(block, ids, texts)

    return ordered.mapInArrow(run, PACKED)


def hot_grams(packed: DataFrame, most: int) -> np.ndarray:
    """Grams with at least `most` places, counted in the blocks where they have `HOT_IN_BLOCK` or more."""
    least = HOT_IN_BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                every = np.sort(Grams(np.zeros(0, np.uint64)).of(unpack(data)))
                some = every[: max(0, len(every) - least + 1)][every[least - 1 :] == every[: max(0, len(every) - least + 1)]]
                some = np.unique(some)
                n = np.searchsorted(every, some, side="right") - np.searchsorted(every, some)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    rows = packed.select("data").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= most)
    return rows.select("gram").toPandas()["gram"].to_numpy(np.uint64)  # at most a number of bytes over `most`


def _told(messages: pd.DataFrame, kind: int) -> list[tuple[int, bytes]]:
    mine = messages[messages["kind"] == kind]
    return list(zip(mine["bucket"], mine["data"], strict=True))


def shared_grams(packed: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """Messages to blocks: which of the grams of their stretches more than one place has."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(hot)
        for batch in batches:
            for block, lens, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if parts := Stretches(Block(lens, data), grams, buckets).names():
                    yield _rows(block, NAMES, parts)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows["data"] = shared_names(list(rows["data"]))
        return rows

    return packed.select("block", "lens", "data").mapInArrow(send, MESSAGE).groupBy("bucket").applyInPandas(meet, MESSAGE)


def sorted_buckets(packed: DataFrame, names: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """Messages to blocks: a bit for each suffix they sent that an earlier one equals."""

    def send(key: tuple, block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lens, data in zip(block["lens"], block["data"], strict=True):
            chosen = Stretches(Block(lens, data), Grams(hot), buckets).choose(_told(told, NAMES))
            out += [(key[0], b, SUFFIXES, m) for b, m in chosen.messages()]
        return pd.DataFrame(out, columns=["block", "bucket", "kind", "data"])

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        rows["data"] = settled(list(rows["data"]), Grams(hot))
        return rows

    sent = packed.select("block", "lens", "data").groupBy("block").cogroup(names.groupBy("block")).applyInPandas(send, MESSAGE)
    return sent.groupBy("bucket").applyInPandas(settle, MESSAGE)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def keep(packed: DataFrame, messages: DataFrame, hot: np.ndarray, buckets: int, with_text: bool = False) -> DataFrame:
    """Per packed document: what is removed, and the hash (or also the bytes) of what stays."""

    def apply(key: tuple, block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, lens, data in zip(*(block[c] for c in ("ids", "lens", "data")), strict=True):
            b = Block(lens, data)
            again = np.zeros(len(b.data) + LENGTH, dtype=np.int32)
            chosen = Stretches(b, Grams(hot), buckets).choose(_told(told, NAMES))
            again[chosen.repeated(_told(told, SUFFIXES)) + LENGTH] = 1
            seen = np.cumsum(again, dtype=np.int32)
            gone = seen[LENGTH:] > seen[:-LENGTH]
            for doc, s, n in zip(ids, b.start.tolist(), b.lens.tolist(), strict=True):
                mine = gone[s : s + n]
                left = b.data[s : s + n][~mine].tobytes()
                spans = int(np.count_nonzero(mine[1:] & ~mine[:-1])) + int(mine[0])
                out.append((doc, n, int(mine.sum()), spans, hashlib.sha256(left).hexdigest(), *([left] if with_text else [])))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])

    return packed.groupBy("block").cogroup(messages.groupBy("block")).applyInPandas(apply, KEPT + ", kept binary" * with_text)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    ws = Workspace(spark, "suffixes")
    keys = ws.save(text_keys(docs), "keys")
    total = keys.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(MIN_BUCKETS, total // BUCKET_BYTES)
    packed = ws.save(pack_firsts(docs, keys), "packed", "none")
    ws.release()
    hot = hot_grams(packed, max(HOT, total >> 20))
    ws.release()
    names = ws.save(shared_grams(packed, hot, buckets), "names")
    ws.release()
    messages = names.unionByName(ws.save(sorted_buckets(packed, names, hot, buckets), "told"))
    ws.release()
    plain = keys.where("sha is not null").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), "copies")
    copies = F.when(F.col("repeats"), F.col("copies")).otherwise(F.col("copies") - 1)
    whole = keys.where("sha is null").select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(EMPTY_SHA).alias("kept_sha256"), copies.alias("copies")).where("copies > 0")
    rows = plain.unionByName(whole).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")
    rows = rows.unionByName(keep(packed, messages, hot, buckets))
    out = Workspace(spark, "repeats").save(rows.withColumn("doc_id", F.when(F.col("doc_id") != FIRST, F.col("doc_id"))), "rows")
    ws.clear()
    ws.release()
    return out


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
