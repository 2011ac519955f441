"""Token-id files: byte-level BPE ids in patched frame-of-reference blocks.

Documents are ordered by doc_id (range partitions, each sorted).  A segment
holds the ids of about a megabyte of text; its frames of 1,024 ids store
their minimum, the differences packed at the width that `PERCENT` of them fit,
and the rest as exceptions (place and high bits), with an index of where each
frame's words and exceptions start.  Segments are the rows of a Parquet table,
so that any store Spark writes to can hold the files.

Defined cases: null text is empty (only the end id); a null doc_id sorts
first; equal doc_ids lie side by side in order of their text, repeated rows
each have ids of their own; an empty table gives an empty file; other columns
are ignored; a text longer than a segment makes a segment of its own.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import SPACE, span_table, text_slices
from .cluster import Workspace, lean, parts_for, table

FRAME = 1024
PERCENT = 95
SEGMENT_BYTES = 1 << 20
END_ID = 0
CACHE = 1_000_000
BATCH = 2048
PART_BYTES = 64 << 20
HEAD = struct.Struct("<4sIQ")
MAGIC = b"LPF1"

#: Of ASCII bytes: letters 1, digits 2, marks but the apostrophe 3.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[39] = 0
#: How byte-level vocabularies spell bytes: as the character of that number if it can be printed, else as one from 256 on.
_SPELLED = np.arange(256, dtype="<u4")
_UNPRINTED = [*range(33), *range(127, 161), 173]
_SPELLED[_UNPRINTED] = 256 + np.arange(len(_UNPRINTED))
_SPELLED[10] = 10  # stands between pieces
#: White space beyond ASCII, and strings of special tokens: such texts are encoded as they are.
_ODD = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"<|", b"\x00", b"\x1c", b"\x1d", b"\x1e", b"\x1f"]


class Encoder:
    """Ids of whole texts; pieces between certain pre-token boundaries are encoded once and remembered.

    A piece of up to seven bytes is its own key; longer ones are found by a
    fingerprint and compared byte by byte, so that no two are ever mixed up.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already; threads would each keep memory
        self.tokenizer = Tokenizer.from_file(vocabulary)
        empty = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.known, self.recent = empty, empty  # keys in order, and the place of each one's ids
        self.flat, self.offset = Growing(np.int32), Growing(np.int64, [0])
        self.bytes, self.ends = Growing(np.uint8), Growing(np.int64, [0])

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype=np.int32)

    @staticmethod
    def boundaries(data: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of pieces that are always cut there, and which are one pre-token; `gap` marks the bytes between texts."""
        space = SPACE[data] & ~gap
        solid = ~space & ~gap
        before = lambda x: np.concatenate([[False], x[:-1]])
        after = lambda x: np.concatenate([x[1:], [False]])
        blank = (data == 32) & space
        word = solid & ~before(solid)
        joins = blank & after(word)  # a space belongs to the word behind it
        cut = gap | before(gap) | (word & ~before(blank)) | joins | (space & ~before(space))
        cut |= space & ~blank & after(word)  # the last of white space that can't join is a piece of its own
        # Letters, digits and marks are never one token; accented letters are two bytes.
        tail = (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)
        pair = (data == 0xC3) & after(tail)
        kind = np.where(pair | before(pair), np.uint8(1), _KIND[data])
        turn = np.concatenate([[False], kind[1:] != kind[:-1]])
        cut |= turn & (kind > 0) & np.concatenate([[False], kind[:-1] > 0])
        cut[:1] = True
        start = np.flatnonzero(cut)
        # One pre-token: letters, digits or marks alone, with at most a space before them.
        odd, turns = (np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in (kind == 0, turn))
        end, solid_from = np.append(start[1:], len(data)), start + (data[start] == 32)
        single = solid_from < end
        solid_from = np.minimum(solid_from, len(data) - 1)
        return start, single & (odd[end] == odd[solid_from]) & (turns[end] == turns[solid_from + 1])

    @staticmethod
    def keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of a piece of up to seven bytes, these and their number; of a longer one, a fingerprint with the top bit set."""
        size = end - start
        short = size <= 7
        eight = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)
        out = np.empty(len(start), np.uint64)
        few = size[short].astype(np.uint64)
        packed = np.ascontiguousarray(eight[start[short]]).view("<u8").ravel() & ((np.uint64(1) << (few * np.uint64(8))) - np.uint64(1))
        out[short] = packed | (few << np.uint64(56))
        out[~short] = span_table(data, start[~short], end[~short]) | np.uint64(1 << 63)
        return out

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the ids of ordered keys, -1 for those not known."""
        out = np.full(len(keys), -1, np.int64)
        for known, place in (self.known, self.recent):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                out = np.where(known[at] == keys, place[at], out)
        return out

    def _append(self, pieces: list[bytes], single: np.ndarray) -> np.ndarray:
        """Encode pieces, of which `single` are one pre-token, and keep their ids and bytes; returns their places."""
        found: list[list[int]] = [[]] * len(pieces)
        tokenize, which = self.tokenizer.model.tokenize, np.flatnonzero(single).tolist()
        spelled = _SPELLED[np.frombuffer(b"\n".join([pieces[i] for i in which]), np.uint8)].tobytes().decode("utf-32-le")
        for i, p in zip(which, spelled.split("\n") if which else [], strict=True):
            found[i] = [t.id for t in tokenize(p)]
        rest = np.flatnonzero(~single).tolist()
        for a in range(0, len(rest), BATCH):
            some = rest[a : a + BATCH]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([pieces[i].decode("utf-8", "replace") for i in some], add_special_tokens=False), strict=True):
                found[i] = e.ids
        first = len(self.offset) - 1
        self.offset.add(self.offset.last() + np.cumsum(np.fromiter(map(len, found), np.int64, len(found))))
        self.flat.add(np.fromiter(chain.from_iterable(found), np.int32))
        self.ends.add(self.ends.last() + np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))))
        self.bytes.add(np.frombuffer(b"".join(pieces), np.uint8))
        return np.arange(first, first + len(pieces), dtype=np.int32)

    def _learn(self, keys: np.ndarray, pieces: list[bytes], single: np.ndarray) -> np.ndarray:
        """Encode new pieces (with keys in order); returns their places."""
        places = self._append(pieces, single)
        self.recent = _merged(self.recent, (keys, places))
        if len(self.recent[0]) > max(1 << 15, len(self.known[0]) // 4):
            self.known, self.recent = _merged(self.known, self.recent), (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        return places

    def _limit(self) -> None:
        """Keep the pieces met first, which are the frequent ones, once there are more than `CACHE`."""
        if len(self.offset) - 1 > CACHE:
            keys, place = _merged(self.known, self.recent)
            old = place < CACHE
            self.known, self.recent = (keys[old], place[old]), (np.zeros(0, np.uint64), np.zeros(0, np.int32))
            self.flat.cut(int(self.offset.view()[CACHE]))
            self.bytes.cut(int(self.ends.view()[CACHE]))
            self.offset.cut(CACHE + 1)
            self.ends.cut(CACHE + 1)

    def many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id behind each text, and each text's number of ids."""
        raw = b"\x00".join(texts)
        marks = [x for x in _ODD if x != b"\x00" and x in raw] + ([b"\x00"] if raw.count(b"\x00") >= len(texts) else [])
        odd = {i for i, t in enumerate(texts) if any(x in t for x in marks)} if marks else set()
        if odd:
            raw = b"\x00".join(b"" if i in odd else t for i, t in enumerate(texts))
        raw += b"\x00"
        data = np.frombuffer(raw, dtype=np.uint8)
        gap = data == 0
        start, single = self.boundaries(data, gap)
        end = np.append(start[1:], len(data))
        unique, first, inverse = np.unique(self.keys(data, start, end), return_index=True, return_inverse=True)
        own = ~gap[start[first]]
        place = self._find(unique)
        if (missing := np.flatnonzero((place < 0) & own)).size:
            place[missing] = self._learn(unique[missing], [raw[a:b] for a, b in zip(start[first[missing]].tolist(), end[first[missing]].tolist(), strict=True)], single[first[missing]])
        piece = place[inverse]
        is_gap = gap[start]
        piece[is_gap] = -2
        offset, flat = self.offset.view(), self.flat.view()
        long = np.flatnonzero((end - start > 7) & ~is_gap)
        ends = self.ends.view()
        size = (end - start)[long]
        differs = ends[piece[long] + 1] - ends[piece[long]] != size
        rest = long[~differs]
        differs[~differs] = _differ(data, start[rest], self.bytes.view(), ends[piece[rest]], size[~differs])
        if differs.any():  # another piece has its fingerprint
            which = long[differs]
            piece[which] = self._append([raw[a:b] for a, b in zip(start[which].tolist(), end[which].tolist(), strict=True)], single[which])
            offset, flat = self.offset.view(), self.flat.view()
        count = np.ones(len(piece), np.int64)  # a gap is the end id
        real = piece >= 0
        count[real] = offset[piece[real] + 1] - offset[piece[real]]
        out_at = np.concatenate([[0], np.cumsum(count)])
        ids = np.full(out_at[-1], END_ID, dtype=np.int32)
        source = np.repeat(offset[np.where(real, piece, 0)] - out_at[:-1], count) + np.arange(out_at[-1])
        filled = np.repeat(real, count)
        ids[filled] = flat[source[filled]]
        self._limit()
        ends = out_at[1:][is_gap]
        lens = np.diff(ends, prepend=0)
        if odd:
            parts, at = [], 0
            for i, n in enumerate(lens.tolist()):
                own = ids[at : at + n]
                at += n
                if i in odd:
                    own = np.append(self.whole(texts[i]), np.int32(END_ID))
                    lens[i] = len(own)
                parts.append(own)
            ids = np.concatenate(parts)
        return ids, lens


class Growing:
    """An array that is appended to in place."""

    def __init__(self, kind: type, values: list[int] | None = None):
        self.held, self.size = np.zeros(1 << 16, kind), 0
        self.add(np.array(values or [], kind))

    def __len__(self) -> int:
        return self.size

    def add(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.held):
            bigger = np.zeros(max(2 * len(self.held), self.size + len(values)), self.held.dtype)
            bigger[: self.size] = self.view()
            self.held = bigger
        self.held[self.size : self.size + len(values)] = values
        self.size += len(values)

    def cut(self, size: int) -> None:
        self.size = size

    def view(self) -> np.ndarray:
        return self.held[: self.size]

    def last(self) -> int:
        return int(self.held[self.size - 1])


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two pairs of ordered keys and their places as one."""
    at = np.searchsorted(a[0], b[0])
    return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])


def _differ(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of a and b behind the two places differ."""
    if not len(size):
        return np.zeros(0, dtype=bool)
    ends = np.cumsum(size)
    step = np.arange(int(ends[-1]))
    wrong = a[np.repeat(at_a - (ends - size), size) + step] != b[np.repeat(at_b - (ends - size), size) + step]
    return np.logical_or.reduceat(wrong, ends - size) if wrong.any() else np.zeros(len(size), dtype=bool)


def pack_frames(ids: np.ndarray) -> bytes:
    """Ids (each under 2**32) as patched frames of reference behind an index."""
    n = len(ids)
    frames = -(-n // FRAME)
    v = np.zeros(frames * FRAME, dtype=np.uint32)
    v[:n] = ids
    if n:
        v[n:] = ids[-1]
    v = v.reshape(frames, 32, 32)  # value i of a frame: row i // 32, lane i % 32
    low = v.min(axis=(1, 2)) if frames else np.zeros(0, np.uint32)
    v = v - low[:, None, None]
    flat = v.reshape(frames, FRAME)
    at = FRAME * PERCENT // 100 - 1
    limit = np.partition(flat, at, axis=1)[:, at] if frames else np.zeros(0, np.uint32)
    width = np.ceil(np.log2(limit.astype(np.float64) + 1)).astype(np.uint8)
    starts, over_starts = np.zeros(frames, np.uint32), np.zeros(frames + 1, np.uint32)
    starts[:] = np.concatenate([[0], np.cumsum(width.astype(np.int64) * 32)[:-1]]) if frames else 0
    body = np.zeros(int(width.astype(np.int64).sum()) * 32, dtype=np.uint32)
    for w in np.unique(width):
        if not w:
            continue
        mine = np.flatnonzero(width == w)
        kept = v[mine] & np.uint32((1 << int(w)) - 1)
        out = np.zeros((len(mine), int(w), 32), dtype=np.uint32)
        for i in range(32):
            word, shift = divmod(i * int(w), 32)
            out[:, word] |= kept[:, i] << np.uint32(shift)
            if shift + int(w) > 32:
                out[:, word + 1] |= kept[:, i] >> np.uint32(32 - shift)
        body[(starts[mine].astype(np.int64)[:, None] + np.arange(int(w) * 32)).ravel()] = out.reshape(-1)
    high = flat >> width[:, None].astype(np.uint32)
    f, p = np.nonzero(high)
    over_starts[1:] = np.cumsum(np.bincount(f, minlength=frames))
    return b"".join([HEAD.pack(MAGIC, frames, n), low.tobytes(), width.tobytes(), starts.tobytes(), over_starts.tobytes(), body.tobytes(), p.astype(np.uint16).tobytes(), high[f, p].astype(np.uint32).tobytes()])


def unpack_frames(blob: bytes) -> np.ndarray:
    magic, frames, n = HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a frame-of-reference segment")
    at = HEAD.size

    def take(kind: type, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    low, width, starts, over_starts = take(np.uint32, frames), take(np.uint8, frames), take(np.uint32, frames), take(np.uint32, frames + 1)
    body = take(np.uint32, int(width.astype(np.int64).sum()) * 32)
    over = int(over_starts[-1]) if frames else 0
    place, high = take(np.uint16, over), take(np.uint32, over)
    v = np.zeros((frames, 32, 32), dtype=np.uint32)
    for w in np.unique(width):
        if not w:
            continue
        mine = np.flatnonzero(width == w)
        words = body[(starts[mine].astype(np.int64)[:, None] + np.arange(int(w) * 32)).ravel()].reshape(len(mine), int(w), 32)
        mask = np.uint32((1 << int(w)) - 1)
        for i in range(32):
            word, shift = divmod(i * int(w), 32)
            x = words[:, word] >> np.uint32(shift)
            if shift + int(w) > 32:
                x |= words[:, word + 1] << np.uint32(32 - shift)
            v[mine, i] = x & mask
    flat = v.reshape(frames, FRAME)
    f = np.repeat(np.arange(frames), np.diff(over_starts.astype(np.int64)))
    flat[f, place] |= high << width[f].astype(np.uint32)
    return (flat + low[:, None]).reshape(-1)[:n]


SEGMENTS = "part int, seq int, ids array<long>, lens array<long>, n_ids long, data binary"
_encoders: dict[str, Encoder] = {}


def encode_sorted(docs: DataFrame, vocabulary: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Segments of `docs` (doc_id, text), which is range-partitioned and sorted; parts are numbered in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encoder = _encoders.get(vocabulary) or _encoders.setdefault(vocabulary, Encoder(vocabulary))
        docs: list[int] = []
        texts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ids, lens = encoder.many(texts)
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            values = [part, seq, docs, lens.tolist(), len(ids), pack_frames(ids)]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds, strict=True)], names=["part", "seq", "ids", "lens", "n_ids", "data"])

        for rows, found in text_slices(batches, 1):
            for doc, text in zip(rows.column(0).to_pylist(), found, strict=True):
                docs.append(doc)
                texts.append(text)
                held += len(text) + 1
                if held >= segment_bytes:
                    yield flush()
                    seq, docs, texts, held = seq + 1, [], [], 0
        if docs:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), SEGMENTS)


def write_files(docs: DataFrame, vocabulary: str, path: str) -> None:
    """Write the token-id files of `docs` in ascending doc_id order."""
    parts = parts_for(docs, PART_BYTES)
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    encode_sorted(ordered, vocabulary).write.option("compression", "none").parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, from the stored files."""
    segments = spark.read.schema(SEGMENTS).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, docs, lens, data in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                raw = unpack_frames(data.as_py()).astype("<u4").tobytes()
                ends = np.cumsum(np.array(lens, dtype=np.int64))
                starts = ends - lens
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                k = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * k, pa.int32()), pa.array([seq] * k, pa.int32()), pa.array(docs, pa.int64()), pa.array(starts), pa.array(lens, pa.int64()), pa.array(sums, pa.int64())],
                    names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    read = segments.select("part", "seq", "ids", "lens", "data").mapInArrow(lean(run), "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    sizes = segments.select("part", "seq", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_at"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("seq_at")).join(parts, F.col("part") == F.col("p")).select("part", "seq", (F.col("part_at") + F.col("seq_at")).alias("base"))
    return read.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_files(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write `docs` as token-id files in the shared folder and return what the files hold of each document."""
    path = Workspace(spark, "tokens").root
    write_files(docs, vocabulary or default_vocabulary(), path)
    return read_files(spark, path)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, table(spark, sf_dir, "documents"))
