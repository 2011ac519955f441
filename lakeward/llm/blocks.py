"""Blocks of whole texts and the rolling fingerprints computed over them.

A block is a few megabytes of documents packed into one row, so that Python
sees large arrays and shuffles carry few, dense rows.  Fingerprints are
polynomial prefix sums modulo 2**64 over randomised byte values: equal byte
strings always agree, different ones disagree but for about one pair in 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .cluster import lean

BLOCK_BYTES = 4 << 20
PIECE = 1 << 18
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of a fingerprint over all its bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_FOLDED = _VALUES[LOWER]
_tables: dict[str, np.ndarray] = {}


def _tables_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, PIECE + 4096)
        _tables["up"], _tables["down"] = _powers(_BASE, size), _powers(_BASE_INV, size)
    return _tables["up"][:n], _tables["down"][:n]


def prefix_sums(data: np.ndarray, folded: bool = False) -> np.ndarray:
    """P with P[i] the fingerprint sum of data[:i]; `folded` lower-cases A-Z."""
    up, _ = _tables_for(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_FOLDED if folded else _VALUES)[data] * up[: len(data)], out=out[1:])
    return out


def span_fingerprints(p: np.ndarray, start: np.ndarray, end: np.ndarray | int) -> np.ndarray:
    """Fingerprints of data[start:end]; a number for `end` is a fixed length."""
    _, down = _tables_for(len(p))
    stop = start + end if isinstance(end, int) else end
    return mix((p[stop] - p[start]) * down[start])


def word_fingerprints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and lower-cased fingerprint of each word; words are maximal runs of non-white-space bytes."""
    solid = np.zeros(len(data) + 2, dtype=np.int8)
    solid[1:-1] = ~SPACE[data]
    edge = np.diff(solid)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, end, span_table(data, start, end, folded=True)


_STEP = np.array([pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64) for k in range(5)], dtype=np.uint64)


def shingle_fingerprints(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Fingerprints of each run of n words; with fewer words, one of the whole sequence; none without words."""
    k = min(n, len(words))
    if not k:
        return np.zeros(0, dtype=np.uint64)
    m = len(words) - k + 1
    out = np.full(m, k, dtype=np.uint64)
    for i in range(k):
        out += words[i : i + m] * _STEP[i]
    return mix(out)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


SLICE_BYTES = 4 << 20


def text_slices(batches: Iterator[pa.RecordBatch], text_col: int, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of record batches with a few megabytes of text (or one longer text) each, and their texts."""
    for batch in batches:
        column, at = batch.column(text_col).cast(pa.binary()), 0
        lens = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        while at < len(lens):
            stop, held = at, 0
            while stop < len(lens) and held < most:
                held += lens[stop]
                stop += 1
            yield batch.slice(at, stop - at), texts_of(column.slice(at, stop - at))
            at = stop


PACKED = "block long, ids array<long>, lens array<long>, data binary"
BLOCK_ROWS = 20_000


def blocks_of(batches: Iterator[pa.RecordBatch], text_col: int, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, list[pa.RecordBatch], list[bytes]]]:
    """Number, rows (in slices) and texts of blocks of whole documents."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 24
    rows: list[pa.RecordBatch] = []
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        first = 0
        for i, text in enumerate(texts_of(batch.column(text_col)), 1):
            texts.append(text)
            held += len(text)
            if held >= block_bytes or len(texts) >= BLOCK_ROWS:
                yield block, [*rows, batch.slice(first, i - first)], texts
                block, first, rows, texts, held = block + 1, i, [], [], 0
        if first < batch.num_rows:
            rows.append(batch.slice(first))
    if texts:
        yield block, rows, texts


def packed_row(block: int, ids: list[int | None], texts: list[bytes], rest: bytes | None = None) -> pa.RecordBatch:
    """A row of `PACKED`, with `rest` if there is any."""
    squeeze = zstandard.ZstdCompressor(level=3)
    columns = [pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in texts]], pa.list_(pa.int64())), pa.array([squeeze.compress(b"".join(texts))], pa.binary())]
    names = ["block", "ids", "lens", "data"]
    if rest is not None:
        columns, names = [*columns, pa.array([rest], pa.binary())], [*names, "rest"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of whole documents: ids, byte lengths and their bytes, compressed.

    The result must be written before it is used twice: a block's number is its
    task's partition and place in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows, texts in blocks_of(batches, 1, block_bytes):
            yield packed_row(block, [i for r in rows for i in r.column(0).to_pylist()], texts)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), PACKED)


def pack_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like `pack`, with all other columns, and which texts are null, in the column `rest`; columns may have any names."""
    at, n = docs.columns.index(text_col), len(docs.columns)
    numbered = docs.toDF(*[f"c{i}" for i in range(n)])
    rows = numbered.select(F.col(f"c{docs.columns.index(id_col)}").cast("long").alias("id"), F.col(f"c{at}").cast("string").alias("text"), *[f"c{i}" for i in range(n) if i != at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held, texts in blocks_of(batches, 1):
            whole = pa.Table.from_batches(held)
            rest = whole.drop_columns(["id", "text"]).append_column("null", whole.column("text").is_null())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rest)
            yield packed_row(block, whole.column("id").to_pylist(), texts, sink.getvalue().to_pybytes())

    return rows.mapInArrow(lean(run), PACKED + ", rest binary")


def unpack_rows(packed: DataFrame, schema: StructType, text_col: str = "text") -> DataFrame:
    """The rows that `pack_rows` packed, without those at the places `gone`; `packed` has lens, data, rest and gone."""
    at = schema.names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lens, data, rest, gone in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                raw, ends = unpack(data.as_py()).tobytes(), np.cumsum(np.array(lens, np.int64))
                own = pa.ipc.open_stream(rest.as_py()).read_all().combine_chunks()
                null = own.column("null").to_pylist()
                texts = pa.array([None if no else raw[e - n : e].decode() for no, e, n in zip(null, ends.tolist(), lens, strict=True)], pa.string())
                columns = own.drop_columns(["null"]).columns
                stay = np.ones(len(lens), dtype=bool)
                stay[gone or []] = False
                yield from pa.Table.from_arrays([*columns[:at], texts, *columns[at:]], names=schema.names).filter(pa.array(stay)).to_batches()

    return packed.mapInArrow(lean(run), schema)


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8) if data else np.zeros(0, np.uint8)


def span_table(data: np.ndarray, start: np.ndarray, end: np.ndarray, folded: bool = False) -> np.ndarray:
    """Fingerprints of many spans in ascending order that don't overlap, computed in small pieces."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, side="right")))
        lo, hi = start[i], end[j - 1]
        out[i:j] = span_fingerprints(prefix_sums(data[lo:hi], folded), start[i:j] - lo, end[i:j] - lo)
        i = j
    return out


def batch_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of many texts, and the index of each one's text."""
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    start, _, words = word_fingerprints(data)
    begin = np.cumsum(np.array([0] + [len(t) + 1 for t in texts[:-1]], dtype=np.int64)) if texts else np.zeros(0, np.int64)
    return words, np.searchsorted(begin, start, side="right") - 1


def batch_ngrams(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of runs of n words that stay within a text, and the place of each run's first word."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
    return shingle_fingerprints(words, n)[at], at
