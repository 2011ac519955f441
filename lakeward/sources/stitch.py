"""Parquet files joined by copying their bytes: tasks write pieces side by side, and each file is then put together by one stream."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

MAGIC = b"PAR1"
COPIED = 4 << 20
#: Thrift's compact types.
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, STRUCT = 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12
#: Fields of a footer: of the file, a row group, a column chunk and its metadata.
SCHEMA, ROWS, GROUPS = 2, 3, 4
CHUNKS, GROUP_OFFSET, ORDINAL = 1, 5, 7
OTHER_FILE, CHUNK_OFFSET, CHUNK_META, PAGE_INDEXES = 1, 2, 3, (4, 5, 6, 7)
OFFSETS = (9, 10, 11, 14)  # data, index and dictionary pages, bloom filter


def stitch(spark: SparkSession, groups: list[tuple[str, list[str]]]) -> None:
    """Write each target from its pieces, in their order, a task each; a task holds footers and `COPIED` bytes."""
    if groups:
        spark.sparkContext.parallelize(groups, len(groups)).foreach(lambda g: stitch_one(*g))


def stitch_one(target: str, pieces: list[str]) -> int:
    """Copy the row groups of pieces of one schema; offsets move, bloom filters stay, page indexes go.  Returns the rows."""
    fs, path = located(target)
    temp = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.tmp"  # a task may run twice
    first, groups, rows, at = None, [], 0, len(MAGIC)
    with fs.open_output_stream(temp) as out:
        out.write(MAGIC)
        for piece in pieces:
            with fs.open_input_file(located(piece)[1]) as f:
                meta, end = footer(f, piece)
                first = first or meta
                if meta[SCHEMA] != first[SCHEMA]:
                    raise ValueError(f"{piece}: another schema than {pieces[0]}")
                for g in meta[GROUPS][1][1]:
                    groups.append(moved(g, at - len(MAGIC), len(groups)))
                rows += meta[ROWS][1]
                f.seek(len(MAGIC))
                for begin in range(len(MAGIC), end, COPIED):
                    data = f.read(min(COPIED, end - begin))
                    out.write(data)
                    at += len(data)
        tail = bytearray()
        encode(tail, STRUCT, first | {ROWS: (I64, rows), GROUPS: (LIST, (STRUCT, groups))})
        out.write(bytes(tail) + len(tail).to_bytes(4, "little") + MAGIC)
    fs.move(temp, path)
    return rows


def located(path: str):
    """A path's file system and its name there, for the schemes that the store takes."""
    from pyarrow import fs

    scheme, rest = path.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    host, key = rest.removeprefix("//").split("/", 1)
    if scheme in ("s3", "s3a"):
        return fs.FileSystem.from_uri(f"s3://{host}")[0], f"{host}/{key}"
    return fs.FileSystem.from_uri(f"{scheme}://{host}")[0], f"/{key}"


def footer(f, name: str) -> tuple[dict, int]:
    """A file's footer, and where the bytes before it end."""
    size = f.size()
    f.seek(size - 8)
    tail = f.read(8)
    if tail[4:] != MAGIC:
        raise ValueError(f"{name}: no plain Parquet file")
    end = size - 8 - int.from_bytes(tail[:4], "little")
    f.seek(end)
    return decode(f.read(size - 8 - end), 0, STRUCT)[0], end


def moved(group: dict, by: int, ordinal: int) -> dict:
    """A row group whose bytes stand `by` further."""
    shift = lambda fields, ids: {i: (k, v + by if i in ids and v > 0 else v) for i, (k, v) in fields.items()}
    chunks = []
    for c in group[CHUNKS][1][1]:
        if OTHER_FILE in c:
            raise ValueError("column chunks in another file")
        c = {i: x for i, x in shift(c, (CHUNK_OFFSET,)).items() if i not in PAGE_INDEXES}
        chunks.append(c | {CHUNK_META: (STRUCT, shift(c[CHUNK_META][1], OFFSETS))})
    out = shift(group, (GROUP_OFFSET,)) | {CHUNKS: (LIST, (STRUCT, chunks))}
    out.pop(ORDINAL, None)
    return out | ({ORDINAL: (I16, ordinal)} if ordinal < 1 << 15 else {})


def varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if b[at - 1] < 128:
            return n, at


def decode(b: bytes, at: int, kind: int):
    """A value of Thrift's compact protocol and where it ends; a struct is a dict of (type, value) by field."""
    if kind in (TRUE, FALSE, BYTE):  # in a list, a truth value is a byte
        return b[at : at + 1], at + 1
    if kind in (I16, I32, I64):
        n, at = varint(b, at)
        return (n >> 1) ^ -(n & 1), at
    if kind == DOUBLE:
        return b[at : at + 8], at + 8
    if kind == BINARY:
        n, at = varint(b, at)
        return b[at : at + n], at + n
    if kind in (LIST, SET):
        n, of, at = b[at] >> 4, b[at] & 15, at + 1
        if n == 15:
            n, at = varint(b, at)
        out = []
        for _ in range(n):
            v, at = decode(b, at, of)
            out.append(v)
        return (of, out), at
    if kind != STRUCT:
        raise ValueError(f"type {kind} in a footer")
    fields, last = {}, 0
    while b[at]:
        delta, of, at = b[at] >> 4, b[at] & 15, at + 1
        if delta:
            last += delta
        else:
            last, at = decode(b, at, I16)
        if of in (TRUE, FALSE):
            fields[last] = (of, 0)
        else:
            v, at = decode(b, at, of)
            fields[last] = (of, v)
    return fields, at + 1


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def encode(out: bytearray, kind: int, v) -> None:
    """The inverse of `decode`."""
    if kind in (I16, I32, I64):
        put_varint(out, v << 1 if v >= 0 else (-v << 1) - 1)
    elif kind == BINARY:
        put_varint(out, len(v))
        out += v
    elif kind in (LIST, SET):
        of, items = v
        out.append(min(15, len(items)) << 4 | of)
        if len(items) > 14:
            put_varint(out, len(items))
        for x in items:
            encode(out, of, x)
    elif kind == STRUCT:
        last = 0
        for i, (of, x) in sorted(v.items()):
            if 0 < i - last < 16:
                out.append(i - last << 4 | of)
            else:
                out.append(of)
                encode(out, I16, i)
            last = i
            if of not in (TRUE, FALSE):
                encode(out, of, x)
        out.append(0)
    else:
        out += v
