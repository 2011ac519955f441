"""Parsers of texts: partition literals, sizes, switches and durations."""

from __future__ import annotations

import base64
import datetime as dt
import re
import uuid
from typing import Any

from pyspark.sql import types as T

#: Spellings of true and false.
TRUE, FALSE = ("true", "1", "t", "yes", "y"), ("false", "0", "f", "no", "n")
UNITS = {"": 1, "B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "TB": 1 << 40, "KIB": 1 << 10, "MIB": 1 << 20, "GIB": 1 << 30, "TIB": 1 << 40}
RANGES = {"byte": 7, "short": 15, "integer": 31, "long": 63}


def parse_literal(raw: str | None, kind: T.DataType | str) -> Any:
    """Value of a partition literal; `kind` is a Spark type, or "uuid", "time", "timestamp_ns" or "fixed(n)"."""
    if raw is None:
        return None
    name = kind if isinstance(kind, str) else kind.typeName()
    if name == "boolean":
        if raw.strip().lower() in TRUE + FALSE:
            return raw.strip().lower() in TRUE
        raise ValueError(f"not a boolean: {raw!r}")
    if name in RANGES:
        if not re.fullmatch(r"[+-]?\d+", raw) or not -(1 << RANGES[name]) <= int(raw) < 1 << RANGES[name]:
            raise ValueError(f"not a {name}: {raw!r}")
        return int(raw)
    if name in ("float", "double"):
        return float(raw)
    if name == "string":
        return raw
    if name == "binary" or name.startswith("fixed("):
        data = base64.b64decode(raw, validate=True)
        if name != "binary" and len(data) != int(name[6:-1]):
            raise ValueError(f"{name} needs {name[6:-1]} bytes, not {len(data)}")
        return data
    if name == "uuid":
        return str(uuid.UUID(raw))
    if name == "date":
        return dt.date.fromisoformat(raw)
    if name == "time":
        t = dt.time.fromisoformat(raw)
        return ((t.hour * 60 + t.minute) * 60 + t.second) * 1_000_000 + t.microsecond
    if name in ("timestamp", "timestamp_ntz"):
        t = dt.datetime.fromisoformat(raw)
        if t.tzinfo is not None:
            t = t.astimezone(dt.UTC).replace(tzinfo=None)
        return t
    if name == "timestamp_ns":
        m = re.fullmatch(r"(.{19})(?:\.(\d{1,9}))?(Z|[+-]\d\d:\d\d)?", raw)
        if not m:
            raise ValueError(f"not a timestamp: {raw!r}")
        t = dt.datetime.fromisoformat(m[1] + (m[3] or "Z")).astimezone(dt.UTC)
        return int((t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)).total_seconds()) * 10**9 + int((m[2] or "0").ljust(9, "0"))
    raise ValueError(f"{name} cannot be a partition literal")


def parse_size(text: str) -> int:
    """Bytes of 64MB, 1 GB, 512: powers of 1024, above zero."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*", text)
    if not m or m[2].upper() not in UNITS or (n := int(float(m[1]) * UNITS[m[2].upper()])) <= 0:
        raise ValueError(f"not a size: {text!r}")
    return n


def human_size(n: int) -> str:
    for unit in ("B", "KiB", "MiB", "GiB"):
        if n < 1024:
            return f"{n} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TiB"


def parse_switch(text: str) -> bool:
    return text.strip().lower() in ("true", "1", "yes", "on")


def parse_partition(text: str) -> dict[str, str]:
    """{column: value} of `column=value`, several joined by commas."""
    out = {}
    for piece in text.split(","):
        column, eq, value = piece.partition("=")
        if not eq or not column.strip():
            raise ValueError(f"not column=value: {piece!r}")
        out[column.strip()] = value
    return out
