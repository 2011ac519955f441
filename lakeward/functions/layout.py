"""Expressions for laying rows out in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16


def spread(value: Column, lo: float | None, hi: float | None) -> Column:
    """A value's place between lo and hi in `BITS` bits; nulls come first."""
    if lo is None or hi is None or hi <= lo:
        return F.lit(0).cast("long")
    top = (1 << BITS) - 1
    place = F.floor((value.cast("double") - F.lit(float(lo))) / F.lit(float(hi - lo)) * top)
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(top), place)), F.lit(0)).cast("long")


def interleave(places: list[Column]) -> Column:
    """Z-order key: the bits of all places in turn, highest first."""
    n, bits = len(places), min(BITS, 62 // len(places))
    out = F.lit(0).cast("long")
    for i, p in enumerate(places):
        for b in range(bits):
            bit = F.shiftright(p, BITS - 1 - b).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(bit.cast("long"), n * (bits - 1 - b) + (n - 1 - i)))
    return out


SAMPLE = 20_000
CUTS = 255


def by_quantiles(value: Column, cuts: list[str]) -> Column:
    """A string's place by the number of cuts that aren't above it, in `BITS` bits; nulls come first."""
    below = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= value)) if cuts else F.lit(0)
    step = ((1 << BITS) - 1) // max(1, len(cuts))
    return F.when(value.isNotNull(), below * step).otherwise(0).cast("long")


def z_key(rows: DataFrame, columns: list[str]) -> Column:
    """Key of columns by their ranges in `rows`, found by one aggregate; strings go by quantiles of a bounded sample."""
    kinds = {c: rows.schema[c].dataType.typeName() for c in columns}
    texts = [c for c in columns if kinds[c] in ("string", "varchar", "char")]
    number = {c: F.unix_micros(F.col(c).cast("timestamp")) if kinds[c] in ("date", "timestamp", "timestamp_ntz") else F.col(c).cast("double") for c in columns if c not in texts}
    limits = [f(x).alias(f"{n}_{c}") for c, x in number.items() for n, f in (("lo", F.min), ("hi", F.max))]
    v = rows.agg(F.count("*").alias("rows"), *limits).first()
    places = {c: spread(x, v[f"lo_{c}"], v[f"hi_{c}"]) for c, x in number.items()}
    if texts:
        share = min(1.0, SAMPLE / max(1, v["rows"]))
        seen = rows.sample(share, seed=1).select(*texts).limit(2 * SAMPLE).collect()
        for c in texts:
            values = sorted(r[c] for r in seen if r[c] is not None)
            places[c] = by_quantiles(F.col(c), sorted({values[len(values) * i // (CUTS + 1)] for i in range(1, CUTS + 1)}) if values else [])
    return interleave([places[c] for c in columns])
