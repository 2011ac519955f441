"""Row-level deletes: application to data files and upkeep of delete files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def apply_position_deletes(rows: DataFrame, deletes: DataFrame, path: str = "file_path", pos: str = "pos") -> DataFrame:
    """Rows whose (path, position) no delete names; Catalyst broadcasts the deletes when they are small."""
    d = deletes.select(F.col("file_path").alias("d_path"), F.col("pos").alias("d_pos"))
    return rows.join(d, (rows[path] == F.col("d_path")) & (rows[pos] == F.col("d_pos")), "left_anti")


def apply_equality_deletes(rows: DataFrame, deletes: DataFrame, keys: list[str], seq: str = "seq", delete_seq: str = "delete_seq", scope: list[str] | None = None) -> DataFrame:
    """Rows that no delete of a larger sequence number equals on all keys.

    Nulls equal nulls, NaN equals nothing; a key that the rows lack matches
    nothing; `scope` columns (the partition) must be equal too.
    """
    if any(k not in rows.columns for k in keys):
        return rows
    # Only the latest delete of a key can matter: the deletes collapse to one row a key.
    d = deletes.groupBy(*[F.col(k) for k in [*keys, *(scope or [])]]).agg(F.max(delete_seq).alias("d_seq"))
    d = d.select("d_seq", *[F.col(k).alias(f"d_{k}") for k in [*keys, *(scope or [])]])
    on = rows[seq] < F.col("d_seq")
    for k in [*keys, *(scope or [])]:
        on = on & rows[k].eqNullSafe(F.col(f"d_{k}"))
        if isinstance(rows.schema[k].dataType, (DoubleType, FloatType)):
            on = on & ~F.isnan(F.coalesce(rows[k], F.lit(0.0)))
    return rows.join(d, on, "left_anti")


def merge_positions(*deletes: DataFrame) -> DataFrame:
    """Distinct positions of several delete files."""
    out = deletes[0].select("file_path", "pos")
    for d in deletes[1:]:
        out = out.unionByName(d.select("file_path", "pos"))
    return out.distinct()


def rewrite_position_deletes(deletes: DataFrame, live_paths: DataFrame) -> DataFrame:
    """Delete rows worth keeping: distinct, and of files that are still there."""
    return merge_positions(deletes).join(live_paths.select(F.col("path").alias("file_path")), "file_path", "left_semi")


def applicable_position_deletes(delete_files: DataFrame, live_paths: DataFrame) -> DataFrame:
    """Delete files that may apply: those that name a live file, or name none."""
    live = live_paths.select(F.col("path").alias("live_path"))
    return delete_files.join(live, F.col("referenced") == F.col("live_path"), "left").where(F.col("referenced").isNull() | F.col("live_path").isNotNull()).drop("live_path")
