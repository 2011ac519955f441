"""Verification of a staged commit against the snapshot before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import DATA


def column_counts(files: DataFrame, counts: str = "value_counts", nulls: str = "null_counts") -> DataFrame:
    """Values and nulls of each column over all files, from per-file maps."""
    rows = files.select(F.explode(counts).alias("col", "v"), F.col(nulls).alias("nulls"))
    return rows.groupBy("col").agg(F.sum("v").alias("v"), F.sum(F.coalesce(F.try_element_at("nulls", "col"), F.lit(0))).alias("n"))


def compare_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Column by column, counts of both sides and whether they agree; missing counts are zero."""
    a = before.select("col", F.col("v").alias("v_in"), F.col("n").alias("n_in"))
    b = after.select("col", F.col("v").alias("v_out"), F.col("n").alias("n_out"))
    out = a.join(b, "col", "full_outer").fillna(0, ["v_in", "v_out", "n_in", "n_out"])
    return out.withColumn("pass", (F.col("v_in") == F.col("v_out")) & (F.col("n_in") == F.col("n_out")))


def bounds_of(files: DataFrame) -> DataFrame:
    """Per column, whether any file has values of it that aren't null, and whether any has bounds (per-file maps)."""
    nulls = F.coalesce(F.try_element_at("null_counts", "col"), F.lit(0))
    rows = files.select(F.explode("value_counts").alias("col", "v"), "null_counts", "lower", "upper")
    bounds = F.try_element_at("lower", "col").isNotNull() & F.try_element_at("upper", "col").isNotNull()
    return rows.groupBy("col").agg(F.max(F.col("v") > nulls).alias("has_values"), F.max(bounds).alias("has_bounds"))


def bounds_presence(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns with bounds on one side only; columns without any value are ignored."""
    a = before.where("has_values").select("col", F.col("has_bounds").alias("was"))
    b = after.where("has_values").select("col", F.col("has_bounds").alias("now"))
    out = a.join(b, "col", "full_outer").fillna(False, ["was", "now"]).where("was <> now")
    return out.select("col", F.when(F.col("was"), "missing").otherwise("spurious").alias("problem"))


def new_files(staged: DataFrame, before: DataFrame) -> DataFrame:
    return staged.select("path").join(before.select("path"), "path", "left_anti")


def missing_files(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """Requested paths that no entry has: a caller treats any as an error."""
    return wanted.join(entries.select("path", F.lit(True).alias("found")), "path", "left").where("found is null").select("path")


def file_set_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Multiset difference both ways: how often a path is missing or extra."""
    a = before.groupBy("path").agg(F.count("*").alias("a"))
    b = after.groupBy("path").agg(F.count("*").alias("b"))
    d = a.join(b, "path", "full_outer").fillna(0, ["a", "b"]).where("a <> b")
    return d.select("path", F.when(F.col("a") > F.col("b"), "missing").otherwise("extra").alias("side"), F.abs(F.col("a") - F.col("b")).alias("times"))


def unsupported(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Whether a rewrite must be refused, per group: several partition specs, or deletes kept in Puffin files (spec_id, content, path)."""
    g = entries.groupBy(*(by or [])).agg(F.count_distinct("spec_id").alias("specs"), F.count_if((F.col("content") != DATA) & F.col("path").endswith(".puffin")).alias("puffin"))
    return g.withColumn("refused", (F.col("specs") > 1) | (F.col("puffin") > 0))


def same_strings(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same strings, in any order."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def _join(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return a.join(b, by, "left") if by else a.join(b)  # without groups, a row each


def verify_compaction(before: DataFrame, after: DataFrame, deleted_rows: int = 0, by: list[str] | None = None) -> DataFrame:
    """Per group, or in one row: files and rows of both sides, and whether rows are conserved but for deleted ones (entries with record_count)."""
    a = before.groupBy(*(by or [])).agg(F.count("*").alias("files_in"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("rows_in"))
    b = after.groupBy(*(by or [])).agg(F.count("*").alias("files_out"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("rows_out"))
    return _join(a, b, by or []).withColumn("i1_rows", F.col("rows_in") - deleted_rows == F.col("rows_out"))


def verify_expire(before: DataFrame, staged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per group, or in one row: whether the newest snapshot stayed and no snapshot was added (snapshot_id, ts)."""
    by = by or []
    keys = [*by, "snapshot_id"]
    tip = lambda d, name: d.groupBy(*by).agg(F.max_by("snapshot_id", F.struct("ts", "snapshot_id")).alias(name))
    both = before.select(*keys, F.lit(1).alias("was")).join(staged.select(*keys, F.lit(1).alias("now")), keys, "full_outer")
    changed = both.groupBy(*by).agg(F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("now").isNull()).alias("removed"))
    out = _join(_join(tip(before, "tip_before"), tip(staged, "tip_after"), by), changed, by)
    return out.withColumn("pass", F.col("tip_before").eqNullSafe(F.col("tip_after")) & (F.col("added") == 0))
