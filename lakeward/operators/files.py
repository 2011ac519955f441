"""Relational operators over file entries: filters, keys, groups, health and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIB = 1 << 20
DATA, POSITION_DELETES, EQUALITY_DELETES = 0, 1, 2
#: Upper ends of the size classes, in order.
SIZE_CLASSES = ((1_048_576, "< 1 MB"), (10_485_760, "1-10 MB"), (67_108_864, "10-64 MB"), (134_217_728, "64-128 MB"), (268_435_456, "128-256 MB"), (None, "> 256 MB"))
INTERNAL = r"(^_lakeward|_lakeward/)"


def partition_key(values: Column) -> Column:
    """Canonical key of a partition map: name=value pairs by name; `(unpartitioned)` when empty."""
    pairs = F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(e.key, F.lit("="), F.coalesce(e.value, F.lit("null"))))
    return F.when(F.size(values) > 0, F.array_join(pairs, "/")).otherwise(F.lit("(unpartitioned)"))


def inferred_partition(path: Column) -> Column:
    """Map of the `column=value` segments of a path."""
    segments = F.filter(F.split(path, "/"), lambda s: F.contains(s, F.lit("=")))
    return F.map_from_entries(F.transform(segments, lambda s: F.struct(F.substring_index(s, "=", 1), F.regexp_replace(s, r"^[^=]*=", ""))))


def within_bounds(lower: Column, upper: Column, wanted: Column) -> Column:
    """Whether a manifest may hold the wanted value; unknown bounds keep it."""
    return F.coalesce((lower <= wanted) & (wanted <= upper), F.lit(True))


def live_at(entries: DataFrame, sequence: int) -> DataFrame:
    """Entries of a snapshot: those added up to its sequence number."""
    return entries.where(F.col("seq") <= sequence)


def compactable(entries: DataFrame, target: int) -> DataFrame:
    """Files below the target; with no target, all."""
    return entries.where(F.col("file_bytes") < target) if target > 0 else entries


def is_internal(path: Column) -> Column:
    """Paths that maintenance must not touch."""
    return path.rlike(INTERNAL)


def current_metadata(paths: DataFrame) -> DataFrame:
    """Per table, the metadata file of the largest version; v<n>, <n>-<uuid> and bare <n> count."""
    name = F.regexp_extract("path", r"([^/]+)\.metadata\.json$", 1)
    version = F.coalesce(*[F.regexp_extract(name, p, 1).try_cast("long") for p in (r"^v(\d+)$", r"^(\d+)-.+$", r"^(\d+)$")])
    rows = paths.select(F.regexp_extract("path", r"^(.*)/metadata/", 1).alias("tbl"), "path", version.alias("version")).where("version is not null")
    return rows.groupBy("tbl").agg(F.max("version").alias("version"), F.max_by("path", F.struct("version", "path")).alias("path"))


def table_health(entries: DataFrame, manifests: DataFrame, small: int = 64 * MIB, warn: float = 0.05, critical: float = 0.10, small_warn: float = 0.30, small_critical: float = 0.60) -> DataFrame:
    """One row: counts, ratios, and which threshold is exceeded."""
    f = entries.agg(
        F.count("*").alias("files"), F.sum("file_bytes").alias("bytes"), F.sum("record_count").alias("total_rows"),
        F.count_if(F.col("file_bytes") < small).alias("small_files"), F.coalesce(F.sum(F.when(F.col("file_bytes") < small, F.col("file_bytes"))), F.lit(0)).alias("small_bytes"),
    )
    m = manifests.agg(F.count("*").alias("manifests"), F.sum("manifest_bytes").alias("manifest_bytes"))
    out = f.join(m).withColumn("avg_manifest", F.expr("manifest_bytes div manifests"))  # two rows of aggregates
    out = out.withColumn("small_ratio", F.coalesce(F.try_divide("small_files", "files"), F.lit(0.0))).withColumn("metadata_ratio", F.coalesce(F.try_divide("manifest_bytes", "bytes"), F.lit(0.0)))
    level = F.when(F.col("metadata_ratio") > critical, "critical metadata").when(F.col("small_ratio") > small_critical, "critical small files").when(F.col("metadata_ratio") > warn, "warn metadata").when(F.col("small_ratio") > small_warn, "warn small files").otherwise("ok")
    return out.withColumn("verdict", level)


def partition_health(entries: DataFrame, commits: DataFrame, now: Column, rewrites: DataFrame | None = None, small: int = 64 * MIB, small_trigger: int = 50, file_trigger: int = 200, hot_window: int | None = 5, stale_hours: int = 24, least_stale: int = 2) -> DataFrame:
    """Per partition: counts, latest commit, hot flag and the three triggers; `commits` has seq, committed_at; `rewrites` part, rewritten_at."""
    groups = entries.groupBy("part").agg(
        F.count("*").alias("file_count"), F.sum("record_count").alias("total_rows"), F.sum("file_bytes").alias("total_bytes"),
        F.count_if(F.col("file_bytes") <= small).alias("small_count"), F.max("seq").alias("max_seq"),
    )
    newest = entries.agg(F.max("seq").alias("table_seq"))
    hot = F.lit(False) if hot_window is None else F.col("max_seq") > F.col("table_seq") - hot_window
    out = groups.join(newest).join(commits.select(F.col("seq").alias("max_seq"), "committed_at"), "max_seq", "left").withColumn("is_hot", hot)
    stale = (F.col("committed_at") < now - F.expr(f"interval {stale_hours} hours")) & (F.col("file_count") >= least_stale)
    if rewrites is not None:
        out = out.join(rewrites, "part", "left")
        stale = stale & (F.col("rewritten_at").isNull() | (F.col("rewritten_at") < now - F.expr(f"interval {stale_hours} hours")))
    flags = {"needs_small": F.col("small_count") >= small_trigger, "needs_files": F.col("file_count") >= file_trigger, "needs_stale": F.coalesce(stale, F.lit(False))}
    return out.withColumns(flags).select("part", "file_count", "total_rows", "total_bytes", "small_count", "max_seq", "is_hot", *flags)


def partition_totals(entries: DataFrame) -> DataFrame:
    return entries.groupBy("part").agg(F.count("*").alias("file_count"), F.sum("record_count").alias("total_rows"), F.sum("file_bytes").alias("total_bytes"))


def partition_files(entries: DataFrame, small: int = 64 * MIB) -> DataFrame:
    """Per partition: totals, latest commit, and the paths of its small and large files, in order."""
    paths = lambda which: F.sort_array(F.collect_list(F.when(which, F.col("path"))))
    size = F.col("file_bytes")
    return entries.groupBy("part").agg(
        F.count("*").alias("file_count"), F.sum("record_count").alias("total_rows"), F.sum("file_bytes").alias("total_bytes"), F.max("seq").alias("max_seq"),
        paths(size <= small).alias("small_files"), paths(size > small).alias("large_files"),
    )


def orphans(listed: DataFrame, used: DataFrame, before: int) -> DataFrame:
    """Listed files (path, modified) that were modified before a time and that no used entry names."""
    return listed.where(F.col("modified") < before).join(used.select("path"), "path", "left_anti")


def size_class(size: Column) -> Column:
    out = F.lit(SIZE_CLASSES[-1][1])
    for end, name in reversed(SIZE_CLASSES[:-1]):
        out = F.when(size < end, name).otherwise(out)
    return out


def size_histogram(entries: DataFrame) -> DataFrame:
    return entries.groupBy(size_class(F.col("file_bytes")).alias("bucket")).agg(F.count("*").alias("file_count"), F.sum("file_bytes").alias("total_bytes"))


def size_summary(entries: DataFrame, small: int = 8 * MIB) -> DataFrame:
    """Average, least, most and median size, and the share of small files."""
    size = F.col("file_bytes")
    return entries.agg(F.count("*").alias("files"), F.avg(size).alias("avg_bytes"), F.min(size).alias("min_bytes"), F.max(size).alias("max_bytes"), F.percentile(size, F.lit(0.5)).alias("median_bytes"), F.avg((size < small).cast("double")).alias("small_ratio"))


def crowded_partitions(entries: DataFrame, more_than: int = 10, limit: int = 20) -> DataFrame:
    """The partitions with most files: a top-k report."""
    return entries.groupBy("part").agg(F.count("*").alias("file_count"), F.sum("file_bytes").alias("total_bytes")).where(F.col("file_count") > more_than).orderBy(F.desc("file_count"), "part").limit(limit)


def partition_stats(entries: DataFrame, threshold: int) -> DataFrame:
    """Per partition, average size and whether compaction pays."""
    out = entries.groupBy("part").agg(F.count("*").alias("file_count"), F.sum("file_bytes").alias("total_bytes"), F.avg("file_bytes").alias("avg_bytes"))
    return out.withColumn("needs_compaction", (F.col("avg_bytes") < threshold) & (F.col("file_count") > 1))


def small_file_partitions(entries: DataFrame, target: int) -> DataFrame:
    """Partitions with at least one file below the target."""
    return entries.groupBy("part").agg(F.count_if(F.col("file_bytes") < target).alias("small_count")).where("small_count > 0")


def manifest_groups(entries: DataFrame) -> DataFrame:
    """One manifest per spec and partition: what a consolidation would write."""
    return entries.groupBy("spec_id", "part").agg(F.count("*").alias("files"), F.sum("record_count").alias("total_rows"), F.min("seq").alias("min_seq"))


def anchors(entries: DataFrame, small: int, rotation: int) -> DataFrame:
    """Per partition the file that small ones are merged into.

    Large files take turns in the order of their paths, starting at a hash of
    the partition; without large files the largest small one is taken, the
    first path on ties.
    """
    large = entries.where(F.col("file_bytes") > small)
    order = Window.partitionBy("part").orderBy("path")
    turn = F.pmod(F.lit(rotation) + fnv1a64(F.concat(F.lit("part="), F.col("part").cast("string"))), F.col("n"))
    ranked = large.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("part")))
    picked = ranked.where(F.col("i") == turn).select("part", "path", F.lit(False).alias("bootstrap"))
    rest = entries.join(large.select("part").distinct(), "part", "left_anti").groupBy("part").agg(F.min_by("path", F.struct(-F.col("file_bytes"), F.col("path"))).alias("path"))
    return picked.unionByName(rest.select("part", "path", F.lit(True).alias("bootstrap")))


def fnv1a64(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, masked to 63 bits, in decimal arithmetic modulo 2**64."""
    two64, prime = F.lit("18446744073709551616").cast("decimal(38,0)"), F.lit(1099511628211).cast("decimal(14,0)")
    bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substr(F.hex(text), (i * 2 - 1).cast("int"), F.lit(2)), 16, 10).cast("long"))

    def step(h: Column, b: Column) -> Column:
        low = (h % 256).cast("long")
        mixed = (h - low.cast("decimal(20,0)") + low.bitwiseXOR(b).cast("decimal(20,0)")).cast("decimal(20,0)")
        return ((mixed * prime) % two64).cast("decimal(20,0)")

    start = F.lit("14695981039346656037").cast("decimal(20,0)")
    return (F.aggregate(bytes_, start, step) % F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long")


def listing(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of a listing; the order must end in a unique key."""
    return rows.orderBy(*order).offset(offset).limit(limit)
