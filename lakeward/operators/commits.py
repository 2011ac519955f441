"""Commit history: workload classes, retention, run lengths and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Class, minutes between compactions, small-file and manifest triggers, time trigger (min), daily byte multiple, priority, expiry (h);
#: then the plan: mode, snapshots kept, hours kept, target MiB, stale hours, write buffer (s), minutes to the next run.
CLASSES = (
    ("streaming", 5, 50, 200, 15, -1.0, 10, 4, "hot", 5, 1.0, 64, 0.5, 60, 5),
    ("batch", 60, 200, 1000, 360, 5.0, 5, 24, "cold", 10, 24.0, 128, 6.0, 0, 60),
    ("slow_changing", 360, 500, 2000, 1440, 1.0, 1, 168, "cold", 20, 168.0, 256, 168.0, 0, 1440),
    ("dormant", 525600, 1073741824, 10000, 525600, 0.0, 0, 720, "cold", 50, 720.0, 512, 720.0, 0, 10080),
)
CLASS_COLUMNS = "class string, recompact_min int, small_trigger int, manifest_trigger int, time_trigger_min int, daily_multiple double, priority int, expire_h int, mode string, keep_last int, keep_h double, target_mib int, stale_h double, buffer_s int, next_min int"
DEFAULT_PLAN = ("cold", 10, 24.0, 128, 24.0, 0, 60)


def class_plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLASSES), CLASS_COLUMNS)


def commit_rates(commits: DataFrame, now: Column, keys: list[str]) -> DataFrame:
    """Foreign commits of the last 15 minutes, day and week, the last one, and how many own ones were left out."""
    foreign = ~F.col("own")
    since = lambda h: F.count_if(foreign & (F.col("ts") > now - F.expr(f"interval {h} minutes")))
    return commits.where(F.col("ts") <= now).groupBy(*keys).agg(since(15).alias("c15"), since(1440).alias("c24"), since(10080).alias("c7"), F.max(F.when(foreign, F.col("ts"))).alias("last_foreign"), F.count_if(F.col("own")).alias("excluded"))


def workload_class() -> Column:
    """Class from the counts c15, c24, c7."""
    return (
        F.when(F.col("c7") == 0, "dormant").when((F.col("c15") >= 2) & (F.col("c15") * 4.0 > 6.0), "streaming").when(F.col("c24") / 24.0 > 6.0, "streaming")
        .when(F.col("c24") / 24.0 > 0.04, "batch").otherwise("slow_changing")
    )


def expirable(snapshots: DataFrame, now: Column, keep_last: int, keep_hours: int) -> DataFrame:
    """Adds `expires`: beyond the newest `keep_last` of the table and older than `keep_hours`; the current one always stays."""
    newest = Window.partitionBy("tbl").orderBy(F.desc("ts"), F.desc("snapshot_id"))
    old = F.col("ts") < now - F.expr(f"interval {keep_hours} hours")
    return snapshots.withColumn("nth", F.row_number().over(newest)).withColumn("expires", (F.col("nth") > max(1, keep_last)) & old)


def repeated_runs(runs: DataFrame) -> DataFrame:
    """Adds `loop_count`: how often in a row a run took the same files."""
    order = Window.partitionBy("tbl").orderBy("ts", "run_id")
    changed = F.coalesce((F.lag("paths").over(order) != F.col("paths")).cast("int"), F.lit(1))
    group = F.sum(changed).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = runs.withColumn("island", group)
    return marked.withColumn("loop_count", F.row_number().over(Window.partitionBy("tbl", "island").orderBy("ts", "run_id"))).drop("island")


def failure_runs(runs: DataFrame) -> DataFrame:
    """Adds `failures`: consecutive failed runs up to this one."""
    order = Window.partitionBy("tbl").orderBy("ts", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    marked = runs.withColumn("island", F.sum(F.col("ok").cast("int")).over(order))
    within = Window.partitionBy("tbl", "island").orderBy("ts", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("failures", F.sum((~F.col("ok")).cast("int")).over(within)).drop("island")


def daily_budget(runs: DataFrame) -> DataFrame:
    """Bytes read and written per table in the current window, which restarts at the first run over 24 hours after its start.

    The restart depends on the data, so each table's ordered runs are folded.
    """
    item = F.struct(F.col("ts"), F.col("run_id"), (F.col("bytes_read") + F.col("bytes_written")).alias("b"))
    start = F.struct(F.lit(None).cast("timestamp_ntz").alias("since"), F.lit(0).cast("long").alias("used"))

    def step(acc: Column, x: Column) -> Column:
        fresh = acc.since.isNull() | (x.ts > acc.since + F.expr("interval 24 hours"))
        return F.struct(F.when(fresh, x.ts).otherwise(acc.since).alias("since"), (F.when(fresh, F.lit(0)).otherwise(acc.used) + x.b).alias("used"))

    folded = runs.groupBy("tbl").agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step).alias("w"))
    return folded.select("tbl", F.col("w.since").alias("window_start"), F.col("w.used").alias("bytes_used"))


def breaker_trips(runs: DataFrame, max_loops: int = 3, max_failures: int = 3, lifetime_ratio: float = 20.0, min_roi: float = 0.1) -> DataFrame:
    """Per run, which breakers trip: loops, metadata share, effectiveness, consecutive failures, lifetime rewriting, return."""
    life = Window.partitionBy("tbl").orderBy("ts", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    r = failure_runs(repeated_runs(runs)).withColumn("lifetime_bytes", F.sum("bytes_written").over(life))
    share, less = F.col("metadata_bytes") / F.col("data_bytes"), F.col("before_files") - F.col("after_files")
    level = F.when(share >= 0.5, "pause").when(share >= 0.10, "critical").when(share >= 0.05, "warn").otherwise("ok")
    return r.select(
        "tbl", "run_id", "loop_count", "failures", "lifetime_bytes", (F.col("loop_count") >= max_loops).alias("cb2"), F.when(F.col("data_bytes") > 0, level).otherwise("ok").alias("cb3"),
        ((F.col("before_files") > 0) & (F.col("after_files") >= F.col("before_files"))).alias("cb4"), (~F.col("ok") & (F.col("failures") >= max_failures)).alias("cb8"),
        (F.col("lifetime_bytes") / F.col("data_bytes") > lifetime_ratio).alias("cb9"), ((less > 0) & (F.col("bytes_read") > 0) & (less * 102400.0 / F.col("bytes_read") < min_roi)).alias("cb11"),
    )
