"""Metadata relations derived from the test tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"

#: Data files over lineitem: partition, commit, rows and bytes; later partitions stop receiving commits earlier.
VF = """vf as (select l_suppkey % 10 as part, l_orderkey % 40 as commit_no, count(*) as record_count, 4096 + 64 * count(*) as file_bytes,
 (l_orderkey % 40) + 1 as seq, 'data/part=' || cast(l_suppkey % 10 as varchar) || '/' || lpad(cast(l_orderkey % 40 as varchar), 3, '0') || '.parquet' as path
 from lineitem where l_orderkey % 40 < 40 - 3 * (l_suppkey % 10) group by l_suppkey % 10, l_orderkey % 40)"""
#: Runs of a compactor over events: table, order, success and effects.
RUNS = """runs as (select user_id % 20 as tbl, ts, event_id as run_id, event_type <> 'error' as ok, 10 + event_id % 50 as before_files, 10 + event_id % 50 - event_id % 7 + 1 as after_files,
 cast(1000000 + 7919 * (event_id % 1000) as bigint) as bytes_read, cast(900000 + 104729 * (event_id % 100) as bigint) as bytes_written,
 cast(50000000 as bigint) as data_bytes, cast(100000 * (event_id % 300) as bigint) as metadata_bytes, 'f' || cast(event_id % 3 as varchar) as paths from events)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def data_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, commit = F.col("l_suppkey") % 10, F.col("l_orderkey") % 40
    files = read(spark, sf_dir, "lineitem").where(commit < 40 - 3 * part).groupBy(part.alias("part"), commit.alias("commit_no")).agg(F.count("*").alias("record_count"))
    path = F.concat(F.lit("data/part="), F.col("part").cast("string"), F.lit("/"), F.lpad(F.col("commit_no").cast("string"), 3, "0"), F.lit(".parquet"))
    return files.withColumns({"file_bytes": 4096 + 64 * F.col("record_count"), "seq": F.col("commit_no") + 1, "path": path})


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snapshot_id, tbl, ts, own: every event is a commit, errors are the engine's own."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("snapshot_id"), F.col("user_id").alias("tbl"), "ts", (F.col("event_type") == "error").alias("own"))


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("tbl"), "event_id", "ts", F.col("value").alias("latency"), F.col("event_type").alias("client"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("tbl"), "ts", e.alias("run_id"), (F.col("event_type") != "error").alias("ok"), (10 + e % 50).alias("before_files"),
        (10 + e % 50 - e % 7 + 1).alias("after_files"), (1000000 + 7919 * (e % 1000)).alias("bytes_read"), (900000 + 104729 * (e % 100)).alias("bytes_written"),
        F.lit(50000000).cast("long").alias("data_bytes"), (100000 * (e % 300)).alias("metadata_bytes"), F.concat(F.lit("f"), (e % 3).cast("string")).alias("paths"),
    )
