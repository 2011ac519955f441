"""What tasks leave behind: memory of workers, files of small tables."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakeward.llm import cluster, jaccardjoin


def test_tasks_give_back_what_they_freed():
    def run(batches):
        held = [bytes(50_000) for _ in range(4_000)]  # small enough for the heap, which the last one keeps from shrinking
        last = held[-1]
        del held
        yield last

    before = cluster.resident()
    kept = list(cluster.lean(run)(iter([])))
    assert len(kept) == 1 and cluster.resident() - before < 100 << 20


def test_memory_is_given_back_after_a_fault_as_well():
    def run(batches):
        held = [bytes(50_000) for _ in range(4_000)]
        del held[:-1]
        yield from batches
        raise ValueError(len(held))

    before = cluster.resident()
    with pytest.raises(ValueError):
        list(cluster.lean(run)(iter([])))
    assert cluster.resident() - before < 100 << 20


@pytest.fixture
def many_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_small_tables_of_components_are_few_files(spark, many_partitions, monkeypatch):
    ws = cluster.Workspace(spark, "few")
    monkeypatch.setattr(cluster.Workspace, "drop", lambda self, name: None)
    nodes = spark.range(300).select(F.col("id").alias("node"), F.col("id").alias("doc"))
    edges = spark.range(299).where("id % 10 < 9").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    labels = jaccardjoin.components(spark, nodes, edges, ws, "x", 300)
    assert sorted((r["node"], r["label"]["node"]) for r in labels.collect()) == [(n, n // 10 * 10) for n in range(300)]
    root = Path(ws.root.removeprefix("file:"))
    tables = [p for p in root.iterdir() if p.is_dir()]
    assert len(tables) > 3 and all(len(list(t.glob("*.parquet"))) == 1 for t in tables)
    assert all(os.path.getsize(f) for t in tables for f in t.glob("*.parquet"))
