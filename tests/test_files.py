"""How many files operations leave, how tasks share the writing of one, and the joining of Parquet files."""

import pytest
from pyspark.sql import functions as F

from lakeward.plans import maintain as mt
from lakeward.plans import physical
from lakeward.sources import footers, stitch
from lakeward.sources.tables import Warehouse

T = ("db", "facts")


@pytest.fixture
def wh(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "wh"))


def fill(wh, parts=("flag",), commits=3):
    rows = wh.spark.range(0, 3000, 1, 4).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("flag"))
    wh.create(T, rows.schema, list(parts), [("id", False)])
    for c in range(commits):
        wh.append(T, rows.where(F.col("id") % 4 == c), sort_files=1)
    return wh.load(T)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def live(wh):
    return [r.asDict() for r in wh.load(T).entries().collect()]


@pytest.mark.parametrize("parts", [("flag",), ()])
def test_a_partition_above_the_target_becomes_one_sorted_file(wh, parts):
    t = fill(wh, parts)
    before, target = rows_of(t.scan()), max(e["file_bytes"] for e in live(wh)) + 1
    assert mt.compact_table(wh, T, target=target, dry_run=True).after_files == (3 if parts else 1)
    done = mt.compact_table(wh, T, target=target)
    assert done.after_files == len(live(wh)) == (3 if parts else 1) and rows_of(wh.load(T).scan()) == before
    for e in live(wh):
        ids = [r["id"] for r in wh.spark.read.parquet(e["path"]).collect()]
        assert ids == sorted(ids, reverse=True) and len(ids) == e["record_count"] and int(e["lower"]["id"]) == ids[-1]


def test_hot_and_single_partitions_become_one_file(wh):
    fill(wh)
    target = max(e["file_bytes"] for e in live(wh)) + 1
    mt.compact(wh, T, {"flag": "1"}, target=target)
    assert sorted(sum(e["part"] == p for e in live(wh)) for p in ("flag=1", "flag=2", "flag=null")) == [1, 3, 3]
    mt.compact_hot(wh, T, small=target - 1, hot_window=3, rotation=0, target=target)
    assert len(live(wh)) == 3


def test_deletes_of_many_tasks_are_one_file_and_a_rewrite_leaves_one_a_partition(wh):
    t = fill(wh)
    rows, before = t.read_files([e["path"] for e in live(wh)]), rows_of(t.scan().where("id % 97 <> 0"))
    wh.delete_rows(T, rows.repartition(4).where("id % 97 = 0").select(F.col("__path").alias("file_path"), F.col("__pos").alias("pos")))
    gone = [e for e in live(wh) if e["content"] == 1]
    assert [e["record_count"] for e in gone] == [24] and rows_of(wh.load(T).scan()) == before
    mt.rewrite(wh, T, lambda table, data: data, "rewrite_deletes", target=max(e["file_bytes"] for e in live(wh)))
    assert len(live(wh)) == 3 and rows_of(wh.load(T).scan()) == before


def test_an_append_of_one_file_is_written_by_all_tasks(wh):
    rows = wh.spark.range(0, 400, 1, 4).select("id", F.spark_partition_id().alias("task"), (F.col("id") % 2).alias("flag"))
    wh.create(T, rows.schema, ["flag"])
    wh.append(T, rows, sort_files=1)
    assert len(live(wh)) == 2 and wh.load(T).scan().select("task").distinct().count() == 4


def test_entries_are_hashed_not_sorted(wh):
    t = fill(wh)
    out = wh.entries_of(t, [e["path"] for e in live(wh)], 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan
    assert {(e["path"], e["record_count"], e["lower"]["s"], e["upper"]["s"]) for e in live(wh)} == {(r["path"], r["record_count"], r["lower"]["s"], r["upper"]["s"]) for r in out.collect()}


def test_an_import_is_written_by_all_tasks(spark, tmp_path, monkeypatch):
    (spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").repartition(3).write.parquet(str(tmp_path / "lineitem.parquet")))
    seen, joined = [], Warehouse.joined
    monkeypatch.setattr(Warehouse, "joined", lambda self, paths, files=1: seen.append(len(paths)) or joined(self, paths, files))
    got = physical.phys_import(spark, str(tmp_path)).collect()
    assert seen[0] > 3 and {(r["l_returnflag"], r["files"]) for r in got} == {("A", 1), ("N", 1), ("R", 1)}


def test_joined_files_hold_all_rows_and_positions(wh):
    rows = wh.spark.range(0, 5000, 1, 5).select("id", F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("s"), F.array("id").alias("a"), (F.col("id") % 2 == 0).alias("b"))
    rows.write.option("parquet.block.size", 4096).option("parquet.bloom.filter.enabled#id", "true").parquet(wh.store.at("x"))
    pieces = [p for p, _, _ in wh.store.walk("x") if p.endswith(".parquet")]
    groups = footers.read_footers(wh.spark, pieces).agg(F.sum("row_groups")).first()[0]
    one = wh.joined(pieces)
    assert len(one) == 1 and len([p for p, _, _ in wh.store.walk("x") if p.endswith(".parquet")]) == 1
    assert footers.read_footers(wh.spark, one).first().asDict() | {"signature": 0} == {"path": one[0], "rows": 5000, "row_groups": groups, "schema_id": None, "signature": 0}
    back = wh.spark.read.parquet(*one)
    assert rows_of(back) == rows_of(rows) and back.where("id = 4321").count() == 1
    assert back.where("id <> _metadata.row_index").count() == 0
    other = wh.write_data(wh.create(T, rows.select("id").schema), rows.select("id").coalesce(1))
    with pytest.raises(ValueError, match="another schema"):
        stitch.stitch_one(wh.store.at("y.parquet"), [*one, *other])
