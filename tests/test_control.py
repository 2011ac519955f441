"""Layouts, cycles over tables, the command line and reports."""

import json

import pytest
from pyspark.sql import functions as F

from lakeward.__main__ import main
from lakeward.functions.layout import interleave
from lakeward.plans import control
from lakeward.plans import maintain as mt
from lakeward.plans.state import Slots
from lakeward.sources.store import Conflict
from lakeward.sources.tables import Warehouse

T = ("db", "points")


@pytest.fixture
def wh(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "wh"))
    rows = spark.range(400).select("id", (F.col("id") % 20).alias("x"), F.floor(F.col("id") / 20).alias("y"))
    w.create(T, rows.schema)
    for c in range(3):
        w.append(T, rows.where(F.col("id") % 3 == c).coalesce(1), at_ms=1_700_000_000_000 + c)
    return w


def test_z_order(wh, spark):
    z = spark.createDataFrame([(1 << 15, 0), (0, 1 << 15), (1 << 15, 1 << 15)], "a long, b long").select(interleave([F.col("a"), F.col("b")]).alias("z"))
    assert [r["z"] for r in z.collect()] == [2 << 30, 1 << 30, 3 << 30]
    size = wh.load(T).entries().agg(F.sum("file_bytes")).first()[0]
    done = mt.compact(wh, T, target=size // 4 + 1, skip_large=False, zorder=["x", "y"])
    assert done.after_rows == 400 and wh.load(T).scan().count() == 400
    boxes = wh.load(T).entries().select((F.col("upper")["x"].cast("int") - F.col("lower")["x"].cast("int")).alias("w"), (F.col("upper")["y"].cast("int") - F.col("lower")["y"].cast("int")).alias("h")).collect()
    assert len(boxes) > 1 and sum(b["w"] * b["h"] for b in boxes) < len(boxes) * 19 * 19 * 0.8


def test_z_order_of_strings(spark):
    from lakeward.functions.layout import z_key

    rows = spark.range(400).select(F.concat(F.lit("k"), F.lpad((F.col("id") % 20).cast("string"), 3, "0")).alias("s"), F.floor(F.col("id") / 20).alias("y")).unionByName(spark.createDataFrame([(None, 3)], "s string, y long"))
    z = rows.withColumn("z", z_key(rows, ["s", "y"])).orderBy("z").collect()
    boxes = [z[i : i + 100] for i in range(0, 400, 100)]
    wide = lambda b: len({r["s"] for r in b})
    assert all(wide(b) <= 12 and len({r["y"] for r in b}) <= 12 for b in boxes)
    assert len({r["z"] for r in z}) > 100


def test_cycle_controller_and_reports(wh):
    m = control.Metrics()
    assert control.trigger_report(wh.load(T), 1_700_000_000_000).first()["by_time"]
    out = control.cycle(wh, metrics=m, mode="full", now_ms=1_700_000_060_000)
    assert out["db.points"]["error"] is None and 'lakeward_runs{table="db.points"} 1' in m.text() and 'files_removed{table="db.points"} 2' in m.text()
    c = control.Controller(wh, mode="full")
    assert c.poll(1_700_000_060_001) == [] and c.poll(1_800_000_000_000) == ["db.points"]
    assert control.suggest_layout(wh.load(T))[0]["suggestion"] == "add_sort_order"
    assert control.table_report(wh.load(T)).first()["files"] == 1
    assert control.estimate(1 << 30)["output_files"] == 8
    with Slots(1).slot() as free:
        assert free


def test_retries():
    tries = []

    def run():
        tries.append(1)
        if len(tries) < 3:
            raise Conflict("x")
        return "done"

    assert control.with_retries(run, wait=0) == ("done", ["Conflict: x", "Conflict: x"])
    with pytest.raises(Conflict):
        control.with_retries(lambda: (_ for _ in ()).throw(Conflict("y")), wait=0)


def test_command_line(wh, spark, capsys, tmp_path):
    root = wh.store.root
    say = lambda *a: (main([root, *a], spark), json.loads(capsys.readouterr().out.strip().splitlines()[-1]))[1]
    assert say("discover")[0][0] == "db.db/points"
    assert say("compact", "db.points", "--dry-run")["after_files"] == 1 and say("compact", "db.points")["after_files"] == 1
    assert say("status", "db.points")["paused"] is None
    say("pause", "db.points", "--reason", "test")
    assert say("status", "db.points")["paused"]["reason"] == "test"
    say("resume", "db.points")
    assert say("expire", "db.points", "--keep-last", "1", "--keep-hours", "0")["notes"]["removed"] == 3
    with pytest.raises(SystemExit):
        main([root, "compact"], spark)
    (tmp_path / "r.csv").write_text("a,b\n1,x\n")
    assert control.read_results(spark, str(tmp_path / "r.csv")).dtypes == [("a", "int"), ("b", "string")]
