"""Every registered query against its oracle on the smallest test tables, and operators on cases the tables lack."""

import math
import os

import pytest
from pyspark.sql import functions as F

from lakeward.operators import commits, decisions, deletes, files, verify
from lakeward.plans import catalog
from lakeward.sources import literals

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    text = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted([text(v) for v in r] for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    duck.execute(f"select {', '.join(cols)} from ({catalog.ORACLES[name]}) q")
    assert plain(got.select(*cols).collect()) == plain(duck.fetchall())


def test_equality_deletes_null_nan_and_sequence(spark):
    rows = spark.createDataFrame([(1, None, 1.0), (1, "a", float("nan")), (5, None, 1.0), (1, "b", None)], "seq int, k string, v double")
    gone = lambda d, keys: sorted(map(tuple, deletes.apply_equality_deletes(rows, spark.createDataFrame(d, "k string, v double, delete_seq int"), keys).select("seq", "k").collect()), key=str)
    assert gone([(None, 1.0, 5)], ["k"]) == [(1, "a"), (1, "b"), (5, None)]
    assert gone([("a", float("nan"), 9)], ["v"]) == [(1, "a"), (1, "b"), (1, None), (5, None)]
    assert gone([("b", None, 9)], ["k", "v"]) == [(1, "a"), (1, None), (5, None)]
    assert deletes.apply_equality_deletes(rows, spark.createDataFrame([(1, 9)], "z int, delete_seq int"), ["z"]) is rows


def test_position_delete_upkeep(spark):
    d = spark.createDataFrame([("a", 1), ("a", 1), ("gone", 2)], "file_path string, pos long")
    assert deletes.rewrite_position_deletes(d, spark.createDataFrame([("a",)], "path string")).collect() == [("a", 1)]


def test_classes_at_the_boundaries(spark):
    cases = [((0, 0, 0), "dormant"), ((0, 0, 1), "slow_changing"), ((0, 1, 1), "batch"), ((1, 144, 200), "batch"), ((1, 145, 200), "streaming"), ((2, 2, 2), "streaming")]
    df = spark.createDataFrame([c for c, _ in cases], "c15 int, c24 int, c7 int").withColumn("k", commits.workload_class())
    assert [r["k"] for r in df.collect()] == [k for _, k in cases]


def test_keys_bounds_and_sizes(spark):
    df = spark.createDataFrame([({"b": "2", "a": None},), ({},)], "m map<string,string>")
    assert [r[0] for r in df.select(files.partition_key(F.col("m"))).collect()] == ["a=null/b=2", "(unpartitioned)"]
    b = spark.createDataFrame([(None, 3), (1, 3), (5, 9)], "lo int, hi int").select(files.within_bounds(F.col("lo"), F.col("hi"), F.lit(2)).alias("x"))
    assert [r["x"] for r in b.collect()] == [True, True, False]
    s = spark.createDataFrame([(1_048_575,), (1_048_576,), (268_435_456,)], "s long").select(files.size_class(F.col("s")).alias("x"))
    assert [r["x"] for r in s.collect()] == ["< 1 MB", "1-10 MB", "> 256 MB"]


def test_verification_finds_what_is_wrong(spark):
    before = spark.createDataFrame([("a", 10), ("b", 5)], "path string, record_count long")
    assert not verify.verify_compaction(before, spark.createDataFrame([("c", 14)], "path string, record_count long")).first()["i1_rows"]
    assert verify.verify_compaction(before, spark.createDataFrame([("c", 14)], "path string, record_count long"), 1).first()["i1_rows"]
    twice = before.unionByName(before.where("path = 'a'"))
    assert verify.file_set_difference(before, twice).collect() == [("a", "extra", 1)]


def test_triggers_modes_and_window(spark):
    s = spark.createDataFrame([(60, 0, None, 0)], "commits_since int, small_files int, last_compaction timestamp_ntz, uncompacted_bytes long")
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    fire = lambda mode, **p: decisions.triggers(s, now, p, mode).first()["fired"]
    assert fire("any") and not fire("all")
    assert not fire("any", commit_trigger=0, file_trigger=0, time_trigger_minutes=0, size_trigger_bytes=0)
    m = spark.createDataFrame([(60,), (200,), (1380,)], "m int").select(decisions.in_window(F.col("m"), 1320, 120).alias("x"))
    assert [r["x"] for r in m.collect()] == [True, False, True]


@pytest.mark.parametrize(("raw", "kind", "value"), [("yes", "boolean", True), (" False\n", "boolean", False), ("-7", "integer", -7), ("aGk=", "binary", b"hi"), ("aGk=", "fixed(2)", b"hi"), ("01:02:03.5", "time", 3723500000), ("1970-01-01T00:00:01.000000002Z", "timestamp_ns", 1_000_000_002), ("2024-01-01T02:00:00+02:00", "timestamp", __import__("datetime").datetime(2024, 1, 1))])
def test_literals(raw, kind, value):
    assert literals.parse_literal(raw, kind) == value


@pytest.mark.parametrize(("raw", "kind"), [("maybe", "boolean"), ("2147483648", "integer"), ("aGk=", "fixed(3)"), ("x", "uuid"), ("1.5", "decimal(3,1)"), ("a", "array")])
def test_bad_literals(raw, kind):
    with pytest.raises(ValueError):
        literals.parse_literal(raw, kind)


def test_texts():
    assert literals.parse_size("64MB") == 64 << 20 and literals.human_size(64 << 20) == "64.0 MiB"
    assert literals.parse_partition("a=1,b=x=y") == {"a": "1", "b": "x=y"} and literals.parse_switch("On") and not literals.parse_switch("2")
    for bad in ("0", "-1MB", "5XB", ""):
        with pytest.raises(ValueError):
            literals.parse_size(bad)
