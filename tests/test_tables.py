"""Physical tables: commits, deletes, compaction, expiry, manifests, streaming."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from lakeward.plans import maintain as mt
from lakeward.plans.state import Breakers, Jobs, LeaseHeld, Leases, Paused, Registry
from lakeward.sources import footers, generate, service
from lakeward.sources.store import Conflict, Store
from lakeward.sources.tables import NoSuchTable, TableExists, Warehouse, parse_version
from lakeward.streaming import ingest as st

T = ("db", "facts")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def wh(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "wh"))


def fill(wh, commits=4, partition=("region",), rows=12):
    schema = wh.spark.createDataFrame([], "id long, value double, region string, d date").schema
    wh.create(T, schema, list(partition), [("id", True)])
    for c in range(commits):
        df = wh.spark.range(rows).select((F.lit(c * 1000) + F.col("id")).alias("id"), (F.col("id") / 2).alias("value"), F.when(F.col("id") % 5 != 4, F.concat(F.lit("r"), (F.col("id") % 2).cast("string"))).alias("region"), F.lit("2024-01-01").cast("date").alias("d"))
        wh.append(T, df.coalesce(1), at_ms=1_700_000_000_000 + c * 60_000)
    return wh.load(T)


def test_create_load_discover(wh):
    with pytest.raises(NoSuchTable):
        wh.load(T)
    fill(wh, 1)
    with pytest.raises(TableExists):
        wh.create(T, wh.load(T).schema)
    assert [(p, v) for p, _, v in wh.discover()] == [("db.db/facts", 2)] and wh.tables("db") == [T]
    assert [parse_version(n) for n in ("v12.metadata.json", "7-ab.metadata.json", "3.metadata.json", "x.metadata.json", "v1.json")] == [12, 7, 3, None, None]
    with pytest.raises(NotImplementedError):
        wh.drop_table(T)
    with pytest.raises(ValueError):
        Store(wh.spark, "gs://x/y")


def test_one_writer_wins(wh):
    won, lost = [], []

    def race(i):
        try:
            wh.store.create("race/v1.metadata.json", {"i": i})
            won.append(i)
        except Conflict:
            lost.append(i)

    threads = [threading.Thread(target=race, args=(i,)) for i in range(32)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 31 and wh.store.read("race/v1.metadata.json") == {"i": won[0]}


def test_compact_keeps_rows(wh):
    before = rows_of(fill(wh).scan())
    files = wh.load(T).entries().count()
    tree = wh.store.walk("")
    plan = mt.compact_table(wh, T, dry_run=True)
    assert wh.store.walk("") == tree and plan.before_files == files and plan.after_files == 3
    done = mt.compact_table(wh, T)
    assert (done.after_files, done.before_rows, done.after_rows) == (3, 48, 48)
    t = wh.load(T)
    assert rows_of(t.scan()) == before and t.entries().count() == 3
    assert mt.compact_table(wh, T).skipped and wh.load(T).version == t.version
    f = footers.read_footers(wh.spark, [r["path"] for r in t.entries().collect()])
    assert {r["row_groups"] for r in f.collect()} == {1} and not footers.mixed_schemas(f)
    for r in t.entries().collect():  # each file sorted
        ids = [x["id"] for x in wh.spark.read.parquet(r["path"]).collect()]
        assert ids == sorted(ids)
    assert rows_of(t.scan(t.meta["snapshots"][0]["id"])) == [r for r in before if r[0] < 1000]


def test_deletes_apply_and_go(wh):
    t = fill(wh)
    rows = t.read_files([r["path"] for r in t.entries().collect()])
    wh.delete_rows(T, rows.where("id % 1000 = 3").select(F.col("__path").alias("file_path"), F.col("__pos").alias("pos")))
    wh.delete_rows(T, wh.spark.createDataFrame([(0.5, None), (1.0, "r0"), (float("nan"), "r1")], "value double, region string"), ["value", "region"])
    wh.append(T, wh.spark.createDataFrame([(9000, 1.0, "r0", None)], t.schema))
    want = rows_of(t.scan().where("id % 1000 <> 3 and not (value <=> 1.0 and region <=> 'r0')").unionByName(wh.spark.createDataFrame([(9000, 1.0, "r0", None)], t.schema)))
    assert rows_of(wh.load(T).scan()) == want
    done = mt.compact_table(wh, T)
    assert done.deleted_rows == 8 and rows_of(wh.load(T).scan()) == want
    assert not wh.load(T).entries().where("content <> 0").count()


def test_hot_cold_and_partition(wh):
    fill(wh, 6)
    one = mt.compact(wh, T, {"region": "r0"})
    assert one.notes["partitions"] == ["region=r0"]
    with pytest.raises(ValueError):
        mt.compact(wh, T, {"value": "1"})
    hot = mt.compact_hot(wh, T, hot_window=2, rotation=0)
    assert hot.after_files <= hot.before_files
    wh.append(T, wh.load(T).scan().limit(5))
    cold = mt.compact_cold(wh, T, small_trigger=1, hot_window=None)
    assert cold.skipped is None and wh.load(T).scan().count() == 77


def test_expire_manifests_orphans(wh):
    fill(wh, 7)
    before = rows_of(wh.load(T).scan())
    now = 1_700_000_000_000 + 8 * 60_000
    assert mt.expire(wh, T, 3, 0, now, dry_run=True).notes == {"removed": 4, "remaining": 3}
    assert mt.expire(wh, T, 3, 24, now).skipped and mt.expire(wh, T, 3, 0, now).notes["remaining"] == 3
    m = mt.rewrite_manifests(wh, T)
    assert (m.notes["before"], m.notes["after"]) == (7, 3) and rows_of(wh.load(T).scan()) == before
    mt.compact_table(wh, T)
    mt.expire(wh, T, 1, 0, now * 2)
    gone = mt.remove_orphans(wh, T, 0, now_ms=now * 2)
    assert len(gone) == 21 and rows_of(wh.load(T).scan()) == before


def test_maintain_and_breakers(wh):
    fill(wh, 5)
    out = mt.maintain(wh, T, mode="full", now_ms=1_700_000_000_000 + 10**6)
    assert out["class"] == "streaming" and out["error"] is None and [s.operation for s in out["steps"]][2] == "compact"
    with pytest.raises(ValueError):
        mt.maintain(wh, T, mode="sideways")
    b, u = Breakers(wh.store), wh.load(T).meta["uuid"]
    with pytest.raises(ValueError):
        b.pause(u, " ")
    b.pause(u, "by hand")
    with pytest.raises(Paused):
        mt.maintain(wh, T)
    b.resume(u)
    b.record(u, False, 1)
    b.record(u, False, 2)
    with pytest.raises(Paused):
        b.record(u, False, 3)
    b.resume(u)
    same = {"before_files": 5, "after_files": 5, "notes": {"paths": ["a"], "bytes_read": 10}}
    assert b.record(u, True, 4, same) == ["compaction did not reduce files"]
    b.record(u, True, 5, same)
    with pytest.raises(Paused):
        b.record(u, True, 6, same)


def test_expiry_spares_files_of_other_writers(wh):
    t = fill(wh, 4)
    staged = wh.write_data(t, t.scan().limit(3).coalesce(1))  # written, not yet committed
    mt.compact_table(wh, T)
    mt.expire(wh, T, 1, 0, 1_800_000_000_000 * 2, delete_files=True)
    assert wh.load(T).scan().count() == 48 and all(wh.store.fs.exists(wh.store._path(p)) for p in staged)
    wh.add_files(T, staged)
    assert wh.load(T).scan().count() == 51
    left = [p for p, _, _ in wh.store.walk(f"{t.key}/data") if p.endswith(".parquet")]
    assert len(left) == 3 + len(staged)  # what only old snapshots had is gone


def test_replayed_batches_after_expiry(wh):
    t = fill(wh, 1)
    rows = t.scan().limit(3)
    for b in (0, 1, 2):
        wh.append(T, rows, {"query_id": "q", "batch_id": str(b)})
    mt.expire(wh, T, 1, 0, 1_800_000_000_000 * 2)
    n = wh.load(T).scan().count()
    for b in (0, 1, 2):
        wh.append(T, rows, {"query_id": "q", "batch_id": str(b)})
    assert wh.load(T).scan().count() == n
    files = [p for p, _, _ in wh.store.walk(f"{t.key}/data") if p.endswith(".parquet")]
    paths = wh.write_data(wh.load(T), rows)  # two writers of one batch: the second one's files go
    wh.add_files(T, paths, {"query_id": "q", "batch_id": "2"})
    assert [p for p, _, _ in wh.store.walk(f"{t.key}/data") if p.endswith(".parquet")] == files and wh.load(T).scan().count() == n
    wh.append(T, rows, {"query_id": "q", "batch_id": "3"})
    wh.append(T, rows, {"query_id": "other", "batch_id": "0"})
    assert wh.load(T).scan().count() == n + 6


def test_log_is_bounded(wh):
    t = fill(wh, 1)
    for day in range(12):
        wh.append(T, t.scan().limit(1), at_ms=1_700_000_000_000 + day * 86_400_000)
    assert len(wh.load(T).meta["commit_log"]) == 9


def test_service_only_reads(wh):
    df = wh.spark.range(3)
    df.write.mode("overwrite").saveAsTable("victim")
    try:
        for sql in ("with t as (select 1L as id) insert overwrite table victim select * from t", "insert into victim values (9)", "select * from (select java_method('java.lang.System', 'lineSeparator'))", "create table x as select 1", "set a = b", "explain insert into victim values (1); drop table victim", "from victim insert into victim select id", "refresh table victim", "select"):
            with pytest.raises(PermissionError):
                service.run_query(wh.spark, sql, {})
        assert sorted(r[0] for r in service.run_query(wh.spark, "-- insert into\n(with a as (select * from victim) select id from a union all select id from victim where id in (select max(id) from a));", {})["rows"]) == [0, 1, 2, 2]
        assert service.run_query(wh.spark, "show tables", {})["row_count"] >= 1 and service.run_query(wh.spark, "describe victim", {})["row_count"] == 1
        assert service.run_query(wh.spark, "select 'drop table victim; insert into t' as s", {})["rows"] == [["drop table victim; insert into t"]]
    finally:
        wh.spark.sql("drop table victim")


def test_manifests_stay_unless_touched(wh):
    t = fill(wh, 4)
    mt.rewrite_manifests(wh, T)
    before = {m["path"] for m in wh.load(T).manifests()}
    mt.compact(wh, T, {"region": "r0"})
    after = {m["path"] for m in wh.load(T).manifests()}
    assert len(before) == 3 and len(before & after) == 2 and len(after) == 3
    assert wh.load(T).scan().count() == t.scan().count()


def test_typed_bounds_prune_manifests(wh):
    schema = wh.spark.createDataFrame([], "id long, k int, d date").schema
    wh.create(T, schema, ["k", "d"])
    for k in (2, 9, 10, 100):
        wh.append(T, wh.spark.createDataFrame([(1, k, None), (2, k, None)], "id long, k int, d string").selectExpr("id", "k", f"date'2024-01-0{1 + k % 9}' as d").coalesce(1))
    t = wh.load(T)
    assert [m["bounds"]["k"] for m in t.manifests()] == [["2", "2"], ["9", "9"], ["10", "10"], ["100", "100"]]
    kept = [m for m in t.manifests() if t.may_hold({"k": 10})(m)]
    assert len(kept) == 1 and mt.partition_entries(t, {"k": "10"}).count() == 1


def test_guards(wh):
    t = fill(wh, 2)
    u = t.meta["uuid"]
    Breakers(wh.store).pause(u, "by hand")
    with pytest.raises(Paused):
        mt.compact_table(wh, T)
    assert mt.compact_table(wh, T, dry_run=True).after_files == 3
    assert mt.compact(wh, T, where="part = 'region=r1'", force=True).notes["partitions"] == ["region=r1"]
    Breakers(wh.store).resume(u)
    entries = t.entries()
    with pytest.raises(mt.Unsupported):
        mt.guard(t, entries.unionByName(entries.limit(1).withColumn("spec_id", F.lit(1))))
    with pytest.raises(mt.Unsupported):
        mt.guard(t, entries.unionByName(entries.limit(1).withColumns({"content": F.lit(1), "path": F.lit("x.puffin")})))
    wide = t.scan().withColumn("more", F.lit(1)).withColumn("__p_region", F.col("region")).coalesce(1)
    folder = f"{t.key}/data/foreign"
    wide.write.partitionBy("__p_region").parquet(wh.store.at(folder))
    wh.add_files(T, [p for p, _, _ in wh.store.walk(folder) if p.endswith(".parquet")])
    wh.add_files(T, wh.write_data(t, t.scan().where("region is null").coalesce(1)))
    assert mt.rewrite(wh, T, lambda table, data: data, "all").skipped == "files of several schemas"


def test_row_groups_follow_the_table(wh):
    schema = wh.spark.createDataFrame([], "id long, s string").schema
    wh.create(T, schema, properties={"write.parquet.row-group-size-bytes": str(1 << 17)})
    rows = wh.spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s"))
    for _ in range(2):
        wh.append(T, rows.coalesce(1))
    assert footers.read_footers(wh.spark, [r["path"] for r in wh.load(T).entries().collect()]).agg(F.min("row_groups")).first()[0] > 4
    mt.compact_table(wh, T, row_group_bytes=64 << 20)
    assert [r["row_groups"] for r in footers.read_footers(wh.spark, [r["path"] for r in wh.load(T).entries().collect()]).collect()] == [1]


def test_breakers_see_metadata_and_bytes_written(wh):
    fill(wh, 3)
    u = wh.load(T).meta["uuid"]
    with pytest.raises(Paused, match="metadata"):  # tiny files: their metadata outweighs them
        mt.maintain(wh, T, mode="full", now_ms=1_700_000_000_000 + 10**6, breakers=Breakers(wh.store, ratio_pause=0.01, ratio_from=0))
    assert Breakers(wh.store).status(u)["day_bytes"] > 0


def test_leases_jobs_registry(wh):
    leases = Leases(wh.store)
    held = leases.acquire("x", "a", 1000, now_ms=1)
    with pytest.raises(LeaseHeld):
        leases.acquire("x", "b", now_ms=2)
    taken = leases.acquire("x", "c", now_ms=10**6)
    assert not leases.release(held) and leases.release(taken) and not leases.release(taken)
    jobs, gate = Jobs(wh.store), threading.Event()
    job, new = jobs.submit("compact", "t", gate.wait)
    assert new and jobs.submit("compact", "t", gate.wait) == (job, False)
    gate.set()
    assert jobs.wait(job)["status"] == "completed"
    bad, _ = jobs.submit("expire", "t", lambda: 1 / 0)
    assert jobs.wait(bad)["status"] == "failed" and "ZeroDivisionError" in jobs.wait(bad)["error"]
    reg = Registry(wh.store)
    reg.save("t1", "batch", 0, 60)
    reg.save("t2", "streaming", 0, 5)
    assert [r["tbl"] for r in reg.due(300_000).collect()] == ["t2"]


def test_import_in_place(wh, tmp_path):
    src = tmp_path / "in"
    wh.spark.range(20).select("id", (F.col("id") % 3).alias("k"), (F.col("id") % 3).alias("p")).write.partitionBy("p").parquet(str(src))
    t = wh.import_folder(("db", "imported"), str(src))
    assert t.scan().count() == 20 and t.meta["partition"] == []
    got = service.run_query(wh.spark, "select count(*) as n from imported", {"imported": t.scan()})
    assert got["rows"] == [[20]]
    for sql in ("drop table x", "", "insert into x values (1)", "with a as (select 1) delete from x"):
        with pytest.raises(PermissionError):
            service.run_query(wh.spark, sql, {})
    assert service.sql_columns(t.schema) == [("id", "bigint"), ("k", "bigint")]
    assert wh.spark.sql(f"select * from {service.register(t)}").count() == 20


def test_stream_ingest_once(wh, tmp_path):
    schema = wh.spark.createDataFrame([], st.EVENTS).schema
    wh.create(("db", "events"), schema)
    src, cp = tmp_path / "src", str(tmp_path / "cp")
    src.mkdir()
    for f in range(2):
        (src / f"{f}.json").write_text("\n".join(json.dumps({"event_id": f"{f}-{i}", "event_type": "view", "user_id": "u", "payload": "p", "event_time": "2024-01-01T00:00:00Z"}) for i in range(5)) + "\nnot json\n")
    for _ in range(2):
        st.ingest(st.json_events(wh.spark, str(src)), wh, ("db", "events"), cp, "q").awaitTermination(120)
    t = wh.load(("db", "events"))
    assert t.scan().count() == 10
    again = wh.append(("db", "events"), t.scan(), {"query_id": "q", "batch_id": "0"})
    assert again.version == t.version


def test_stream_windows_and_heat(wh, tmp_path):
    src = str(tmp_path / "acc")
    wh.spark.range(20).selectExpr("id % 2 as tbl", "timestamp_seconds(1700000000 + id * 600) as ts", "id % 5 = 0 as own", "cast(id as double) as latency", "cast(1700000000 + id * 600 as double) as seconds").coalesce(1).write.parquet(src)
    stream = wh.spark.readStream.schema(wh.spark.read.parquet(src).schema).parquet(src)
    for name, df, mode in (("rates", st.commit_rates(stream, "1 hour", None), "complete"), ("sessions", st.access_sessions(stream), "complete"), ("heat", st.streaming_heat(stream.select("tbl", "seconds", "latency")), "update")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    assert wh.spark.table("rates").agg(F.sum("commits")).first()[0] == 16
    assert wh.spark.table("sessions").agg(F.sum("accesses")).first()[0] == 20
    heat = {r["tbl"]: r for r in wh.spark.table("heat").collect()}
    assert abs(heat[0]["decayed"] - sum(0.5 ** (i * 1200 / 21600) for i in range(10))) < 1e-9 and heat[1]["seconds"] == 1700000000 + 19 * 600


def test_generators(wh):
    item = generate.dimension(wh.spark, "item")
    assert item.count() == 5000 and rows_of(item.limit(3)) == rows_of(generate.dimension(wh.spark, "item").limit(3))
    b = generate.fact_batch(wh.spark, "store_sales", 50, 3)
    wh.create(("tpc", "store_sales"), b.schema, ["ss_store_sk"])
    assert list(generate.stream_batches(wh.spark, wh, {"store_sales": ("tpc", "store_sales")}, 3, {"store_sales": 20})) == ["store_sales"]
    assert wh.load(("tpc", "store_sales")).scan().count() == 20
    assert max(generate.burst_waits(50, 40)) <= 30
