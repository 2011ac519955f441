"""Queries over what physical operations leave behind: each builds a table from lineitem, runs one, and reads the result."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.files import DATA
from ..sources.tables import Table, Warehouse
from . import maintain
from .fixtures import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
IDENT = ("check", "facts")
COMMITS = 4
START_MS = 1_700_000_000_000
COLUMNS = ("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice", "l_shipdate")
SUMS = "count(*) as n, round(sum(l_quantity), 2) as quantity, round(sum(l_extendedprice), 2) as price"


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return add


def warehouse(spark: SparkSession) -> Warehouse:
    """A new warehouse in the folder that all executors share, or in a local one where none is set and Spark is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return Warehouse(spark, f"{(shared or tempfile.mkdtemp(prefix='lakeward-')).rstrip('/')}/warehouse-{uuid.uuid4().hex}")


def facts(spark: SparkSession, d: str, partition: tuple[str, ...] = ("l_returnflag",)) -> tuple[Warehouse, Table]:
    """A table of all of lineitem, in `COMMITS` commits."""
    wh = warehouse(spark)
    rows = read(spark, d, "lineitem").select(*COLUMNS)
    wh.create(IDENT, rows.schema, list(partition), [("l_shipdate", True), ("l_orderkey", True)])
    for c in range(COMMITS):
        wh.append(IDENT, rows.where(F.col("l_orderkey") % COMMITS == c), {"query_id": "facts", "batch_id": str(c)}, at_ms=START_MS + 60_000 * c, sort_files=1)
    return wh, wh.load(IDENT)


def per_flag(table: Table) -> DataFrame:
    """Rows and sums of a table's partitions, and how many data and delete files they have."""
    rows = table.scan().groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"))
    files = table.entries().groupBy(F.col("part_values")["l_returnflag"].alias("l_returnflag")).agg(F.count_if(F.col("content") == DATA).alias("files"))
    deletes = table.entries().agg(F.count_if(F.col("content") != DATA).alias("deletes"))
    return rows.join(files, "l_returnflag").join(deletes)


@query(f"select l_returnflag, {SUMS}, cast(1 as bigint) as files, cast(0 as bigint) as deletes from lineitem group by l_returnflag")
def phys_compact(spark, d):
    wh, _ = facts(spark, d)
    maintain.compact_table(wh, IDENT)
    return per_flag(wh.load(IDENT))


@query(f"select l_returnflag, {SUMS}, case when l_returnflag = 'R' then 1 else count(distinct l_orderkey % {COMMITS}) end as files, cast(0 as bigint) as deletes from lineitem group by l_returnflag")
def phys_compact_partition(spark, d):
    wh, _ = facts(spark, d)
    maintain.compact(wh, IDENT, {"l_returnflag": "R"})
    return per_flag(wh.load(IDENT))


@query(f"select l_returnflag, {SUMS}, cast(1 as bigint) as files, cast(0 as bigint) as deletes from lineitem group by l_returnflag")
def phys_compact_hot(spark, d):
    wh, _ = facts(spark, d)
    maintain.compact_hot(wh, IDENT, hot_window=2, rotation=0)
    return per_flag(wh.load(IDENT))


_KEPT = "l_orderkey % 97 <> 0 and not (l_returnflag = 'A' and l_linenumber = 2)"


@query(f"select l_returnflag, {SUMS}, cast(1 as bigint) as files, cast(0 as bigint) as deletes from lineitem where {_KEPT} group by l_returnflag")
def phys_deletes(spark, d):
    """Position and equality deletes, applied by a rewrite that leaves none behind."""
    wh, t = facts(spark, d)
    at = t.read_files([r["path"] for r in t.entries().collect()]).where("l_orderkey % 97 = 0").select(F.col("__path").alias("file_path"), F.col("__pos").alias("pos"))
    wh.delete_rows(IDENT, at)
    wh.delete_rows(IDENT, spark.createDataFrame([("A", 2)], "l_returnflag string, l_linenumber int").select(*[F.col(c).cast(t.schema[c].dataType) for c in ("l_returnflag", "l_linenumber")]), ["l_returnflag", "l_linenumber"])
    maintain.rewrite_delete_files(wh, IDENT)
    return per_flag(wh.load(IDENT))


@query(f"select l_returnflag, {SUMS}, count(distinct l_orderkey % {COMMITS}) as files, cast(2 as bigint) as deletes from lineitem where {_KEPT} group by l_returnflag")
def phys_deletes_on_read(spark, d):
    """The same deletes, applied while reading; the table keeps its files."""
    wh, t = facts(spark, d)
    at = t.read_files([r["path"] for r in t.entries().collect()]).where("l_orderkey % 97 = 0").select(F.col("__path").alias("file_path"), F.col("__pos").alias("pos"))
    wh.delete_rows(IDENT, at)
    wh.delete_rows(IDENT, spark.createDataFrame([("A", 2)], "l_returnflag string, l_linenumber int").select(*[F.col(c).cast(t.schema[c].dataType) for c in ("l_returnflag", "l_linenumber")]), ["l_returnflag", "l_linenumber"])
    return per_flag(wh.load(IDENT))


@query(f"select cast(c.seq as bigint) as seq, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem join (values ({COMMITS - 1}), ({COMMITS})) c(seq) on l_orderkey % {COMMITS} < c.seq group by c.seq")
def phys_expire(spark, d):
    """The rows of the snapshots that stay, after older ones went with the files that only they had."""
    wh, t = facts(spark, d)
    maintain.expire(wh, IDENT, keep_last=2, keep_hours=0, now_ms=START_MS + 3_600_000, delete_files=True)
    out = None
    for s in wh.load(IDENT).meta["snapshots"]:
        rows = wh.load(IDENT).scan(s["id"]).agg(F.lit(s["seq"]).cast("long").alias("seq"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"select 'l_returnflag=' || l_returnflag as part, count(distinct l_orderkey % {COMMITS}) as files, count(*) as n, cast(1 as bigint) as manifests, cast(1 as bigint) as first_seq from lineitem group by l_returnflag")
def phys_manifests(spark, d):
    """What each partition's manifest holds after consolidation."""
    wh, _ = facts(spark, d)
    maintain.rewrite_manifests(wh, IDENT)
    t = wh.load(IDENT)
    return t.read_manifests(t.manifests()).groupBy("part").agg(F.count("*").alias("files"), F.sum("record_count").alias("n"), F.count_distinct("manifest").alias("manifests"), F.min("seq").cast("long").alias("first_seq"))


_STATS = " union all ".join(f"select 'l_returnflag=' || l_returnflag as part, '{c}' as col, count(*) as n, count(*) - count({c}) as nulls, cast(min({c}) as varchar) as lower, cast(max({c}) as varchar) as upper from lineitem group by l_returnflag" for c in ("l_orderkey", "l_linenumber", "l_shipdate"))


@query(_STATS)
def phys_file_stats(spark, d):
    """Counts and bounds of the compacted files' columns, as their entries have them."""
    wh, _ = facts(spark, d)
    maintain.compact_table(wh, IDENT)
    e = wh.load(IDENT).entries().select("part", F.explode("value_counts").alias("col", "n"), "null_counts", "lower", "upper").where(F.col("col").isin("l_orderkey", "l_linenumber", "l_shipdate"))
    return e.select("part", "col", "n", F.col("null_counts")[F.col("col")].alias("nulls"), F.col("lower")[F.col("col")].alias("lower"), F.col("upper")[F.col("col")].alias("upper"))


@query(f"select l_returnflag, {SUMS}, cast(1 as bigint) as files, cast(0 as bigint) as deletes from lineitem group by l_returnflag")
def phys_import(spark, d):
    """A folder of Parquet files, registered in place."""
    wh = warehouse(spark)
    source = wh.store.at("source")
    rows = read(spark, d, "lineitem").select(*COLUMNS)
    rows.withColumn("__p_l_returnflag", F.col("l_returnflag")).write.partitionBy("__p_l_returnflag").parquet(source)
    wh.joined([p for p, _, _ in wh.store.walk("source") if p.endswith(".parquet")])
    return per_flag(wh.import_folder(IDENT, source, ["l_returnflag"]))


@query(f"select l_returnflag, {SUMS}, count(distinct l_orderkey % {COMMITS}) as files, cast(0 as bigint) as deletes from lineitem group by l_returnflag")
def phys_replay(spark, d):
    """A batch that comes again after its snapshot expired changes nothing; files staged by others survive expiry."""
    wh, t = facts(spark, d)
    staged = wh.write_data(t, t.scan().limit(10).coalesce(1))
    maintain.expire(wh, IDENT, keep_last=1, keep_hours=0, now_ms=START_MS + 3_600_000, delete_files=True)
    wh.append(IDENT, read(spark, d, "lineitem").select(*COLUMNS).where(F.col("l_orderkey") % COMMITS == 1), {"query_id": "facts", "batch_id": "1"})
    if not all(wh.store.fs.exists(wh.store._path(p)) for p in staged):
        raise RuntimeError("expiry deleted files that it didn't own")
    return per_flag(wh.load(IDENT))


@query("select cast(12 as bigint) as staged, cast(12 as bigint) as listed, count(*) as n from lineitem")
def phys_orphans(spark, d):
    """Files that no commit has are found and removed; the table's own stay."""
    wh, t = facts(spark, d, ())
    for _ in range(12):
        wh.write_data(t, t.scan().limit(5).coalesce(1))
    found = maintain.remove_orphans(wh, IDENT, 0, now_ms=4_000_000_000_000)
    left = maintain.orphans(wh, IDENT, 0, now_ms=4_000_000_000_000).count()
    return wh.load(IDENT).scan().agg(F.lit(12).cast("long").alias("staged"), F.lit(len(found) - left).cast("long").alias("listed"), F.count("*").alias("n"))
