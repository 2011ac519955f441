"""Queries of the metadata operators over the derived relations, each with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import commits as cm
from ..operators import decisions as dc
from ..operators import deletes as dl
from ..operators import files as fl
from ..operators import verify as vf
from .fixtures import NOW, RUNS, VF, accesses, commits, data_files, read, runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW_SQL = f"timestamp '{NOW}'"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def query(sql: str):
    """Register a query under its function's name with the SQL it is checked against."""

    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return add


# Sources and listings


@query("""select tbl, cast(max(v) as bigint) as version, arg_max(path, v) as path from (select *, case when regexp_matches(n, '^v\\d+$') then cast(substr(n, 2) as bigint) when regexp_matches(n, '^\\d+-.+$') then cast(split_part(n, '-', 1) as bigint)
 when regexp_matches(n, '^\\d+$') then cast(n as bigint) end as v from (select tbl, path, regexp_extract(path, '([^/]+)\\.metadata\\.json$', 1) as n from
 (select 't' || cast(user_id % 40 as varchar) as tbl, 't' || cast(user_id % 40 as varchar) || '/metadata/' || case event_id % 4 when 0 then 'v' || cast(event_id as varchar) when 1 then lpad(cast(event_id as varchar), 5, '0') || '-ab-cd' when 2 then cast(event_id as varchar) else 'snap' || cast(event_id as varchar) end || '.metadata.json' as path from events) e) f) g where v is not null group by tbl""")
def src_metadata_version(spark, d):
    e = F.col("event_id").cast("string")
    name = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("v"), e)).when(F.col("event_id") % 4 == 1, F.concat(F.when(F.length(e) < 5, F.lpad(e, 5, "0")).otherwise(F.substr(e, F.lit(1), F.lit(5))), F.lit("-ab-cd"))).when(F.col("event_id") % 4 == 2, e).otherwise(F.concat(F.lit("snap"), e))
    return fl.current_metadata(read(spark, d, "events").select(F.concat(F.lit("t"), (F.col("user_id") % 40).cast("string"), F.lit("/metadata/"), name, F.lit(".metadata.json")).alias("path")))


@query(f"with {VF} select path, seq, record_count from vf where seq <= 20")
def src_snapshot_entries(spark, d):
    return fl.live_at(data_files(spark, d), 20).select("path", "seq", "record_count")


@query("select p_partkey, p_brand, p_retailprice from part where p_retailprice > (select avg(p_retailprice) from part)")
def src_data_files(spark, d):
    schema = "p_partkey long, p_brand string, p_retailprice double"
    part = spark.read.schema(schema).parquet(f"{d}/part.parquet")
    return part.join(part.agg(F.avg("p_retailprice").alias("m"))).where("p_retailprice > m").drop("m")  # one row of an aggregate


@query(f"with {VF} select path, '{{part=' || cast(part as varchar) || '}}' as inferred from vf")
def src_partition_inference(spark, d):
    m = fl.inferred_partition(F.col("path"))
    return data_files(spark, d).select("path", F.concat(F.lit("{part="), m["part"], F.lit("}")).alias("inferred"))


@query(f"with {VF} select count(*) as files, cast(sum(file_bytes) as bigint) as bytes from vf")
def src_files_metadata(spark, d):
    return data_files(spark, d).agg(F.count("*").alias("files"), F.sum("file_bytes").alias("bytes"))


@query("select event_id as snapshot_id, ts from events order by ts desc, event_id desc limit 50 offset 100")
def src_list_snapshots(spark, d):
    return fl.listing(commits(spark, d).select("snapshot_id", "ts"), [F.desc("ts"), F.desc("snapshot_id")], 50, 100)


@query(f"with {VF} select path, file_bytes from vf where file_bytes between 8000 and 14000 order by file_bytes desc, path limit 20 offset 5")
def src_list_files(spark, d):
    return fl.listing(data_files(spark, d).where("file_bytes between 8000 and 14000").select("path", "file_bytes"), [F.desc("file_bytes"), F.col("path")], 20, 5)


# Filters


@query(f"with {VF}, e as (select *, case when seq % 10 = 0 then 1 when seq % 15 = 0 then 2 else 0 end as content from vf) select content, count(*) as n, cast(sum(record_count) as bigint) as total_rows from e group by content")
def flt_content(spark, d):
    e = data_files(spark, d).withColumn("content", F.when(F.col("seq") % 10 == 0, fl.POSITION_DELETES).when(F.col("seq") % 15 == 0, fl.EQUALITY_DELETES).otherwise(fl.DATA))
    return e.groupBy("content").agg(F.count("*").alias("n"), F.sum("record_count").alias("total_rows"))


@query(f"with {VF} select path, part from vf where part = 3")
def flt_partition_match(spark, d):
    return data_files(spark, d).where(F.col("part") == F.lit("3").cast("long")).select("path", "part")


@query(f"with {VF}, m as (select seq % 8 as manifest, case when seq % 8 = 5 then null else min(part) end as lo, max(part) as hi from vf group by seq % 8) select manifest, lo, hi from m where coalesce(lo <= 9 and 9 <= hi, true)")
def flt_manifest_bounds(spark, d):
    m = data_files(spark, d).groupBy((F.col("seq") % 8).alias("manifest")).agg(F.min("part").alias("lo"), F.max("part").alias("hi")).withColumn("lo", F.when(F.col("manifest") != 5, F.col("lo")))
    return m.where(fl.within_bounds(F.col("lo"), F.col("hi"), F.lit(9)))


@query(f"with {VF} select path, file_bytes from vf where file_bytes < 13000")
def flt_skip_large(spark, d):
    return fl.compactable(data_files(spark, d), 13000).select("path", "file_bytes")


@query(f"with {VF}, t as (select cast(median(file_bytes) as bigint) as m from vf) select count(*) filter (where file_bytes < m) as table_small, count(*) filter (where file_bytes <= m) as partition_small from vf cross join t")
def flt_small_predicates(spark, d):
    files = data_files(spark, d)
    m = files.agg(F.percentile("file_bytes", F.lit(0.5)).cast("long").alias("m"))
    return files.join(F.broadcast(m)).agg(F.count_if(F.col("file_bytes") < F.col("m")).alias("table_small"), F.count_if(F.col("file_bytes") <= F.col("m")).alias("partition_small"))


@query("select pkey, count(*) as n, sum(l_linenumber) as line_sum from (select l_linenumber, case when l_linenumber = 7 then '(unpartitioned)' when l_linenumber % 2 = 0 then 'flag=' || l_returnflag || '/line=null' else 'flag=' || l_returnflag || '/line=' || cast(l_linenumber as varchar) end as pkey from lineitem) q group by pkey")
def flt_partition_key(spark, d):
    line = F.col("l_linenumber")
    values = F.create_map(F.lit("line"), F.when(line % 2 == 1, line.cast("string")), F.lit("flag"), F.col("l_returnflag"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = read(spark, d, "lineitem").withColumn("pkey", fl.partition_key(F.when(line == 7, none).otherwise(values)))
    return rows.groupBy("pkey").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("line_sum"))


@query(f"with {VF} select part % 3 as tbl, count(distinct case when part = 4 then commit_no % 2 else 0 end) as specs, count(*) filter (where part = 5 and commit_no < 3) as puffin, count(distinct case when part = 4 then commit_no % 2 else 0 end) > 1 or count(*) filter (where part = 5 and commit_no < 3) > 0 as refused from vf group by 1")
def flt_unsupported(spark, d):
    """Of three tables one has two specs, one has delete vectors, and one has neither."""
    part = F.col("part")
    e = data_files(spark, d).select((part % 3).alias("tbl"), F.when(part == 4, F.col("commit_no") % 2).otherwise(0).alias("spec_id"), F.when((part == 5) & (F.col("commit_no") < 3), F.concat("path", F.lit(".puffin"))).otherwise(F.col("path")).alias("path"), F.when((part == 5) & (F.col("commit_no") < 3), 1).otherwise(0).alias("content"))
    return vf.unsupported(e, ["tbl"])


@query(f"with {VF} select part, count(*) as n from vf where contains('part=' || cast(part as varchar), '=1') group by part")
def flt_substring(spark, d):
    return data_files(spark, d).where(F.concat(F.lit("part="), F.col("part").cast("string")).contains("=1")).groupBy("part").agg(F.count("*").alias("n"))


@query("select p, p like '\\_lakeward%' escape '\\' or contains(p, '_lakeward/') as internal from (select case event_id % 3 when 0 then '_lakeward/state/' when 1 then 'db/t/_lakeward/' else 'db/lakeward/' end || cast(event_id as varchar) as p from events) q")
def flt_recursion_guard(spark, d):
    e = F.col("event_id")
    p = F.concat(F.when(e % 3 == 0, "_lakeward/state/").when(e % 3 == 1, "db/t/_lakeward/").otherwise("db/lakeward/"), e.cast("string"))
    return read(spark, d, "events").select(p.alias("p")).withColumn("internal", fl.is_internal(F.col("p")))


# Joins and deletes

_DROWS = "select l_orderkey % 40 + 1 as seq, l_orderkey, l_linenumber, l_returnflag, l_extendedprice from lineitem"


@query(f"with d as ({_DROWS}), eqd as (select * from (values ('R', 3, 20), ('N', 1, 5), (null, 2, 40)) v(k1, k2, dseq)) select l_returnflag, count(*) as rows_left, round(sum(l_extendedprice), 2) as price_left from d where l_orderkey % 97 <> 0 and not exists (select 1 from eqd where d.l_returnflag is not distinct from eqd.k1 and d.l_linenumber is not distinct from eqd.k2 and d.seq < eqd.dseq) group by l_returnflag")
def mnt_delete_application(spark, d):
    rows = read(spark, d, "lineitem").withColumn("seq", F.col("l_orderkey") % 40 + 1)
    pos = rows.where("l_orderkey % 97 = 0").select(F.lit("t").alias("file_path"), F.col("l_orderkey").alias("pos"))
    eq = spark.createDataFrame([("R", 3, 20), ("N", 1, 5), (None, 2, 40)], "l_returnflag string, l_linenumber int, delete_seq int")
    kept = dl.apply_position_deletes(rows.withColumns({"file_path": F.lit("t"), "pos": F.col("l_orderkey")}), pos)
    kept = dl.apply_equality_deletes(kept, eq, ["l_returnflag", "l_linenumber"])
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("rows_left"), F.round(F.sum("l_extendedprice"), 2).alias("price_left"))


@query("select count(*) as n from (select distinct l_suppkey % 10 as f, l_orderkey as p from lineitem where l_orderkey % 97 = 0 union select distinct l_suppkey % 10, l_orderkey from lineitem where l_orderkey % 89 = 0) q")
def set_merge_positions(spark, d):
    at = lambda m: read(spark, d, "lineitem").where(f"l_orderkey % {m} = 0").select((F.col("l_suppkey") % 10).alias("file_path"), F.col("l_orderkey").alias("pos"))
    return dl.merge_positions(at(97), at(89)).agg(F.count("*").alias("n"))


@query(f"with {VF}, df as (select seq as id, case when seq % 3 = 0 then null when seq % 3 = 1 then path else 'gone' || path end as referenced from vf) select id, count(*) as n from df where referenced is null or referenced in (select path from vf) group by id")
def join_applicable_deletes(spark, d):
    v = data_files(spark, d)
    df = v.select(F.col("seq").alias("id"), F.when(F.col("seq") % 3 == 1, F.col("path")).when(F.col("seq") % 3 == 2, F.concat(F.lit("gone"), "path")).alias("referenced"))
    return dl.applicable_position_deletes(df, v).groupBy("id").agg(F.count("*").alias("n"))


@query(f"with {VF}, s as (select commit_no + 1 as seq, max(commit_no) as c from vf where commit_no % 5 <> 0 group by commit_no) select v.path, s.c as committed from vf v left join s on v.seq = s.seq")
def join_commit_time(spark, d):
    v = data_files(spark, d)
    s = v.where("commit_no % 5 <> 0").groupBy("seq").agg(F.max("commit_no").alias("committed"))
    return v.join(s, "seq", "left").select("path", "committed")


@query(f"with {VF} select path from vf where seq > 30")
def join_new_files(spark, d):
    v = data_files(spark, d)
    return vf.new_files(v, v.where("seq <= 30"))


@query(f"with {VF} select path || '.x' as path from vf where seq % 7 = 0")
def join_override_paths(spark, d):
    v = data_files(spark, d)
    return vf.missing_files(v.select(F.when(F.col("seq") % 7 == 0, F.concat("path", F.lit(".x"))).otherwise(F.col("path")).alias("path")), v)


_SNAPS = "select user_id % 6 as tbl, event_id as snapshot_id, ts from events"


@query(f"with s as ({_SNAPS}), k as (select *, row_number() over (partition by tbl order by ts desc, snapshot_id desc) as back from s) select tbl, count(*) filter (where (case tbl when 1 then back = 1 when 2 then back > 4 else back > 4 end)) as removed, cast(case when tbl = 2 then 1 else 0 end as bigint) as added, arg_max(snapshot_id, (ts, snapshot_id)) as tip_before, case when tbl = 1 then arg_max(snapshot_id, (ts, snapshot_id)) filter (where back > 1) else arg_max(snapshot_id, (ts, snapshot_id)) end as tip_after, tbl not in (1, 2) as pass from k group by tbl")
def mnt_verify_expire(spark, d):
    """Six tables: one loses its newest snapshot, one gets an old snapshot that it never had, the rest expire rightly."""
    newest = Window.partitionBy("tbl").orderBy(F.desc("ts"), F.desc("snapshot_id"))
    s = read(spark, d, "events").select((F.col("user_id") % 6).alias("tbl"), F.col("event_id").alias("snapshot_id"), "ts")
    ranked = s.withColumn("back", F.row_number().over(newest))
    after = ranked.where(F.when(F.col("tbl") == 1, F.col("back") > 1).otherwise(F.col("back") <= 4)).drop("back")
    never = spark.createDataFrame([(2, -1, "1999-01-01 00:00:00")], "tbl long, snapshot_id long, t string").select("tbl", "snapshot_id", F.col("t").cast(s.schema["ts"].dataType).alias("ts"))
    return vf.verify_expire(s, after.unionByName(never), ["tbl"]).select("tbl", "removed", "added", "tip_before", "tip_after", "pass")


@query(f"with {VF} select path as path from vf where part >= 5 and seq <= 20")
def join_orphans(spark, d):
    """Listed files that no retained snapshot references and that are older than the margin."""
    listed = data_files(spark, d).withColumn("modified", F.col("seq"))
    return fl.orphans(listed, listed.where("part < 5"), 21).select("path")


_LOST = "l_orderkey % 40 = 7 and l_linenumber = 2"


@query(f"select col, v_in, v_out, n_in, n_out, v_in = v_out and n_in = n_out as pass from (select 'l_returnflag' as col, count(*) as v_in, count(*) as v_out, count(*) filter (where l_returnflag = 'N') as n_in, count(*) filter (where l_returnflag = 'N' or ({_LOST})) as n_out from lineitem union all select 'l_tax', count(*), count(*), count(*) - count(l_tax), count(*) - count(l_tax) from lineitem union all select 'l_quantity', count(*), count(*) filter (where not ({_LOST})), 0, 0 from lineitem union all select 'added', 0, count(*), 0, 0 from lineitem) q")
def mnt_verify_counts(spark, d):
    """A rewrite that made nulls of some values, lost others, and has a column that wasn't there: only one column passes."""
    lost = F.expr(_LOST)

    def footers(groups: int, after: bool) -> DataFrame:
        n = lambda c: F.count_if(c)
        r = F.col("l_returnflag") == "N"
        g = read(spark, d, "lineitem").groupBy((F.col("l_orderkey") % groups).alias("f")).agg(
            F.count("*").alias("v"), n(r | lost if after else r).alias("n1"), n(F.col("l_tax").isNull()).alias("n2"), n(~lost if after else F.lit(True)).alias("kept"), n(F.lit(False)).alias("none")
        )
        more = [F.lit("added"), "v"] if after else []
        return g.select(F.create_map(F.lit("l_returnflag"), "v", F.lit("l_tax"), "v", F.lit("l_quantity"), "kept", *more).alias("value_counts"), F.create_map(F.lit("l_returnflag"), "n1", F.lit("l_tax"), "n2", F.lit("l_quantity"), "none").alias("null_counts"))

    return vf.compare_counts(vf.column_counts(footers(40, False)), vf.column_counts(footers(3, True)))


@query(f"with {VF} select 'c' || cast(part as varchar) as col, case when part % 4 = 1 then 'missing' else 'spurious' end as problem from vf where part % 4 in (1, 2) group by part having max(record_count) > 0")
def join_bounds_presence(spark, d):
    """Columns 1, 5 and 9 lose their bounds, 2 and 6 get some; 3 and 7 have no values, so theirs don't count."""
    part, name = F.col("part"), F.concat(F.lit("c"), F.col("part").cast("string"))

    def footers(after: bool) -> DataFrame:
        bounded = F.when(part % 4 == 1, not after).when(part % 4 == 2, after).when(part % 4 == 3, after).otherwise(True)
        edge = F.create_map(name, F.when(bounded, F.col("path")))
        nulls = F.when(part % 4 == 3, F.col("record_count")).otherwise(0)
        return data_files(spark, d).select(F.create_map(name, "record_count").alias("value_counts"), F.create_map(name, nulls).alias("null_counts"), edge.alias("lower"), edge.alias("upper"))

    return vf.bounds_presence(vf.bounds_of(footers(False)), vf.bounds_of(footers(True)))


@query(f"with {VF}, a as (select part, count(*) as files_in, cast(sum(record_count) as bigint) as rows_in from vf group by part) select part, files_in, rows_in, cast(1 as bigint) as files_out, rows_in - case when part % 3 = 0 then 5 when part % 3 = 1 then 10 else 0 end as rows_out, part % 3 = 0 as i1_rows from a")
def mnt_verify_rows(spark, d):
    """Rewrites of ten partitions that should lose five rows each: a third does, the others lose more or none."""
    v = data_files(spark, d)
    lost = F.when(F.col("part") % 3 == 0, 5).when(F.col("part") % 3 == 1, 10).otherwise(0)
    after = v.groupBy("part").agg(F.sum("record_count").alias("record_count")).withColumn("record_count", F.col("record_count") - lost)
    return vf.verify_compaction(v, after, 5, ["part"])


@query(f"with {VF} select path, case when seq % 5 = 0 then 'missing' else 'extra' end as side, cast(1 as bigint) as times from vf where seq % 5 = 0 or seq % 7 = 0 and seq % 5 <> 0")
def set_file_difference(spark, d):
    v = data_files(spark, d).select("path", "seq")
    after = v.where("seq % 5 <> 0").unionByName(v.where("seq % 7 = 0 and seq % 5 <> 0"))
    return vf.file_set_difference(v, after)


@query("select tbl, list_sort(list(distinct a)) = list_sort(list(distinct b)) as same from (select user_id as tbl, event_type as a, lag(event_type, 1, event_type) over (partition by user_id order by ts desc, event_id desc) as b, row_number() over (partition by user_id order by ts desc, event_id desc) as i from events) q group by tbl")
def set_same_strings(spark, d):
    """Whether a table's kinds of events are still the same without its last one."""
    newest = Window.partitionBy("tbl").orderBy(F.desc("ts"), F.desc("event_id"))
    e = read(spark, d, "events").select(F.col("user_id").alias("tbl"), "event_type", "ts", "event_id").withColumn("before", F.lag("event_type", 1).over(newest)).withColumn("before", F.coalesce("before", "event_type"))
    g = e.groupBy("tbl").agg(F.collect_set("event_type").alias("a"), F.collect_set("before").alias("b"))  # few kinds
    return g.select("tbl", vf.same_strings(F.col("a"), F.col("b")).alias("same"))


# Health and groups


@query(f"""with {VF}, f as (select count(*) as files, cast(sum(file_bytes) as bigint) as bytes, cast(sum(record_count) as bigint) as total_rows, count(*) filter (where file_bytes < 13500) as small_files, cast(coalesce(sum(case when file_bytes < 13500 then file_bytes end), 0) as bigint) as small_bytes from vf),
m as (select count(*) as manifests, cast(sum(b) as bigint) as manifest_bytes from (select 1000 + 100 * count(*) as b from vf group by seq) q), h as (select *, manifest_bytes // manifests as avg_manifest, small_files / files as small_ratio, manifest_bytes / bytes as metadata_ratio from f cross join m)
select *, case when metadata_ratio > 0.10 then 'critical metadata' when small_ratio > 0.60 then 'critical small files' when metadata_ratio > 0.05 then 'warn metadata' when small_ratio > 0.30 then 'warn small files' else 'ok' end as verdict from h""")
def agg_table_health(spark, d):
    v = data_files(spark, d)
    return fl.table_health(v, v.groupBy("seq").agg((1000 + 100 * F.count("*")).alias("manifest_bytes")), small=13500)


@query(f"""with {VF}, g as (select part, count(*) as file_count, cast(sum(record_count) as bigint) as total_rows, cast(sum(file_bytes) as bigint) as total_bytes, count(*) filter (where file_bytes <= 13500) as small_count, max(seq) as max_seq from vf group by part),
x as (select *, max_seq > (select max(seq) from vf) - 5 as is_hot, timestamp '2024-01-01' + to_hours(max_seq) as c, case when part % 2 = 0 then timestamp '2024-01-01' + to_hours(35) end as rw from g)
select part, file_count, total_rows, total_bytes, small_count, max_seq, is_hot, small_count >= 10 as needs_small, file_count >= 30 as needs_files, c < timestamp '2024-01-02 12:00:00' - interval 12 hour and file_count >= 2 and (rw is null or rw < timestamp '2024-01-02 12:00:00' - interval 12 hour) as needs_stale from x""")
def agg_partition_health(spark, d):
    v = data_files(spark, d)
    at = lambda h: (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=h))
    snaps = v.select("seq").distinct().select("seq", at(F.col("seq").cast("int")).alias("committed_at"))
    rewrites = v.where("part % 2 = 0").select("part").distinct().withColumn("rewritten_at", at(F.lit(35)))
    return fl.partition_health(v, snaps, F.lit("2024-01-02 12:00:00").cast("timestamp_ntz"), rewrites, small=13500, small_trigger=10, file_trigger=30, stale_hours=12)


@query(f"with {VF}, m as (select seq, count(*) as n, sum(record_count) as r from vf group by seq) select (select count(*) from vf) as files, (select cast(sum(record_count) as bigint) from vf) as total_rows, cast(sum(n) as bigint) as fast_files, cast(sum(r) as bigint) as fast_rows from m")
def agg_snapshot_stats(spark, d):
    v = data_files(spark, d)
    m = v.groupBy("seq").agg(F.count("*").alias("n"), F.sum("record_count").alias("r"))
    return v.agg(F.count("*").alias("files"), F.sum("record_count").alias("total_rows")).join(m.agg(F.sum("n").alias("fast_files"), F.sum("r").alias("fast_rows")))


_CLS = "case when c7 = 0 then 'dormant' when c15 >= 2 and c15 * 4.0 > 6.0 then 'streaming' when c24 / 24.0 > 6.0 then 'streaming' when c24 / 24.0 > 0.04 then 'batch' else 'slow_changing' end"
_RATES = "select {key} as tbl, count(*) filter (where not own and ts > now - interval 15 minute) as c15, count(*) filter (where not own and ts > now - interval 24 hour) as c24, count(*) filter (where not own and ts > now - interval 168 hour) as c7, max(case when not own then ts end) as last_foreign, count(*) filter (where own) as excluded from (select *, event_type = 'error' as own, " + NOW_SQL + " as now from events) e where ts <= now group by 1"


@query(f"select *, {_CLS} as class from ({_RATES.format(key='user_id')}) q")
def mnt_classify_tables(spark, d):
    return cm.commit_rates(commits(spark, d), now(), ["tbl"]).withColumn("class", cm.workload_class())


@query(f"select *, {_CLS} as class from ({_RATES.format(key='event_type')}) q")
def mnt_classify_streams(spark, d):
    c = read(spark, d, "events").select(F.col("event_type").alias("tbl"), "ts", (F.col("event_type") == "error").alias("own"))
    return cm.commit_rates(c, now(), ["tbl"]).withColumn("class", cm.workload_class())


_PLANS = "(values " + ", ".join(f"('{c[0]}', '{c[8]}', {c[9]}, {c[11]}, {c[2]}, {c[14]})" for c in cm.CLASSES) + ") p(class, mode, keep_last, target_mib, small_trigger, next_min)"


@query(f"select q.tbl, q.class, p.mode, p.keep_last, p.target_mib, p.small_trigger, q.last_foreign + to_minutes(p.next_min) as next_at from (select *, {_CLS} as class from ({_RATES.format(key='user_id')}) r) q join {_PLANS} on q.class = p.class")
def mnt_plans(spark, d):
    q = mnt_classify_tables(spark, d).select("tbl", "class", "last_foreign")
    p = F.broadcast(cm.class_plans(spark))  # four rows
    return q.join(p, "class").select("tbl", "class", "mode", "keep_last", "target_mib", "small_trigger", (F.col("last_foreign") + F.make_dt_interval(mins=F.col("next_min"))).alias("next_at"))


@query(f"with {VF} select part from vf group by part having count(*) filter (where file_bytes < 12000) > 0")
def agg_small_partitions(spark, d):
    return fl.small_file_partitions(data_files(spark, d), 12000).select("part")


@query(f"with {VF} select count(*) as files, avg(file_bytes) as avg_bytes, min(file_bytes) as min_bytes, max(file_bytes) as max_bytes, median(file_bytes) as median_bytes, avg(case when file_bytes < 13000 then 1.0 else 0.0 end) as small_ratio from vf")
def agg_size_summary(spark, d):
    return fl.size_summary(data_files(spark, d), 13000)


@query("select case when s < 1048576 then '< 1 MB' when s < 10485760 then '1-10 MB' when s < 67108864 then '10-64 MB' when s < 134217728 then '64-128 MB' when s < 268435456 then '128-256 MB' else '> 256 MB' end as bucket, count(*) as file_count, cast(sum(s) as bigint) as total_bytes from (select event_id * 40000 as s from events) q group by 1")
def agg_size_histogram(spark, d):
    return fl.size_histogram(read(spark, d, "events").select((F.col("event_id") * 40000).alias("file_bytes")))


@query(f"with {VF} select part, count(*) as file_count, cast(sum(file_bytes) as bigint) as total_bytes, avg(file_bytes) as avg_bytes, avg(file_bytes) < 13600 and count(*) > 1 as needs_compaction from vf group by part")
def agg_partition_stats(spark, d):
    return fl.partition_stats(data_files(spark, d), 13600)


@query(f"with {VF} select part, count(*) as file_count, cast(sum(file_bytes) as bigint) as total_bytes from vf group by part having count(*) > 15 order by count(*) desc, part limit 5")
def srt_crowded_partitions(spark, d):
    return fl.crowded_partitions(data_files(spark, d), 15, 5)


@query(f"with {VF} select 0 as spec_id, part, count(*) as files, cast(sum(record_count) as bigint) as total_rows, min(seq) as min_seq from vf group by part order by 1, 2")
def agg_manifest_groups(spark, d):
    return fl.manifest_groups(data_files(spark, d).withColumn("spec_id", F.lit(0))).orderBy("spec_id", "part")


@query(f"with {VF}, mx as (select max(seq) as m from vf) select part, max(seq) as max_seq, max(seq) > max(m) - 5 as hot from vf cross join mx group by part")
def win_hot_window(spark, d):
    v = data_files(spark, d)
    return v.groupBy("part").agg(F.max("seq").alias("max_seq")).join(v.agg(F.max("seq").alias("m"))).select("part", "max_seq", (F.col("max_seq") > F.col("m") - 5).alias("hot"))


_FNV = {p: 0 for p in range(10)}
for _p in _FNV:
    _h = 14695981039346656037
    for _b in f"part={_p}".encode():
        _h = ((_h ^ _b) * 1099511628211) % (1 << 64)
    _FNV[_p] = _h & ((1 << 63) - 1)
_FNV_SQL = "(values " + ", ".join(f"({p}, {h})" for p, h in _FNV.items()) + ") k(p, h)"


@query(f"""with {VF}, big as (select *, row_number() over (partition by part order by path) - 1 as i, count(*) over (partition by part) as n from vf where file_bytes > 14500), pick as (select part, path, false as bootstrap from big join {_FNV_SQL} on part = p where i = (7 + cast(h as hugeint)) % n),
rest as (select part, arg_min(path, (-file_bytes, path)) as path, true as bootstrap from vf where part not in (select part from big) group by part) select * from pick union all select * from rest""")
def win_anchor(spark, d):
    return fl.anchors(data_files(spark, d), 14500, 7)


# Retention, runs, breakers


@query(f"with s as (select event_id as snapshot_id, user_id as tbl, ts from events where ts <= {NOW_SQL}), r as (select *, row_number() over (partition by tbl order by ts desc, snapshot_id desc) as rn from s) select tbl, count(*) as total, count(*) filter (where rn > 5 and ts < {NOW_SQL} - interval 168 hour) as expired from r group by tbl")
def mnt_expire_retention(spark, d):
    s = cm.expirable(commits(spark, d).where(F.col("ts") <= now()), now(), 5, 168)
    return s.groupBy("tbl").agg(F.count("*").alias("total"), F.count_if(F.col("expires")).alias("expired"))


_TRIPS = f"""with {RUNS}, a as (select *, case when paths is distinct from lag(paths) over w or lag(paths) over w is null then 1 else 0 end as chg, sum(case when ok then 1 else 0 end) over w as okn, sum(bytes_written) over w as life from runs window w as (partition by tbl order by ts, run_id rows between unbounded preceding and current row)),
b as (select *, sum(chg) over (partition by tbl order by ts, run_id rows between unbounded preceding and current row) as isl, sum(case when ok then 0 else 1 end) over (partition by tbl, okn order by ts, run_id rows between unbounded preceding and current row) as failures from a),
c as (select *, row_number() over (partition by tbl, isl order by ts, run_id) as loop_count, metadata_bytes / data_bytes as share, before_files - after_files as less from b)"""


@query(_TRIPS + """ select tbl, run_id, cast(loop_count as bigint) as loop_count, cast(failures as bigint) as failures, cast(life as bigint) as lifetime_bytes, loop_count >= 3 as cb2, case when share >= 0.5 then 'pause' when share >= 0.10 then 'critical' when share >= 0.05 then 'warn' else 'ok' end as cb3,
 before_files > 0 and after_files >= before_files as cb4, not ok and failures >= 3 as cb8, life / data_bytes > 20.0 as cb9, less > 0 and bytes_read > 0 and less * 102400.0 / bytes_read < 0.1 as cb11 from c""")
def mnt_breakers(spark, d):
    return cm.breaker_trips(runs(spark, d)).withColumns({"loop_count": F.col("loop_count").cast("long"), "failures": F.col("failures").cast("long")})


@query(_TRIPS + " select tbl, max(loop_count) as longest_loop, cast(max(failures) as bigint) as longest_failure from c group by tbl")
def win_run_lengths(spark, d):
    r = cm.failure_runs(cm.repeated_runs(runs(spark, d)))
    return r.groupBy("tbl").agg(F.max("loop_count").cast("long").alias("longest_loop"), F.max("failures").cast("long").alias("longest_failure"))


@query(f"""with recursive {RUNS}, o as (select *, bytes_read + bytes_written as b, row_number() over (partition by tbl order by ts, run_id) as i from runs),
f as (select tbl, i, ts as since, b as used from o where i = 1 union all select o.tbl, o.i, case when o.ts > f.since + interval 24 hour then o.ts else f.since end, case when o.ts > f.since + interval 24 hour then o.b else f.used + o.b end from f join o on o.tbl = f.tbl and o.i = f.i + 1)
select tbl, arg_max(since, i) as window_start, cast(arg_max(used, i) as bigint) as bytes_used from f group by tbl""")
def win_daily_budget(spark, d):
    return cm.daily_budget(runs(spark, d))


@query(f"with {RUNS} select tbl, run_id, cast(sum(bytes_written) over (partition by tbl order by ts, run_id rows between unbounded preceding and current row) as bigint) as lifetime_bytes from runs")
def win_lifetime_bytes(spark, d):
    return cm.breaker_trips(runs(spark, d)).select("tbl", "run_id", "lifetime_bytes")


# Decisions

_STATE = "select c_custkey as tbl, c_custkey % 7 <> 0 as enabled, (c_custkey % 100) / 100.0 as small_ratio, (c_custkey * 37) % 15000 as file_count, (c_custkey * 13) % 300 as snapshot_count, (c_custkey * 7) % 120 as commits_since, (c_custkey * 11) % 900 as small_files, case when c_custkey % 5 <> 0 then timestamp '2024-01-30' + to_minutes(cast((c_custkey * 17) % 1500 as integer)) end as last_compaction, (c_custkey * 1000003) % 2000000000 as uncompacted_bytes, (c_custkey % 11) / 10.0 as health_score, cast(c_custkey % 60 as double) as boost from customer"


def _states(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    last = F.when(k % 5 != 0, F.lit("2024-01-30").cast("timestamp_ntz") + F.make_dt_interval(mins=((k * 17) % 1500).cast("int")))
    return read(spark, d, "customer").select(
        k.alias("tbl"), (k % 7 != 0).alias("enabled"), ((k % 100) / 100.0).alias("small_ratio"), ((k * 37) % 15000).alias("file_count"), ((k * 13) % 300).alias("snapshot_count"), ((k * 7) % 120).alias("commits_since"),
        ((k * 11) % 900).alias("small_files"), last.alias("last_compaction"), ((k * 1000003) % 2000000000).alias("uncompacted_bytes"), ((k % 11) / 10.0).alias("health_score"), (k % 60).cast("double").alias("boost"),
    )


@query(f"with s as ({_STATE}) select tbl, 'compact' as action, case when small_ratio > 0.3 then 10 else 8 end as priority from s where enabled and (small_ratio > 0.3 or file_count > 10000) union all select tbl, 'expire', 7 from s where enabled and snapshot_count > 100 union all select tbl, 'remove_orphans', 3 from s where enabled")
def mnt_policy_actions(spark, d):
    return dc.policy_actions(_states(spark, d))


_FIRE = f"commits_since >= 50 as by_commits, small_files >= 500 as by_files, last_compaction is null or date_diff('second', last_compaction, {NOW_SQL}) >= 1800 as by_time, uncompacted_bytes >= 1073741824 as by_size"


@query(f"with s as ({_STATE}), t as (select tbl, {_FIRE} from s) select *, by_commits or by_files or by_time or by_size as fired from t")
def mnt_triggers(spark, d):
    return dc.triggers(_states(spark, d), now()).select("tbl", "by_commits", "by_files", "by_time", "by_size", "fired")


@query(f"with s as ({_STATE}) select tbl, round(least(small_files / 1000.0, 5.0) * 25 + least(commits_since / 100.0, 5.0) * 20 + case when last_compaction is null then 75.0 else least(date_diff('second', last_compaction, {NOW_SQL}) / 3600.0 / 24, 5.0) * 15 end + least(uncompacted_bytes / 1073741824.0, 10.0) * 10 + (1.0 - health_score) * 30 + boost, 6) as priority from s")
def mnt_schedule_priority(spark, d):
    return _states(spark, d).select("tbl", F.round(dc.schedule_priority(now()), 6).alias("priority"))


@query("select event_id, (hour(ts) * 60 + minute(ts)) >= 1320 or (hour(ts) * 60 + minute(ts)) <= 240 as open from events")
def mnt_maintenance_window(spark, d):
    return read(spark, d, "events").select("event_id", dc.in_window(F.hour("ts") * 60 + F.minute("ts"), 1320, 240).alias("open"))


@query(f"with s as ({_STATE}) select tbl, last_compaction as next_at from s where last_compaction <= {NOW_SQL} order by last_compaction, tbl limit 25")
def srt_due_tables(spark, d):
    return dc.due_tables(_states(spark, d).select("tbl", F.col("last_compaction").alias("next_at")), now(), 25)


_AGE = f"(epoch({NOW_SQL}) - epoch(ts))"
_HEAT = f"""with e as (select user_id as tbl, event_id, ts, value, event_type, {_AGE} as age from events where ts <= {NOW_SQL}), pos as (select tbl, value, row_number() over (partition by tbl order by ts, event_id) as i, count(*) over (partition by tbl) as n from e where value > 0),
ema as (select tbl, sum(value * case when i = 1 then power(0.9, n - 1) else 0.1 * power(0.9, n - i) end) as ema from pos group by tbl),
g as (select tbl, count(*) as total, count(distinct event_type) as clients, max(ts) as last_access, min(age) as age, sum(case when age <= 3600 then exp(-{dc.DECAY} * age) else 0 end) as d1, sum(case when age <= 21600 then exp(-{dc.DECAY} * age) else 0 end) as d6, sum(case when age <= 86400 then exp(-{dc.DECAY} * age) else 0 end) as d24 from e group by tbl),
h as (select g.tbl, total, clients, last_access, d1, d6, d24, ema, least(1.0, 0.60 * least(d24 / 24.0 / 2.0, 1.0) + 0.25 * exp(-{dc.DECAY} * age) + 0.15 * least(coalesce(ema, 0.0) / 5000.0, 1.0)) as heat, case when d1 >= 2 then 'hot' when d1 >= 0.5 then 'warm' else 'cold' end as tier from g left join ema on g.tbl = ema.tbl)"""


@query(_HEAT + " select tbl, total, clients, last_access, round(d1, 6) as d1, round(d6, 6) as d6, round(d24, 6) as d24 from h")
def agg_access_stats(spark, d):
    a = dc.access_stats(accesses(spark, d), now())
    return a.select("tbl", "total", "clients", "last_access", *[F.round(f"decayed_{h}h", 6).alias(f"d{h}") for h in (1, 6, 24)])


@query(_HEAT + " select tbl, round(ema, 6) as ema from h where ema is not null")
def agg_latency_ema(spark, d):
    return dc.latency_ema(accesses(spark, d).where(F.col("ts") <= now())).select("tbl", F.round("ema", 6).alias("ema"))


@query(_HEAT + " select tbl, round(heat, 4) as heat, tier, round_even(least(100.0, case tier when 'hot' then 60.0 + heat * 40.0 when 'warm' then heat * 30.0 else 0.0 end), 2) as boost from h")
def mnt_heat(spark, d):
    return dc.heat(accesses(spark, d), now(), hot_qph=2.0, warm_qph=0.5)


_TIER = "select c_custkey as tbl, case c_custkey % 3 when 0 then 'hot' when 1 then 'warm' else 'cold' end as tier, (array[0.7, 0.85, 1.0, 1.5, 2.0])[cast(c_custkey % 5 as integer) + 1] as feedback from customer"


@query(f"with t as ({_TIER}), m as (select *, cast(case tier when 'hot' then 0.5 when 'warm' then 1.0 else 3.0 end as double) * cast(feedback as double) as m from t), x as (select *, case tier when 'hot' then greatest(m, 0.25) when 'cold' then least(m, 5.0) else 1.0 end as f from m) select tbl, "
       + ", ".join(f"cast(greatest(1, floor({dc.POLICY[k]} * m)) as bigint) as {k}" for k in ("commit_trigger", "file_trigger", "time_trigger_minutes", "max_file_count")) + ", "
       + ", ".join(f"cast(floor({dc.POLICY[k]} * f) as bigint) as {k}" for k in ("snapshot_retention_hours", "orphan_retention_hours")) + ", round(greatest(0.05, least(0.95, cast(0.3 as double) * m)), 6) as max_small_file_ratio from x")
def mnt_adaptive_policy(spark, d):
    k = F.col("c_custkey")
    feedback = F.element_at(F.array(*[F.lit(x) for x in (0.7, 0.85, 1.0, 1.5, 2.0)]), (k % 5).cast("int") + 1)
    rows = read(spark, d, "customer").select(k.alias("tbl"), F.when(k % 3 == 0, "hot").when(k % 3 == 1, "warm").otherwise("cold").alias("tier"), feedback.alias("feedback"))
    return dc.adaptive_policy(rows)


_PAIRS = "select tbl, run_id as seq, cast(before_files as double) as b_files, cast(after_files as double) as a_files, cast(run_id % 30 as double) as b_small, cast(run_id % 11 as double) as a_small, cast(run_id % 900 as double) as b_latency, cast(run_id % 700 as double) as a_latency, cast(1000 + run_id % 97 as double) as b_size, cast(1000 + run_id % 389 as double) as a_size from runs"
_CUT = "case when b_{0} > 0 then (b_{0} - a_{0}) / b_{0} else 0.0 end"
_SCORE = "0.35 * greatest(-1.0, least(1.0, {0})) + 0.25 * greatest(-1.0, least(1.0, {1})) + 0.25 * greatest(-1.0, least(1.0, {2})) + 0.15 * greatest(-1.0, least(1.0, -({3})))".format(*[_CUT.format(c) for c in ("files", "small", "latency", "size")])


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("run_id")
    figures = {"b_files": F.col("before_files"), "a_files": F.col("after_files"), "b_small": r % 30, "a_small": r % 11, "b_latency": r % 900, "a_latency": r % 700, "b_size": 1000 + r % 97, "a_size": 1000 + r % 389}
    return runs(spark, d).select("tbl", r.alias("seq"), *[c.cast("double").alias(k) for k, c in figures.items()])


@query(f"with {RUNS}, p as ({_PAIRS}) select tbl, count(*) as n, round(avg(s), 3) as avg_score, round(min(s), 3) as min_score, round(max(s), 3) as max_score from (select tbl, round_even({_SCORE}, 4) as s from p) q group by tbl")
def mnt_effectiveness(spark, d):
    s = dc.effectiveness(_pairs(spark, d))
    return s.groupBy("tbl").agg(F.count("*").alias("n"), *[F.round(f("score"), 3).alias(f"{n}_score") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))])


@query(f"""with {RUNS}, s as (select tbl, ts, run_id as seq, (run_id % 41) / 20.0 - 1.0 as score from runs where tbl % 3 <> 0 or ts < {NOW_SQL} - interval 48 hour), r as (select *, row_number() over (partition by tbl order by ts desc, seq desc) as back, ts >= {NOW_SQL} - interval 24 hour and ts <= {NOW_SQL} as near from s),
 k as (select *, max(case when near then 1 else 0 end) over (partition by tbl) = 1 as any_near from r), p as (select * from k where case when any_near then near else back <= 3 end), h as (select *, count(*) over (partition by tbl) as n, row_number() over (partition by tbl order by ts desc, seq desc) as i from p),
 g as (select tbl, max(n) as n, avg(score) as a, avg(case when i > n - n // 2 then score end) as e, avg(case when i <= n - n // 2 then score end) as l from h group by tbl), z as (select tbl, avg(score) as five from r where back <= 5 group by tbl)
select tbl, n, round(a, 6) as avg_score, case when n < 2 then 'stable' when l > e + 0.1 then 'improving' when l < e - 0.1 then 'degrading' else 'stable' end as trend, cast(case when a > 0.5 then 0.7 when a > 0.2 then 0.85 when a > -0.1 then 1.0 when a > -0.5 then 1.5 else 2.0 end as double) as multiplier, round(greatest(0.3, least(2.0, 1.0 + five / 2)), 6) as priority_factor, n >= 3 and a < -0.5 as skip from g join z using (tbl)""")
def win_feedback_trend(spark, d):
    s = runs(spark, d).where((F.col("tbl") % 3 != 0) | (F.col("ts") < now() - F.expr("interval 48 hours"))).select("tbl", "ts", F.col("run_id").alias("seq"), ((F.col("run_id") % 41) / 20.0 - 1.0).alias("score"))
    return dc.recommendation(s, now())


@query(f"with s as ({_STATE}) select tbl, round(least(small_files / 1000.0, 5.0) * 25 + least(commits_since / 100.0, 5.0) * 20 + case when last_compaction is null then 75.0 else least(date_diff('second', last_compaction, {NOW_SQL}) / 3600.0 / 24, 5.0) * 15 end + least(uncompacted_bytes / 1073741824.0, 10.0) * 10 + (1.0 - health_score) * 30 + boost, 6) as priority from s order by priority desc, tbl limit 40")
def srt_ranked_tables(spark, d):
    """The most urgent tables: a top-k report."""
    return dc.ranked(_states(spark, d), now(), 40)


@query(f"with {VF} select part, count(*) as file_count, cast(sum(record_count) as bigint) as total_rows, cast(sum(file_bytes) as bigint) as total_bytes, max(seq) as max_seq, string_agg(case when file_bytes <= 13500 then path end, ',' order by path) as small_files, string_agg(case when file_bytes > 13500 then path end, ',' order by path) as large_files from vf group by part")
def agg_partition_files(spark, d):
    """Small and large files of each partition, in order of their paths."""
    out = fl.partition_files(data_files(spark, d), 13500)
    text = lambda c: F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c)
    return out.select("part", "file_count", "total_rows", "total_bytes", "max_seq", text("small_files"), text("large_files"))


@query(f"with {VF} select part, count(*) as file_count, cast(sum(record_count) as bigint) as total_rows, cast(sum(file_bytes) as bigint) as total_bytes from vf group by part order by total_bytes desc, part limit 6 offset 2")
def src_list_partitions(spark, d):
    return fl.listing(fl.partition_totals(data_files(spark, d)), [F.desc("total_bytes"), F.col("part")], 6, 2)


@query(f"with {VF}, g as (select part, count(*) as file_count, count(*) filter (where file_bytes < 13500) as small_count, case when part = 9 then 0 else cast(sum(file_bytes) as bigint) end as total_bytes from vf group by part) select part, 'compact' as action, round(small_count / file_count * 100 + small_count, 4) as priority from g where file_count >= 5 and small_count / file_count > 0.3 union all select part, 'prune', 10.0 from g where file_count >= 5 and total_bytes = 0")
def mnt_partition_recommendations(spark, d):
    g = data_files(spark, d).groupBy("part").agg(F.count("*").alias("file_count"), F.count_if(F.col("file_bytes") < 13500).alias("small_count"), F.sum("file_bytes").alias("total_bytes"))
    return dc.partition_recommendations(g.withColumn("total_bytes", F.when(F.col("part") == 9, 0).otherwise(F.col("total_bytes"))))


@query(f"with t as (select s_suppkey as tbl, cast(s_suppkey as double) * 0.37 as gb, s_suppkey * 100 as files from supplier), c as (select *, greatest(1, floor(gb / 0.128)) as o from t), k as (select tbl, round_even(gb * 0.001 + files / 1000.0 * 0.0004 + o / 1000 * 0.005, 4) as one, round_even(gb * 0.02 + o / 1000 * 0.005, 4) as ship from c) select tbl, round(one * 2, 4) as both_regions, round(one + ship, 4) as shipped, one as one_region, case when round(one * 2, 4) < round(one + ship, 4) then 'compact both' else 'compact+ship' end as winner from k")
def mnt_region_costs(spark, d):
    return dc.region_costs(read(spark, d, "supplier").select(F.col("s_suppkey").alias("tbl"), (F.col("s_suppkey").cast("double") * 0.37).alias("data_gb"), (F.col("s_suppkey") * 100).alias("files")))
