"""Star-schema, load-test and summary queries: the reads whose latency maintenance is measured by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import read

_FROM = {
    "l": "lineitem l", "o": "join orders o on l.l_orderkey = o.o_orderkey", "c": "join customer c on o.o_custkey = c.c_custkey",
    "s": "join supplier s on l.l_suppkey = s.s_suppkey", "p": "join part p on l.l_partkey = p.p_partkey", "n": "join nation n on c.c_nationkey = n.n_nationkey",
}


def _from(keys: str) -> str:
    return "from " + " ".join(_FROM[k] for k in keys)


_DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
_WEEK = ", ".join(f"sum(case when {{dow}} = {i} then l.l_extendedprice else 0 end) as {d}_sales" for i, d in enumerate(_DAYS))

#: {dow} is the day of the week with Sunday 0, which the two dialects spell differently.
SQL = {
    "star_q1": f"select c.c_custkey, c.c_name, sum(l.l_extendedprice * l.l_discount) as total_returns {_from('locs')} where l.l_returnflag = 'R' and l.l_shipdate >= date '1996-01-01' and l.l_shipdate < date '1997-01-01' group by c.c_custkey, c.c_name order by total_returns desc, c.c_custkey limit 100",
    "star_q3": f"select cast(year(l.l_shipdate) as bigint) as yr, p.p_brand, sum(l.l_extendedprice) as revenue {_from('lp')} where p.p_size = 15 group by year(l.l_shipdate), p.p_brand order by yr, revenue desc, p.p_brand limit 100",
    "star_q7": f"select p.p_partkey, avg(l.l_quantity) as avg_qty, avg(l.l_extendedprice) as avg_price, avg(l.l_discount) as avg_disc, avg(l.l_tax) as avg_tax {_from('locps')} where c.c_mktsegment = 'BUILDING' and o.o_orderstatus = 'F' and l.l_shipdate >= date '1997-01-01' and l.l_shipdate < date '1998-01-01' group by p.p_partkey order by p.p_partkey limit 100",
    "star_q13": f"select avg(l.l_quantity) as avg_qty, avg(l.l_extendedprice) as avg_price, sum(l.l_tax) as total_tax, count(*) as n {_from('locsn')} where c.c_mktsegment = 'BUILDING' and o.o_orderdate >= date '1996-01-01' and o.o_orderdate < date '1997-01-01' and n.n_regionkey in (0, 2, 3)",
    "star_q19": f"select p.p_brand, p.p_type, sum(l.l_extendedprice) as revenue {_from('lpocn')} {_FROM['s']} join nation sn on s.s_nationkey = sn.n_nationkey where l.l_shipdate >= date '1996-11-01' and l.l_shipdate < date '1996-12-01' and n.n_regionkey <> sn.n_regionkey group by p.p_brand, p.p_type order by revenue desc, p.p_brand, p.p_type limit 100",
    "star_q25": f"select p.p_partkey, s.s_suppkey, sum(l.l_extendedprice) as sold, sum(r.l_extendedprice * r.l_discount) as loss, count(*) as n from lineitem l join lineitem r on l.l_orderkey = r.l_orderkey and l.l_partkey = r.l_partkey and l.l_suppkey = r.l_suppkey {_FROM['o']} {_FROM['p']} {_FROM['s']} where r.l_returnflag = 'R' and o.o_orderdate >= date '1996-01-01' and o.o_orderdate < date '1997-01-01' and r.l_shipdate >= date '1996-01-01' group by p.p_partkey, s.s_suppkey order by p.p_partkey, sold, s.s_suppkey limit 100",
    "star_q43": f"select s.s_name, s.s_suppkey, {_WEEK} {_from('ls')} where l.l_shipdate >= date '1997-01-01' and l.l_shipdate < date '1998-01-01' group by s.s_name, s.s_suppkey order by s.s_name, s.s_suppkey limit 100",
    "star_q46": f"select c.c_custkey, c.c_name, n.n_name, sum(l.l_extendedprice) as total_spend {_from('locns')} where l.l_shipdate >= date '1996-01-01' and l.l_shipdate < date '1998-01-01' and l.l_quantity >= 20 group by c.c_custkey, c.c_name, n.n_name order by total_spend desc, c.c_custkey limit 100",
    "star_q55": f"select p.p_brand, sum(l.l_extendedprice) as total_revenue {_from('lp')} where l.l_shipdate >= date '1997-06-01' and l.l_shipdate < date '1997-07-01' and p.p_size <= 25 group by p.p_brand order by total_revenue desc, p.p_brand limit 100",
    "star_q96": "select count(*) as order_count from events e join customer c on e.user_id = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey where hour(e.ts) = 14 and n.n_regionkey = 3",
    "load_type_filter": "select event_id, user_id, event_type, value from events where event_type = 'purchase' order by event_id limit 1000",
    "load_time_range": "select event_id, user_id, ts from events where ts >= {ts}'2024-01-05 00:00:00' and ts < {ts}'2024-01-06 00:00:00' order by ts, event_id limit 1000",
    "load_count": "select count(*) as n from events",
    "load_group_avg_len": "select event_type, count(*) as n, avg(length(props)) as avg_len from events group by event_type",
    "load_distinct": "select count(*) as row_count, count(distinct user_id) as distinct_users, count(distinct event_type) as event_types from events",
    "summary_pivot": "select event_type, round(avg(case when user_id % 2 = 0 then value end), 1) as even_avg, round(avg(case when user_id % 2 = 1 then value end), 1) as odd_avg, round(100.0 * (avg(case when user_id % 2 = 1 then value end) - avg(case when user_id % 2 = 0 then value end)) / avg(case when user_id % 2 = 0 then value end), 1) as pct_change from events group by event_type",
    "derived_count": "select count(*) as n_groups, max(n) as largest from (select event_type, user_id, count(*) as n from events group by 1, 2) q",
}
_TABLES = ("lineitem", "orders", "customer", "supplier", "part", "nation", "events")


def _run(name: str):
    text = SQL[name].replace("{dow}", "(dayofweek(l.l_shipdate) - 1)").replace("{ts}", "timestamp_ntz")
    for t in _TABLES:  # tables are passed in as DataFrames, so nothing is registered in the session
        for keyword in ("from", "join"):
            text = text.replace(f"{keyword} {t}", f"{keyword} {{{t}}}")
    used = [t for t in _TABLES if "{" + t + "}" in text]
    return lambda spark, sf_dir: spark.sql(text, **{t: read(spark, sf_dir, t) for t in used})


def latency_percentiles(samples: DataFrame, label: str, latency: str) -> DataFrame:
    """Exact percentiles with linear interpolation, mean and count by label."""
    p = F.percentile(latency, F.array(*[F.lit(q) for q in (0.5, 0.9, 0.95, 0.99)]))
    out = samples.groupBy(label).agg(p.alias("p"), F.count("*").alias("n"), F.avg(latency).alias("mean"))
    return out.select(label, "n", F.round("mean", 4).alias("mean"), *[F.round(F.col("p")[i], 4).alias(c) for i, c in enumerate(("p50", "p90", "p95", "p99"))])


def load_summary(samples: DataFrame, label: str, ok: Column, at: str) -> DataFrame:
    """Per label: samples, share of errors in percent, and samples a second from the first to the last (null for an instant)."""
    seconds = F.timestamp_diff("MICROSECOND", F.min(at), F.max(at)) / 1e6
    out = samples.groupBy(label).agg(F.count("*").alias("n"), F.avg(F.when(ok, 0.0).otherwise(100.0)).alias("e"), seconds.alias("s"))
    return out.select(label, "n", F.round("e", 4).alias("error_pct"), F.round(F.try_divide("n", "s"), 6).alias("per_second"))


def median_of_runs(times: DataFrame, keys: list[str], value: str, warmups: int = 1) -> DataFrame:
    """Median time of each query and phase over its runs, the first `warmups` dropped (keys, run, value), and the change to the first phase."""
    kept = times.where(F.col("run") >= warmups)
    return kept.groupBy(*keys).agg(F.count("*").alias("runs"), F.round(F.percentile(value, F.lit(0.5)), 4).alias("median"))


QUERIES = {name: _run(name) for name in SQL} | {
    "load_percentiles": lambda spark, sf_dir: latency_percentiles(read(spark, sf_dir, "events"), "event_type", "value"),
    "load_summary": lambda spark, sf_dir: load_summary(read(spark, sf_dir, "events").withColumn("client", F.col("user_id") % 7), "client", F.col("event_type") != "error", "ts"),
    "agg_median_of_runs": lambda spark, sf_dir: median_of_runs(read(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("query"), "event_type", (F.col("event_id") % 4).alias("run"), "value"), ["query", "event_type"], "value"),
}
ORACLES = {name: sql.replace("{dow}", "dayofweek(l.l_shipdate)").replace("{ts}", "timestamp ") for name, sql in SQL.items()}
ORACLES["load_percentiles"] = "select event_type, count(*) as n, round(avg(value), 4) as mean, " + ", ".join(f"round(quantile_cont(value, {q}), 4) as {c}" for c, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))) + " from events group by event_type"
ORACLES["load_summary"] = "select user_id % 7 as client, count(*) as n, round(avg(case when event_type <> 'error' then 0.0 else 100.0 end), 4) as error_pct, round(count(*) / (date_diff('microsecond', min(ts), max(ts)) / 1e6), 6) as per_second from events group by 1"
ORACLES["agg_median_of_runs"] = "select user_id % 5 as query, event_type, count(*) as runs, round(median(value), 4) as median from events where event_id % 4 >= 1 group by 1, 2"
