"""Decisions over table states: policy actions, triggers, priorities, heat, feedback and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Policy defaults.
POLICY = {
    "max_small_file_ratio": 0.3, "max_file_count": 10_000, "max_snapshots": 100, "snapshot_retention_hours": 168, "orphan_retention_hours": 72,
    "commit_trigger": 50, "file_trigger": 500, "time_trigger_minutes": 30, "size_trigger_bytes": 1 << 30,
}
GIB = 1 << 30


def _clamp(x: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def policy_actions(reports: DataFrame, policy: dict = POLICY) -> DataFrame:
    """Actions a table's report asks for, with priority; orphan removal always, nothing when disabled."""
    p = POLICY | policy
    by_ratio, by_count = F.col("small_ratio") > p["max_small_file_ratio"], F.col("file_count") > p["max_file_count"]
    action = lambda when, name, priority: F.when(when, F.struct(F.lit(name).alias("action"), F.lit(priority).alias("priority")))
    every = F.array(action(by_ratio, "compact", 10), action(~by_ratio & by_count, "compact", 8), action(F.col("snapshot_count") > p["max_snapshots"], "expire", 7), action(F.lit(True), "remove_orphans", 3))
    return reports.where("enabled").select("tbl", F.explode(F.filter(every, lambda a: a.isNotNull())).alias("a")).select("tbl", "a.action", "a.priority")


def triggers(states: DataFrame, now: Column, policy: dict = POLICY, mode: str = "any") -> DataFrame:
    """Which triggers fire and whether the table is due; a threshold of 0 disables; with none, file count decides."""
    p = POLICY | policy
    age = F.timestamp_diff("SECOND", F.col("last_compaction"), now)
    all_ = {
        "by_commits": (p["commit_trigger"], F.col("commits_since") >= p["commit_trigger"]), "by_files": (p["file_trigger"], F.col("small_files") >= p["file_trigger"]),
        "by_time": (p["time_trigger_minutes"], F.col("last_compaction").isNull() | (age >= 60 * p["time_trigger_minutes"])), "by_size": (p["size_trigger_bytes"], F.col("uncompacted_bytes") >= p["size_trigger_bytes"]),
    }
    active = {k: c for k, (t, c) in all_.items() if t > 0} or {"by_files": F.col("small_files") >= p["max_file_count"]}
    conds = list(active.values())
    fired = conds[0]
    for c in conds[1:]:
        fired = (fired | c) if mode == "any" else (fired & c)
    return states.withColumns({k: active.get(k, F.lit(False)) for k in all_}).withColumn("fired", fired)


def schedule_priority(now: Column) -> Column:
    """Urgency of a table: files, commits, age, bytes, health and heat boost."""
    hours = F.timestamp_diff("SECOND", F.col("last_compaction"), now) / 3600
    return (
        F.least(F.col("small_files") / 1000, F.lit(5.0)) * 25 + F.least(F.col("commits_since") / 100, F.lit(5.0)) * 20
        + F.when(F.col("last_compaction").isNull(), F.lit(75.0)).otherwise(F.least(hours / 24, F.lit(5.0)) * 15)
        + F.least(F.col("uncompacted_bytes") / GIB, F.lit(10.0)) * 10 + (1.0 - F.col("health_score")) * 30 + F.col("boost")
    )


def ranked(states: DataFrame, now: Column, most: int) -> DataFrame:
    """The most urgent tables, by falling priority: a top-k."""
    return states.select("tbl", F.round(schedule_priority(now), 6).alias("priority")).orderBy(F.desc("priority"), "tbl").limit(most)


def in_window(minute: Column, start: int | None, end: int | None) -> Column:
    """Whether a minute of the day is in a maintenance window, which may cross midnight; no window is always open."""
    if start is None or end is None:
        return F.lit(True)
    return (minute >= start) & (minute <= end) if start <= end else (minute >= start) | (minute <= end)


def access_stats(events: DataFrame, now: Column) -> DataFrame:
    """Clients, last access and decayed counts of the last 1, 6 and 24 hours per table."""
    age = F.timestamp_diff("MICROSECOND", F.col("ts"), now) / 1e6
    decayed = lambda h: F.sum(F.when(age <= 3600 * h, F.exp(-F.lit(DECAY) * age)).otherwise(0.0)).alias(f"decayed_{h}h")
    return events.where(F.col("ts") <= now).groupBy("tbl").agg(F.count("*").alias("total"), F.countDistinct("client").alias("clients"), F.max("ts").alias("last_access"), F.min(age).alias("age"), decayed(1), decayed(6), decayed(24))


#: Fixed value: decay per second, a half-life of six hours.
DECAY = 0.6931471805599453 / 21600


def latency_ema(events: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Exponential moving average of latencies in order of time; values that aren't positive are ignored, the first seeds.

    The closed form of the fold: each value's weight follows from its rank, so
    that partial sums can be combined and no table's history is held at once.
    """
    newest = Window.partitionBy("tbl").orderBy(F.desc("ts"), F.desc("event_id"))
    ranked = events.where(F.col("latency") > 0).withColumn("back", F.row_number().over(newest) - 1)
    first = F.max("back").over(Window.partitionBy("tbl"))
    weight = F.pow(F.lit(1 - alpha), F.col("back")) * F.when(F.col("back") == first, 1.0).otherwise(alpha)
    return ranked.select("tbl", (F.col("latency") * weight).alias("w")).groupBy("tbl").agg(F.sum("w").alias("ema"))


def heat(events: DataFrame, now: Column, hot_qph: float = 100.0, warm_qph: float = 10.0, adjust: float = 1.0) -> DataFrame:
    """Heat from 0 to 1, tier, and the priority boost of a table."""
    rows = access_stats(events, now).join(latency_ema(events.where(F.col("ts") <= now)), "tbl", "left")
    score = 0.60 * F.least(F.col("decayed_24h") / 24.0 / max(hot_qph, 1), F.lit(1.0)) + 0.25 * F.exp(-F.lit(DECAY) * F.col("age")) + 0.15 * F.least(F.coalesce("ema", F.lit(0.0)) / 5000.0, F.lit(1.0))
    tier = F.when(F.col("decayed_1h") >= hot_qph, "hot").when(F.col("decayed_1h") >= warm_qph, "warm").otherwise("cold")
    rows = rows.withColumn("heat", _clamp(score * adjust, 0.0, 1.0)).withColumn("tier", tier)
    boost = F.when(F.col("tier") == "hot", 60.0 + F.col("heat") * 40.0).when(F.col("tier") == "warm", F.col("heat") * 30.0).otherwise(0.0)
    return rows.select("tbl", F.round("heat", 4).alias("heat"), "tier", F.bround(_clamp(boost * adjust, 0.0, 100.0), 2).alias("boost"))


def adaptive_policy(rows: DataFrame, policy: dict = POLICY) -> DataFrame:
    """Thresholds of a table from its `tier` and `feedback` multiplier; hot tables retain less, cold ones longer."""
    p = POLICY | policy
    m = F.when(F.col("tier") == "hot", 0.5).when(F.col("tier") == "warm", 1.0).otherwise(3.0) * F.col("feedback")
    scaled = {k: F.greatest(F.lit(1), F.floor(F.lit(p[k]) * m)).cast("long") for k in ("commit_trigger", "file_trigger", "time_trigger_minutes", "max_file_count")}
    factor = F.when(F.col("tier") == "hot", F.greatest(m, F.lit(0.25))).when(F.col("tier") == "cold", F.least(m, F.lit(5.0))).otherwise(1.0)
    least = F.when(F.col("tier") == "hot", 1).otherwise(0)
    keep = {k: F.greatest(least, F.floor(F.lit(p[k]) * factor)).cast("long") for k in ("snapshot_retention_hours", "orphan_retention_hours")}
    return rows.select("tbl", *[c.alias(k) for k, c in (scaled | keep).items()], F.round(_clamp(F.lit(p["max_small_file_ratio"]) * m, 0.05, 0.95), 6).alias("max_small_file_ratio"))


def effectiveness(pairs: DataFrame) -> DataFrame:
    """Score of a compaction from the figures before (b_) and after (a_): files, small files, latency, average size."""
    cut = lambda c: F.when(F.col(f"b_{c}") > 0, (F.col(f"b_{c}") - F.col(f"a_{c}")) / F.col(f"b_{c}")).otherwise(0.0)
    score = 0.35 * _clamp(cut("files")) + 0.25 * _clamp(cut("small")) + 0.25 * _clamp(cut("latency")) + 0.15 * _clamp(-cut("size"))
    return pairs.withColumn("score", F.bround(_clamp(score), 4))


def recommendation(history: DataFrame, now: Column, lookback_hours: int = 24, fallback: int = 3, last: int = 5, least: int = 3, poor: float = -0.5) -> DataFrame:
    """Per table (tbl, ts, seq, score): average and trend of recent scores, threshold multiplier, priority factor, and whether to skip it.

    Recent are the scores of the last `lookback_hours`, or the `fallback` newest
    where there are none; the trend compares the halves of these.  The factor
    goes by the `last` newest scores; a table with `least` recent scores that
    are poor on average is skipped.
    """
    newest = Window.partitionBy("tbl").orderBy(F.desc("ts"), F.desc("seq"))
    near = (F.col("ts") >= now - F.expr(f"interval {lookback_hours} hours")) & (F.col("ts") <= now)
    ranked = history.withColumn("back", F.row_number().over(newest)).withColumn("near", near).withColumn("any_near", F.bool_or("near").over(Window.partitionBy("tbl")))
    recent = ranked.where(F.when(F.col("any_near"), F.col("near")).otherwise(F.col("back") <= fallback)).withColumn("i", F.row_number().over(newest))
    n = F.count("*").over(Window.partitionBy("tbl"))
    recent = recent.withColumn("first", F.col("i") > n - F.floor(n / 2))
    g = recent.groupBy("tbl").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"), F.avg(F.when(F.col("first"), F.col("score"))).alias("early"), F.avg(F.when(~F.col("first"), F.col("score"))).alias("late"))
    factor = ranked.where(F.col("back") <= last).groupBy("tbl").agg(_clamp(1.0 + F.avg("score") / 2, 0.3, 2.0).alias("factor"))
    trend = F.when(F.col("n") < 2, "stable").when(F.col("late") > F.col("early") + 0.1, "improving").when(F.col("late") < F.col("early") - 0.1, "degrading").otherwise("stable")
    a = F.col("avg_score")
    multiplier = F.when(a > 0.5, 0.7).when(a > 0.2, 0.85).when(a > -0.1, 1.0).when(a > -0.5, 1.5).otherwise(2.0)
    return g.join(factor, "tbl").select("tbl", "n", F.round("avg_score", 6).alias("avg_score"), trend.alias("trend"), multiplier.alias("multiplier"), F.round("factor", 6).alias("priority_factor"), ((F.col("n") >= least) & (a < poor)).alias("skip"))


def partition_recommendations(stats: DataFrame, least_files: int = 5, ratio: float = 0.3) -> DataFrame:
    """Compact crowded partitions, prune empty ones (part, file_count, small_count, total_bytes)."""
    share = F.col("small_count") / F.col("file_count")
    compact = F.when(share > ratio, F.struct(F.lit("compact").alias("action"), (share * 100 + F.col("small_count")).alias("priority")))
    prune = F.when((F.col("total_bytes") == 0) & (F.col("file_count") > 0), F.struct(F.lit("prune").alias("action"), F.lit(10.0).alias("priority")))
    return stats.where(F.col("file_count") >= least_files).select("part", F.explode(F.filter(F.array(compact, prune), lambda a: a.isNotNull())).alias("a")).select("part", "a.action", F.round("a.priority", 4).alias("priority"))


#: Dollars per 1,000 writes and reads, per GB shipped and per GB compacted, and GB in an output file.
PUT_1K, GET_1K, SHIP_GB, COMPUTE_GB, OUT_GB = 0.005, 0.0004, 0.02, 0.001, 0.128


def region_costs(tables: DataFrame) -> DataFrame:
    """Cost of compacting in both regions, of compacting once and shipping, and of one region only (tbl, data_gb, files)."""
    outputs = F.greatest(F.lit(1), F.floor(F.col("data_gb") / OUT_GB))
    compact = F.bround(F.col("data_gb") * COMPUTE_GB + F.col("files") / 1000 * GET_1K + outputs / 1000 * PUT_1K, 4)
    ship = F.bround(F.col("data_gb") * SHIP_GB + outputs / 1000 * PUT_1K, 4)
    #: The names of the two outcomes.
    out = tables.select("tbl", F.round(compact * 2, 4).alias("both_regions"), F.round(compact + ship, 4).alias("shipped"), compact.alias("one_region"))
    return out.withColumn("winner", F.when(F.col("both_regions") < F.col("shipped"), "compact both").otherwise("compact+ship"))


def due_tables(registry: DataFrame, now: Column, most: int) -> DataFrame:
    """The tables due for maintenance, longest overdue first: a top-k."""
    return registry.where(F.col("next_at") <= now).orderBy("next_at", "tbl").limit(most)
