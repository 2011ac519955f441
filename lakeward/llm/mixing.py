"""Mixing sources to target weights by a low-discrepancy source schedule (DataFrame functions only).

Every document gets an interval of its source's shuffled word stream; the
stream is cut into blocks of `BLOCK` words, whatever the size of the table.  A
source needs as many slots as blocks make up its target.  Slot n of the mix
takes the point frac((n + 1/2) * golden ratio) and finds the source whose share
of all slots holds it; slots are ranked within their source, and rank r reads
block r modulo the source's blocks.  The points miss a source's number of slots
by a few at most: slots beyond it are dropped, and what is short is added at
the end.  A source's last slot is read up to the word that meets its target.

Defined cases: null text counts no words; documents without words take
nothing; a null source is a source of its own, last in order; repeated rows
are separate documents that lie side by side; rows with equal doc_id are
ordered by their text; an empty table gives an empty mix; extra columns are
ignored, whatever their names; long texts span many blocks.  Targets are
`max_epochs` times a source's words at most, so no document is taken more
often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import Workspace, table

WORD = r"[^\x20\x09-\x0D]+"
PHI = 0.6180339887498949
PHI_2_20 = 0.7888545675668865  # fractional part of 2**20 * PHI
BLOCK = 1024
LANE_ROWS = 5_000
CELLS = 4096


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, the shuffle key (MD5 of doc_id and text), and how many equal rows there are."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(known("doc_id"), F.lit("|"), known("text"))).alias("shuffle_key"),
    )
    return rows.groupBy("doc_id", "source", "size", "shuffle_key").agg(F.count("*").alias("copies"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row per source: its size, weight and target words.

    Targets share all words by weight; a source stops at `max_epochs` times its
    size, and the excess goes to the others by weight until none is above: with
    sources ordered by cap over weight, those before the first whose share
    fits are capped, and the rest split what is left.
    """
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("nth", F.row_number().over(order)).withColumn("weight", F.element_at(cycle, F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("long"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left_words", F.col("total") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
        .withColumn("level", F.col("left_words").cast("double") / F.col("left_weight"))
        .withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
        .withColumn("share", F.max("fits").over(everything))
    )
    capped = F.col("share").isNull() | (F.col("share") * F.col("weight") > F.col("cap"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("share") * F.col("weight"))
    per = per.withColumn("target", target)
    return per.select("source", "nth", "source_size", "target")


def quotas(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds blocks, full passes over them, words of the last pass, slots, and the source's share of all slots."""
    wanted = F.round("target").cast("long")
    own = goals.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.try_divide(wanted, "source_size"))).otherwise(F.lit(0)))
    own = own.withColumn("rest", F.when(F.col("source_size") > 0, wanted - F.col("passes") * F.col("source_size")).otherwise(F.lit(0)))
    own = own.withColumn("quota", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block))
    all_, reach = F.greatest(F.sum("quota").over(Window.partitionBy()), F.lit(1)), Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("quota").over(reach), F.lit(0))
    return own.withColumns({"from_share": before / all_, "to_share": (before + F.col("quota")) / all_})


def place(sized: DataFrame, rows: int) -> DataFrame:
    """doc_id, source, size, key, `at` (the word at which each row starts in its source's shuffled stream) and `tie` (its number among equal rows).

    The shuffle order is cut into lanes of about `LANE_ROWS` rows, so that a
    large source is summed by many tasks; equal rows are one until the end.
    """
    lanes = max(1, min(1 << 20, rows // LANE_ROWS))
    lane = F.floor(F.conv(F.substring("shuffle_key", 1, 5), 16, 10).cast("long") * lanes / (1 << 20))
    sized = sized.withColumn("lane", lane).withColumn("words", F.col("size") * F.col("copies"))
    sums = sized.groupBy("source", "lane").agg(F.sum("words").alias("lane_size"))
    before = Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("lane").alias("l"), F.coalesce(F.sum("lane_size").over(before), F.lit(0)).alias("lane_at"))
    within = Window.partitionBy("source", "lane").orderBy("shuffle_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("in_lane", F.coalesce(F.sum("words").over(within), F.lit(0))).join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("lane") == F.col("l")))
    placed = placed.withColumn("tie", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return placed.select("doc_id", "source", "size", "shuffle_key", (F.col("lane_at") + F.col("in_lane") + F.col("tie") * F.col("size")).alias("at"), "tie")


def schedule(spark: SparkSession, goals: DataFrame, slots: int, block: int = BLOCK) -> DataFrame:
    """The mix's slots in order: slot, source (by number), the block it reads, and the word of the source's stream it stops at.

    The source of a point is found by cells of the unit interval, an equi-join.
    """
    n = F.col("id")
    point = F.pmod((n % F.lit(1 << 20) + 0.5) * PHI + F.floor(n / F.lit(1 << 20)) * PHI_2_20, F.lit(1.0))
    drawn = spark.range(slots).select(n.alias("slot"), point.alias("u"), F.floor(point * CELLS).cast("int").alias("cell"))
    spans = goals.where("quota > 0").select(
        "nth", "from_share", "to_share",
        F.explode(F.sequence(F.floor(F.col("from_share") * CELLS).cast("int"), F.least(F.lit(CELLS - 1), F.floor(F.col("to_share") * CELLS).cast("int")))).alias("cell"),
    )
    hit = drawn.join(spans, "cell").where("u >= from_share and u < to_share")
    # Ranks of a source's slots: lanes of consecutive slots are counted first, then numbered within.
    hit = hit.select("slot", "nth", F.floor(F.col("slot") / 4096).alias("run"))
    runs = hit.groupBy("nth", "run").agg(F.count("*").alias("n"))
    counts = runs.groupBy(F.col("nth").alias("k")).agg(F.sum("n").alias("drawn"))
    runs = runs.select(F.col("nth").alias("k"), F.col("run").alias("r"), F.coalesce(F.sum("n").over(Window.partitionBy("nth").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = hit.withColumn("i", F.row_number().over(Window.partitionBy("nth", "run").orderBy("slot")) - 1).join(runs, (F.col("nth") == F.col("k")) & (F.col("run") == F.col("r")))
    ranked = ranked.select("slot", "nth", (F.col("base") + F.col("i")).alias("rank"))
    short = goals.join(counts, F.col("nth") == F.col("k"), "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).where("drawn < quota")
    short = short.select("nth", "drawn", F.explode(F.sequence("drawn", F.col("quota") - 1)).alias("rank"))
    every = ranked.unionByName(short.select((F.lit(slots) + F.col("rank") - F.col("drawn")).alias("slot"), "nth", "rank"))
    own = goals.select(F.col("nth").alias("k"), "blocks", "passes", "rest", "quota")
    every = every.join(own, F.col("nth") == F.col("k")).where(F.col("rank") < F.col("quota"))
    at = F.pmod("rank", "blocks")
    ends = (at + 1) * block
    return every.select("slot", "nth", at.alias("block"), F.when(F.floor(F.col("rank") / F.col("blocks")) < F.col("passes"), ends).otherwise(F.least(ends, "rest")).alias("upto"))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: words the mix takes of each document."""
    ws = Workspace(spark, "mix")
    sized = ws.save(sizes(docs), "sizes")  # texts are read once
    goals = ws.save(quotas(targets(sized, weights, max_epochs), block), "goals")  # a row a source
    slots, rows = goals.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0], sized.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    placed = place(sized, rows).join(goals.select(F.col("source").alias("g"), "nth", "source_size", "target"), F.col("source").eqNullSafe(F.col("g"))).drop("g")
    reads = schedule(spark, goals, slots, block).groupBy("nth", "block", "upto").agg(F.count("*").alias("times"))
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.greatest(F.col("size"), F.lit(1)) - 1) / block)
    pieces = placed.withColumn("block", F.explode(F.sequence(first, last)))
    inside = F.greatest(F.lit(0), F.least(F.col("at") + F.col("size"), "upto") - F.greatest(F.col("at"), F.col("block") * block))
    taken = F.coalesce(F.sum(F.coalesce(inside * F.col("times"), F.lit(0))), F.lit(0)).cast("long")
    return pieces.join(reads, ["nth", "block"], "left").groupBy("doc_id", "source", "nth", "at", "shuffle_key", "tie", "size", "source_size", "target").agg(taken.alias("taken")).drop("tie", "shuffle_key")


def take(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """The rows of `docs` as often as the mix takes their words, to the nearest whole copy (rows of equal doc_id alike).

    Rows without words are never taken; null doc_ids are equal to one another;
    all columns stay, whatever their names; an empty table stays empty.
    """
    taken = mix(spark, docs, weights, max_epochs).groupBy(F.col("doc_id").alias("taken_id")).agg(F.sum("taken").alias("t"), F.sum("size").alias("s"))
    copies = taken.select("taken_id", F.floor(F.col("t") / F.greatest(F.col("s"), F.lit(1)) + 0.5).cast("int").alias("taken_copies")).where("taken_copies > 0")
    names = docs.columns
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no name clashes
    key = F.col(f"c{names.index('doc_id')}").cast("long")
    out = numbered.join(copies, key.eqNullSafe(F.col("taken_id")))
    return out.withColumn("taken_copy", F.explode(F.sequence(F.lit(1), F.col("taken_copies")))).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def oracle() -> str:
    """The mix without its schedule: a source's target is so many whole passes over its stream, and its first words once more."""
    return f"""
with sized as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size, md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')) as k from documents),
per as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
num as (select *, row_number() over (order by source collate "binary" asc nulls last) as nth from per),
wt as (select *, ((nth - 1) % 3) + 1 as weight, source_size * 3 as cap from num),
lv as (select *, cast(sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, nth rows between unbounded preceding and 1 preceding), 0) as double)
    / cast(sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, nth rows between unbounded preceding and 1 preceding), 0) as double) as level from wt),
sh as (select *, max(case when level * weight <= cap then level end) over () as share from lv),
goal as (select source, source_size, case when share is null or share * weight > cap then cast(cap as double) else share * weight end as target from sh),
quota as (select *, case when source_size > 0 then cast(round(target) as bigint) // source_size else 0 end as passes from goal),
placed as (select doc_id, size, source, cast(coalesce(sum(size) over (partition by source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as bigint) as pos from sized)
select p.doc_id, p.size, q.source_size, q.target, cast(passes * size + greatest(0, least(pos + size, cast(round(target) as bigint) - passes * source_size) - pos) as bigint) as taken
from placed p join quota q on p.source is not distinct from q.source
"""
