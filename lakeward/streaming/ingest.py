"""Streams into tables, and windowed views of commit and access streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import Table, Warehouse

EVENTS = "event_id string, event_type string, user_id string, payload string, event_time timestamp"


def json_events(spark: SparkSession, source: str, schema: str = EVENTS, **options: str) -> DataFrame:
    """JSON events of a folder of files, or of a `kafka` topic where the connector is present."""
    if source == "kafka":
        raw = spark.readStream.format("kafka").options(**options).load().select(F.col("value").cast("string").alias("value"))
    else:
        raw = spark.readStream.format("text").options(**options).load(source)
    return raw.select(F.from_json("value", schema).alias("e")).select("e.*").where("event_id is not null")


def ingest(events: DataFrame, wh: Warehouse, ident: tuple[str, str], checkpoint: str, query_id: str, interval: str | None = None, on_commit: Callable[[Table], None] | None = None) -> StreamingQuery:
    """Append a stream to a table, a commit per batch; a batch that was committed before a restart is not committed again.

    `on_commit` is called after each commit, for maintenance that follows commits.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        table = wh.append(ident, batch.withColumn("ingested_at", F.current_timestamp()) if "ingested_at" in wh.load(ident).schema.names else batch, {"query_id": query_id, "batch_id": str(batch_id)})
        if on_commit:
            on_commit(table)

    writer = events.withWatermark("event_time", "5 seconds").writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def commit_rates(commits: DataFrame, window: str = "24 hours", slide: str | None = "15 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Commits per table and window of a stream (tbl, ts, own): sliding, or tumbling without a slide."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return commits.where(~F.col("own")).withWatermark("ts", lateness).groupBy("tbl", span.alias("w")).agg(F.count("*").alias("commits")).select("tbl", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "commits")


def access_sessions(accesses: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Bursts of accesses per table of a stream (tbl, ts, latency)."""
    return accesses.withWatermark("ts", lateness).groupBy("tbl", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("accesses"), F.avg("latency").alias("latency")).select("tbl", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "accesses", "latency")


def streaming_heat(accesses: DataFrame, half_life_hours: float = 6.0) -> DataFrame:
    """Decayed access count per table, kept as state: (tbl, seconds, latency) rows in, the state after each batch out."""
    import math

    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    decay = math.log(2) / (half_life_hours * 3600)

    def fold(key: tuple, batches, state: GroupState):
        at, score, ema = state.get if state.exists else (0.0, 0.0, -1.0)
        rows = pd.concat(list(batches)).sort_values("seconds", kind="stable")
        seconds, latency = rows["seconds"].to_numpy(float), rows["latency"].to_numpy(float)
        newest = max(at, float(seconds.max()))  # late events, too, are decayed to the present
        score = score * math.exp(-decay * (newest - at)) + float(np.exp(-decay * (newest - seconds)).sum())
        at = newest
        found = latency[latency > 0]  # each value's weight follows from its rank
        if len(found):
            weights = 0.1 * 0.9 ** np.arange(len(found) - 1, -1, -1.0)
            first = float(found[0]) if ema < 0 else 0.9 * ema + 0.1 * float(found[0])
            ema = first * 0.9 ** (len(found) - 1) + float((weights[1:] * found[1:]).sum())
        state.update((at, score, ema))
        yield pd.DataFrame({"tbl": [key[0]], "seconds": [at], "decayed": [score], "ema": [ema]})

    return accesses.groupBy("tbl").applyInPandasWithState(fold, "tbl long, seconds double, decayed double, ema double", "at double, score double, ema double", "update", GroupStateTimeout.NoTimeout)
