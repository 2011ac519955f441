"""Around maintenance: resource estimates, retries, cycles over tables, trigger reports, advice and metrics."""

from __future__ import annotations

import math
import threading
import time
from collections import Counter
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions as dc
from ..operators import files as fl
from ..operators.files import DATA, MIB
from ..sources.store import Conflict
from ..sources.tables import Table, Warehouse
from . import maintain
from .state import Breakers, Paused, Registry, Slots


def estimate(total_bytes: int, target: int = maintain.TARGET, cores: int = 4) -> dict[str, int]:
    """Output files, tasks and executors for a rewrite of so many bytes."""
    files = max(1, math.ceil(total_bytes / target))
    return {"output_files": files, "tasks": max(files, math.ceil(total_bytes / (128 * MIB))), "executors": max(1, math.ceil(files / cores))}


def with_retries(run: Callable[[], Any], attempts: int = 3, wait: float = 0.1) -> tuple[Any, list[str]]:
    """Result of the first run that succeeds and the errors before it; a pause is final."""
    errors: list[str] = []
    for i in range(attempts):
        try:
            return run(), errors
        except Paused:
            raise
        except (Conflict, maintain.VerificationFailed, OSError) as e:
            errors.append(f"{type(e).__name__}: {e}")
            if i + 1 == attempts:
                raise
            time.sleep(wait * 2**i)
    raise AssertionError("unreachable")


class Metrics:
    """Counters of operations, as text lines for a scraper."""

    def __init__(self) -> None:
        self.values: Counter[tuple[str, str]] = Counter()
        self.lock = threading.Lock()

    def add(self, name: str, table: str, n: float = 1) -> None:
        with self.lock:
            self.values[name, table] += n

    def observed(self, rows: DataFrame, name: str) -> DataFrame:
        """Count rows as they pass, without another job."""
        return rows.observe(name, F.count("*").alias("rows"))

    def text(self) -> str:
        return "\n".join(f'lakeward_{n}{{table="{t}"}} {v:g}' for (n, t), v in sorted(self.values.items()))


def cycle(wh: Warehouse, tables: list[tuple[str, str]] | None = None, metrics: Metrics | None = None, now_ms: int | None = None, **options: Any) -> dict[str, dict]:
    """Maintain each table once; a failure or a pause of one doesn't stop the others.  Registers when each is due next."""
    now = now_ms or int(time.time() * 1000)
    wanted = tables or [(p.split("/")[-2].removesuffix(".db"), p.split("/")[-1]) for p, _, _ in wh.discover()]
    out: dict[str, dict] = {}
    for ident in wanted:
        name = ".".join(ident)
        try:
            out[name] = maintain.maintain(wh, ident, now_ms=now, **options)
            plan = maintain.plan_for(out[name]["class"])
            Registry(wh.store).save(name, out[name]["class"], now, plan["next_min"])
        except Paused as e:
            out[name] = {"error": f"paused: {e}", "steps": []}
        if metrics:
            metrics.add("failures" if out[name]["error"] else "runs", name)
            metrics.add("files_removed", name, sum(s.before_files - s.after_files for s in out[name]["steps"]))
    return out


class Controller:
    """Polls for due tables in the background."""

    def __init__(self, wh: Warehouse, every: float = 60.0, most: int = 2, **options: Any):
        self.wh, self.every, self.options, self.slots = wh, every, options, Slots(most)
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def poll(self, now_ms: int | None = None) -> list[str]:
        now = now_ms or int(time.time() * 1000)
        known = {r["tbl"]: r["next_ms"] for r in Registry(self.wh.store).rows().collect()}
        due = [(p.split("/")[-2].removesuffix(".db"), p.split("/")[-1]) for p, _, _ in self.wh.discover()]
        done = []
        for ident in due:
            if known.get(".".join(ident), 0) <= now:
                with self.slots.slot() as free:
                    if free:
                        cycle(self.wh, [ident], now_ms=now, **self.options)
                        done.append(".".join(ident))
        return done

    def _run(self) -> None:
        while not self._stop.wait(self.every):
            self.poll()

    def start(self) -> None:
        self._thread.start()

    def stop(self) -> None:
        self._stop.set()
        self._thread.join(timeout=self.every + 60)


def trigger_report(table: Table, now_ms: int, small: int = 64 * MIB, policy: dict | None = None) -> DataFrame:
    """Which triggers of a table fire, from its files and its commits since the last compaction."""
    done = [s for s in table.meta["snapshots"] if s["summary"].get("maintenance", "").startswith("compact")]
    last = done[-1]["ts_ms"] if done else None
    since = [s for s in table.meta["snapshots"] if last is None or s["ts_ms"] > last]
    state = table.entries().where(F.col("content") == DATA).agg(F.count_if(F.col("file_bytes") < small).alias("small_files"), F.coalesce(F.sum(F.when(F.col("file_bytes") < small, F.col("file_bytes"))), F.lit(0)).alias("uncompacted_bytes"))
    stamp = lambda ms: F.timestamp_millis(F.lit(ms)).cast("timestamp_ntz")
    state = state.withColumns({"tbl": F.lit(".".join(table.ident)), "commits_since": F.lit(len(since)), "last_compaction": stamp(last) if last else F.lit(None).cast("timestamp_ntz")})
    return dc.triggers(state, stamp(now_ms), policy or {})


def suggest_layout(table: Table, crowded: int = 100) -> list[dict]:
    """Advice on sort order and partition granularity."""
    out = [] if table.meta["sort"] else [{"suggestion": "add_sort_order", "estimated_improvement": "high"}]
    found = [r["part"] for r in fl.crowded_partitions(table.entries().where(F.col("content") == DATA), crowded, 10).collect()]
    return out + ([{"suggestion": "review_partition_granularity", "estimated_improvement": "medium", "partitions": found}] if found else [])


def table_report(table: Table, small: int = 64 * MIB) -> DataFrame:
    """Health of a table's current snapshot."""
    sizes = [(table.warehouse.store.fs.getContentSummary(table.warehouse.store._path(table.warehouse.store.at(f"{table.key}/metadata/{m['path']}"))).getLength(),) for m in table.manifests()]
    return fl.table_health(table.entries().where(F.col("content") == DATA), table.spark.createDataFrame(sizes, "manifest_bytes long"), small)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark or load-test results from CSV files with a header."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def status(wh: Warehouse, ident: tuple[str, str]) -> dict:
    """Version, snapshots, breaker counters and pause of a table."""
    t = wh.load(ident)
    return {"table": ".".join(ident), "version": t.version, "snapshots": len(t.meta["snapshots"])} | Breakers(wh.store).status(t.meta["uuid"])
