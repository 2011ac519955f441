"""Small shared state of maintenance: breakers and pauses, leases, jobs, the registry of tables, and concurrency slots."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..sources.store import Conflict, Store


class Paused(Exception):
    """Maintenance of the table is stopped until an operator resumes it."""


class Breakers:
    """Counters of a table's runs; a fatal finding writes a pause, a soft one asks to skip."""

    def __init__(self, store: Store, max_failures: int = 3, max_loops: int = 3, daily_bytes: int = 0, lifetime_ratio: float = 0, min_roi: float = 0.1, ratio_pause: float = 0.5, ratio_from: int = 64 << 20):
        self.ratio_from = ratio_from  # smaller tables are mostly metadata
        self.store, self.max_failures, self.max_loops, self.daily_bytes, self.lifetime_ratio, self.min_roi, self.ratio_pause = store, max_failures, max_loops, daily_bytes, lifetime_ratio, min_roi, ratio_pause

    def _state(self, table: str) -> dict:
        key = f"_state/tables/{table}.json"
        return self.store.read(key) if self.store.exists(key) else {"failures": 0, "loops": 0, "paths": [], "day_from": None, "day_bytes": 0, "lifetime": 0, "runs": 0}

    def status(self, table: str) -> dict:
        key = f"_state/paused/{table}.json"
        return self._state(table) | {"paused": self.store.read(key) if self.store.exists(key) else None}

    def preflight(self, table: str) -> None:
        """Raise if the table is paused; a state that cannot be read raises too."""
        pause = self.status(table)["paused"]
        if pause:
            raise Paused(pause["reason"])

    def pause(self, table: str, reason: str) -> None:
        if not reason.strip():
            raise ValueError("a pause needs a reason")
        self.store.put(f"_state/paused/{table}.json", {"reason": reason, "at": int(time.time() * 1000)})

    def resume(self, table: str) -> None:
        self.store.delete(f"_state/paused/{table}.json")
        self.store.put(f"_state/tables/{table}.json", self._state(table) | {"failures": 0, "loops": 0})

    def record(self, table: str, ok: bool, now_ms: int, outcome: dict | None = None, metadata_bytes: int = 0, data_bytes: int = 0) -> list[str]:
        """Record a run; returns the soft findings, raises Paused on a fatal one."""
        s, fatal, soft = self._state(table), [], []
        s["runs"] += 1
        s["failures"] = 0 if ok else s["failures"] + 1
        if not ok and s["failures"] >= self.max_failures:
            fatal.append(f"{s['failures']} consecutive failed runs")
        notes = (outcome or {}).get("notes", {})
        paths = sorted(notes.get("paths", []))
        s["loops"] = (s["loops"] + 1 if paths == sorted(s["paths"]) else 1) if paths else 0
        s["paths"] = paths
        if s["loops"] >= self.max_loops:
            fatal.append(f"the same {len(paths)} files were compacted {s['loops']} times in a row")
        if data_bytes > self.ratio_from and metadata_bytes / data_bytes >= self.ratio_pause:
            fatal.append(f"metadata is {metadata_bytes / data_bytes:.0%} of the data")
        if paths and outcome:
            read, written = notes.get("bytes_read", 0), notes.get("bytes_written", 0)
            less = outcome["before_files"] - outcome["after_files"]
            if less <= 0:
                soft.append("compaction did not reduce files")
            elif read and less * 102_400 / read < self.min_roi:
                soft.append("compaction gains little for the bytes it reads")
            if s["day_from"] is None or now_ms - s["day_from"] > 86_400_000:
                s["day_from"], s["day_bytes"] = now_ms, 0
            s["day_bytes"] += written
            s["lifetime"] += written
            if self.daily_bytes and s["day_bytes"] > self.daily_bytes:
                soft.append("daily bytes exceed the budget")
            if self.lifetime_ratio and data_bytes and s["lifetime"] / data_bytes > self.lifetime_ratio:
                fatal.append("the table was rewritten too often")
        self.store.put(f"_state/tables/{table}.json", s)
        if fatal:
            self.pause(table, "; ".join(fatal))
            raise Paused("; ".join(fatal))
        return soft


@dataclass
class Lease:
    """An exclusive claim that ends by itself."""

    key: str
    nonce: str
    owner: str
    expires_ms: int

    def stale(self, now_ms: int, grace_ms: int = 60_000) -> bool:
        return now_ms > self.expires_ms + grace_ms


class LeaseHeld(Exception):
    def __init__(self, lease: Lease):
        super().__init__(f"held by {lease.owner}")
        self.lease = lease


class Leases:
    def __init__(self, store: Store):
        self.store = store

    def read(self, name: str) -> Lease | None:
        key = f"_state/leases/{name}.json"
        return Lease(**self.store.read(key)) if self.store.exists(key) else None

    def acquire(self, name: str, owner: str, ttl_ms: int = 900_000, now_ms: int | None = None) -> Lease:
        """Take the lease, also over a stale one; one of several takers wins."""
        now = now_ms or int(time.time() * 1000)
        held = self.read(name)
        if held and held.stale(now):
            try:  # whoever creates the marker for this nonce may remove the stale lease
                self.store.create(f"_state/leases/stale/{held.nonce}.json", {"by": owner})
            except Conflict:
                raise LeaseHeld(held) from None
            self.store.delete(held.key)
        lease = Lease(f"_state/leases/{name}.json", uuid.uuid4().hex, owner, now + ttl_ms)
        try:
            self.store.create(lease.key, lease.__dict__)
        except Conflict:
            raise LeaseHeld(self.read(name) or lease) from None
        return lease

    def renew(self, lease: Lease, ttl_ms: int = 900_000) -> Lease:
        if (held := self.read(lease.key.split("/")[-1].removesuffix(".json"))) is None or held.nonce != lease.nonce:
            raise LeaseHeld(held or lease)
        lease.expires_ms = int(time.time() * 1000) + ttl_ms
        self.store.put(lease.key, lease.__dict__)
        return lease

    def release(self, lease: Lease) -> bool:
        """Give the lease back; only its holder can, and twice does nothing."""
        held = self.read(lease.key.split("/")[-1].removesuffix(".json"))
        return self.store.delete(lease.key) if held and held.nonce == lease.nonce else False


class Jobs:
    """Background operations with records that other processes can read; one of a kind per table at a time."""

    def __init__(self, store: Store, workers: int = 4):
        self.store, self.pool, self.leases, self.lock = store, ThreadPoolExecutor(workers), Leases(store), threading.Lock()

    def get(self, job: str) -> dict | None:
        key = f"_state/jobs/{job}.json"
        return self.store.read(key) if self.store.exists(key) else None

    def submit(self, operation: str, table: str, run: Callable[[], object]) -> tuple[str, bool]:
        """Job id and whether it is new."""
        with self.lock:
            try:
                lease = self.leases.acquire(f"{operation}-{table}", uuid.uuid4().hex, 3_600_000)
            except LeaseHeld as e:
                return e.lease.owner, False
            record = {"id": lease.owner, "operation": operation, "table": table, "status": "pending", "at": int(time.time() * 1000)}
            self.store.put(f"_state/jobs/{lease.owner}.json", record)

        def work() -> None:
            save = lambda **x: self.store.put(f"_state/jobs/{lease.owner}.json", record | x | {"heartbeat": int(time.time() * 1000)})
            save(status="running")
            try:
                result = run()
                save(status="completed", result=str(result))
            except Exception as e:  # the record carries whatever ended the job
                save(status="failed", error=f"{type(e).__name__}: {e}")
            finally:
                self.leases.release(lease)

        self.pool.submit(work)
        return lease.owner, True

    def wait(self, job: str, seconds: float = 120) -> dict:
        end = time.time() + seconds
        while (record := self.get(job)) and record["status"] in ("pending", "running") and time.time() < end:
            time.sleep(0.05)
        return record


class Registry:
    """Tables under maintenance and when each is due."""

    def __init__(self, store: Store):
        self.store = store

    def save(self, table: str, kind: str, last_ms: int, next_min: int) -> None:
        self.store.put(f"_state/registry/{table}.json", {"tbl": table, "class": kind, "last_ms": last_ms, "next_ms": last_ms + 60_000 * next_min})

    def delete(self, table: str) -> bool:
        return self.store.delete(f"_state/registry/{table}.json")

    def rows(self) -> DataFrame:
        found = [self.store.read(f"_state/registry/{n}") for n, folder, _, _ in self.store.names("_state/registry") if not folder and n.endswith(".json")]
        return self.store.spark.createDataFrame([(r["tbl"], r["class"], r["last_ms"], r["next_ms"]) for r in found], "tbl string, class string, last_ms long, next_ms long")

    def due(self, now_ms: int, most: int = 10) -> DataFrame:
        return self.rows().where(f"next_ms <= {now_ms}").orderBy("next_ms", "tbl").limit(most)


class Slots:
    """At most so many operations at a time."""

    def __init__(self, most: int = 2):
        self._free = threading.Semaphore(most)

    @contextmanager
    def slot(self):
        """Yields whether a slot was free; it is given back exactly if it was taken."""
        got = self._free.acquire(blocking=False)
        try:
            yield got
        finally:
            if got:
                self._free.release()
