"""Command line: python -m lakeward WAREHOUSE COMMAND [NAMESPACE.TABLE] [options]."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans import control, maintain
from .plans.state import Breakers
from .sources.literals import parse_partition, parse_size
from .sources.tables import Warehouse

COMMANDS = ("discover", "analyze", "compact", "compact-hot", "compact-cold", "expire", "rewrite-manifests", "orphans", "maintain", "import", "pause", "resume", "status", "triggers")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="lakeward", description=__doc__)
    p.add_argument("warehouse")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("table", nargs="?", help="namespace.table")
    p.add_argument("--partition", type=parse_partition, help="column=value[,column=value]")
    p.add_argument("--target", type=parse_size, default=maintain.TARGET, help="such as 128MB")
    p.add_argument("--keep-last", type=int, default=5)
    p.add_argument("--keep-hours", type=float, default=168)
    p.add_argument("--older-than-hours", type=float, default=72)
    p.add_argument("--mode", choices=("hot", "cold", "full"))
    p.add_argument("--folder", help="Parquet files to import")
    p.add_argument("--reason", default="")
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args(argv)
    if a.command != "discover" and (not a.table or "." not in a.table):
        p.error("the command needs namespace.table")
    wh = Warehouse(spark or SparkSession.builder.appName("lakeward").getOrCreate(), a.warehouse)
    ident = tuple(a.table.split(".", 1)) if a.table else ("", "")
    run = {
        "discover": lambda: wh.discover(), "analyze": lambda: control.table_report(wh.load(ident)).first().asDict(), "compact": lambda: maintain.compact(wh, ident, a.partition, a.target, dry_run=a.dry_run),
        "compact-hot": lambda: maintain.compact_hot(wh, ident, dry_run=a.dry_run), "compact-cold": lambda: maintain.compact_cold(wh, ident, dry_run=a.dry_run),
        "expire": lambda: maintain.expire(wh, ident, a.keep_last, a.keep_hours, dry_run=a.dry_run), "rewrite-manifests": lambda: maintain.rewrite_manifests(wh, ident, dry_run=a.dry_run),
        "orphans": lambda: maintain.remove_orphans(wh, ident, a.older_than_hours, dry_run=a.dry_run), "maintain": lambda: maintain.maintain(wh, ident, a.mode, a.dry_run),
        "import": lambda: wh.import_folder(ident, a.folder).version, "pause": lambda: Breakers(wh.store).pause(wh.load(ident).meta["uuid"], a.reason), "resume": lambda: Breakers(wh.store).resume(wh.load(ident).meta["uuid"]),
        "status": lambda: control.status(wh, ident), "triggers": lambda: control.trigger_report(wh.load(ident), maintain.time.time_ns() // 10**6).first().asDict(),
    }[a.command]
    print(json.dumps(run(), default=lambda x: getattr(x, "__dict__", None) or str(x)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
