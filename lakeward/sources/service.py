"""Read-only SQL over tables, and what an outer catalog needs to know of a table."""

from __future__ import annotations

import re
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .tables import Table

ROW_CAP = 10_000
#: Commands that only read, by the start of their names in Spark's parser.
READS = ("Show", "Describe", "Explain")
_CALLS = re.compile(r"\b(java_method|reflect|try_reflect)\s*\(", re.I)


def reject_writes(spark: SparkSession, sql: str) -> None:
    """Raise unless Spark's parser takes the statement for a query, or for a command that only shows something."""
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    find = spark.sparkContext._jvm.org.apache.spark.util.Utils.classForName
    kinds = [find(logical + k, True, False) for k in ("Command", "ParsedStatement", "CompoundBody")]
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise PermissionError(f"not a statement that can be read: {type(e).__name__}") from None

    def check(node: Any, top: bool) -> None:
        name = node.nodeName()
        if any(k.isInstance(node) for k in kinds):
            if not (top and name.startswith(READS)):
                raise PermissionError(f"{name} statements are not allowed")
            return
        inner = node.innerChildren()
        for group in (node.children(), inner):
            for i in range(group.size()):
                if hasattr(group.apply(i), "nodeName"):
                    check(group.apply(i), False)

    check(plan, True)
    if _CALLS.search(sql):
        raise PermissionError("calls into the virtual machine are not allowed")


def run_query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], cap: int = ROW_CAP) -> dict:
    """Columns, at most `cap` rows and the time of a read-only statement; tables are named as {name} or by name."""
    sql = sql.rstrip().rstrip(";")
    reject_writes(spark, sql)
    began = time.time()
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    out = spark.sql(sql).limit(cap)
    rows = [list(r) for r in out.collect()]
    return {"columns": out.columns, "rows": rows, "row_count": len(rows), "elapsed_ms": round((time.time() - began) * 1000, 1)}


def sql_columns(schema: StructType) -> list[tuple[str, str]]:
    """Columns as an outer catalog names their types; a date or time type without a name there is a string."""
    names = {"integer": "int", "long": "bigint", "short": "smallint", "byte": "tinyint", "timestamp_ntz": "timestamp"}
    return [(f.name, names.get(f.dataType.typeName(), f.dataType.simpleString().replace("timestamp_ntz", "timestamp"))) for f in schema.fields]


def register(table: Table, name: str | None = None) -> str:
    """Register the table's current rows with the session's catalog as a view; registering again moves it on."""
    view = name or "_".join(table.ident)
    table.scan().createOrReplaceTempView(view)
    return view


def unregister(spark: SparkSession, view: str) -> bool:
    return spark.catalog.dropTempView(view)
