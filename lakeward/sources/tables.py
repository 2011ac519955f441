"""Log-structured tables: versioned metadata, snapshots, manifests of file entries, and commits by compare-and-swap."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import deletes as dl
from ..operators.files import DATA, EQUALITY_DELETES, POSITION_DELETES, partition_key
from .literals import parse_literal
from .stitch import stitch
from .store import Conflict, Store, spark_path

ENTRIES = (
    "path string, content int, file_bytes long, record_count long, part_values map<string,string>, part string, seq long, spec_id int, "
    "value_counts map<string,long>, null_counts map<string,long>, lower map<string,string>, upper map<string,string>, eq_columns array<string>, referenced string"
)
ENTRY_NAMES = re.findall(r"(\w+) (?:map<[^>]*>|array<[^>]*>|\w+)(?:, |$)", ENTRIES)
MANIFEST = r"(m-[0-9a-f]+/__m=[^/]+)/[^/]+$"
LOG_MS = 8 * 86_400_000
ROW_GROUP = 128 << 20
VERSION = re.compile(r"^v(\d+)$|^(\d+)-.+$|^(\d+)$")
UNPARTITIONED = "(unpartitioned)"
NULL_PART = "__HIVE_DEFAULT_PARTITION__"
OWN = "lakeward.maintenance"


class NoSuchTable(Exception):
    pass


class TableExists(Exception):
    pass


def parse_version(name: str) -> int | None:
    """Version in a metadata file's name: v<n>, <n>-<uuid> or <n>, before .metadata.json."""
    m = VERSION.match(name.removesuffix(".metadata.json")) if name.endswith(".metadata.json") else None
    return int(next(g for g in m.groups() if g)) if m else None


@dataclass
class Table:
    """A table at one version of its metadata."""

    warehouse: Warehouse
    ident: tuple[str, str]
    version: int
    meta: dict

    @property
    def key(self) -> str:
        return f"{self.ident[0]}.db/{self.ident[1]}"

    @property
    def spark(self) -> SparkSession:
        return self.warehouse.spark

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(self.meta["schema"])

    def snapshot(self, snapshot_id: int | None = None) -> dict | None:
        wanted = self.meta["current"] if snapshot_id is None else snapshot_id
        return next((s for s in self.meta["snapshots"] if s["id"] == wanted), None)

    def manifests(self, snapshot_id: int | None = None) -> list[dict]:
        s = self.snapshot(snapshot_id)
        return self.warehouse.store.read(f"{self.key}/metadata/{s['manifest_list']}") if s else []

    def read_manifests(self, manifests: list[dict]) -> DataFrame:
        """Entries of manifests, with the name of each one's manifest."""
        paths = [self.warehouse.store.at(f"{self.key}/metadata/{p}") for p in sorted({m["path"] for m in manifests})]
        if not paths:
            return self.spark.createDataFrame([], ENTRIES + ", manifest string")
        return self.spark.read.schema(ENTRIES).parquet(*paths).select("*", F.regexp_extract(F.col("_metadata.file_path"), MANIFEST, 1).alias("manifest"))

    def entries(self, snapshot_id: int | None = None, keep: Callable[[dict], bool] | None = None) -> DataFrame:
        """File entries of a snapshot; `keep` prunes manifests by their bounds before any is read."""
        return self.read_manifests([m for m in self.manifests(snapshot_id) if keep is None or keep(m)]).drop("manifest")

    def may_hold(self, partition: dict[str, object]) -> Callable[[dict], bool]:
        """Whether a manifest may hold entries of a partition (typed values), by its bounds."""
        types = {c: self.schema[c].dataType for c in partition}

        def keep(m: dict) -> bool:
            for c, v in partition.items():
                lo, hi = (None if b is None else parse_literal(b, types[c]) for b in m["bounds"].get(c, (None, None)))
                if v is not None and lo is not None and hi is not None and not lo <= v <= hi:
                    return False
            return True

        return keep

    def bytes(self) -> tuple[int, int]:
        """Bytes of the current snapshot's manifests and of its files."""
        store = self.warehouse.store
        meta = sum(store.fs.getContentSummary(store._path(store.at(f"{self.key}/metadata/{m['path']}"))).getLength() for m in self.manifests())
        return meta, self.entries().agg(F.coalesce(F.sum("file_bytes"), F.lit(0)).alias("n")).first()["n"]

    def read_files(self, paths: list[str]) -> DataFrame:
        """Rows of data files, with each row's file and position."""
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else None
        if rows is None:
            empty = self.spark.createDataFrame([], self.schema)
            return empty.withColumns({"__path": F.lit(None).cast("string"), "__pos": F.lit(None).cast("long")})
        return rows.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__pos"))

    def live_rows(self, data: list[dict], deletes: list[dict]) -> DataFrame:
        """Rows of data entries without those that delete entries remove."""
        rows = self.read_files([e["path"] for e in data])
        position = [e["path"] for e in deletes if e["content"] == POSITION_DELETES]
        if position:
            rows = dl.apply_position_deletes(rows, self.spark.read.schema("file_path string, pos long").parquet(*position), "__path", "__pos")
        equality = [e for e in deletes if e["content"] == EQUALITY_DELETES]
        if equality:
            where = self.spark.createDataFrame([(e["path"], e["seq"], e["part"]) for e in data], "__path string, __seq long, __part string")
            rows = rows.join(where, "__path")  # one row a file
            for columns in {tuple(e["eq_columns"]) for e in equality}:
                for scope, some in (([], [e for e in equality if e["part"] == UNPARTITIONED]), (["__part"], [e for e in equality if e["part"] != UNPARTITIONED])):
                    some = [e for e in some if tuple(e["eq_columns"]) == columns]
                    if not some:
                        continue
                    fields = StructType([f for f in self.schema if f.name in columns])
                    d = self.spark.read.schema(fields).parquet(*[e["path"] for e in some]).select(*columns, F.col("_metadata.file_path").alias("__from"))
                    d = d.join(self.spark.createDataFrame([(e["path"], e["seq"], e["part"]) for e in some], "__from string, delete_seq long, __part string"), "__from")
                    rows = dl.apply_equality_deletes(rows, d, list(columns), "__seq", "delete_seq", scope)
        return rows.select(*self.schema.names)

    def scan(self, snapshot_id: int | None = None) -> DataFrame:
        """The table's rows."""
        rows = [r.asDict() for r in self.entries(snapshot_id).select("path", "content", "seq", "part", "eq_columns").collect()]
        return self.live_rows([r for r in rows if r["content"] == DATA], [r for r in rows if r["content"] != DATA])


class Warehouse:
    """Tables in a folder, without a catalog service."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    # Discovery

    def discover(self, prefix: str = "") -> list[tuple[str, str, int]]:
        """(table folder, metadata file, version) of every table; a table's own folders are not searched."""
        found, folders = [], []
        for name, folder, _, _ in self.store.names(prefix):
            child = f"{prefix}/{name}" if prefix else name
            if not folder:
                continue
            if name == "metadata":
                versions = [(v, n) for n, d, _, _ in self.store.names(child) if not d and (v := parse_version(n)) is not None]
                if versions:
                    v, n = max(versions)
                    return [(prefix, f"{child}/{n}", v)]
            if name not in ("_lakeward", "_state", "metadata", "data"):
                folders.append(child)
        for child in folders:
            found += self.discover(child)
        return found

    def discovered(self) -> DataFrame:
        return self.spark.createDataFrame(self.discover(), "prefix string, metadata string, version int")

    def tables(self, namespace: str) -> list[tuple[str, str]]:
        return [(namespace, p.rsplit("/", 1)[-1]) for p, _, _ in self.discover(f"{namespace}.db")]

    def load(self, ident: tuple[str, str]) -> Table:
        key = f"{ident[0]}.db/{ident[1]}/metadata"
        versions = sorted((v, n) for n, d, _, _ in self.store.names(key) if not d and (v := parse_version(n)) is not None)
        if not versions:
            raise NoSuchTable(".".join(ident))
        if len(versions) > 1 and versions[-1][0] == versions[-2][0]:
            raise ValueError(f"ambiguous metadata version {versions[-1][0]}")
        v, name = versions[-1]
        return Table(self, ident, v, self.store.read(f"{key}/{name}"))

    def drop_table(self, ident: tuple[str, str]) -> None:
        raise NotImplementedError("tables are dropped by their owner, not by maintenance")

    rename_table = create_namespace = drop_namespace = create_view = drop_table

    def create(self, ident: tuple[str, str], schema: StructType, partition: list[str] | None = None, sort: list[tuple[str, bool]] | None = None, properties: dict | None = None) -> Table:
        """A new table; sort lists (column, ascending)."""
        for c in [*(partition or []), *[s for s, _ in sort or []]]:
            if c not in schema.names:
                raise ValueError(f"no column {c!r}")
        fields = {f["name"]: f | {"metadata": f.get("metadata", {}) | {"field_id": i + 1}} for i, f in enumerate(schema.jsonValue()["fields"])}
        props = {k: v for k, v in (properties or {}).items() if k != "format-version"}
        meta = {"format-version": 2, "uuid": str(uuid.uuid4()), "schema": {"type": "struct", "fields": list(fields.values())}, "schema_id": 0, "partition": partition or [], "sort": sort or [], "properties": props, "snapshots": [], "current": None, "last_seq": 0, "commit_log": []}
        try:
            self.store.create(f"{ident[0]}.db/{ident[1]}/metadata/v1.metadata.json", meta)
        except Conflict:
            raise TableExists(".".join(ident)) from None
        return self.load(ident)

    # Commits

    def commit(self, ident: tuple[str, str], change: Callable[[Table], dict | None], attempts: int = 15, wait: float = 0.1) -> Table:
        """Apply `change` to the newest metadata until no other writer interferes; None changes nothing."""
        for attempt in range(attempts):
            table = self.load(ident)
            meta = change(table)
            if meta is None:
                return table
            key = f"{table.key}/metadata/v{table.version + 1}.metadata.json"
            try:
                self.store.create(key, meta)
            except Conflict:
                time.sleep(min(5.0, wait * 2**attempt))
                continue
            self.store.put(f"{table.key}/metadata/version-hint.text", table.version + 1)
            return self.load(ident)
        raise Conflict(f"{'.'.join(ident)}: no commit in {attempts} attempts")

    def write_manifests(self, table: Table, entries: DataFrame, split: bool = True) -> list[dict]:
        """Write entries as manifests, one for each kind of content and (with `split`) partition, and describe them.

        One job writes all of them and one aggregate finds their counts and the
        bounds of partition values, in the order of the columns' own types.
        """
        name = f"m-{uuid.uuid4().hex}"
        kind = F.col("content") == DATA
        group = F.md5(F.concat_ws("|", kind.cast("string"), F.col("spec_id").cast("string"), "part")) if split else kind.cast("string")
        keyed = entries.select(*ENTRY_NAMES, group.alias("__m"))
        keyed.repartition("__m").write.partitionBy("__m").parquet(self.store.at(f"{table.key}/metadata/{name}"))
        own = self.spark.read.schema(ENTRIES + ", __m string").parquet(self.store.at(f"{table.key}/metadata/{name}"))
        typed = {c: F.col("part_values")[c].cast(table.schema[c].dataType) for c in table.meta["partition"]}
        limits = [f(x).cast("string").alias(f"{b}_{c}") for c, x in typed.items() for b, f in (("lo", F.min), ("hi", F.max))]
        found = own.groupBy("__m").agg(F.count("*").alias("files"), F.sum("record_count").alias("rows"), F.min("seq").alias("min_seq"), F.max("content").alias("content"), F.max("spec_id").alias("spec_id"), *limits)
        return [
            {"path": f"{name}/__m={v['__m']}", "files": v["files"], "rows": v["rows"] or 0, "min_seq": v["min_seq"], "content": v["content"], "spec_id": v["spec_id"], "bounds": {c: [v[f"lo_{c}"], v[f"hi_{c}"]] for c in typed}}
            for v in found.orderBy("__m").collect()
        ]

    def staged(self, table: Table, manifests: list[dict], operation: str, summary: dict | None = None, own: bool = False, at_ms: int | None = None) -> dict:
        """Metadata with a new current snapshot of these manifests."""
        snapshot_id, now = uuid.uuid4().int >> 65, at_ms if at_ms is not None else int(time.time() * 1000)
        name = f"snap-{snapshot_id}.json"
        self.store.create(f"{table.key}/metadata/{name}", manifests)
        notes = {"operation": operation} | (summary or {}) | ({OWN: "true"} if own else {})
        s = {"id": snapshot_id, "parent": table.meta["current"], "seq": table.meta["last_seq"] + 1, "ts_ms": now, "manifest_list": name, "schema_id": table.meta["schema_id"], "summary": notes}
        # The log outlives expired snapshots, for as long as workloads are judged by it.
        log = [*[x for x in table.meta["commit_log"] if x["ts_ms"] >= now - LOG_MS], {"id": snapshot_id, "ts_ms": now, "own": own}]
        return table.meta | {"snapshots": [*table.meta["snapshots"], s], "current": snapshot_id, "last_seq": s["seq"], "commit_log": log}

    def entries_of(self, table: Table, paths: list[str], seq: int, content: int = DATA) -> DataFrame:
        """Entries of written files: sizes, counts and bounds from one aggregate over them.

        Bounds of texts alone would make Spark sort all rows by their file;
        with an object among the aggregates it hashes them, a group a file.
        """
        columns = [f.name for f in table.schema if f.dataType.typeName() not in ("array", "map", "struct", "binary")]
        rows = self.spark.read.schema(table.schema).parquet(*paths)
        none = F.size(F.collect_list(F.lit(None).cast("int")))  # 0; the object that lets Spark hash
        as_map = lambda f: F.create_map(*[x for c in columns for x in (F.lit(c), f(F.col(c)))]) if columns else F.lit(None)
        g = rows.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_bytes")).agg(
            (F.count("*") + none).alias("record_count"), as_map(lambda c: F.count("*")).alias("value_counts"), as_map(lambda c: F.count_if(c.isNull())).alias("null_counts"),
            as_map(lambda c: F.min(c).cast("string")).alias("lower"), as_map(lambda c: F.max(c).cast("string")).alias("upper"),
        )
        parts = self.spark.createDataFrame([(p, part_values(p)) for p in paths], "path string, part_values map<string,string>")
        out = g.join(parts, "path").withColumns({"content": F.lit(content), "seq": F.lit(seq).cast("long"), "spec_id": F.lit(0), "eq_columns": F.lit(None).cast("array<string>"), "referenced": F.lit(None).cast("string")})
        return out.withColumn("part", part_text(F.col("part_values")))

    def write_data(self, table: Table, rows: DataFrame, row_group_bytes: int | None = None, files: int | None = None) -> list[str]:
        """Write rows as data files, a folder per partition; partition columns stay in the files.

        Row groups are as large as the argument or the table asks, else 128 MiB.
        With `files`, a partition has no more than so many, in the order of the rows.
        """
        folder = f"{table.key}/data/{uuid.uuid4().hex}"
        parts = table.meta["partition"]
        writer = rows.withColumns({f"__p_{c}": F.col(c) for c in parts}).write if parts else rows.write
        writer = writer.option("parquet.block.size", row_group_bytes or int(table.meta["properties"].get("write.parquet.row-group-size-bytes", ROW_GROUP)))
        (writer.partitionBy(*[f"__p_{c}" for c in parts]) if parts else writer).parquet(self.store.at(folder))
        return self.joined([p for p, _, _ in self.store.walk(folder) if p.endswith(".parquet")], files)

    def joined(self, paths: list[str], files: int | None = 1) -> list[str]:
        """Files of the same rows, no more than `files` in each folder: neighbours become one; all stay as they are without `files`."""
        folders: dict[str, list[str]] = {}
        for p in paths:
            folders.setdefault(p.rsplit("/", 1)[0], []).append(p)
        out, groups = [], []
        for folder, own in folders.items():
            if files is None or len(own) <= files:
                out += own
                continue
            name = uuid.uuid4().hex
            groups += [(f"{folder}/part-{i:05}-{name}.parquet", own[i * len(own) // files : (i + 1) * len(own) // files]) for i in range(files)]
        stitch(self.spark, groups)
        for target, pieces in groups:
            out.append(target)
            for p in pieces:
                self.store.delete_path(p)
        return out

    def append(self, ident: tuple[str, str], rows: DataFrame, summary: dict | None = None, at_ms: int | None = None, sort_files: int | None = None) -> Table:
        """Commit rows as a new snapshot, with no more than `sort_files` files a partition.

        With a query_id and a batch_id (a number that grows) in `summary`, a
        batch up to the last one of its query is not committed again.
        """
        table = self.load(ident)
        if committed(table, summary):
            return table
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in table.schema])
        paths = self.write_data(table, rows, files=sort_files)
        return self.add_files(ident, paths, summary, at_ms)

    def staged_entries(self, table: Table, paths: list[str]) -> DataFrame | None:
        """Entries of new files, computed once and kept, for however many attempts a commit takes."""
        if not paths:
            return None
        path = self.store.at(f"{table.key}/metadata/staged-{uuid.uuid4().hex}")
        self.entries_of(table, paths, 0).select(*ENTRY_NAMES).coalesce(1 + len(paths) // 10_000).write.parquet(path)
        return self.spark.read.schema(ENTRIES).parquet(path)

    def drop_staged(self, entries: DataFrame | None) -> None:
        if entries is not None:
            for folder in {f.rsplit("/", 1)[0] for f in entries.inputFiles()}:
                self.store.delete_path(folder, True)

    def add_files(self, ident: tuple[str, str], paths: list[str], summary: dict | None = None, at_ms: int | None = None) -> Table:
        entries = self.staged_entries(self.load(ident), paths)
        late = []

        def change(t: Table) -> dict | None:
            if committed(t, summary):  # by another writer, since this one began
                late.append(True)
                return None
            added = self.write_manifests(t, entries.withColumn("seq", F.lit(t.meta["last_seq"] + 1)), split=False) if entries is not None else []
            meta = self.staged(t, [*t.manifests(), *added], "append", summary, at_ms=at_ms)
            return meta | {"batches": t.meta.get("batches", {}) | {summary["query_id"]: int(summary["batch_id"])}} if summary and "batch_id" in summary else meta

        table = self.commit(ident, change)
        self.drop_staged(entries)
        for p in paths if late else []:
            self.store.delete_path(p)
        return table

    def delete_rows(self, ident: tuple[str, str], deletes: DataFrame, eq_columns: list[str] | None = None, part_values_: dict | None = None) -> Table:
        """Commit a delete file: (file_path, pos) rows, or rows of the equality columns, of one partition or all."""
        table = self.load(ident)
        folder = f"{table.key}/data/deletes-{uuid.uuid4().hex}"
        deletes.write.parquet(self.store.at(folder))
        self.joined([p for p, _, _ in self.store.walk(folder) if p.endswith(".parquet")])
        files = [(p, n) for p, n, _ in self.store.walk(folder) if p.endswith(".parquet")]
        count = self.spark.read.schema(deletes.schema).parquet(*[p for p, _ in files]).count()

        def change(t: Table) -> dict:
            rows = [(p, EQUALITY_DELETES if eq_columns else POSITION_DELETES, n, count, part_values_ or {}, t.meta["last_seq"] + 1, eq_columns) for p, n in files]
            e = self.spark.createDataFrame(rows, "path string, content int, file_bytes long, record_count long, part_values map<string,string>, seq long, eq_columns array<string>")
            empty = F.lit(None)
            e = e.withColumns({"spec_id": F.lit(0), "value_counts": empty.cast("map<string,long>"), "null_counts": empty.cast("map<string,long>"), "lower": empty.cast("map<string,string>"), "upper": empty.cast("map<string,string>"), "referenced": empty.cast("string"), "part": part_text(F.col("part_values"))})
            return self.staged(t, [*t.manifests(), *self.write_manifests(t, e, split=False)], "delete")

        return self.commit(ident, change)

    def import_folder(self, ident: tuple[str, str], folder: str, partition: list[str] | None = None) -> Table:
        """Register Parquet files in place; partitions come from `column=value` segments of the first path that has them."""
        source = Store(self.spark, folder)
        hidden = lambda p: any(s[:1] in "_." and "=" not in s for s in p.split(spark_path(source.root), 1)[-1].strip("/").split("/"))
        files = [p for p, _, _ in source.walk("") if p.endswith(".parquet") and not hidden(p)]
        if not files:
            raise ValueError("no Parquet files")
        schema = self.spark.read.parquet(files[0]).schema
        inferred = next((found for p in files if (found := [c for c in part_values(p) if c in schema.names])), [])
        self.create(ident, schema, partition if partition is not None else inferred)
        return self.add_files(ident, files, {"imported": "true"})


def committed(table: Table, summary: dict | None) -> bool:
    """Whether the table holds the batch that `summary` names; the table remembers the last batch of each query."""
    return bool(summary and "batch_id" in summary and int(summary["batch_id"]) <= table.meta.get("batches", {}).get(summary["query_id"], -1))


def part_values(path: str) -> dict[str, str | None]:
    """Partition values in a path's folders."""
    pairs = [s.split("=", 1) for s in path.split("/")[:-1] if "=" in s]
    return {c.removeprefix("__p_"): None if v == NULL_PART else unquote(v) for c, v in pairs}


def part_text(values: Column) -> Column:
    return partition_key(values)
