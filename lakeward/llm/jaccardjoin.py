"""Size-aware heavy-light Jaccard join of word-shingle sets, and its components.

Sets are the distinct 5-word shingles of a text (words are runs of other than
ASCII white space, A-Z lower-cased); two link when 100 * |intersection| >=
75 * |union|.

* Equal sets are one class, held by its smallest doc_id.
* Light sets (size up to a boundary): a pair of sizes s, t needs c = ceil(3/7 *
  (s + t)) common shingles, so each light set lists its c-subsets for every
  partner size; sets of the two sizes with a common subset are linked, by a
  star to the smallest of the other size, without counting anything.
* Heavy pairs: shingles are ordered by how many texts hold them, rarest first;
  linked sets share one of the first s - ceil(0.75 s) + 1.  Each such inverted
  list gives its members to the group of its largest set.  A group first scans
  with its largest set; members that this leaves outside the largest set's
  component then scan the group's inverted lists and count overlaps, in blocks
  of members, so no link between sets of different components is lost and no
  pairs are listed within a component.
* The boundary is the size at which listing subsets would cost more than
  scanning: both costs come from the histogram of sizes.

Counts of shingles, inverted lists and classes are over all documents; 64-bit
fingerprints stand for shingles, 128-bit ones for whole sets.

Defined cases: null or empty texts, and texts of white space, have no set and
link with nothing; a text of fewer than five words has one shingle, all its
words; repeated rows are equal sets and link; a null doc_id is never the
smallest unless a class has no other; texts of any length are whole; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import pack, pack_rows, shingle_fingerprints, unpack, unpack_rows, word_fingerprints
from .cluster import Workspace, lean, table

SHARE = 3, 4  # the similarity 0.75
LIGHT_MOST = 24
CHUNK = 256
BUCKET_BYTES = 16 << 20
LAST = (1 << 63) - 1
HEADS = 3
MESSAGE = "block long, bucket int, kind int, data binary"
SETS = "node long, doc long, n long, sig binary"
HEAVY = "node long, n long, prefix array<long>, held binary"


def needed(s: int, t: int) -> int:
    """Common shingles that sets of these sizes need to link."""
    a, b = SHARE
    return -(-a * (s + t) // (a + b))


def linked(common: int | np.ndarray, s: int | np.ndarray, t: int | np.ndarray) -> bool | np.ndarray:
    return 100 * common >= 75 * (s + t - common)


def prefix_length(n: int) -> int:
    a, b = SHARE
    return n - -(-a * n // b) + 1


def block_sets(lens: np.ndarray, data: bytes) -> Iterator[np.ndarray]:
    """The shingle set of each text of a block, in ascending order."""
    raw = unpack(data)
    ends = np.cumsum(np.asarray(lens, dtype=np.int64))
    for start, end in zip((ends - lens).tolist(), ends.tolist(), strict=True):
        yield np.unique(shingle_fingerprints(word_fingerprints(raw[start:end])[2]))


def _names(sets: np.ndarray, buckets: int) -> np.ndarray:
    return ((((sets >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)) << np.uint64(32)) | (sets & np.uint64(0xFFFFFFFF))


def to_held(ordered: np.ndarray) -> bytes:
    return ordered.tobytes()


def from_held(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint64)


def node_of(block: int, i: int) -> int:
    return block << 15 | i


def shingle_sets(packed: DataFrame) -> DataFrame:
    """node, doc, size and signature of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, lens, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                found = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest()) for s in block_sets(np.array(lens), data)]
                nodes = [node_of(block, i) for i in range(len(ids))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array([LAST if d is None else d for d in ids], pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())],
                    names=["node", "doc", "n", "sig"],
                )

    return packed.mapInArrow(lean(run), SETS)


def shared_shingles(packed: DataFrame, buckets: int) -> DataFrame:
    """Messages to blocks: names of their shingles that several texts hold, and in how many."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lens, data in zip(batch.column("block").to_pylist(), batch.column("lens").to_pylist(), batch.column("data").to_pylist(), strict=True):
                sets = list(block_sets(np.array(lens), data))
                names, counts = np.unique(_names(np.concatenate(sets), buckets) if sets else np.zeros(0, np.uint64), return_counts=True)
                cut = np.searchsorted(names >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                parts = []
                for b in range(buckets):
                    mine, n = names[cut[b] : cut[b + 1]].astype(np.uint32), counts[cut[b] : cut[b + 1]]
                    for kind, which in ((1, n == 1), (2, n > 1)):
                        if which.any():
                            parts.append((b, kind, mine[which].tobytes() + (n[which].astype(np.uint32).tobytes() if kind == 2 else b"")))
                if parts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block] * len(parts), pa.int64()), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int32()), pa.array([p[2] for p in parts], pa.binary())],
                        names=["block", "bucket", "kind", "data"],
                    )

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        held = []
        for kind, data in zip(rows["kind"], rows["data"], strict=True):
            values = np.frombuffer(data, dtype=np.uint32)
            half = len(values) // 2
            held.append((values, np.ones(len(values), np.uint32)) if kind == 1 else (values[:half], values[half:]))
        names, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([h[1] for h in held]).astype(np.float64)).astype(np.int64)
        out = []
        for block, bucket, (mine, _) in zip(rows["block"], rows["bucket"], held, strict=True):
            df = total[np.searchsorted(names, mine)]
            many = df > 1
            if many.any():
                out.append((block, bucket, 0, mine[many].tobytes() + df[many].astype(np.uint32).tobytes()))
        return pd.DataFrame(out, columns=["block", "bucket", "kind", "data"])

    return packed.select("block", "lens", "data").mapInArrow(lean(name), MESSAGE).groupBy("bucket").applyInPandas(meet, MESSAGE)


def head_messages(heads: DataFrame) -> DataFrame:
    """Messages to blocks: which of their documents head a class."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": rows["block"][:1], "bucket": -1, "kind": HEADS, "data": [rows["node"].to_numpy(np.int64).tobytes()]})

    return heads.select(F.shiftright("node", 15).alias("block"), "node").groupBy("block").applyInPandas(run, MESSAGE)


def rare_prefixes(packed: DataFrame, messages: DataFrame, buckets: int) -> DataFrame:
    """Heads that can link with others: the shared shingles of their prefix, and all their shared ones."""

    def run(key: tuple, block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        names, counts = [], []
        for kind, bucket, data in zip(told["kind"], told["bucket"], told["data"], strict=True):
            if kind == HEADS:
                continue
            values = np.frombuffer(data, dtype=np.uint32)
            names.append(values[: len(values) // 2].astype(np.uint64) | (np.uint64(bucket) << np.uint64(32)))
            counts.append(values[len(values) // 2 :])
        out = []
        heads = set(np.frombuffer(b"".join(told.loc[told["kind"] == HEADS, "data"]), np.int64).tolist())
        if names:
            names, counts = np.concatenate(names), np.concatenate(counts)
            order = np.argsort(names)
            names, counts = names[order], counts[order]
            for lens, data in zip(block["lens"], block["data"], strict=True):
                for i, s in enumerate(block_sets(np.asarray(lens), data)):
                    if node_of(key[0], i) not in heads:
                        continue
                    wanted = _names(s, buckets)
                    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
                    df = np.where(names[at] == wanted, counts[at], 1)
                    first = np.lexsort((s, df))[: prefix_length(len(s))]
                    first = first[df[first] > 1]
                    if len(first):
                        out.append((node_of(key[0], i), len(s), s[first].view(np.int64), to_held(s[df > 1])))
        return pd.DataFrame(out, columns=["node", "n", "prefix", "held"])

    return packed.select("block", "lens", "data").groupBy("block").cogroup(messages.groupBy("block")).applyInPandas(run, HEAVY)


def boundary(heavy: DataFrame) -> int:
    """The size up to which listing subsets costs less than scanning lists."""
    rows = heavy.where(F.col("n") <= LIGHT_MOST).groupBy("n").count().collect()
    lists = heavy.select(F.sum(F.size("prefix")).alias("entries")).first()["entries"] or 1
    keys = heavy.select(F.explode("prefix").alias("t")).agg(F.approx_count_distinct("t").alias("k")).first()["k"] or 1
    histogram = {r["n"]: r["count"] for r in rows}
    best, at, light = 0.0, 0, 0.0
    for x in range(1, LIGHT_MOST + 1):
        partners = [t for t in range(-(-3 * x // 4), 4 * x // 3 + 1)]
        light += histogram.get(x, 0) * sum(math.comb(x, needed(x, t)) for t in partners if needed(x, t) <= min(x, t))
        scan = sum(histogram.get(s, 0) * s * prefix_length(s) for s in range(1, x + 1)) * (lists / keys)
        if light - scan < best:
            best, at = light - scan, x
    return at


def light_edges(heavy: DataFrame, most: int) -> DataFrame:
    """Stars of light sets that have a common subset of the size their pair needs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for node, n, held in zip(batch["node"], batch["n"], batch["held"], strict=True):
                mine = [held[i : i + 8] for i in range(0, len(held), 8)]
                for t in range(-(-3 * n // 4), min(most, 4 * n // 3) + 1):
                    c = needed(n, t)
                    if c <= min(n, t, len(mine)):
                        head = b"%d,%d:" % (min(n, t), max(n, t))
                        side = (n > t) - (n < t)
                        out += [(hashlib.blake2b(head + b"".join(some), digest_size=16).digest(), node, side) for some in combinations(mine, c)]
            yield pd.DataFrame(out, columns=["key", "node", "side"])

    keys = heavy.where(F.col("n") <= most).select("node", "n", "held").mapInPandas(run, "key binary, node long, side int")
    # A subset proves a link only between sets of its two sizes, so each side's star has the other side's smallest.
    first = lambda side: F.min(F.when(F.col("side") == side, F.col("node")))
    heads = keys.groupBy("key").agg(first(-1).alias("less"), first(0).alias("same"), first(1).alias("more"))
    other = F.when(F.col("side") == -1, F.col("more")).when(F.col("side") == 1, F.col("less")).otherwise(F.col("same"))
    return keys.join(heads, "key").select(other.alias("a"), F.col("node").alias("b")).where("a <> b").distinct()


def groups(heavy: DataFrame, most: int) -> DataFrame:
    """Members (pivot, node, n, held) of the groups that the inverted lists of heavy pairs make."""
    least = -(-3 * (most + 1) // 4)
    entries = heavy.where(F.col("n") >= least).select("node", "n", F.explode("prefix").alias("t"))
    lists = entries.groupBy("t").agg(F.max(F.struct("n", "node")).alias("top"), F.count("*").alias("m")).where("m > 1").select("t", F.col("top.node").alias("pivot"))
    return entries.join(lists, "t").select("pivot", "node").distinct().join(heavy.select("node", "n", "held"), "node").select("pivot", "node", "n", "held")


def star_edges(members: DataFrame) -> DataFrame:
    """Links between the largest set of a group and its members."""
    tops = members.where("pivot = node").select("pivot", F.col("n").alias("m"), F.col("held").alias("top"))
    rows = members.where("pivot <> node").join(tops, "pivot").where(F.col("n") * 4 >= F.col("m") * 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                common = len(np.intersect1d(from_held(x), from_held(y), assume_unique=True))
                if linked(common, n, m):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.select("pivot", "node", "n", "m", "held", "top").mapInArrow(lean(run), "a long, b long")


def components(spark: SparkSession, nodes: DataFrame, edges: DataFrame, ws: Workspace, name: str, rows: int | None = None) -> DataFrame:
    """node, label: the smallest (doc, node) reachable by edges (a, b), for each row of `nodes` (node, doc), which are about `rows`."""
    both = ws.save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges", rows=rows)
    own = F.struct("doc", "node")
    touched = both.select(F.col("a").alias("node")).distinct()
    labels = ws.save(nodes.select("node", own.alias("label")).join(touched, "node"), f"{name}-0", rows=rows)
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("theirs")), "b").groupBy("a").agg(F.min("theirs").alias("theirs"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "theirs").alias("next"))
        jumps = labels.select(F.col("node").alias("j"), F.col("label").alias("far"))
        moved = stepped.join(jumps, F.col("next.node") == F.col("j"), "left").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved"))
        labels = ws.save(moved, f"{name}-{turn}", rows=rows)
        if turn > 1:
            ws.drop(f"{name}-{turn - 2}")
        if not labels.where("moved").limit(1).count():
            break
        labels = labels.select("node", "label")
    rest = nodes.join(touched, "node", "left_anti").select("node", own.alias("label"))
    return labels.select("node", "label").unionByName(rest)


def scan_edges(members: DataFrame, labels: DataFrame, ws: Workspace, total: int | None = None) -> DataFrame:
    """Links found by members outside their group's main component, each scanning the lists of all other members."""
    mark = labels.select("node", F.col("label.node").alias("comp"))
    tops = mark.select(F.col("node").alias("pivot"), F.col("comp").alias("main"))
    rows = ws.save(members.select("pivot", "node").join(mark, "node").join(tops, "pivot").withColumn("out", F.col("comp") != F.col("main")), "members", rows=total)
    sizes = rows.groupBy("pivot").agg(F.count("*").alias("g"), F.sum(F.col("out").cast("long")).alias("u")).where("u > 0")
    sizes = sizes.select("pivot", F.ceil(F.col("g") / CHUNK).cast("int").alias("gs"), F.ceil(F.col("u") / CHUNK).cast("int").alias("us"))
    split = rows.join(sizes, "pivot").withColumn("h", F.xxhash64("node"))
    asks = split.where("out").select("pivot", "node", "comp", F.lit(True).alias("asks"), F.pmod("h", "us").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("gs") - 1)).alias("j"))
    answers = split.select("pivot", "node", "comp", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("us") - 1)).alias("i"), F.pmod("h", "gs").cast("int").alias("j"))
    tasks = asks.unionByName(answers).join(members, ["pivot", "node"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        those = rows[~rows["asks"]].reset_index(drop=True)
        sets = [from_held(h) for h in those["held"]]
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        nodes, comps, n = (those[c].to_numpy() for c in ("node", "comp", "n"))
        a, b = [], []
        joined: dict[int, int] = {}  # components that this task has linked: only links that join two are needed

        def top(c: int) -> int:
            while (up := joined.get(c, c)) != c:
                joined[c] = joined.get(up, up)
                c = up
            return c

        asking = rows[rows["asks"]]
        for node, comp, size, held in zip(asking["node"], asking["comp"], asking["n"], asking["held"], strict=True):
            mine = from_held(held)
            lo, hi = np.searchsorted(tokens, mine), np.searchsorted(tokens, mine, side="right")
            width = hi - lo
            at = np.repeat(lo - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
            common = np.bincount(owner[at], minlength=len(nodes))
            hit = np.flatnonzero(linked(common, size, n) & (common > 0) & (comps != comp))
            others, first = np.unique(comps[hit], return_index=True)
            for other, at_node in zip(others.tolist(), nodes[hit[first]].tolist(), strict=True):
                if top(comp) != top(other):
                    joined[top(comp)] = top(other)
                    a.append(node)
                    b.append(at_node)
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return tasks.groupBy("pivot", "i", "j").applyInPandas(run, "a long, b long")


@dataclass
class Joined:
    """What the join finds: node, doc, n and sig of each row, and sig, smallest doc and node of its component."""

    sets: DataFrame
    smallest: DataFrame


def join_nodes(packed: DataFrame, ws: Workspace) -> Joined:
    """Components of the texts of `packed`, which stays as it is."""
    spark = packed.sparkSession
    texts = F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)
    total, rows = packed.agg(F.coalesce(F.sum(texts), F.lit(0)), F.coalesce(F.sum(F.size("lens")), F.lit(0))).first()
    buckets = max(2, total // BUCKET_BYTES)
    sets = ws.save(shingle_sets(packed), "sets", "none")
    messages = ws.save(shared_shingles(packed, buckets), "messages", "none")
    ws.release()
    # Classes of equal sets, each held by its smallest (doc, node).
    classes = ws.save(sets.where("n > 0").groupBy("sig").agg(F.min(F.struct("doc", "node")).alias("head")).select("sig", F.col("head.doc").alias("doc"), F.col("head.node").alias("node")), "classes", "none", rows)
    heads = classes.select("node", "doc")
    heavy = ws.save(rare_prefixes(packed, messages.unionByName(head_messages(heads)), buckets), "heavy", "none")
    ws.drop("messages")
    ws.release()
    most = boundary(heavy)
    members = ws.save(groups(heavy, most), "groups", "none", rows)
    edges = ws.save(light_edges(heavy, most).unionByName(star_edges(members)), "edges", rows=rows)
    active = ws.save(heavy.select("node").join(heads, "node"), "active", rows=rows)
    ws.drop("heavy")
    ws.release()
    labels = components(spark, active, edges, ws, "first", rows)
    found = ws.save(scan_edges(members, labels, ws, rows), "found")
    ws.drop("groups")
    labels = components(spark, active, edges.unionByName(found), ws, "last", rows)
    own = F.struct("doc", classes["node"])
    return Joined(sets, classes.join(labels.withColumnRenamed("node", "at"), classes["node"] == F.col("at"), "left").select("sig", F.coalesce("label", own).alias("smallest")))


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs` (doc_id, text)."""
    ws = Workspace(docs.sparkSession, "jaccard")
    packed = ws.save(pack(docs), "packed", "none")
    joined = join_nodes(packed, ws)
    out = joined.sets.withColumn("sig", F.when(F.col("n") > 0, F.col("sig"))).join(joined.smallest, "sig", "left")
    real = lambda c: F.when(F.col(c) != LAST, F.col(c))
    out = out.select(real("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce(real("smallest.doc"), real("doc")).alias("component_id"))
    out = Workspace(docs.sparkSession, "components").save(out, "rows")
    ws.clear()
    ws.release()
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, the first by doc_id (nulls last), with all columns and whatever their names.

    A row whose text has no words links with nothing and stays, as do repeated
    ones of that kind; null texts stay null; of equal rows one stays; an empty
    table gives none.  Rows are packed once, in blocks of a few megabytes, and
    told by a list of places for each block which of them go; that list has
    two bytes a row at most, so while it is small no text is shuffled, and
    where it is not, blocks are shuffled compressed.
    """
    ws = Workspace(docs.sparkSession, "jaccard")
    packed = ws.save(pack_rows(docs), "packed", "none")
    joined = join_nodes(packed.select("block", "ids", "lens", "data"), ws)
    gone = joined.sets.where("n > 0").join(joined.smallest, "sig").where("node <> smallest.node")
    place = F.col("node").bitwiseAND(F.lit((1 << 15) - 1)).cast("short")
    lists = gone.groupBy(F.shiftright("node", 15).alias("block")).agg(F.collect_list(place).alias("gone"))  # at most a block's rows
    kept = Workspace(docs.sparkSession, "kept")
    lists = kept.save(lists, "gone", "none")
    told = packed.join(lists, "block", "left").select("lens", "data", "rest", "gone")
    out = kept.save(unpack_rows(told, docs.schema), "rows")
    ws.clear()
    kept.drop("gone")
    ws.release()
    return out


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))
