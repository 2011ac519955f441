"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Both models are bags of hashed words and word pairs (`BUCKETS` buckets, one
added to each count).  A document's weight is the log of the ratio of its
likelihoods; adding Gumbel noise (from a hash of doc_id) and keeping the
largest keys samples without replacement in proportion to the weights.

The raw model counts every document.  The target model is fitted on a bounded
sample: the `SAMPLE` documents labelled good with the smallest hashes of their
doc_id.  The k-th largest key is found by counting keys in bins and binning the
one that holds it again, until a bin has a single value: no task sorts or
holds a bin, whatever the spread of the keys.

Defined cases: null or empty texts have weight 0; texts of any length are
counted whole, a few megabytes at a time; equal doc_ids with equal texts get
equal keys, and ties at the last place are broken by doc_id (nulls last), then
by the place of the row, so that exactly as many rows are drawn as asked for; without labelled documents the target is the
raw model, all weights are 0 and the sample is uniform; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import batch_ngrams, batch_words, text_slices
from .cluster import Workspace, table

BUCKETS = 10_000
SAMPLE = 10_000
KEEP = 0.75
BINS = 4096
LAST = (1 << 63) - 1
SEED = 17


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word and word pair, and the index of its text."""
    words, owner = batch_words(texts)
    pairs, at = batch_ngrams(words, owner, 2)
    return (np.concatenate([words, pairs]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([owner, owner[at]])


def counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the texts of `docs`; tasks send sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for _, texts in text_slices(batches, 0):
            total += np.bincount(features(texts)[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, the log of the models' ratio; zero without a target."""
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def weighed(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, log_weight and Gumbel key of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, 1):
            bucket, owner = features(texts)
            weight = np.bincount(owner, ratios[bucket], len(texts)).astype(np.float64)  # without words they are integers
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight)], names=["doc_id", "log_weight"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, log_weight double")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    return scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))


def kth_largest(rows: DataFrame, column: str, k: int) -> tuple[float | int, int]:
    """The k-th largest value of a column without nulls, and how many rows are larger.

    Each round counts the rows of `BINS` bins and goes on within the one that
    has the wanted row; a bin of one value ends it.
    """
    whole = rows.schema[column].dataType.typeName() == "long"
    above = 0
    span = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi = span["lo"], span["hi"]
    while lo < hi:
        left = rows.where(F.col(column).between(F.lit(lo), F.lit(hi)))
        if whole:  # numbers are split exactly
            width = max(1, -(-(hi - lo + 1) // BINS))
            place = F.floor((F.col(column).cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)"))
        else:
            place = F.floor((F.col(column) / 2 - lo / 2) / max(hi / 2 - lo / 2, 5e-324) * BINS)
        place = F.when(F.col(column) == hi, BINS - 1).otherwise(F.least(place.cast("int"), F.lit(BINS - 2)))
        bins = left.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for b in sorted(bins, key=lambda b: -b["bin"]):
            if above + b["n"] >= k:
                lo, hi = b["lo"], b["hi"]
                break
            above += b["n"]
    return lo, above


def top_k(keyed: DataFrame, k: int) -> DataFrame:
    """Adds `selected`: whether the row's key is among the k largest.  `keyed` must be stored, for its rows to keep their place."""
    if k <= 0 or not keyed.limit(1).count():
        return keyed.withColumn("selected", F.lit(False))
    order = {"gumbel_key": F.col("gumbel_key"), "by_id": F.bitwise_not(F.coalesce(F.col("doc_id"), F.lit(LAST))), "by_row": F.bitwise_not("row")}
    rows, selected, so_far, k = keyed.withColumns(order), F.lit(False), F.lit(True), k
    for name in order:
        edge, above = kth_largest(rows, name, k)
        selected = selected | (so_far & (F.col(name) > edge))
        so_far = so_far & (F.col(name) == edge)
        k -= above
        rows = rows.where(F.col(name) == edge)
    return keyed.withColumns(order).withColumn("selected", selected | so_far).drop(*[c for c in order if c != "gumbel_key"])


def resample(docs: DataFrame, target: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, log_weight, gumbel_key, selected for each row of `docs`; `target` holds the texts to resemble."""
    ratios = log_ratios(counts(docs), counts(target))
    ws = Workspace(docs.sparkSession, "resample")
    keyed = ws.save(weighed(docs, ratios).withColumn("row", F.monotonically_increasing_id()), "keys")
    return top_k(keyed, round(keyed.count() * keep)).drop("row")


def good_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The labelled sample that the target model is fitted on: at most `sample` ids, so they may be broadcast."""
    ids = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return resample(docs, good_sample(docs, table(spark, sf_dir, "labels")))
