"""URL filter: rules first, then the log-likelihood ratio of two character models.

Two variable-order Markov models (orders 0 to `ORDER`, each smoothed into the
next lower by Witten-Bell weights) are trained on URLs that the rules accept
and reject; a URL without a rule is allowed if the difference of its
log-likelihoods, divided by its length, reaches a threshold calibrated on
held-out URLs.

Training uses every URL that a rule decides, once however often it occurs; Spark
counts its symbols.  URLs are held out by their hash, one in `HELD`; where that
leaves a kind without URLs to train or to calibrate on, all its URLs do both.
The counts are gathered on the driver and broadcast; they grow with the number
of different contexts.  Defined cases: a null
URL, or one without ``://``, has empty host and path and no rule, and is
judged by the models as it is (null as the empty string); where the rules
accept or reject no URL at all, there is no model, and URLs without a rule are
allowed; repeated rows and ties are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import Workspace, table

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
ORDER = 5
HELD = 5
BATCH_BYTES = 1 << 20
ALPHABET = 256
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWERED)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Adds host, path, rule and the rule's verdict; the longest rule that fits wins."""
    host, path = parts(F.col("url"))
    out = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("ruled", verdict)


def contexts(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, its `ORDER` preceding bytes as one number, and URL index, of each byte and each end mark."""
    data = [u.encode() for u in urls]
    lens = np.array([len(b) + 1 for b in data], dtype=np.int64)
    symbols = np.frombuffer(b"".join(b + b"\x01" for b in data), dtype=np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(urls)), lens)
    within = np.arange(len(symbols)) - np.repeat(np.cumsum(lens) - lens, lens)
    before = np.zeros(len(symbols), dtype=np.int64)
    for k in range(1, ORDER + 1):
        shifted = np.zeros_like(symbols)
        shifted[k:] = symbols[:-k] if k else symbols
        before |= np.where(within >= k, shifted, 0) << (8 * (k - 1))
    return symbols, before, owner


def grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers made of order, context and symbol, in order, and how often each occurs."""
    symbols, before, _ = contexts(urls)
    return np.unique(np.concatenate([(k << 48) | ((before & ((1 << (8 * k)) - 1)) << 8) | symbols for k in range(ORDER + 1)]), return_counts=True)


class MarkovModel:
    """Counts of symbols behind contexts of each order."""

    def __init__(self, urls: list[str]):
        self._fill(*grams(urls))

    @classmethod
    def counted(cls, keys: np.ndarray, counts: np.ndarray) -> MarkovModel:
        """The model of what `grams` counts."""
        model = cls.__new__(cls)
        model._fill(keys, counts)
        return model

    def _fill(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.orders = []
        for k in range(ORDER + 1):
            lo, hi = np.searchsorted(keys, [k << 48, (k + 1) << 48])
            pairs, count = keys[lo:hi] & ((1 << 48) - 1), counts[lo:hi]
            owners, first = np.unique(pairs >> 8, return_index=True)
            types = np.diff(np.append(first, len(pairs)))
            self.orders.append((pairs, count, owners, np.add.reduceat(count, first), types))

    def log_likelihood(self, symbols: np.ndarray, before: np.ndarray) -> np.ndarray:
        p = np.full(len(symbols), 1.0 / ALPHABET)
        for k, (pairs, count, owners, totals, types) in enumerate(self.orders):
            context = before & ((1 << (8 * k)) - 1)
            total, kinds = _lookup(owners, totals, context), _lookup(owners, types, context)
            seen = _lookup(pairs, count, (context << 8) | symbols)
            p = np.where(total > 0, (seen + kinds * p) / np.maximum(total + kinds, 1), p)
        return np.log(p)


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def scores(models: list[MarkovModel], urls: list[str]) -> np.ndarray:
    """Length-normalised log-likelihood differences."""
    symbols, before, owner = contexts(urls)
    gain = models[0].log_likelihood(symbols, before) - models[1].log_likelihood(symbols, before)
    return np.bincount(owner, gain, len(urls)) / np.bincount(owner, minlength=len(urls))


def _few(urls: pd.Series) -> Iterator[np.ndarray]:
    """Places of URLs that aren't null, about `BATCH_BYTES` characters of them (or one longer) at a time."""
    known = np.flatnonzero(urls.notna())
    if len(known):
        turn = np.cumsum([len(u) for u in urls.iloc[known]]) // BATCH_BYTES
        yield from np.split(known, np.flatnonzero(np.diff(turn)) + 1)


def scored_by(shared: Broadcast, url: Column) -> Column:
    """Scores of URLs by broadcast models, NaN for null."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.full(len(batch), np.nan)
            for some in _few(batch):
                out[some] = scores(shared.value, batch.iloc[some].tolist())
            yield pd.Series(out)

    return score(url)


@dataclass
class UrlClassifier:
    """The two models, as broadcast, and their threshold."""

    shared: Broadcast
    threshold: float
    held_out_accuracy: float


def count_grams(urls: DataFrame) -> list[MarkovModel]:
    """The models of kinds 0 and 1 over all rows (url, kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: tuple[list[str], list[str]] = ([], [])
            size = 0
            for at, (url, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), 1):
                held[kind].append(url)
                size += len(url)
                if size >= BATCH_BYTES or at == batch.num_rows:
                    for k, some in enumerate(held):
                        if some:
                            keys, counts = grams(some)
                            yield pa.RecordBatch.from_arrays([pa.array(keys | (k << 52)), pa.array(counts)], names=["gram", "n"])
                            some.clear()
                    size = 0

    found = urls.select("url", "kind").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    keys, counts = found.column("gram").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    cut = np.searchsorted(keys, 1 << 52)
    return [MarkovModel.counted(keys[:cut], counts[:cut]), MarkovModel.counted(keys[cut:] - (1 << 52), counts[cut:])]


def train(labelled: DataFrame) -> UrlClassifier | None:
    """A classifier from rows (url, ruled); None where either kind is missing."""
    spark = labelled.sparkSession
    work = Workspace(spark, "urls")
    known = labelled.where("ruled is not null").select("url", (F.col("ruled") == "block").cast("int").alias("kind")).distinct()
    known = work.save(known.withColumn("held", F.pmod(F.xxhash64("url"), F.lit(HELD)) == 0), "known")
    split = {(r.kind, r.held) for r in known.groupBy("kind", "held").count().collect()}
    if len({kind for kind, _ in split}) < 2:
        work.clear()
        return None
    both = F.col("kind").isin([kind for kind in (0, 1) if not {(kind, True), (kind, False)} <= split])
    shared = spark.sparkContext.broadcast(count_grams(known.where(~F.col("held") | both)))
    found = known.where(F.col("held") | both).select("kind", scored_by(shared, F.col("url")).alias("score")).toArrow()
    work.clear()
    kind, score = found.column("kind").to_numpy(), found.column("score").to_numpy()
    good, bad = np.sort(score[kind == 0]), np.sort(score[kind == 1])
    cuts = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([cuts[:1], (cuts[1:] + cuts[:-1]) / 2])
    right = (len(good) - np.searchsorted(good, cuts)) / len(good) + np.searchsorted(bad, cuts) / len(bad)
    return UrlClassifier(shared, float(cuts[int(np.argmax(right))]), float(right.max() / 2))


def judge(spark: SparkSession, pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides or there is no model)."""
    urls = ruled(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")), rules)
    classifier = train(urls)
    if classifier is None:
        scored = urls.withColumn("score", F.lit(None).cast("double"))
        passed = F.lit(True)
    else:
        asked = F.when(F.col("rule").isNull(), F.coalesce("url", F.lit("")))  # what a rule decides is not scored
        scored = urls.withColumn("score", F.nanvl(scored_by(classifier.shared, asked), F.lit(None)))
        passed = F.col("score") >= classifier.threshold
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(passed, "allow").otherwise("block")).alias("verdict"), "score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "pages"))
