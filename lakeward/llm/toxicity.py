"""Toxicity by a classifier chain.

Categories are predicted one after another by linear (logistic) models; each
sees the text's features and the probabilities of the categories before it,
which are out-of-fold predictions in training.  The last category is whether
the text is toxic, and is no function of the ones before.  Features are hashed
words and their first 3 to 8 bytes; those that differ most between toxic and
other texts are kept.

Folds are dealt by the hash of the text, so that copies share one, and each
fold's features are chosen without it: no label of a text has a part in its
out-of-fold prediction, nor in the threshold that is fitted on these.

The chain is fitted on a bounded sample: the `SAMPLE` labelled documents with
the smallest hashes of their doc_id.  Every document is scored whole.

Defined cases: null, empty or wordless texts have no features and are scored
by the models' constants; labelled ids without a document, and documents with
several labels, are left out or take the largest; a null label counts as 0;
where leaving out a fold leaves no toxic, or no other, text to train
on (as few different texts may), folds are dealt by doc_id instead; with fewer
than `LEAST` toxic or other texts in the sample nothing is rejected and
probabilities are null; repeated rows are scored alike; texts of any length are scored whole; an
empty table gives no rows; other columns are ignored, or kept where rows are
filtered, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import LOWER, mix, span_table, text_slices
from .cluster import Workspace, lean, table

SAMPLE = 12_000
FEATURES = 3_000
FOLDS = 5
LEAST = 10
PREFIXES = (3, 4, 5, 6, 8)
CHAIN = ("low_quality", "toxic_low_quality", "toxic")

_WORD = np.zeros(256, dtype=bool)
_WORD[97:123] = _WORD[128:] = True


def hashed_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, index of its text, and words in each text."""
    data = LOWER[np.frombuffer(b"\n".join(texts), dtype=np.uint8)]
    solid = np.zeros(len(data) + 2, dtype=np.int8)
    solid[1:-1] = _WORD[data]
    edge = np.diff(solid)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begin = np.cumsum(np.array([0] + [len(t) + 1 for t in texts[:-1]], dtype=np.int64))
    owner = np.searchsorted(begin, start, side="right") - 1
    found, owners = [span_table(data, start, end)], [owner]
    for k in PREFIXES:
        long = end - start >= k
        found.append(mix(span_table(data, start[long], start[long] + k) + np.uint64(k)))
        owners.append(owner[long])
    return np.concatenate(found), np.concatenate(owners), np.bincount(owner, minlength=len(texts))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps on the constant and the columns of x."""
    a = np.hstack([np.ones((len(x), 1), x.dtype), x])
    w = np.zeros(a.shape[1])
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + penalty * w
        hessian = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


@dataclass
class Chain:
    """Kept features with their weight as toxic or not, the chain's models, and the threshold of the last."""

    features: np.ndarray
    signs: np.ndarray
    models: list[np.ndarray] = field(default_factory=list)
    threshold: float = 0.5

    def columns(self, feature: np.ndarray, owner: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Per text: log counts of kept toxic and other features, the same per length, and a constant for no words."""
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        hit = self.features[at] == feature
        at, owner = at[hit], owner[hit]
        sign = self.signs[at]
        n = len(words)
        strong = np.bincount(owner[sign > 0], sign[sign > 0], n)
        most = np.zeros(n)
        np.maximum.at(most, owner[sign > 0], sign[sign > 0])
        weak = np.bincount(owner[sign < 0], -sign[sign < 0], n)
        kinds = np.bincount(owner[sign > 0], minlength=n)
        per = np.maximum(words, 20)
        return np.column_stack([np.log1p(strong), np.log1p(kinds), most / 5, 100 * strong / per, np.log1p(100 * kinds / per), np.log1p(weak) / 3, np.log1p(words) / 5])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of each category per row of features."""
        out = np.zeros((len(x), 0))
        for w in self.models:
            out = np.column_stack([out, _probability(w, np.column_stack([x, out]))])
        return out


def fit(chain: Chain, x: np.ndarray, within: list[np.ndarray], fold: np.ndarray, labels: np.ndarray) -> None:
    """Fit the chain's models and threshold.

    `x` has features as the chain chose them, `within[f]` as they were chosen
    without fold f, `labels` a column for each category.  The categories'
    out-of-fold probabilities are the features of those behind them.
    """
    held = np.zeros((len(x), 0))
    for y in labels.T.astype(np.float64):
        chain.models.append(_logistic(np.column_stack([x, held]), y))
        p = np.zeros(len(x))
        for f in range(FOLDS):
            own = np.column_stack([within[f], held])
            p[fold == f] = _probability(_logistic(own[fold != f], y[fold != f]), own[fold == f])
        held = np.column_stack([held, p])
    cuts = np.linspace(0.3, 0.95, 66)
    tp = np.array([(labels[:, -1] * (p >= c)).sum() for c in cuts])
    fp = np.array([((1 - labels[:, -1]) * (p >= c)).sum() for c in cuts])
    chain.threshold = float(cuts[int(np.argmax(tp - 5 * fp))])


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic, quality of the documents the chain is fitted on; at most `sample` ids are broadcast."""
    ids = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.max(F.coalesce("quality", F.lit(0))).alias("quality"))
    ids = ids.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")


def chosen(frequencies: DataFrame, bad: Column, good: Column, n_bad: int, n_good: int) -> Chain | None:
    """The features that differ most between `n_bad` toxic and `n_good` other texts, of which `bad` and `good` have each."""
    rate = lambda c, n: (c + 0.2) / (n + 0.4)
    lift = F.log(rate(bad, n_bad) / rate(good, n_good))
    sure = F.abs(lift / F.sqrt(1 / (bad + 0.2) + 1 / (good + 0.2)))
    kept = frequencies.where((bad >= 3) | (good >= 30)).select("feature", lift.alias("lift"), sure.alias("sure")).where("sure >= 2.0 and abs(lift) >= 1.5")
    rows = kept.orderBy(F.desc("sure"), "feature").limit(FEATURES).collect()
    if not rows:
        return None
    keys = np.array([r["feature"] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Chain(keys[order], np.array([r["lift"] for r in rows])[order])


def train(docs: DataFrame, labels: DataFrame) -> Chain | None:
    ws = Workspace(docs.sparkSession, "toxicity")
    sample = labelled_sample(docs, labels)
    for by in ("text", "doc_id"):
        dealt = sample.withColumn("fold", F.pmod(F.xxhash64(by), F.lit(FOLDS)).cast("int"))
        dealt = ws.save(dealt, f"by-{by}")  # bounded, and read from now on
        sample = dealt.drop("fold")
        totals = np.zeros((FOLDS, 2), np.int64)
        for r in dealt.groupBy("fold", (F.col("toxic") > 0).cast("int").alias("t")).agg(F.count("*").alias("n")).collect():
            totals[r["fold"], r["t"]] = r["n"]
        if (totals.sum(axis=0) > totals).all():
            break
    try:
        return _train(dealt, totals, ws)
    finally:
        ws.clear()


def _train(sample: DataFrame, totals: np.ndarray, ws: Workspace) -> Chain | None:
    """The chain fitted on `sample`, of which `totals` has the other and toxic texts of each fold."""
    good, bad = totals.sum(axis=0).tolist()
    if min(bad, good) < LEAST or not (totals.sum(axis=0) > totals).all():
        return None

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, 0):
            toxic, own = np.array(batch.column(1).to_pylist(), dtype=np.int64) > 0, np.array(batch.column(2).to_pylist(), dtype=np.int64)
            feature, owner, _ = hashed_features(texts)
            once = np.unique(np.column_stack([feature.view(np.int64), owner]), axis=0)
            kinds, n = np.unique(np.column_stack([once[:, 0], own[once[:, 1]], toxic[once[:, 1]]]), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(kinds[:, 0])), pa.array(kinds[:, 1].astype(np.int32)), pa.array(kinds[:, 2].astype(bool)), pa.array(n)], names=["feature", "fold", "toxic", "n"])

    found = sample.select("text", F.col("toxic").cast("long"), "fold").mapInArrow(lean(frequencies), "feature long, fold int, toxic boolean, n long")
    count = lambda t, f: F.coalesce(F.sum(F.when((F.col("toxic") == t) & (F.col("fold") == f), F.col("n"))), F.lit(0)).alias(f"{'bad' if t else 'good'}{f}")
    table_ = ws.save(found.groupBy("feature").agg(*[count(t, f) for t in (True, False) for f in range(FOLDS)]), "features")
    sums = lambda kind, out: sum((F.col(f"{kind}{f}") for f in range(FOLDS) if f != out), F.lit(0))
    chains = [chosen(table_, sums("bad", f), sums("good", f), bad - int(totals[f, 1] if f >= 0 else 0), good - int(totals[f, 0] if f >= 0 else 0)) for f in (-1, *range(FOLDS))]
    if any(c is None for c in chains):
        return None

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, 1):
            features = hashed_features(texts)
            x = np.column_stack([c.columns(*features) for c in chains])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "toxic", "quality", "fold", "x"])

    rows = sample.select("doc_id", "text", F.col("toxic").cast("long"), F.col("quality").cast("long"), "fold").mapInArrow(lean(vectors), "doc_id long, toxic long, quality long, fold int, x array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    toxic, quality = (np.array([r[c] > 0 for r in rows], dtype=np.float64) for c in ("toxic", "quality"))
    x, *within = np.split(np.array([r["x"] for r in rows]), FOLDS + 1, axis=1)
    fit(chains[0], x, within, np.array([r["fold"] for r in rows]), np.column_stack([1 - quality, toxic * (1 - quality), toxic]))
    return chains[0]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the probability of each category, and whether the document is rejected."""
    spark = docs.sparkSession
    chain = train(docs, labels)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if chain is None:
        return ids.select("doc_id", *[F.lit(None).cast("double").alias(f"p_{c}") for c in CHAIN], F.lit(False).alias("rejected"))
    shared = spark.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, 1):
            p = shared.value.predict(shared.value.columns(*hashed_features(texts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in p.T], pa.array(p[:, -1] >= shared.value.threshold)], names=["doc_id", *[f"p_{c}" for c in CHAIN], "rejected"])

    return ids.mapInArrow(lean(run), "doc_id long, " + ", ".join(f"p_{c} double" for c in CHAIN) + ", rejected boolean")


def keep_clean(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of `docs` that the chain doesn't reject, with all their columns; `labelled` holds the labelled texts.

    Null, empty and very long texts, repeated rows, empty tables and any names of columns: as above, for each row alone.
    """
    chain = train(docs if labelled is None else labelled, labels)
    if chain is None:
        return docs
    shared, place = docs.sparkSession.sparkContext.broadcast(chain), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, place):
            p = shared.value.predict(shared.value.columns(*hashed_features(texts)))
            yield batch.filter(pa.array(p[:, -1] < shared.value.threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
