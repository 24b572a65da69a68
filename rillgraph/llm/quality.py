"""Quality: Bradley-Terry ranking of documents from pairwise preferences.

A document of label 1 is preferred to one of label 0. Each pair gives the logistic loss of
w . (f(better) - f(worse)); the learnt score w . f(x) orders all documents, and a quantile
of the scores, at the share of label 0 in the sample, is the cut between the classes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .sampling import fold, labelled_sample

THRESHOLD = 0.7
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~[]"]] = True
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "!?"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPREAD = np.array([1.0, 30.0, 1000.0])  # shares at three scales, so that a little of something shows
SHARES = 9
FEATURES = SHARES * len(_SPREAD) + 4


def features(text: str | None) -> np.ndarray:
    """Shape of a whole text; zeros for one without words."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return np.zeros(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    size = len(raw)
    symbol = _SYMBOLS[raw]
    again = sum(map(eq, words, words[1:]))
    pairs = Counter(zip(words, words[1:], strict=False))
    common = pairs.most_common(1)[0][1] - 1 if pairs else 0
    upper = sum(map(str.isupper, words))
    bare = sum(1 for w in words if not w[0].isalnum() and not w[-1].isalnum()) / n
    shares = [
        counts[_SYMBOLS].sum() / size,
        counts[_MARKS].sum() / size,
        counts[_UPPER].sum() / size,
        counts[_DIGIT].sum() / size,
        again / n,
        upper / n,
        bare,
        common / n,
        float((symbol[1:] & (raw[1:] == raw[:-1])).sum()) / size,
    ]
    unlike = len(set(words)) / n
    spread = np.log1p(np.outer(np.array(shares, float), _SPREAD)).ravel()
    return np.concatenate((spread, [np.log1p(n), unlike, unlike * np.log1p(n), np.log1p(size / n)]))


@dataclass
class BradleyTerry:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float  # the quantile of the scores that parts the classes
    slope: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the cut is at THRESHOLD."""
        m = ((x - self.mean) / self.scale) @ self.weights
        at = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.slope * (m - self.cut) + at, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, epochs: int = 25, share: float | None = None, seed: int = 5) -> BradleyTerry:
    """Learns from at most `pairs` sampled preferences. `share` is the share of label 0 among
    all labelled rows (of the sample, if not given); without both labels every document is kept."""
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return BradleyTerry(mean, scale, np.zeros(FEATURES), 0.0 if len(good) or not len(bad) else 1.0, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    n = min(pairs, len(good) * len(bad))
    d = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w, g = np.zeros(FEATURES), np.full(FEATURES, 1e-6)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(n), max(1, n // 512)):
            r = d[rows]
            grad = -r.T @ (1 / (1 + np.exp(np.clip(r @ w, -30, 30)))) / len(rows) + 1e-4 * w
            g += grad**2
            w -= 0.2 * grad / np.sqrt(g)
    m = ((x - mean) / scale) @ w
    # The quantile of the mixture of both classes, in their true shares, that leaves `share` below.
    share = len(bad) / len(y) if share is None else share
    order = np.argsort(m, kind="stable")
    mass = np.where(y[order] == 0, share / len(bad), (1 - share) / len(good))
    k = int(np.searchsorted(np.cumsum(mass), share))
    around = m[order[max(0, k - 1)]], m[order[min(k + 1, len(order) - 1)]]
    cut = float(sum(around)) / 2
    spread = float(np.median(m[good]) - np.median(m[bad]))
    return BradleyTerry(mean, scale, w, cut, 8 / max(abs(spread), 1e-6))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.binary())], names=["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, most: int = 3000) -> BradleyTerry:
    """Fits on at most `most` documents of each label (see labelled_sample)."""
    rows = labelled_sample(docs, labels, "quality", most).select("doc_id", "text", "y").mapInArrow(_featured, "doc_id long, y int, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.x))
    of = {r.quality: r.n for r in labels.where(fold() != 2).where("quality in (0, 1)").groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(of.values())
    x = np.stack([np.frombuffer(r.x) for r in rows]) if rows else np.zeros((0, FEATURES))
    return fit(x, np.array([r.y for r in rows], float), share=of.get(0, 0) / total if total else None)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every document's quality: doc_id, held_out, score, predicted.

    Null and empty texts have the features of no words. A null doc_id is never held out
    (null). Equal texts get equal scores. Inputs are the texts alone.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            x = np.stack([features(t) for t in texts]) if texts else np.zeros((0, FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(x))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
