"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) with x_i the presence of a
term: words, and the first letters of words, which inflected forms share. The pairwise part
learns what additive weights miss: two terms that are toxic only together, or several of
which each says the same. It is computed as half of |sum v_i|^2 - sum |v_i|^2.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .sampling import fold, labelled_sample

SPACE = 1 << 22
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
_memo: dict[str, tuple[int, ...]] = {}


def _hashes(word: str) -> tuple[int, ...]:
    """The slots of a word and of its first 4 and 5 letters."""
    import xxhash

    h = xxhash.xxh32_intdigest
    out = [h("w" + word) % SPACE]
    out += [h(f"p{k}" + word[:k]) % SPACE for k in (4, 5) if len(word) >= k]
    return tuple(out)


def _terms(text: str | None) -> set[int]:
    """All slots of a whole text. The memo of words is bounded and only saves time."""
    out: set[int] = set()
    for word in set(_WORD.findall((text or "").lower())):
        slots = _memo.get(word)
        if slots is None:
            if len(_memo) > 200_000:
                _memo.clear()
            slots = _memo[word] = _hashes(word)
        out.update(slots)
    return out


@dataclass
class FactorizationMachine:
    slots: np.ndarray  # sorted hash slots of the terms that count
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        known = {int(s): i for i, s in enumerate(self.slots)}
        margins = np.empty(len(texts))
        for k, text in enumerate(texts):
            if text is None:
                text = ""
            at = [known[s] for s in _terms(text) if s in known]
            v = self.factors[at]
            pair = 0.5 * float((v.sum(0) ** 2).sum() - (v**2).sum()) if at else 0.0
            margins[k] = self.bias + float(self.weights[at].sum()) + pair
        return 1 / (1 + np.exp(-np.clip(margins, -40, 40)))


def fit(slots: list[np.ndarray], labels: np.ndarray, terms: int = 3000, least: float = 14.0, rank: int = 6, epochs: int = 40, seed: int = 11) -> FactorizationMachine:
    """Learns from the term sets of a sample. At most `terms` terms are kept, those
    that best tell the labels apart, by a likelihood ratio of at least `least`; without rows of both labels every score is the share of label 1."""
    n, positive = len(labels), float(labels.sum())
    if not n or positive in (0, n):
        share = min(max(positive / n if n else 0.0, 1e-6), 1 - 1e-6)
        return FactorizationMachine(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, rank)))
    every = np.concatenate(slots) if slots else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), [len(s) for s in slots])
    found, column, count = np.unique(every, return_inverse=True, return_counts=True)
    ones = np.bincount(column, weights=labels[owner], minlength=len(found))
    # Likelihood ratio of presence and label, 2 n times their mutual information.
    worth = np.zeros(len(found))
    for k, all_y in ((ones, positive), (count - ones, n - positive)):
        for part, all_part in ((k, count), (all_y - k, n - count)):
            with np.errstate(divide="ignore", invalid="ignore"):
                worth += np.where(part > 0, 2 * part * np.log(part * n / (all_part * all_y)), 0)
    kept = np.sort(np.argsort(-worth, kind="stable")[: min(terms, int((worth >= least).sum()))])
    place = np.full(len(found), -1)
    place[kept] = np.arange(len(kept))
    at = place[column]
    x = np.zeros((n, len(kept)), np.float32)
    x[owner[at >= 0], at[at >= 0]] = 1
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(kept), np.float32), rng.normal(0, 0.01, (len(kept), rank)).astype(np.float32)
    b = float(np.log(positive / (n - positive)))
    gw, gv, gb = np.full_like(w, 1e-6), np.full_like(v, 1e-6), 1e-6
    weight = np.where(labels > 0, 0.5 * n / positive, 0.5 * n / (n - positive)).astype(np.float32)
    y = labels.astype(np.float32)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(n), max(1, n // 256)):
            r = x[rows]
            s = r @ v
            m = b + r @ w + 0.5 * ((s**2).sum(1) - r @ (v**2).sum(1))
            e = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[rows]) * weight[rows] / len(rows)
            dw = r.T @ e + 2e-4 * w
            dv = r.T @ (e[:, None] * s) - (r.T @ e)[:, None] * v + 1e-3 * v
            gw += dw**2
            gv += dv**2
            gb += e.sum() ** 2
            w -= 0.2 * dw / np.sqrt(gw)
            v -= 0.02 * dv / np.sqrt(gv)
            b -= 0.2 * float(e.sum()) / gb**0.5
    return FactorizationMachine(found[kept], b, w.astype(float), v.astype(float))


def train(docs: DataFrame, labels: DataFrame, most: int = 3000) -> FactorizationMachine:
    """Fits on at most `most` documents of each label (see labelled_sample)."""

    def termed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, y = (c.to_pylist() for c in batch.columns)
            slots = [np.array(sorted(_terms(t)), np.int32).tobytes() for t in texts]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(y, pa.int32()), pa.array(slots, pa.binary())], names=["doc_id", "y", "slots"])

    rows = labelled_sample(docs, labels, "toxic", most).select("doc_id", "text", "y").mapInArrow(termed, "doc_id long, y int, slots binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.slots))
    return fit([np.frombuffer(r.slots, np.int32).astype(np.int64) for r in rows], np.array([r.y for r in rows], float))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Every document's toxicity: doc_id, held_out, score, predicted, then the columns `keep`.

    Null and empty texts are scored as texts without terms. A null doc_id is never held
    out (null). Equal rows get equal scores. Inputs are the texts alone.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    keep = keep or []

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.value.scores(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s)], names=[*batch.schema.names[1:], "score"])

    rows = docs.select(F.col("text").cast("string").alias("_scored"), F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(f"_{c}") for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    out = rows.mapInArrow(scored, f"{schema}, score double")
    return out.select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[F.col(f"_{c}").alias(c) for c in keep])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
