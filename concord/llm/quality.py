"""Quality by a regularised quadratic discriminant.

Statistics of a document (shares of character kinds, word lengths, repetition) are transformed to be closer to
normal; each class gets its own mean and a covariance shrunk towards the pooled diagonal. The score is the logistic
of the difference of the two Mahalanobis log-densities plus the log prior, from Cholesky factors held in the model.

Class moments are sums over partitions, added up in Spark; only the 2 x (1 + d + d * d) sums reach the driver.

Defined cases: a null text counts as empty; an empty text gets the statistics of zero words and so a score like any
other; very long texts are read whole; labels other than 0 and 1 and null doc_ids are not learned from; a doc_id
labelled twice counts once with its smaller label; if a class has no rows to learn from, the score is the share of
label 1 (0.5 without any label); columns other than those named are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import held_out, thinned

NAMES = ("log_words", "letters", "upper", "digits", "marks", "word_length", "distinct", "top_word", "adjacent", "marked_words", "line_length", "repeated_lines")
#: At most about so many labelled rows are learned from, chosen by a hash of doc_id.
MAX_FIT = 60_000

_KIND = np.zeros(256, dtype=np.int64)  # 0 other control, 1 lower, 2 upper, 3 digit, 4 space, 5 mark, 6 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[[32, 9, 10, 11, 12, 13]] = 4
for _lo, _hi in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _KIND[_lo:_hi] = 5
_ENDS = frozenset(b"!#$%&*|<>=~^@+")


def _logit(x: float) -> float:
    return float(np.log((x + 0.002) / (1.002 - x)))


def statistics(text: bytes | None) -> list[float]:
    text = text or b""
    kinds = np.bincount(_KIND, weights=np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256), minlength=7)
    inked = max(1.0, len(text) - kinds[4])
    words = text.split()
    n = len(words)
    if not n:
        return [0.0, _logit(0), _logit(0), _logit(0), _logit(0), 0.0, 1.0, _logit(0), _logit(0), _logit(0), 0.0, _logit(0)]
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    cased = max(1.0, kinds[1] + kinds[2])
    return [
        float(np.log1p(n)),
        _logit(min(1.0, (kinds[1] + kinds[2] + kinds[6]) / inked)),
        _logit(kinds[2] / cased),
        _logit(kinds[3] / inked),
        _logit(kinds[5] / inked),
        float(np.log(inked / n)),
        float(np.log(len(counts)) / np.log(n + 1)),
        _logit(max(counts.values()) / (n + 4)),
        _logit(sum(map(bytes.__eq__, words, words[1:])) / n),
        _logit(sum(w[-1] in _ENDS for w in words) / n),
        float(np.log1p(n / len(lines))),
        _logit((len(lines) - len(set(lines))) / len(lines)),
    ]


class Discriminant:
    """Means, Cholesky factors and log-determinants of the two classes."""

    def __init__(self, count: np.ndarray, total: np.ndarray, square: np.ndarray, shrinkage: float = 0.1, floor: float = 1e-3) -> None:
        self.share = float((count[1] + 1) / (count.sum() + 2)) if count.sum() else 0.5
        self.known = bool((count > 1).all())
        if not self.known:
            return
        d = total.shape[1]
        self.mean = total / count[:, None]
        cov = square / count[:, None, None] - self.mean[:, :, None] * self.mean[:, None, :]
        pooled = (cov * count[:, None, None]).sum(axis=0) / count.sum()
        target = np.diag(np.maximum(np.diag(pooled), floor))
        weight = np.maximum(shrinkage, d / (count + d))
        self.factor = [np.linalg.inv(np.linalg.cholesky((1 - w) * c + w * target + floor * np.eye(d))) for w, c in zip(weight, cov)]
        self.log_det = [2 * float(np.log(np.diag(f)).sum()) for f in self.factor]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), self.share)
        logs = [0.5 * self.log_det[k] - 0.5 * (((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        z = logs[1] - logs[0] + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def labelled_sample(labels: DataFrame, label: str, modulus: int, remainder: int, bound: int) -> DataFrame:
    """(doc_id, y) of the rows to learn from: not held out, label 0 or 1, thinned by a hash to about `bound` rows."""
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), modulus, remainder))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
    )
    share = min(1.0, bound / max(1, rows.count()))
    return rows.where(thinned(share, "doc_id"))


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_FIT) -> Discriminant:
    d = len(NAMES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = batch.column("y").to_numpy()
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()]).reshape(-1, d)
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        at = np.arange(sums.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel())], ["at", "v"])

    sample = F.broadcast(labelled_sample(labels, "quality", 5, 0, bound))  # `bound` rows of 12 bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(sample, "doc_id")
    sums = np.zeros((2, 1 + d + d * d))
    for at, v in rows.select("text", "y").mapInArrow(moments, "at long, v double").groupBy("at").agg(F.sum("v")).collect():
        sums.ravel()[at] = v
    return Discriminant(sums[:, 0], sums[:, 1 : 1 + d], sums[:, 1 + d :].reshape(2, d, d))


def score(model: Discriminant, text: Column) -> Column:
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(model.score(np.array([statistics(t) for t in texts])))

    return of(text.cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """documents -> (doc_id, held_out, score, predicted)."""
    model = fit(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 5, 0).alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    return docs.where(score(fit(docs, labels), F.col("text")) >= threshold)
