"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bitmap, cut, lean, slices

#: Statistics of a text, in the order of `statistics`.
NAMES = ("words", "word_length", "upper", "digits", "symbols", "pauses", "exclaims", "bars", "lines", "distinct", "repeats", "wide", "longest")
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PAUSE = np.zeros(256, bool)
_PAUSE[[ord(c) for c in ".,;:?"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:?!|'\"-()=+@_/"]] = True


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text: logarithms of sizes, square roots of shares.

    Shares are taken as if some plain bytes and words came before, so that a short text's aren't extreme."""
    text = text or ""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    hist = np.bincount(raw, minlength=256)
    n = len(raw) + 40
    words = text.split()
    w = len(words) + 8
    distinct = len(set(words))
    repeats = sum(map(operator.eq, words, words[1:]))
    accented = "" if text.isascii() else text
    upper = hist[_UPPER].sum() + sum(accented.count(c) for c in "ÄÖÜÉÈÊÇÑÍÓÁÀ")
    share = lambda x: float(np.sqrt(x / n))
    return [
        float(np.log1p(len(words))), float(np.log1p((len(text) + 48) / w)), share(upper), share(hist[_DIGIT].sum()), share(hist[_SYMBOL].sum()),
        share(hist[_PAUSE].sum()), share(hist[33]), share(hist[124]), share(hist[10]), float(np.log1p(distinct + 8) / np.log1p(w)),
        float(np.sqrt(repeats / w)), share(hist[128:].sum()), float(np.log1p(max(map(len, words), default=0))),
    ]


class QuadraticDiscriminant:
    """Two Gaussian classes with shrunk covariances; scores come from cached Cholesky factors."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = 0.1, temper: float = 0.5):
        d = len(NAMES)
        self.temper, self.classes = temper, {}
        total = sum(n for n, _, _ in moments.values())
        if not total:
            self.centre, self.scale = np.zeros(d), np.ones(d)
            return
        mean = sum(s for _, s, _ in moments.values()) / total
        square = sum(np.diag(o) for _, _, o in moments.values()) / total
        self.centre, self.scale = mean, np.sqrt(np.maximum(square - mean**2, 1e-6))
        for label, (n, s, outer) in moments.items():
            if n:
                mu = s / n
                cov = (outer / n - np.outer(mu, mu)) / np.outer(self.scale, self.scale)
                cov = (1 - shrinkage) * cov + shrinkage * max(np.trace(cov) / d, 1e-3) * np.eye(d) + 1e-4 * np.eye(d)
                chol = np.linalg.cholesky(cov)
                self.classes[label] = (np.linalg.inv(chol), (mu - self.centre) / self.scale, float(2 * np.log(np.diag(chol)).sum()), float(np.log(n / total)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability-like score of label 1. With one learned class that class's label; with none 0.5."""
        if len(self.classes) < 2:
            return np.full(len(x), float(next(iter(self.classes), 0.5)))
        z = (x - self.centre) / self.scale
        log = {}
        for label, (inv, mu, det, prior) in self.classes.items():
            log[label] = prior - 0.5 * (det + (((z - mu) @ inv.T) ** 2).sum(1))
        return 1 / (1 + np.exp(-np.clip(self.temper * (log[1] - log[0]), -60, 60)))


def features(docs: DataFrame, id_col: str, text_col: str, among: DataFrame | None = None) -> DataFrame:
    """`(id_col, x array<double>)` for each document, or for those with an id in `among(id)` and a few others; narrow."""
    kind = docs.schema[id_col].dataType.simpleString()
    holds, place = bitmap(among) if among is not None else (None, lambda i: F.lit(0))

    def run(batches):
        for batch in slices(batches):
            if holds is not None:
                batch = batch.filter(pa.array(holds(batch.column(2).to_numpy())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=[id_col, "x"])

    return docs.select(F.col(id_col), F.col(text_col), place(F.col(id_col)).alias("p")).mapInArrow(lean(run), f"`{id_col}` {kind}, x array<double>")


def fit(labelled: DataFrame, label_col: str, shrinkage: float = 0.1) -> QuadraticDiscriminant:
    """Fit from `(x, label_col)` rows, all of them: class moments are summed in parallel, and only
    2 * (1 + d + d * d) sums reach the driver."""
    d = len(NAMES)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), dtype=float).reshape(-1, d)
            y = np.array(batch.column(1).to_pylist())
            for label in (0, 1):
                own = x[y == label]
                v = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(v), pa.int32()), pa.array(range(len(v)), pa.int32()), pa.array(v)], names=["label", "k", "v"])

    sums = labelled.where(F.col(label_col).isin(0, 1)).select("x", F.col(label_col).cast("int")).mapInArrow(lean(run), "label int, k int, v double")
    moments = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
    for r in sums.groupBy("label", "k").agg(F.sum("v").alias("v")).collect():
        moments[r["label"]][r["k"]] = r["v"]
    return QuadraticDiscriminant({y: (v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d)) for y, v in moments.items()}, shrinkage)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn=None, threshold: float = 0.7, shrinkage: float = 0.1) -> DataFrame:
    """Score every document; returns `id_col, score, predicted` with predicted 1 at `threshold` or more.

    Learns from rows of `labels` (joined by `id_col`) for which the column expression `learn`
    holds; labels other than 0 and 1, null labels and null ids teach nothing. Only the text is
    an input of a score. Null texts count as empty and get a score; repeated rows are scored
    each; an empty table gives an empty result; without labels every score is 0.5; other columns
    are ignored. Texts are read once, and only their statistics are checkpointed, then joined with the labels."""
    x = cut(features(docs, id_col, text_col))
    taught = labels.select(F.col(id_col), F.col(label_col).alias("_label"))
    model = fit(x.where(learn if learn is not None else F.lit(True)).join(taught, id_col), "_label", shrinkage)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) if len(batch) else np.zeros((0, len(NAMES)))
            s = model.score(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return x.mapInArrow(lean(run), f"`{id_col}` {kind}, score double, predicted int")


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, shrinkage: float = 0.1) -> DataFrame:
    """The documents of score `threshold` or more, with all their columns.

    Learns like `classify`, from statistics of the labelled documents alone. They are checkpointed: with labels few
    enough to be broadcast, a task would otherwise hold two workers, which an executor then keeps for
    good. The filter is narrow: statistics are taken as the texts stream by, so no text is shuffled. Nulls
    and empty tables are treated as in `classify`."""
    taught = labels.select(F.col(id_col), F.col(label_col).alias("_label"))
    some = taught.where(F.col("_label").isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast(docs.schema[id_col].dataType).alias("id"))
    model = fit(cut(features(docs, id_col, text_col, some)).join(taught, id_col), "_label", shrinkage)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            x = np.array([statistics(t) for t in batch.column(at).to_pylist()]).reshape(-1, len(NAMES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)
