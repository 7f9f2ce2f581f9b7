"""Quality scores by a regularised quadratic discriminant (operator 2).

Each text gives a vector of transformed statistics. Class means and covariances come from sums that Spark makes over all
labelled rows; covariances shrink towards the pooled one and its diagonal. A document's score follows from the difference of
log densities, with Mahalanobis distances by cached Cholesky factors, through a logistic curve fitted on a histogram of the
training rows' differences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled, materialise

BINS = 400  # of the calibration histogram
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:?'\"()-", "symbol": b"!#$%&*+/<=>@[\\]^_`{|}~", "blank": b" \t\r\n\x0b\x0c"}
_CLASS = np.full(256, len(CLASSES), np.int64)
for _i, _members in enumerate(CLASSES.values()):
    _CLASS[np.frombuffer(_members, np.uint8)] = _i
NAMES = ("log_words", "word_length", "upper", "digit", "stop", "symbol", "other", "unique", "common", "log_line", "line_repeats", "stopped_lines", "capital_words", "entropy")


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text, in the order of NAMES; an empty text gives zeros."""
    if not text:
        return [0.0] * len(NAMES)
    raw = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(raw, minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=len(CLASSES) + 1)
    lower, upper, digit, stop, symbol, blank, other = kinds
    inked = max(1.0, len(raw) - blank)
    words = text.split()
    n = max(1, len(words))
    unique = len(set(words))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    share = counts[counts > 0] / len(raw)
    root = lambda x: float(np.arcsin(np.sqrt(min(1.0, max(0.0, x)))))  # noqa: E731  evens out the variance of shares
    return [
        float(np.log1p(len(words))), float(np.log(inked / n)), root(upper / inked), root(digit / inked), root(stop / inked), root(symbol / inked), root(other / inked),
        float(np.log(unique / n + 1e-3)), float(np.log(unique / n**0.75 + 1e-3)), float(np.log1p(len(raw) / max(1, len(lines)))), root(1 - len(set(lines)) / max(1, len(lines))),
        root(sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines))), root(upper / max(1.0, upper + lower)), float(-(share * np.log(share)).sum()),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of every row; a null text counts as empty."""

    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                x = [statistics(t.as_py() or "") for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Standardisation, and for each class mean, Cholesky factor of the covariance and log weight; then the curve.

    ``factors`` holds the inverses of the lower Cholesky factors, found once in ``fit``: whitening a batch is one product.
    """

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with prior weights, over the square root of the dimension."""
        z = (x - self.centre) / self.scale
        logs = []
        for k in (0, 1):
            y = (z - self.means[k]) @ self.factors[k].T
            logs.append(self.offsets[k] - 0.5 * (y * y).sum(1))
        return (logs[1] - logs[0]) / np.sqrt(x.shape[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.shift, -30, 30)))


def fit(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrink: float, diagonal: float) -> Discriminant:
    """The discriminant from counts (2), sums (2, d) and sums of products (2, d, d)."""
    d = sums.shape[1]
    n = np.maximum(n, 1e-9)
    centre = sums.sum(0) / n.sum()
    pooled = squares.sum(0) / n.sum() - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    means = sums / n[:, None]
    covs = [(squares[k] / n[k] - np.outer(means[k], means[k])) / np.outer(scale, scale) for k in (0, 1)]
    within = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    target = (1 - diagonal) * within + diagonal * np.diag(np.diag(within))
    factors, offsets = [], []
    for k in (0, 1):
        weight = shrink + (1 - shrink) * d / (d + n[k])  # few rows shrink more
        cov = (1 - weight) * covs[k] + weight * target + 1e-3 * np.eye(d)
        lower = np.linalg.cholesky((cov + cov.T) / 2)
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(n[k] / n.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(centre, scale, (means - centre) / scale, np.array(factors), np.array(offsets))


def calibrate(model: Discriminant, at: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Discriminant:
    """Slope and shift of the logistic curve by Newton steps on weighted differences, slightly regularised."""
    b = np.array([1.0, 0.0])
    x = np.column_stack([at, np.ones_like(at)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (label - p)) - 1e-2 * (b - [1.0, 0.0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.shift = float(b[0]), float(b[1])
    return model


def train(stats: DataFrame, labels: DataFrame, label: str, shrink: float = 0.1, diagonal: float = 0.2) -> Discriminant | None:
    """Fits on the rows of ``stats`` (doc_id, x) that have labels; all of them count. None without both classes."""
    rows = materialise(stats.join(labelled(stats, labels, label), "doc_id").select("label", "x"), "labelled")
    d = len(NAMES)

    def moments(batches):
        n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for k in (0, 1):
                own = x[y == k]
                n[k] += len(own)
                s[k] += own.sum(0)
                q[k] += own.T @ own
        flat = np.concatenate([n, s.ravel(), q.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["i", "v"])

    got = rows.mapInArrow(moments, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # 2 + 2d + 2d² rows
    flat = np.zeros(2 + 2 * d + 2 * d * d)
    for r in got:
        flat[r["i"]] = r["v"]
    n = flat[:2]
    if n.min() < 1:
        return None
    model = fit(n, flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d), shrink, diagonal)

    def histogram(batches):
        counts = np.zeros((2, BINS))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                at = np.clip(np.tanh(model.difference(x) / 10) * BINS / 2 + BINS / 2, 0, BINS - 1).astype(int)
                np.add.at(counts, (batch.column(0).to_numpy(zero_copy_only=False), at), 1)
        i = np.flatnonzero(counts.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(counts.ravel()[i])], ["i", "v"])

    bins = rows.mapInArrow(histogram, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # 2 * BINS rows at most
    i, w = np.array([r["i"] for r in bins]), np.array([r["v"] for r in bins])
    centres = 10 * np.arctanh(np.clip(((i % BINS) + 0.5 - BINS / 2) / (BINS / 2), -0.999999, 0.999999))
    return calibrate(model, centres, (i // BINS).astype(float), w)


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. Held-out folds teach nothing.

    Null texts count as empty; empty texts are scored as any other. Without labels of both classes every score is 0.5. Rows
    that repeat are scored alike, and a labelled row that repeats teaches as often; labels that repeat and disagree count as 1.
    A row without doc_id belongs to fold 0 and has no label. Other columns are not looked at; an empty table gives no rows.
    """
    stats = materialise(document_statistics(docs), "statistics")
    model = train(stats.where(fold(F.col("doc_id"), modulus) != held), labels, "quality")

    def score(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            made = model.score(x) if model is not None and len(x) else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], ["doc_id", "score"])

    scored = stats.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
