"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import by_value, whole_documents, whole_text, without

by_value(__name__)

FIT_ROWS = 20_000                  # labelled documents that are fitted on, at most about
OWN_SHARE = 0.9                    # of a class covariance; the rest is the pooled diagonal
FLOOR = 1e-3                       # added to each variance, in units of the pooled variance
MARKS = [ord(c) for c in "#*$%&|<>"]
FEATURES = ["log_words", "log_word_length", "length_spread", "upper", "digits", "punctuation", "marks", "exclamations", "stops",
            "distinct", "repeats", "top_word", "dup_lines", "short_words", "non_ascii"]


def statistics(text: str) -> list[float]:
    """FEATURES of a whole text, transformed to be less skewed: logarithms of counts, square roots of shares."""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    words = raw.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    chars = max(1, int(lengths.sum()))
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    digits, wide = int(counts[48:58].sum()), int(counts[128:].sum())
    punctuation = chars - upper - lower - digits - wide
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    repeats = sum(map(bytes.__eq__, words[1:], words[:-1]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, n)
    return [np.log1p(n), np.log(chars / k + 1), np.sqrt(lengths.std()) if n else 0.0, np.sqrt(upper / max(1, upper + lower)),
            np.sqrt(digits / chars), np.sqrt(max(0, punctuation) / chars), np.log1p(20 * sum(int(counts[m]) for m in MARKS) / k),
            np.log1p(20 * int(counts[33]) / k), np.log1p(20 * int(counts[46]) / k), np.log(len(distinct) + 1) / np.log(n + 2),
            np.sqrt(repeats / k), np.sqrt(max(distinct.values(), default=0) / k), np.sqrt(1 - len(set(lines)) / max(1, len(lines))) if lines else 0.0,
            np.sqrt(float((lengths <= 3).sum()) / k), np.sqrt(wide / chars)]


def with_statistics(df: DataFrame) -> DataFrame:
    @F.pandas_udf("array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t) for t in texts])

    return whole_documents(df).withColumn("_x", measured(whole_text()))


class Model:
    """Means, Cholesky factors of the shrunk covariances and log priors of both classes, on a common scale."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.middle, self.scale = x.mean(0), x.std(0)
        self.scale[self.scale == 0] = 1.0
        x = (x - self.middle) / self.scale
        parts = [x[y == k] for k in (0, 1)]
        centred = [p - p.mean(0) for p in parts]
        pooled = sum((c ** 2).sum(0) for c in centred) / max(1, len(x) - 2)
        self.means = [p.mean(0) for p in parts]
        self.factors, self.logs = [], []
        for c in centred:
            own = c.T @ c / max(1, len(c) - 1)
            cov = OWN_SHARE * own + (1 - OWN_SHARE) * np.diag(pooled) + FLOOR * np.eye(x.shape[1])
            factor = np.linalg.cholesky(cov)
            self.factors.append(np.linalg.inv(factor).T)             # cached: whitens a batch by one product
            self.logs.append(np.log(len(c) / len(x)) - np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 from the difference of the Mahalanobis log densities."""
        x = (x - self.middle) / self.scale
        density = [log - 0.5 * (((x - m) @ f) ** 2).sum(1) for m, f, log in zip(self.means, self.factors, self.logs)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(sample: DataFrame) -> Model | None:
    """A model from a bounded sample with ``text`` and ``label``; None unless both classes have two rows."""
    rows = with_statistics(sample).select("_x", "label").toPandas()
    y = rows["label"].to_numpy()
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    return Model(np.array(rows["_x"].tolist()), y)


def quality(df: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from the threshold on) to rows with a ``text``.

    Statistics are taken over the whole text.  A null text counts as empty; an empty one has all counts zero and is scored
    like any other.  Without a model every score is 0.5.  Repeated rows score alike, an empty table gives an empty table,
    and input columns named like added ones are replaced.
    """
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pd.Series(model.score(x) if model else np.full(len(x), 0.5))

    return (without(whole_documents(df), "score", "predicted").withColumn("score", scored(whole_text()))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
