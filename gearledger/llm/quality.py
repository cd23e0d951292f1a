"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each text becomes a vector of transformed statistics. Per class the labelled documents give a
mean and a covariance, which shrinks towards the pooled diagonal; its Cholesky factor is
computed once. A document's log-odds are the difference of the two Gaussian log densities
(Mahalanobis distances from the cached factors) plus the log prior, and its score their
logistic.

Scale: the statistics are computed where the texts lie and written as a narrow table; moments
of the labelled rows are sums, combined before the shuffle; all labelled rows of the training
folds count, none is sampled. The driver holds a mean and a covariance per class.

Defined results: null is the empty text and gets a finite score; labels other than 0 and 1 and
labels of unknown documents are ignored; a document labelled twice counts twice; with one
class missing every score is that class's 0 or 1; without labels it is 0.5; repeated rows
repeat; further columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, unwrap, whole_text, wrap

FOLDS = 5
# Below this score a document is rejected.
THRESHOLD = 0.3
# Weight of the pooled diagonal in a class covariance, in rows per feature: few rows shrink much.
SHRINKAGE = 2.0
FEATURES = (
    "log_bytes", "letters", "upper", "digits", "blanks", "lines", "stops", "pipes", "symbols",
    "word_length", "words_per_line", "distinct_words", "entropy", "repeated_lines", "capitalised",
)
VECTOR = T.ArrayType(T.DoubleType())

# Byte classes: letter, upper case, digit, blank, line end, full stop or comma, pipe, other.
LETTER, UPPER, DIGIT, BLANK, LINE, STOP, PIPE, OTHER = range(8)
CLASS = np.array([
    UPPER if 65 <= b <= 90 else LETTER if 97 <= b <= 122 or b >= 128 else DIGIT if 48 <= b <= 57
    else LINE if b == 10 else BLANK if b <= 32 else STOP if b in b".,;:'" else PIPE if b == 124 else OTHER
    for b in range(256)
])


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text; finite for every text."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(CLASS, weights=counts, minlength=8)
    n = max(len(data), 1)
    part = kinds / n
    words = data.split()
    lines = [x for x in data.split(b"\n") if x]
    m, k = max(len(words), 1), max(len(lines), 1)
    p = counts[counts > 0] / n
    odd = np.log(part + 0.002)
    return [
        float(np.log1p(len(data))),
        float(part[LETTER]),
        *[float(odd[c]) for c in (UPPER, DIGIT, BLANK, LINE, STOP, PIPE, OTHER)],
        float(np.log(n / m)),
        float(np.log(m / k)),
        len(set(words)) / m,
        float(-(p * np.log2(p)).sum()),
        1 - len(set(lines)) / k,
        sum(w[:1].isupper() for w in words) / m,
    ]


@F.pandas_udf(VECTOR)
def statistics_of(texts: pd.Series) -> pd.Series:
    return texts.map(statistics)


def held_out(column: str = "doc_id") -> Column:
    """Rows whose label may not be learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % FOLDS == 0, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors, log determinants and log priors of the classes 0 and 1."""

    mean: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 per row."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = [
            self.log_prior[k] - 0.5 * (((x - self.mean[k]) @ self.whiten[k].T) ** 2).sum(axis=1) - self.log_det[k]
            for k in (0, 1)
        ]
        odds = np.clip(density[1] - density[0], -500, 500)
        return 1 / (1 + np.exp(-odds))


def learn(vectors: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Model:
    """Fit on settled (doc_id, vector) and the labels of the training folds."""
    d = len(FEATURES)
    marks = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", F.col("quality").alias("_class"))
    rows = vectors.select("doc_id", "vector").join(marks, "doc_id")
    cells = [F.col("vector")[i] for i in range(d)]
    sums = [F.sum(c) for c in cells] + [F.sum(cells[i] * cells[j]) for i in range(d) for j in range(i, d)]
    moments = {
        row[0]: (row[1], np.array(row[2:], dtype=float))
        for row in rows.groupBy("_class").agg(F.count(F.lit(1)), *sums).collect()  # two rows
    }
    none = np.zeros(0)
    if len(moments) < 2:
        return Model(none, none, none, none, float(next(iter(moments), 0.5)))
    upper = np.triu_indices(d)
    count = np.array([moments[k][0] for k in (0, 1)], dtype=float)
    mean = np.array([moments[k][1][:d] / moments[k][0] for k in (0, 1)])
    cov = np.zeros((2, d, d))
    for k in (0, 1):
        cov[k][upper] = moments[k][1][d:] / count[k]
        cov[k] = cov[k] + np.triu(cov[k], 1).T - np.outer(mean[k], mean[k])
    pooled = np.diag((cov * count[:, None, None]).sum(axis=0) / count.sum()).clip(min=0) + 1e-4
    whiten, log_det = np.zeros((2, d, d)), np.zeros(2)
    for k in (0, 1):
        part = shrinkage * d / (shrinkage * d + count[k])
        factor = np.linalg.cholesky((1 - part) * cov[k] + part * np.diag(pooled) + 1e-6 * np.eye(d))
        whiten[k] = np.linalg.inv(factor)
        log_det[k] = np.log(np.diag(factor)).sum()
    return Model(mean, whiten, log_det, np.log(count / count.sum()))


def vectors_of(docs: DataFrame) -> DataFrame:
    """(doc_id, vector) of every document, written once."""
    return settle(docs.select("doc_id", statistics_of(whole_text()).alias("vector")))


def scorer(model: Model):
    """A Column function from vectors to scores."""

    @F.pandas_udf(T.DoubleType())
    def score(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=float)
        return pd.Series(model.score(np.array(vectors.tolist(), dtype=float)))

    return score


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: whether its label was held out, its score and the predicted label."""
    vectors = vectors_of(docs)
    scored = vectors.withColumn("score", scorer(learn(vectors, labels))("vector"))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, same columns."""
    model = learn(vectors_of(docs), labels)
    scored = wrap(docs, score=scorer(model)(statistics_of(whole_text())))
    return unwrap(scored.where(F.col("score") >= threshold), docs)
