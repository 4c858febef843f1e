"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes a vector of statistics, transformed so that classes are closer to normal. Each class has a mean and
a covariance that is shrunk twice: towards the pooled covariance, and towards a multiple of the identity. Cholesky
factors of the two covariances are computed once; a score is the logistic of the difference of the two log densities
(Mahalanobis distance by triangular solve, log determinant from the factor's diagonal) plus the log prior ratio.

Sums, not rows, are gathered from all labelled documents that are not held out: they are combined in the executors, and
one row a class reaches the driver.

Defined results: null and empty texts have the statistics of an empty text and a score like any other; documents whose
labels contradict each other or are null teach nothing; with one class only, the score is that class; with none it is
0.5; repeated documents are scored alike and, if labelled, count each time.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import held_out, materialise, table, text_batches

THRESHOLD = 0.7
#: Weight of the pooled covariance in a class's, and of the identity in the result.
POOLED, IDENTITY = 0.3, 0.05

_KIND = np.zeros(256, np.int64)  # of bytes: 1 lower case, 2 upper case, 3 digit, 4 space, 5 line end, 6 sentence mark, 7 other sign, 8 not ASCII
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", "\n", ".,;:?'\"-()"), 1):
    _KIND[[ord(c) for c in _chars]] = _k
_KIND[(_KIND == 0) & (np.arange(256) < 128)] = 7
_KIND[128:] = 8
FEATURES = ("length", "upper", "digit", "sentence_mark", "other_sign", "not_ascii", "word_length", "line_length", "line_repeats", "word_repeats", "byte_entropy", "mark_entropy")


def _entropy(counts: np.ndarray) -> float:
    total = counts.sum()
    if total == 0:
        return 0.0
    p = counts[counts > 0] / total
    return float(-(p * np.log2(p)).sum())


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text, in the order of FEATURES."""
    data = (text or "").encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lower, upper, digit, space, ends, mark, sign, wide = np.bincount(_KIND, weights=counts, minlength=9)[1:]
    n = max(1, len(data))
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    root = lambda x: float(np.sqrt(max(0.0, x)))
    return [
        float(np.log1p(len(data))), root(upper / n), root(digit / n), root(mark / n), root(sign / n), root(wide / n),
        float(np.log1p((n - space - ends) / max(1, len(words)))), float(np.log1p(n / max(1, len(lines)))),
        root(1 - len(set(lines)) / max(1, len(lines))), root((1 - len(set(words)) / max(1, len(words))) / np.log2(2 + len(words))),
        _entropy(counts), _entropy(counts[_KIND == 7]),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and f, the statistics of every row."""

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return texts.map(statistics, na_action=None)

    return docs.select("doc_id", measure("text").alias("f"))


class Moments(NamedTuple):
    n: float
    mean: np.ndarray
    scatter: np.ndarray  # divided by n


def moments(labelled: DataFrame) -> dict[int, Moments]:
    """Moments of each class (columns label and f); one row a class comes to the driver."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(F.col("f")[i]).alias(f"s{i}") for i in range(d)] + [F.sum(F.col("f")[i] * F.col("f")[j]).alias(f"p{i}_{j}") for i, j in pairs]
    out = {}
    for row in labelled.where("label in (0, 1)").groupBy("label").agg(F.count("*").alias("n"), *sums).collect():
        mean = np.array([row[f"s{i}"] for i in range(d)]) / row["n"]
        second = np.zeros((d, d))
        for i, j in pairs:
            second[i, j] = second[j, i] = row[f"p{i}_{j}"] / row["n"]
        out[row["label"]] = Moments(row["n"], mean, second - np.outer(mean, mean))
    return out


class Discriminant(NamedTuple):
    """Scale of the statistics, then mean, inverse Cholesky factor and log density constant of each class."""

    scale: np.ndarray
    classes: dict[int, tuple[np.ndarray, np.ndarray, float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(x), float(next(iter(self.classes), 0.5)))
        log = {}
        for k, (mean, solve, constant) in self.classes.items():
            z = (x / self.scale - mean) @ solve.T
            log[k] = constant - 0.5 * (z * z).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(found: dict[int, Moments], pooled: float = POOLED, identity: float = IDENTITY) -> Discriminant:
    total = sum(m.n for m in found.values())
    if not found:
        return Discriminant(np.ones(len(FEATURES)), {})
    common = sum(m.n * m.scatter for m in found.values()) / total
    scale = np.sqrt(np.maximum(np.diag(common), 1e-9))
    out = {}
    for k, m in found.items():
        mixed = ((1 - pooled) * m.scatter + pooled * common) / np.outer(scale, scale)
        shrunk = (1 - identity) * mixed + identity * max(np.trace(mixed) / len(mixed), 1e-6) * np.eye(len(mixed))
        factor = np.linalg.cholesky(shrunk)
        solve = np.linalg.solve(factor, np.eye(len(factor)))
        out[k] = (m.mean / scale, solve, float(np.log(m.n / total) - np.log(np.diag(factor)).sum()))
    return Discriminant(scale, out)


def classify(measured: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (of label 1) and predicted to a table with the column f."""

    @F.pandas_udf("double")
    def score(f: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(f.to_numpy())) if len(f) else np.zeros(0))

    return measured.withColumn("score", score("f")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    """doc_id, f, held_out, score and predicted of every document."""
    measured, _ = materialise(features(docs), "quality-features")
    clear = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(target).alias("label"), F.max(target).alias("other")).where("label = other")
    taught = measured.where(~held_out(F.col("doc_id"))).join(clear.select("doc_id", "label"), "doc_id")
    return classify(measured.withColumn("held_out", held_out(F.col("doc_id"))), fit(moments(taught)))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")
