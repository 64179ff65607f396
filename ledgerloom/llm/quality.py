"""Quality classifier: regularised quadratic discriminant over document statistics (operator 5).

Each text becomes a short vector of transformed statistics (lengths as logarithms, shares as arc sines of roots). The
class means and covariances come from one distributed sum of moments over every labelled row. A class covariance is
shrunk towards the pooled one and that towards a multiple of the identity, and its Cholesky factor kept; the score is
the logistic function of the difference of the two log densities (Mahalanobis distances by solving with the factors)
and log priors, for each feature on the average.

Defined cases: a null text is an empty one, and an empty text gets a score like any other (its statistics are zero); a
null doc_id has no label and is not held out; labels other than 0 and 1 are not learnt from; a document with several
labels counts once for each; with no labels of a class every score is 1 for the other class's only presence, or 0.5
with no labels at all; an empty table gives no rows; other columns are not read (reject() keeps them).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.batches import few_rows, texts_of
from ledgerloom.plans.stash import SMALL_ROWS, stash

#: Shrinkage of a class covariance towards the pooled one, and of that towards the identity's multiple.
TO_POOLED, TO_IDENTITY = 0.02, 0.01

_UPPER, _LOWER, _DIGIT = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
_ENDS, _QUOTES = b".,;:?", b"'\"()-"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _ENDS + _QUOTES)
FEATURES = ("chars", "words", "lines", "word length", "its spread", "long words", "distinct words", "distinct lines", "upper", "digits", "ends", "quotes", "marks", "exclamations", "bars", "non-ASCII", "compressed", "line length")
D = len(FEATURES)


def features(text: str | None) -> list[float]:
    b = (text or "").encode()
    words, lines = b.split(), b.split(b"\n")
    n, w = max(1, len(b)), max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words))
    count = lambda kind: n0 - len(b.translate(None, kind))
    n0 = len(b)
    upper = count(_UPPER)
    share = lambda x: float(np.arcsin(np.sqrt(min(1.0, x))))
    mean = float(lengths.mean()) if len(words) else 0.0
    return [
        float(np.log1p(n0)),
        float(np.log1p(len(words))),
        float(np.log1p(len(lines) - (not b))),
        float(np.log1p(mean)),
        float(np.log1p(lengths.std())) if len(words) else 0.0,
        share(float((lengths > 12).sum()) / w),
        share(len(set(words)) / w),
        share(len(set(lines)) / len(lines)),
        share(upper / max(1, upper + count(_LOWER))),
        share(count(_DIGIT) / n),
        share(count(_ENDS) / n),
        share(count(_QUOTES) / n),
        share(count(_MARKS) / n),
        share(b.count(b"!") / w),
        share(b.count(b"|") / w),
        share((n0 - len(b.decode())) / n),
        float(np.log1p(len(zlib.compress(b, 1)) / n)),
        float(np.log1p(n0 / len(lines))),
    ]


def with_features(docs: DataFrame, key_cols: list[str], text_col: str = "text") -> DataFrame:
    """The key columns and x, the statistics of each text."""
    own = few_rows(docs).select(*key_cols, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t) for t in texts_of(batch.column(len(key_cols)))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key_cols)], x], [*key_cols, "x"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields[:-1])
    return own.mapInArrow(run, f"{kinds}x array<double>")


@dataclass(frozen=True)
class Model:
    """Means and lower Cholesky factors of the classes 0 and 1, and the log odds of 1 beforehand."""

    means: np.ndarray
    factors: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not np.isfinite(self.prior) or not len(self.means):
            return np.full(len(x), 0.5 if np.isnan(self.prior) else float(self.prior > 0))
        density = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            density.append(-0.5 * (z * z).sum(0) - np.log(np.diag(factor)).sum())
        log_odds = (density[1] - density[0] + self.prior) / x.shape[1]
        return 1 / (1 + np.exp(-np.clip(log_odds, -700, 700)))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Class: count, sum and sum of products of x, from (x, y); a task gives one row for each class and product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {0: np.zeros((D + 1, D + 1)), 1: np.zeros((D + 1, D + 1))}
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(0).to_pylist(), np.float64).reshape(len(y), D)
            x = np.concatenate((np.ones((len(y), 1)), x), axis=1)
            for k, t in total.items():
                t += x[y == k].T @ x[y == k]
        for k, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * t.size, pa.int32()), pa.array(np.arange(t.size, dtype=np.int32)), pa.array(t.ravel())], ["y", "i", "v"])

    sums = labelled.select("x", "y").mapInArrow(run, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v"))
    got = {k: np.zeros((D + 1) ** 2) for k in (0, 1)}
    for r in sums.collect():  # 2 (D + 1)^2 rows, whatever the input
        got[r.y][r.i] = r.v
    return {k: ((m := v.reshape(D + 1, D + 1))[0, 0], m[0, 1:], m[1:, 1:]) for k, v in got.items()}


def fit(labelled: DataFrame, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Model:
    """The model from rows (x, y); all of them count."""
    got = moments(labelled)
    n = {k: got[k][0] for k in got}
    if not all(n.values()):
        return Model(np.zeros((0, D)), np.zeros((0, D, D)), float("nan") if not any(n.values()) else (np.inf if n[1] else -np.inf))
    means = np.stack([got[k][1] / n[k] for k in (0, 1)])
    scatter = [got[k][2] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = sum(scatter) / (n[0] + n[1])
    # in units of the pooled deviations, so that the identity suits every feature
    unit = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    factors = []
    for k in (0, 1):
        c = ((1 - to_pooled) * scatter[k] / n[k] + to_pooled * pooled) / np.outer(unit, unit)
        c = (1 - to_identity) * c + to_identity * max(np.trace(c) / D, 1e-3) * np.eye(D)
        factors.append(unit[:, None] * np.linalg.cholesky(c))
    return Model(means, np.stack(factors), float(np.log(n[1] / n[0])))


def score_column(model: Model, x: Column) -> Column:
    @F.pandas_udf("double")
    def score(xs: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array(xs.tolist(), np.float64).reshape(len(xs), D)))

    return score(x)


def fold(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3))


def training_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, y) of the labels that may be learnt from."""
    return labels.where(F.col("quality").isin(0, 1) & (fold() != 1)).select("doc_id", F.col("quality").cast("int").alias("y"))


def fit_to_labels(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> Model:
    """The model from the documents that have labels to learn from. Few enough labels go to every executor, so that only
    labelled texts are read closely; else the statistics of all texts meet the labels in a shuffle."""
    known = stash(training_rows(labels), "labels")
    if known.count() <= SMALL_ROWS:
        labelled = with_features(docs.select("doc_id", text_col).join(F.broadcast(known), "doc_id"), ["y"], text_col)
    else:
        labelled = with_features(docs, ["doc_id"], text_col).join(known, "doc_id")
    return fit(labelled)


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents, in their own columns, whose score is at least the threshold."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([features(t) for t in texts], np.float64).reshape(len(texts), D)))

    return few_rows(docs).where(score(F.coalesce(F.col(text_col), F.lit(""))) >= threshold)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    x = stash(with_features(docs, ["doc_id"]), "features")
    model = fit(x.join(training_rows(spark.read.parquet(f"{sf_dir}/labels.parquet")), "doc_id"))
    scored = x.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), score_column(model, F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
