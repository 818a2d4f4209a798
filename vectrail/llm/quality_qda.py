"""Regularised quadratic discriminant over transformed document statistics.

The two classes of ``labels.quality`` each get a mean and a covariance from one
distributed pass of moment sums. Each covariance is shrunk towards the pooled
one and then towards a multiple of the identity, and is kept as the inverse of
its Cholesky factor, so that scoring is a fixed set of multiplications in the
JVM: ``log p(x | good) - log p(x | bad)`` from the two Mahalanobis distances.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .text_stats import bound, counts

FEATURES = ("size", "repetition", "word_length", "symbol_rate", "upper_rate", "digit_rate")


def feature_struct(text: Column) -> Column:
    """Transformed statistics; the added constants keep short and empty texts near the middle."""

    def transformed(c: Column) -> Column:
        return F.struct(
            F.log1p(c["words"]).alias("size"),
            (F.log(c["distinct_words"] + 5) - 0.85 * F.log(c["words"] + 5)).alias("repetition"),
            F.log((c["chars"] + 30) / (c["words"] + 5)).alias("word_length"),
            F.log((c["symbols"] + 0.5) / (c["chars"] + 50)).alias("symbol_rate"),
            F.log((c["uppers"] + 2) / (c["chars"] + 80)).alias("upper_rate"),
            F.log((c["digits"] + 0.5) / (c["chars"] + 50)).alias("digit_rate"),
        )

    return bound(counts(text), transformed)


@dataclass(frozen=True)
class Discriminant:
    """means, whitening factors (inverse Cholesky, lower) and log determinants, good class first."""

    means: np.ndarray
    whitening: np.ndarray
    log_det: np.ndarray
    log_prior_odds: float

    def log_odds(self, x: Column) -> Column:
        """Log density difference plus log prior odds, over a struct of FEATURES."""

        def distance(v: Column, k: int) -> Column:
            total = F.lit(0.0)
            for i in range(len(FEATURES)):
                z = F.lit(0.0)
                for j in range(i + 1):
                    z = z + (v[FEATURES[j]] - F.lit(float(self.means[k, j]))) * F.lit(float(self.whitening[k, i, j]))
                total = total + bound(z, lambda y: y * y)
            return total

        shift = 0.5 * float(self.log_det[1] - self.log_det[0]) + self.log_prior_odds
        return bound(x, lambda v: 0.5 * (distance(v, 1) - distance(v, 0)) + F.lit(shift))

    def log_odds_of(self, x: np.ndarray) -> np.ndarray:
        d = [(((x - m) @ w.T) ** 2).sum(1) for m, w in zip(self.means, self.whitening)]
        return 0.5 * (d[1] - d[0]) + 0.5 * (self.log_det[1] - self.log_det[0]) + self.log_prior_odds


def _shrink(cov: np.ndarray, pooled: np.ndarray, to_pooled: float, to_identity: float) -> np.ndarray:
    mixed = (1 - to_pooled) * cov + to_pooled * pooled
    scale = max(float(np.trace(mixed)) / len(mixed), 1e-9)
    return (1 - to_identity) * mixed + to_identity * scale * np.eye(len(mixed))


def fit(labelled: DataFrame, quality: str, to_pooled: float = 0.1, to_identity: float = 0.01) -> Discriminant | None:
    """``labelled``: FEATURES and ``quality`` (1 good, 0 bad; others are ignored). None if a class has no row.

    One aggregation with map-side sums over all rows; only two rows of sums reach the driver.
    """
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]
    rows = labelled.where(F.col(quality).isin(0, 1)).groupBy(F.col(quality).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"), *sums).collect()
    by = {r["k"]: r for r in rows}
    if set(by) != {0, 1}:
        return None
    n, means, covs = [], [], []
    for k in (1, 0):
        r = by[k]
        mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        second = np.zeros((d, d))
        for i, j in pairs:
            second[i, j] = second[j, i] = r[f"p{i}_{j}"] / r["n"]
        n.append(r["n"])
        means.append(mean)
        covs.append(second - np.outer(mean, mean))
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    factors = [np.linalg.cholesky(_shrink(c, pooled, to_pooled, to_identity)) for c in covs]
    return Discriminant(
        np.array(means),
        np.array([np.linalg.inv(f) for f in factors]),
        np.array([2 * np.log(np.diag(f)).sum() for f in factors]),
        math.log(n[0] / n[1]),
    )


def features(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("__doc"), feature_struct(F.col(text)).alias("__x"))


def _labelled(feats: DataFrame, labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """Features with their labels. A document labelled twice alike counts once, one labelled both ways not at all."""
    known = (
        labels.select(F.col(doc_id).alias("__id"), F.col(label).alias("__y"))
        .where(F.col("__id").isNotNull() & F.col("__y").isin(0, 1))
        .groupBy("__id").agg(F.min("__y").alias("__y"), F.max("__y").alias("__y2"))
        .where(F.col("__y") == F.col("__y2")).drop("__y2")
    )
    joined = feats.join(known, F.col("__doc") == F.col("__id"), "inner")
    return joined.select("__y", *[F.col("__x")[f].alias(f) for f in FEATURES])


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", reject_below: float = -3.0, to_pooled: float = 0.1, to_identity: float = 0.01) -> DataFrame:
    """One row per document: ``doc_id``, ``score`` (posterior log odds, 6 decimals) and ``keep``.

    ``score`` adds the log odds of the classes to the density difference; a
    document goes if it is under ``reject_below``. All labelled rows are used.
    Null and empty texts have all counts 0 and a score like any other. Repeated
    rows are scored alike and all returned; a null doc_id matches no label.
    Labels other than 0 and 1 are ignored, as are documents labelled both ways.
    Where a class has no labelled document nothing can be learned: score is
    null and every document is kept. Extra columns are not read. An empty
    table gives an empty result.
    """
    feats = materialise(features(docs, doc_id, text), "qda")
    model = fit(_labelled(feats, labels, doc_id, label), "__y", to_pooled, to_identity)
    if model is None:
        return feats.select(F.col("__doc").alias(doc_id), F.lit(None).cast("double").alias("score"), F.lit(True).alias("keep"))
    scored = feats.select(F.col("__doc").alias(doc_id), model.log_odds(F.col("__x")).alias("score"))
    return scored.select(doc_id, F.round("score", 6).alias("score"), (F.col("score") >= F.lit(reject_below)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", reject_below: float = -3.0) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, with all their columns as they are, whatever their names; no row is shuffled with its text.

    Null, empty and very long texts, ties, repeated rows, missing labels and empty tables are treated as there.
    """
    model = fit(_labelled(features(docs, doc_id, text), labels, doc_id, label), "__y")
    return docs if model is None else docs.where(model.log_odds(feature_struct(F.col(text))) >= F.lit(reject_below))
