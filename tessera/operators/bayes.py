"""Gaussian naive Bayes from grouped moments, searched by folds over priors and the smoothing of variances."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The grid.
SMOOTHINGS, PRIORS = (1e-9, 1e-2, 1.0), ("empirical", "uniform")
FOLDS = 5


def moments(rows: DataFrame, label: str, fold: str, features: str) -> DataFrame:
    """(fold, label, place, n, s, q): of each class's values at each feature their number, sum and sum of squares, by fold.

    One aggregation with sums made before the shuffle: its size is folds x classes x features, whatever the rows. Rows
    whose label or features are null teach nothing.
    """
    each = rows.where(F.col(label).isNotNull()).select(F.col(fold).alias("fold"), F.col(label).cast("long").alias("label"), F.posexplode(F.col(features).cast("array<double>")).alias("place", "x"))
    return each.groupBy("fold", "label", "place").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))


class Bayes:
    """Models by (smoothing, priors, fold left out); ``fold`` None leaves none out."""

    def __init__(self, found: list) -> None:
        self.labels = np.array(sorted({r.label for r in found}), np.int64)
        self.folds = sorted({r.fold for r in found})
        features = 1 + max((r.place for r in found), default=-1)
        at = {k: i for i, k in enumerate(self.labels.tolist())}
        self.sums = np.zeros((3, len(self.folds), len(self.labels), features))
        for r in found:
            self.sums[:, self.folds.index(r.fold), at[r.label], r.place] = r.n, r.s, r.q
        self._made: dict = {}

    def model(self, smoothing: float, priors: str, fold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log priors, means, variances). Variances grow by ``smoothing`` times the largest variance of a feature over all classes;
        a class without rows is never predicted."""
        key = smoothing, priors, fold
        if key not in self._made:
            kept = [i for i, f in enumerate(self.folds) if f != fold]
            n, s, q = self.sums[:, kept].sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                mean = s / n
                variance = q / n - mean * mean
                whole = q.sum(0) / n.sum(0) - (s.sum(0) / n.sum(0)) ** 2
                share = n[:, 0] / n[:, 0].sum() if priors == "empirical" else (n[:, 0] > 0) / max(1, (n[:, 0] > 0).sum())
                self._made[key] = np.log(share), mean, np.maximum(variance, 0) + smoothing * whole.max()
        return self._made[key]

    def joint(self, x: np.ndarray, smoothing: float, priors: str, fold) -> np.ndarray:
        """Log likelihood of each row and class, priors in it."""
        log_prior, mean, variance = self.model(smoothing, priors, fold)
        gap = x[:, None, :] - mean[None]
        with np.errstate(divide="ignore", invalid="ignore"):
            out = log_prior - 0.5 * (np.log(2 * np.pi * variance).sum(1) + (gap * gap / variance).sum(2))
        return np.where(np.isneginf(log_prior) | np.isnan(out), -np.inf, out)

    def predicted(self, x: np.ndarray, smoothing: float, priors: str, fold) -> np.ndarray:
        """The likeliest class of each row; of equally likely ones the smallest."""
        return self.labels[self.joint(x, smoothing, priors, fold).argmax(1)]


def grid_search(rows: DataFrame, label: str, features: str, fold: str, test: str, smoothings=SMOOTHINGS, priors=PRIORS) -> DataFrame:
    """(smoothing, priors, fold, n, hits): per grid point and fold, the rows of the fold that the other folds' model meets;
    with fold -1, the ``test`` rows that the model of all folds meets.

    One pass gathers the moments, one predicts: every row is asked of all models that it has not taught. Sums of
    another fold come by subtraction, so that folds cost no further pass. Rows with a null or short vector, or a null label, count nowhere.
    """
    size = rows.select(F.max(F.size(features))).first()[0] or 0
    whole = rows.where((F.size(features) == size) & F.forall(features, lambda x: x.isNotNull()) & F.col(label).isNotNull())
    bayes = Bayes(moments(whole.where(~F.col(test)), label, fold, features).collect())  # folds x classes x features
    shared = rows.sparkSession.sparkContext.broadcast(bayes)  # the same
    points = list(product(smoothings, priors))

    def judge(batches):
        bayes = shared.value
        import pandas as pd

        for part in batches:
            if not len(bayes.labels) or not len(part):
                continue
            x = np.stack(part["x"].to_numpy()).astype(np.float64)
            for (smoothing, prior), at in product(points, np.unique(part["fold"])):
                mine = (part["fold"] == at).to_numpy()
                hits = bayes.predicted(x[mine], smoothing, prior, None if at < 0 else at) == part["label"].to_numpy()[mine]
                yield pd.DataFrame({"smoothing": [smoothing], "priors": [prior], "fold": [int(at)], "n": [int(mine.sum())], "hits": [int(hits.sum())]})

    asked = whole.select(F.when(F.col(test), -1).otherwise(F.col(fold)).cast("int").alias("fold"), F.col(label).cast("long").alias("label"), F.col(features).cast("array<double>").alias("x"))
    found = asked.mapInPandas(judge, "smoothing double, priors string, fold int, n long, hits long")
    return found.groupBy("smoothing", "priors", "fold").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


def best_confusion(rows: DataFrame, label: str, features: str, fold: str, test: str) -> tuple[str, DataFrame]:
    """(parameters as text, (label, prediction, n) over the test rows) of the grid point with most hits over the folds; of equal ones the first."""
    points = grid_search(rows, label, features, fold, test).where("fold >= 0").groupBy("smoothing", "priors").agg(F.sum("hits").alias("hits"))
    best = points.orderBy(F.desc("hits"), "smoothing", "priors").first()  # six rows
    smoothing, priors = (best.smoothing, best.priors) if best else (SMOOTHINGS[0], PRIORS[0])
    whole = rows.where(F.col(label).isNotNull() & F.forall(features, lambda x: x.isNotNull()))
    bayes = Bayes(moments(whole.where(~F.col(test)), label, fold, features).collect())  # folds x classes x features
    shared = rows.sparkSession.sparkContext.broadcast(bayes)  # the same

    def predict(batches):
        for part in batches:
            if len(part):
                part["prediction"] = shared.value.predicted(np.stack(part["x"].to_numpy()).astype(np.float64), smoothing, priors, None).astype(float)
                yield part[["label", "prediction"]]

    asked = whole.where(F.col(test)).select(F.col(label).cast("double").alias("label"), F.col(features).cast("array<double>").alias("x"))
    found = asked.mapInPandas(predict, "label double, prediction double").groupBy("label", "prediction").agg(F.count("*").alias("n"))
    return f"priors={priors}, smoothing={smoothing}", found
