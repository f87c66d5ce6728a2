"""Kernel machines by features of fixed size, searched by folds over kernels, gamma and C from summed moments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sketches import tensor_sketch

#: The grid, and the degree of the polynomial kernel.
KERNELS, GAMMAS, CS, DEGREE = ("linear", "rbf", "poly"), (0.001, 0.01, 0.1, 1.0, 10.0), (0.01, 0.1, 1.0, 10.0, 100.0), 3

#: Features of a kernel. An rbf kernel is then off by about 0.07 of its value at one point, a polynomial one by about DEGREE times that, of the norms' product.
SIZE = 256


def features(x: np.ndarray, kernel: str, gamma: float, size: int = SIZE, seed: int = 1) -> np.ndarray:
    """Rows whose inner products are, or estimate without bias, the kernel of the rows of ``x``: linear ``xy``, poly ``(gamma xy) ** DEGREE``,
    rbf ``exp(-gamma |x - y|^2)`` by waves of random frequency."""
    if kernel == "linear":
        return x
    if kernel == "poly":
        return gamma ** (DEGREE / 2) * tensor_sketch(x, DEGREE, size, seed)
    waves = x @ (np.random.default_rng(seed).normal(size=(x.shape[1], size // 2)) * (2 * gamma) ** 0.5)
    return np.hstack([np.cos(waves), np.sin(waves)]) / (size // 2) ** 0.5


def points(kernels, gammas, cs) -> list[tuple]:
    """(kernel, gamma, c, map, strength) of the grid. Points of one map share features: gamma only scales those of poly, which is as if C grew
    by ``gamma ** DEGREE``; linear has no gamma."""
    out = []
    for kernel in kernels:
        for gamma in [None] if kernel == "linear" else gammas:
            mapped = (kernel, gamma if kernel == "rbf" else 1.0)
            out += [(kernel, gamma, c, mapped, c * (gamma**DEGREE if kernel == "poly" else 1.0)) for c in cs]
    return out


def solved(moments: np.ndarray, strengths: list[float]) -> list[np.ndarray]:
    """Weights of each strength, their first row the classes' offsets, by one eigendecomposition. ``moments`` are the inner products of the columns
    (1, features) with (1, features, a 0/1 column a class); targets are 1 for the class and -1 for the others, squared errors count C times."""
    width = len(moments)
    n, mean = max(moments[0, 0], 1.0), moments[0, 1:width] / max(moments[0, 0], 1.0)
    target = 2 * moments[0, width:] / n - 1
    values, vectors = np.linalg.eigh(moments[1:, 1:width] - n * np.outer(mean, mean))
    aim = vectors.T @ (2 * moments[1:, width:] - n * np.outer(mean, target + 1))
    out = []
    for c in strengths:
        w = vectors @ (aim / (np.maximum(values, 0) + 1 / c)[:, None])
        out.append(np.vstack([target - mean @ w, w]))
    return out


def grid_search(rows: DataFrame, label: str, vector: str, fold: str, test: str, kernels=KERNELS, gammas=GAMMAS, cs=CS, size: int = SIZE) -> DataFrame:
    """(kernel, gamma, c, fold, n, hits): for each grid point and fold the rows of the fold and those whose label the machine fitted on
    the other folds finds; fold -1 are the test rows, judged by machines fitted on all others.

    Machines are least-squares support vector machines, one against the rest, over values scaled to mean 0 and deviation 1 of their
    own training rows. All points of a map come from one matrix of sums: three passes for the whole grid, whatever its size; what a
    task leaves and what a group solves has (features + 1) x (features + 1 + classes) entries a map and fold. Equal scores go to the
    smallest label. Rows without a label, or whose vector is null, holds a null or has not the longest length are left out.
    """
    grid = points(kernels, gammas, cs)
    maps = list(dict.fromkeys(p[3] for p in grid))
    whole = F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull()) & F.col(label).isNotNull()
    fold_of = F.when(F.col(test), -1).otherwise(F.col(fold)).cast("int")
    used = rows.where(whole).select(F.col(label).cast("long").alias("y"), fold_of.alias("fold"), F.col(vector).cast("array<double>").alias("v")).where("fold is not null")
    dims = used.agg(F.max(F.size("v")).alias("d")).first().d or 0
    schema = "kernel string, gamma double, c double, fold int, n long, hits long"
    if not dims:
        return rows.sparkSession.createDataFrame([], schema)
    used = used.where(F.size("v") == dims)
    labels = np.array(sorted(r.y for r in used.where("fold >= 0").select("y").distinct().collect()), np.int64)
    each = used.select("fold", F.posexplode("v").alias("i", "x")).groupBy("fold", "i").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    sums: dict[int, np.ndarray] = {}
    for r in each.collect():  # folds x features
        sums.setdefault(r.fold, np.zeros((3, dims)))[:, r.i] = r.n, r.s, r.q
    learnt = sorted(f for f in sums if f >= 0)
    held = [h for h in sorted(sums) if any(f != h for f in learnt)]  # folds whose machines have rows to learn from
    if not held:
        return rows.sparkSession.createDataFrame([], schema)
    scales = {}
    for h in held:
        n, s, q = sum(sums[f] for f in learnt if f != h)
        deviation = np.sqrt(np.maximum(q / n - (s / n) ** 2, 0))
        scales[h] = s / n, np.where(deviation > 0, deviation, 1)

    def columns(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.stack(batch["v"].to_numpy()), batch["y"].to_numpy(), batch["fold"].to_numpy()

    def mapped(x: np.ndarray, h: int, m: tuple) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), features((x - scales[h][0]) / scales[h][1], *m, size=size)])

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row a matrix, after all rows of the task."""
        total: dict = {}
        for batch in batches:
            if not len(batch):
                continue
            x, y, f = columns(batch)
            known = (y[:, None] == labels[None]).astype(float)
            for h in held:
                taught = (f != h) & (f >= 0)
                for k, m in enumerate(maps):
                    z = mapped(x[taught], h, m)
                    total[h, k] = total.get((h, k), 0) + z.T @ np.hstack([z, known[taught]])
        for (h, k), found in total.items():
            yield pd.DataFrame({"h": [h], "k": [k], "m": [found.ravel().tolist()]})

    def fitted(key: tuple, entries: pd.DataFrame) -> pd.DataFrame:
        """A row for each grid point of a map; a group has one row an entry of its matrix."""
        flat = np.zeros(len(entries))
        flat[entries["i"].to_numpy()] = entries["x"].to_numpy()
        width = (-len(labels) + int(round((len(labels) ** 2 + 4 * len(flat)) ** 0.5))) // 2
        at = [i for i, p in enumerate(grid) if p[3] == maps[int(key[1])]]
        weights = solved(flat.reshape(width, -1), [grid[i][4] for i in at])
        return pd.DataFrame({"h": key[0], "p": at, "w": [w.ravel().tolist() for w in weights]})

    summed = used.mapInPandas(moments, "h int, k int, m array<double>").select("h", "k", F.posexplode("m").alias("i", "x")).groupBy("h", "k", "i").agg(F.sum("x").alias("x"))
    machines = {(r.h, r.p): np.array(r.w).reshape(-1, len(labels)) for r in summed.groupBy("h", "k").applyInPandas(fitted, "h int, p int, w array<double>").collect()}

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            x, y, f = columns(batch) if len(batch) else (np.zeros((0, dims)), np.zeros(0), np.zeros(0))
            for h in held:
                asked = f == h
                if not asked.any():
                    continue
                for m in maps:
                    z = mapped(x[asked], h, m)
                    for i, p in enumerate(grid):
                        if p[3] == m:
                            hits = labels[(z @ machines[h, i]).argmax(1)] == y[asked]
                            out.append((p[0], p[1], p[2], h, len(hits), int(hits.sum())))
            yield pd.DataFrame(out, columns=["kernel", "gamma", "c", "fold", "n", "hits"])

    counts = used.mapInPandas(judged, schema).groupBy("kernel", "gamma", "c", "fold")
    return counts.agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


def best_point(found: DataFrame) -> DataFrame:
    """(kernel, gamma, c, accuracy, test_accuracy): the grid point of the largest mean accuracy over folds, of equally good ones the first by
    kernel, gamma and C; its accuracy on the test rows, null without any."""
    share = F.col("hits") / F.col("n")
    each = found.groupBy("kernel", "gamma", "c").agg(F.avg(F.when(F.col("fold") >= 0, share)).alias("accuracy"), F.max(F.when(F.col("fold") < 0, share)).alias("test_accuracy"))
    return each.orderBy(F.desc(F.round("accuracy", 9)), "kernel", "gamma", "c").limit(1)
