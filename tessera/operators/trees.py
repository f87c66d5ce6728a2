"""Decision trees with random thresholds (the ``random`` splitter), grown by levels from sums and searched by folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The grid. A tree of the largest depth holds all smaller ones, and at most 2 ** depth nodes a level.
CRITERIA, DEPTHS = ("gini", "entropy"), (3, 6, 10)


def impurity(counts: np.ndarray, criterion: str) -> np.ndarray:
    """Of the class counts in the last axis, times their sum."""
    n = counts.sum(-1, keepdims=True)
    share = counts / np.maximum(n, 1)
    if criterion == "gini":
        return n[..., 0] * (1 - (share * share).sum(-1))
    return -n[..., 0] * (share * np.log2(np.where(share > 0, share, 1))).sum(-1)


def thresholds(node: int, low: np.ndarray, high: np.ndarray, seed: int) -> np.ndarray:
    """One a feature, at random between its least and its largest value in the node; the same whenever the node is drawn again."""
    drawn = low + np.random.default_rng((seed, node)).random(len(low)) * (high - low)
    return np.where(drawn < high, drawn, low)


class Trees:
    """Trees over places of nodes: the root is 1, the children of i are 2i (values up to the threshold) and 2i + 1."""

    def __init__(self, number: int, depth: int, classes: int) -> None:
        self.depth = depth
        self.feature = np.full((number, 2 ** (depth + 1)), -1, np.int32)
        self.threshold = np.zeros((number, 2 ** (depth + 1)))
        self.counts = np.zeros((number, 2 ** (depth + 1), classes))

    def reached(self, tree: int, x: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row, ``depth`` levels below the root at most."""
        at, rows = np.ones(len(x), np.int64), np.arange(len(x))
        for _ in range(depth):
            f = self.feature[tree, at]
            at = np.where(f >= 0, 2 * at + (x[rows, f] > self.threshold[tree, at]), at)
        return at


def grid_search(rows: DataFrame, label: str, vector: str, fold: str, test: str, criteria=CRITERIA, depths=DEPTHS, seed: int = 1) -> DataFrame:
    """(criterion, depth, fold, n, hits): for each grid point and fold the rows of the fold and those whose label the tree grown on the
    other folds finds; fold -1 are the test rows, judged by trees grown on all others.

    An impure node draws one threshold a feature that varies in it and takes the feature whose parts are purest, of equal ones the first. All trees
    grow together, a level in two passes over the rows: least and largest values, then class counts below the thresholds; a task leaves one
    row a tree and node, so neither it nor the driver holds more than trees x 2 ** depth x features x classes numbers. Equally
    frequent labels of a leaf go to the smallest. Rows without label, fold or a whole vector of the longest length are left out.
    """
    fold_of = F.when(F.col(test), -1).otherwise(F.col(fold)).cast("int")
    whole = F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull()) & F.col(label).isNotNull()
    used = rows.where(whole).select(F.col(label).cast("long").alias("y"), fold_of.alias("fold"), F.col(vector).cast("array<double>").alias("v")).where("fold is not null")
    dims = used.agg(F.max(F.size("v")).alias("d")).first().d or 0
    used = used.where(F.size("v") == dims)
    schema = "criterion string, depth int, fold int, n long, hits long"
    sizes = used.groupBy("fold", "y").count().collect()  # folds x classes
    labels = np.array(sorted({r.y for r in sizes if r.fold >= 0}), np.int64)
    learnt = {r.fold for r in sizes if r.fold >= 0}
    kinds = [(c, h) for c in criteria for h in sorted({r.fold for r in sizes}) if learnt - {h}]
    if not dims or not kinds:
        return rows.sparkSession.createDataFrame([], schema)
    trees = Trees(len(kinds), max(depths), len(labels))
    for t, (_, h) in enumerate(kinds):
        for r in sizes:
            if r.fold >= 0 and r.fold != h:
                trees.counts[t, 1, np.searchsorted(labels, r.y)] += r["count"]

    def columns(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.stack(batch["v"].to_numpy()), batch["y"].to_numpy(), batch["fold"].to_numpy()

    def gathered(level: int, open_nodes: list[tuple], drawn: dict | None) -> dict:
        """By (tree, node): without ``drawn`` the features' least and negated largest values; with it class counts of the rows up to each threshold."""
        wanted = set(open_nodes)

        def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: dict = {}
            for batch in batches:
                if not len(batch):
                    continue
                x, y, f = columns(batch)
                for t in {t for t, _ in wanted}:
                    taught = np.flatnonzero((f != kinds[t][1]) & (f >= 0))
                    at = trees.reached(t, x[taught], level)
                    for node in np.unique(at).tolist():
                        if (t, node) not in wanted:
                            continue
                        mine = taught[at == node]
                        if drawn is None:
                            one = np.concatenate([x[mine].min(0), -x[mine].max(0)])
                            found[t, node] = np.minimum(found[t, node], one) if (t, node) in found else one
                        else:
                            below = (x[mine] <= drawn[t, node]).astype(float)
                            one = (below.T @ (y[mine][:, None] == labels[None])).ravel()
                            found[t, node] = found.get((t, node), 0) + one
            for (t, node), one in found.items():
                yield pd.DataFrame({"t": [t], "node": [node], "a": [one.tolist()]})

        each = used.mapInPandas(parts, "t int, node long, a array<double>").select("t", "node", F.posexplode("a").alias("i", "x"))
        joined = each.groupBy("t", "node", "i").agg((F.min if drawn is None else F.sum)("x").alias("x")).toPandas()
        return {k: g.sort_values("i")["x"].to_numpy() for k, g in joined.groupby(["t", "node"])}

    for level in range(max(depths)):
        level_nodes = range(2**level, 2 ** (level + 1))
        impure = [(t, i) for t in range(len(kinds)) for i in level_nodes if (trees.counts[t, i] > 0).sum() > 1]
        if not impure:
            break
        ranges = {k: (a[:dims], -a[dims:]) for k, a in gathered(level, impure, None).items()}
        drawn = {k: thresholds(k[1], low, high, seed) for k, (low, high) in ranges.items() if (low < high).any()}
        if not drawn:
            break
        for (t, i), a in gathered(level, list(drawn), drawn).items():
            left, (low, high), node = a.reshape(dims, -1), ranges[t, i], trees.counts[t, i]
            cost = impurity(left, kinds[t][0]) + impurity(node - left, kinds[t][0])
            best = int(np.argmin(np.where(low < high, np.round(cost, 9), np.inf)))
            trees.feature[t, i], trees.threshold[t, i] = best, drawn[t, i][best]
            trees.counts[t, 2 * i], trees.counts[t, 2 * i + 1] = left[best], node - left[best]

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            if len(batch):
                x, y, f = columns(batch)
                for t, (criterion, h) in enumerate(kinds):
                    asked = f == h
                    for depth in depths if asked.any() else ():
                        guess = labels[trees.counts[t, trees.reached(t, x[asked], depth)].argmax(1)]
                        out.append((criterion, depth, h, len(guess), int((guess == y[asked]).sum())))
            yield pd.DataFrame(out, columns=["criterion", "depth", "fold", "n", "hits"])

    counts = used.mapInPandas(judged, schema).groupBy("criterion", "depth", "fold")
    return counts.agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
