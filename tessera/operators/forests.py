"""Random forests, grown by levels from sums while nodes are large and node by node in tasks below, searched by folds."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import ceil, exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import scratch

#: Values that a feature is cut to, bootstrap rows that one task grows a node from, and numbers that a task's histograms hold at a time.
BINS, LOCAL, CELLS = 32, 65_536, 2**19

#: Rows of votes that are counted together.
VOTES = 100_000


def _hashed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def drawn_features(tree: np.ndarray, node: np.ndarray, dims: int) -> np.ndarray:
    """The root of ``dims`` features for each node of a tree, at random, the same whenever the node is looked at."""
    with np.errstate(over="ignore"):
        key = _hashed(_hashed(tree + np.int64(1)) + node.astype(np.uint64))
        ranks = _hashed(key[:, None] + np.arange(1, dims + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.sort(np.argsort(ranks, axis=1, kind="stable")[:, : ceil(dims**0.5)], axis=1)


def histograms(bins: np.ndarray, y: np.ndarray, w: np.ndarray, slot: np.ndarray, features: np.ndarray, classes: int) -> np.ndarray:
    """(node, drawn feature, bin, class): bootstrap rows."""
    s, f = features.shape
    at = bins[np.arange(len(y))[:, None], features[slot]].astype(np.int64)
    at = ((slot[:, None] * f + np.arange(f)) * BINS + at) * classes + y[:, None]
    return np.bincount(at.ravel(), np.repeat(w, f), s * f * BINS * classes).reshape(s, f, BINS, classes)


def best_cuts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place among the drawn features, or -1; bin; class counts up to it) that lower each node's Gini impurity most, the first of equal ones."""
    left = counts.cumsum(2)
    whole = left[:, :, -1:]
    right = whole - left
    n, m = left.sum(3), right.sum(3)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left * left).sum(3) / n + (right * right).sum(3) / m - (whole * whole).sum(3) / (n + m)
    gain = np.where((n > 0) & (m > 0), np.round(gain, 9), 0).reshape(len(counts), -1)
    best = gain.argmax(1)
    rows = np.arange(len(counts))
    place, cut = np.divmod(best, BINS)
    return np.where(gain[rows, best] > 0, place, -1), cut, left[rows, place, cut]


def grown_votes(tree: int, node: int, depth: int, bins: np.ndarray, y: np.ndarray, w: np.ndarray, asked: np.ndarray, depths: tuple, classes: int) -> np.ndarray:
    """(asked row, depth limit, class): shares of the classes in the leaf that each asked row reaches in the subtree of ``node``, whose
    bootstrap rows are given, at each of the ``depths`` (sorted) from ``depth`` on."""
    out = np.zeros((len(asked), len(depths), classes))
    share = np.zeros((len(asked), classes))
    nodes, slot, where = np.array([node]), np.zeros(len(y), np.int64), np.zeros(len(asked), np.int64)
    rest = np.arange(len(asked))  # asked rows that have no leaf yet
    while len(nodes):
        counts = np.bincount(slot * classes + y, w, len(nodes) * classes).reshape(-1, classes)
        share[rest] = (counts / counts.sum(1, keepdims=True))[where]
        if depth in depths:
            out[:, depths.index(depth)] = share
        if depth >= depths[-1]:
            break
        place, cut = np.full(len(nodes), -1), np.zeros(len(nodes), np.int64)
        order = np.argsort(slot, kind="stable")
        ends = np.searchsorted(slot[order], np.arange(len(nodes) + 1))
        impure = np.flatnonzero((counts > 0).sum(1) > 1)
        drawn = drawn_features(np.full(len(nodes), tree), nodes, bins.shape[1])
        step = max(1, CELLS // (drawn.shape[1] * BINS * classes))
        for i in range(0, len(impure), step):
            mine = impure[i : i + step]
            n = ends[mine + 1] - ends[mine]
            rows = order[np.arange(n.sum()) + np.repeat(ends[mine] - np.cumsum(n) + n, n)]
            at, cut[mine], _ = best_cuts(histograms(bins[rows], y[rows], w[rows], np.repeat(np.arange(len(mine)), n), drawn[mine], classes))
            place[mine] = np.where(at >= 0, drawn[mine, at], -1)
        new = np.where(place >= 0, np.cumsum(place >= 0) - 1, -1)
        keep = new[slot] >= 0
        bins, y, w, slot = bins[keep], y[keep], w[keep], slot[keep]
        slot = 2 * new[slot] + (bins[np.arange(len(y)), place[slot]] > cut[slot])
        keep = new[where] >= 0
        rest, where = rest[keep], where[keep]
        where = 2 * new[where] + (asked[rest, place[where]] > cut[where])
        parents = nodes[place >= 0]
        nodes = np.stack([2 * parents, 2 * parents + 1], 1).ravel()
        depth += 1
    for i, d in enumerate(depths):
        if d >= depth:  # all leaves are found
            out[:, i] = share
    return out


class Tops:
    """The large nodes of all trees, by slots; slot i is the root of tree i. A node's children have the places 2i and 2i + 1 of a root 1."""

    def __init__(self, counts: np.ndarray) -> None:
        self.feature, self.cut, self.child = ([-1] * len(counts), [0] * len(counts), [0] * len(counts))
        self.tree, self.node, self.depth, self.parent = list(range(len(counts))), [1] * len(counts), [0] * len(counts), [-1] * len(counts)
        self.counts, self.whole = list(counts), [False] * len(counts)

    def split(self, slot: int, feature: int, cut: int, left: np.ndarray) -> None:
        self.feature[slot], self.cut[slot], self.child[slot] = feature, cut, len(self.node)
        for side, counts in enumerate((left, self.counts[slot] - left)):
            for name, value in (("feature", -1), ("cut", 0), ("child", 0), ("tree", self.tree[slot]), ("node", 2 * self.node[slot] + side), ("depth", self.depth[slot] + 1), ("parent", slot), ("counts", counts), ("whole", False)):
                getattr(self, name).append(value)

    def reached(self, tree: np.ndarray, bins: np.ndarray) -> np.ndarray:
        at, feature, cut, child = tree.astype(np.int64), np.array(self.feature), np.array(self.cut), np.array(self.child)
        for _ in range(max(self.depth)):
            f = feature[at]
            at = np.where(f >= 0, child[at] + (bins[np.arange(len(at)), f] > cut[at]), at)
        return at

    def shares(self, slot: int, depths: tuple) -> dict[int, np.ndarray]:
        """Shares of the classes at the limits that the slot's ancestors, or the slot as a leaf, stand for, by place of the limit."""
        found = {}
        for i, d in enumerate(depths):
            at = slot
            while self.depth[at] > d:
                at = self.parent[at]
            if at != slot or self.whole[slot]:
                found[i] = self.counts[at] / max(self.counts[at].sum(), 1)
        return found


def judged(rows: DataFrame, label: str, features: str, fold: str, test: str, depths: tuple, numbers: tuple, seed: int = 1) -> DataFrame:
    """(fold, depth, number, label, prediction, n): for each grid point and fold the rows of the fold, judged by the forest grown on the other
    folds; fold -1 are the test rows, judged by the forest grown on all others.

    Values are cut to BINS bins at the training rows' quantiles; a row is in a tree as often as a Poisson number of mean 1 says; an impure node draws the root of all
    features and takes the cut of least Gini impurity. The trees of the largest point hold those of all others: fewer trees are the first ones, a smaller
    depth is where a row stands then. Nodes of more than LOCAL rows are split from histograms, a level of all trees in one pass; smaller ones go to a task each with their rows and
    the rows to judge, so no tree is ever in one place. A forest predicts the class of the largest mean share, of equal ones the smallest.
    Rows without label, fold or a whole vector of the longest length are left out.
    """
    spark, depths, most = rows.sparkSession, tuple(sorted(depths)), max(numbers)
    whole = F.col(features).isNotNull() & F.forall(features, lambda v: v.isNotNull()) & F.col(label).isNotNull()
    used = rows.where(whole).select(F.col(label).cast("double").alias("label"), F.when(F.col(test), -1).otherwise(F.col(fold)).cast("int").alias("fold"), F.col(features).cast("array<double>").alias("v")).where("fold is not null")
    dims = used.agg(F.max(F.size("v")).alias("d")).first().d or 0
    used = used.where(F.size("v") == dims)
    sizes = used.groupBy("fold", "label").count().collect()  # folds x classes
    labels = np.array(sorted({r.label for r in sizes if r.fold >= 0}))
    taught, classes = {r.fold for r in sizes if r.fold >= 0}, len(labels)
    if len(taught) < 2:
        raise ValueError("a search needs rows in two folds")
    held = sorted({r.fold for r in sizes})
    quantiles = F.percentile_approx("x", [i / BINS for i in range(1, BINS)], 10_000).alias("q")
    found = used.where("fold >= 0").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(quantiles).collect()  # a row a feature
    limits = [np.unique(r.q) for r in sorted(found, key=lambda r: r.i)]

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy())
                b = np.stack([np.searchsorted(q, x[:, i]) for i, q in enumerate(limits)], 1).astype(np.uint8)
                yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "fold": batch["fold"], "b": [r.tobytes() for r in b]})

    path = scratch(spark, "forest-rows")
    used.withColumn("id", F.monotonically_increasing_id()).mapInPandas(binned, "id long, label double, fold int, b binary").write.parquet(path)
    # a copy for each tree: tree g judges the fold held[g // most]; w is 0 for rows to judge
    kept = F.element_at(F.array(*[F.lit(h) for h in held]), F.floor(F.col("g") / most).cast("int") + 1)
    drawn = F.pmod(F.xxhash64("id", "g", F.lit(seed)), F.lit(2**40)) / F.lit(float(2**40))
    below = [sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(9)]
    times = sum((drawn >= p).cast("int") for p in below)
    each = spark.read.parquet(path).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(len(held) * most - 1)))).withColumn("_held", F.col("fold") == kept)
    each = each.withColumn("w", F.when(F.col("_held"), 0).when(F.col("fold") >= 0, times).otherwise(0)).where("_held or w > 0").select("id", "g", "label", "w", "b")
    counts = np.zeros((len(held) * most, classes))
    for r in each.where("w > 0").groupBy("g", "label").agg(F.sum("w").alias("n")).collect():  # trees x classes
        counts[r.g, np.searchsorted(labels, r.label)] = r.n
    tops = Tops(counts)
    matrix = lambda batch: np.frombuffer(b"".join(batch["b"]), np.uint8).reshape(len(batch), dims)
    pure = lambda i: (tops.counts[i] > 0).sum() < 2
    level = 0
    while level < depths[-1]:
        large = [i for i in range(len(tops.node)) if tops.depth[i] == level and tops.counts[i].sum() > LOCAL and not pure(i)]
        if not large:
            break

        def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            wanted, sums = np.full(len(tops.node), -1), {}
            wanted[large] = np.arange(len(large))
            features = drawn_features(np.array(tops.tree)[large], np.array(tops.node)[large], dims)
            for batch in batches:
                if not len(batch):
                    continue
                bins = matrix(batch)
                slot = wanted[tops.reached(batch["g"].to_numpy(), bins)]
                y, w = np.searchsorted(labels, batch["label"].to_numpy()), batch["w"].to_numpy()
                for i in np.unique(slot[slot >= 0]).tolist():
                    mine = slot == i
                    one = histograms(bins[mine], y[mine], w[mine], np.zeros(mine.sum(), np.int64), features[i : i + 1], classes)
                    sums[i] = sums.get(i, 0) + one
            for i, one in sums.items():
                yield pd.DataFrame({"slot": [large[i]], "h": [one.tobytes()]})

        def chosen(parts: pd.DataFrame) -> pd.DataFrame:
            slot = int(parts["slot"].iloc[0])
            features = drawn_features(np.array([tops.tree[slot]]), np.array([tops.node[slot]]), dims)[0]
            total = sum(np.frombuffer(h).reshape(1, len(features), BINS, classes) for h in parts["h"])
            place, cut, left = best_cuts(total)
            return pd.DataFrame({"slot": [slot], "feature": [int(features[place[0]]) if place[0] >= 0 else -1], "cut": [int(cut[0])], "n": [left[0].tolist()]})

        trees = sorted({tops.tree[i] for i in large})
        parts = each.where((F.col("w") > 0) & F.col("g").isin(trees)).select("g", "label", "w", "b").mapInPandas(gathered, "slot int, h binary")
        for r in parts.groupBy("slot").applyInPandas(chosen, "slot int, feature int, cut int, n array<double>").collect():  # a row for LOCAL rows of a tree
            if r.feature < 0:
                tops.whole[r.slot] = True
            else:
                tops.split(r.slot, r.feature, r.cut, np.array(r.n))
        level += 1
    leaves = [i for i in range(len(tops.node)) if tops.feature[i] < 0]
    for i in leaves:
        tops.whole[i] = tops.whole[i] or bool(pure(i)) or tops.depth[i] >= depths[-1]

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = np.array(tops.whole)
        for batch in batches:
            if len(batch):
                batch["slot"] = tops.reached(batch["g"].to_numpy(), matrix(batch)).astype(np.int32)
                yield batch[(batch["w"] == 0) | ~done[batch["slot"]]][["id", "slot", "label", "w", "b"]]

    def votes(part: pd.DataFrame) -> pd.DataFrame:
        slot = int(part["slot"].iloc[0])
        bins, asked, w = matrix(part), part["w"].to_numpy() == 0, part["w"].to_numpy()
        found = np.zeros((asked.sum(), len(depths), classes))
        if asked.any() and not tops.whole[slot]:
            y = np.searchsorted(labels, part["label"].to_numpy()[~asked])
            found = grown_votes(tops.tree[slot], tops.node[slot], tops.depth[slot], bins[~asked], y, w[~asked], bins[asked], depths, classes)
        for i, share in tops.shares(slot, depths).items():
            found[:, i] = share
        mine = part[asked]
        return pd.DataFrame({"id": mine["id"], "g": np.full(len(mine), tops.tree[slot], np.int32), "label": mine["label"], "p": [v.tobytes() for v in found.astype(np.float32)]})

    at = each.mapInPandas(placed, "id long, slot int, label double, w int, b binary") if max(tops.depth) else each.withColumnRenamed("g", "slot")
    voted = at.repartition(min(2000, len(leaves)), "slot").groupBy("slot").applyInPandas(votes, "id long, g int, label double, p binary")

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        """The votes of a share of the rows, by trees in order."""
        part = part.sort_values(["id", "g"])
        ids, row = np.unique(part["id"].to_numpy(), return_inverse=True)
        p = np.frombuffer(b"".join(part["p"]), np.float32).reshape(len(part), len(depths), classes).astype(float)
        tree, first = part["g"].to_numpy() % most, np.searchsorted(part["id"].to_numpy(), ids)
        mine, out = part.iloc[first], []
        for number in numbers:
            total = np.zeros((len(ids), len(depths), classes))
            np.add.at(total, row[tree < number], p[tree < number])
            for i, d in enumerate(depths):
                out.append(pd.DataFrame({"fold": np.array(held)[mine["g"].to_numpy() // most], "depth": d, "number": number, "label": mine["label"].to_numpy(), "prediction": labels[total[:, i].argmax(1)], "n": 1}))
        return pd.concat(out).groupby(["fold", "depth", "number", "label", "prediction"], as_index=False).sum()

    buckets = max(1, -(-sum(r["count"] for r in sizes) * most // VOTES))
    schema = "fold int, depth int, number int, label double, prediction double, n long"
    counted = voted.groupBy(F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("_bucket")).applyInPandas(summed, schema)
    return counted.groupBy("fold", "depth", "number", "label", "prediction").agg(F.sum("n").alias("n"))


def best_confusion(rows: DataFrame, label: str, features: str, fold: str, test: str, depths: tuple, numbers: tuple) -> tuple[str, DataFrame]:
    """(parameters as text, (label, prediction, n) over the test rows) of the grid point with the best mean accuracy over the folds; of equal ones the first."""
    found = judged(rows, label, features, fold, test, depths, numbers).toPandas()  # folds x points x classes squared
    asked = found[found.fold >= 0].assign(hits=lambda x: x.n * (x.label == x.prediction))
    by_fold = asked.groupby(["depth", "number", "fold"])[["n", "hits"]].sum()
    means = (by_fold.hits / by_fold.n).groupby(["depth", "number"]).mean()
    depth, number = max(product(depths, numbers), key=lambda x: means[x])
    mine = found[(found.fold < 0) & (found.depth == depth) & (found.number == number)]
    confusion = rows.sparkSession.createDataFrame([tuple(r) for r in mine[["label", "prediction", "n"]].astype(object).itertuples(index=False)], "label double, prediction double, n long")
    return f"maxDepth={depth}, numTrees={number}", confusion
