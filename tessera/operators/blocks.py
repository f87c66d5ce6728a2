"""A stated query set against all rows, and rows against those a lag further on, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Queries and rows that meet in one task, and those whose scores it holds at a time. A row is sent once for each block of queries.
#: Rows are dealt to BLOCKS blocks before blocks grow to ROW_BLOCK; those that meet queries to ROW_BLOCKS, as each block is sent all queries.
QUERY_BLOCK, ROW_BLOCK, SMALL_BLOCK, BLOCKS, ROW_BLOCKS, TASKS = 16_384, 16_384, 4096, 64, 32, 2000
QUERY_TILE, ROW_TILE = 128, 2048

#: Lags that two blocks of positions meet for at a time.
LAGS = 64

#: Vectors that are shorter are compared in single precision first.
ROUGH = 1e15

#: An index is used where its cells hold at most this part of all distances: in many cells a row is sent many times.
WORTH = 0.5

#: Rows that cells are made around, where an index is asked for.
PIVOTS = 32


def _rounded(s: np.ndarray) -> np.ndarray:
    """Half up to six places."""
    return np.sign(s) * np.floor(np.abs(s) * 1e6 + 0.5) / 1e6


def _scores(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Query by row, larger is nearer, rounded half up to six places."""
    if metric == "dot":
        s = q @ r.T
    else:
        s, gap = np.zeros((len(q), len(r))), np.empty((len(q), len(r)))
        for i in range(q.shape[1]):
            np.subtract(q[:, i, None], r[None, :, i], out=gap)
            s -= np.abs(gap, out=gap) if metric == "manhattan" else np.multiply(gap, gap, out=gap)
    return _rounded(s)


def _first(owner: np.ndarray, at: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The places of each owner's ``n`` largest scores, equal ones by id."""
    order = np.lexsort((ids[at], -score, owner))
    mine = owner[order]
    return order[np.arange(len(order)) - np.searchsorted(mine, mine) < n]


def _nearest(q: np.ndarray, r: np.ndarray, q_ids: np.ndarray, r_ids: np.ndarray, n: int, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in q, places in r, scores) of each query's ``n`` nearest rows of another id, by tiles of queries.

    Inner products are taken in single precision first; the exact score is computed where that leaves a chance, its error and rounding allowed for.
    """
    # ids' order as numbers: cheap to compare, whatever their type
    ids = np.unique(np.concatenate([q_ids, r_ids]), return_inverse=True)[1].ravel()
    q_ids, r_ids = ids[: len(q)], ids[len(q) :]
    longest = [np.sqrt((x * x).sum(1)).max() for x in (q, r)]
    rough = metric == "dot" and all(x < ROUGH for x in longest)  # false where a number is none
    if rough:
        q_rough, r_rough = q.astype(np.float32), r.astype(np.float32)
        slack = (q.shape[1] + 4) * 2.0**-23 * longest[0] * longest[1] + 1e-6
    else:
        r = np.asfortranarray(r)
    for i in range(0, len(q), QUERY_TILE):
        mine = q[i : i + QUERY_TILE]
        least, full = np.full(len(mine), -np.inf), np.zeros(len(mine), bool)
        owner, at, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for j in range(0, len(r), ROW_TILE):
            s = q_rough[i : i + QUERY_TILE] @ r_rough[j : j + ROW_TILE].T if rough else _scores(mine, r[j : j + ROW_TILE], metric)
            if not rough or not full.all():
                s[q_ids[i : i + QUERY_TILE, None] == r_ids[None, j : j + ROW_TILE]] = -np.inf
            if s.shape[1] > n and not full.all() and (rough or not len(owner)):
                nth = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]  # those at least as near as the n-th, ties included
                least = np.maximum(least, nth - slack) if rough else nth
            bound = np.nextafter((least - slack).astype(np.float32), np.float32(-np.inf)) if rough else least
            chance = s >= bound[:, None]
            a, b = np.divmod(np.flatnonzero(chance if rough and full.all() else chance & (s > -np.inf)), s.shape[1])
            if rough:
                other = q_ids[i + a] != r_ids[j + b]
                a, b = a[other], b[other]
                many = len(a) > s.size // 16  # copies: all scores of the tile take less than so many one by one
                exact = _scores(mine, r[j : j + ROW_TILE], metric)[a, b] if many else _rounded(np.einsum("ij,ij->i", mine[a], r[j + b]))
            else:
                exact = s[a, b]
            owner, at, score = np.concatenate([owner, a]), np.concatenate([at, b + j]), np.concatenate([score, exact])
            keep = _first(owner, at, score, r_ids, n)
            owner, at, score = owner[keep], at[keep], score[keep]
            full = np.bincount(owner, minlength=len(mine)) == n
            worst = np.full(len(mine), np.inf)
            np.minimum.at(worst, owner, score)
            least = np.where(full, worst, -np.inf)
        yield owner + i, at, score


def _distances(x: np.ndarray, pivots: np.ndarray, metric: str) -> np.ndarray:
    """Row by pivot, unrounded."""
    if metric == "manhattan":
        return np.stack([np.abs(x - p).sum(1) for p in pivots], 1)
    return np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in pivots], 1))


def _celled(q: DataFrame, r: DataFrame, n: int, metric: str, number: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_cell``: a query's is that of its nearest pivot, a row is in each cell where it may be near enough.

    A cell's queries lie within u of its pivot. So their n nearest rows of another id lie within the bound that the n + 1 rows give whose way
    over their own pivot and this one is shortest; by the triangle inequality a row farther from the pivot than u and that bound is not
    among them. What reaches the driver is a number a cell and n + 1 numbers a pivot. Vectors of another length than the pivots' meet in cell -1.
    """
    drawn = r.orderBy(F.xxhash64("_r", "_v"), "_r").limit(number).select("_v").collect()
    if not drawn:
        return q.withColumn("_cell", F.lit(-1)), r.withColumn("_cell", F.lit(-1))
    size = len(drawn[0][0])
    pivots = np.array([d[0] for d in drawn if len(d[0]) == size])

    @F.pandas_udf("array<double>")
    def away(v: pd.Series) -> pd.Series:
        return pd.Series(list(_distances(np.stack(v.to_numpy()), pivots, metric)) if len(v) else [], dtype=object)

    fits = F.col("_size") == size
    placed = lambda df: df.where(fits).withColumn("_d", away("_v")).withColumn("_own", F.array_position("_d", F.array_min("_d")).cast("int") - 1)
    asked, held = placed(q), placed(r)
    radius = {x["_own"]: x.u for x in asked.groupBy("_own").agg(F.max(F.array_min("_d")).alias("u")).collect()}
    order = W.partitionBy("_own").orderBy("_near")  # Spark keeps n + 1 rows of each part before it sorts a cell
    near = held.select("_own", F.array_min("_d").alias("_near")).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n + 1).collect()
    between = _distances(pivots, pivots, metric)
    reach = {}
    for cell, u in radius.items():
        ways = sorted(u + between[x["_own"], cell] + x["_near"] for x in near)
        # rows as far as the last one to six places are ties
        bound = ways[n] if len(ways) > n else np.inf
        reach[cell] = u + (bound + 2e-6 if metric == "manhattan" else (bound * bound + 2e-6) ** 0.5) * (1 + 1e-9)
    limits = F.array(*[F.lit(float(reach.get(i, -1.0))) for i in range(len(pivots))])
    inside = F.filter(F.sequence(F.lit(0), F.lit(len(pivots) - 1)), lambda i: F.get("_d", i) <= F.get(limits, i))
    rest = lambda df: df.where(~fits).withColumn("_cell", F.lit(-1))
    return (
        asked.withColumn("_cell", F.col("_own")).drop("_d", "_own").unionByName(rest(q)),
        held.withColumn("_cell", F.explode(inside)).drop("_d", "_own").unionByName(rest(r)),
    )


def _pairs(q: DataFrame, r: DataFrame) -> int:
    """How many queries and rows meet; a row a cell reaches the driver."""
    asked, held = ({x["_cell"]: x["count"] for x in df.groupBy("_cell").count().collect()} for df in (q, r))
    return sum(n * held.get(cell, 0) for cell, n in asked.items())


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, vector: str, n: int, metric: str = "dot", carry: str | None = None, pivots: int = 0) -> DataFrame:
    """(query, other, score, rank, carry where given): each query's ``n`` nearest rows of another id, the nearest first,
    equally near ones by id. ``metric``: dot, euclidean (squared) or manhattan; distances are negated.

    Every block of queries meets every block of rows in one cogroup and leaves ``n`` rows a query, so that neither
    side is broadcast or gathered. Vectors that are null, hold a null or have another length meet nothing.
    With ``pivots`` (distances only) queries meet only the rows of their cell of a metric index, where that leaves out enough (WORTH); the result is the same.
    """
    def prepared(df: DataFrame, columns: list) -> DataFrame:
        whole = F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull())
        return df.where(whole & F.col(id_col).isNotNull()).select(*columns, F.col(vector).cast("array<double>").alias("_v"), F.size(vector).alias("_size"))

    kind = dict(rows.dtypes)[id_col]
    q = prepared(queries, [F.col(id_col).alias("_q")])
    r = prepared(rows, [F.col(id_col).alias("_r"), (F.col(carry) if carry else F.lit(None).cast("int")).alias("_c")])
    asked, held = max(1, q.count()), max(1, r.count())
    q_blocks, r_blocks = -(-asked // QUERY_BLOCK), max(-(-held // ROW_BLOCK), min(-(-held // SMALL_BLOCK), ROW_BLOCKS))
    whole = q.withColumn("_cell", F.lit(-1)), r.withColumn("_cell", F.lit(-1))
    celled = _celled(q, r, n, metric, pivots) if pivots and metric != "dot" else whole
    q, r = celled if celled is not whole and _pairs(*celled) <= WORTH * asked * held else whole
    cells = 1 if q is whole[0] else pivots
    place = lambda key, n: F.pmod(F.xxhash64(key, "_v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("_qb", place("_q", q_blocks)).withColumn("_rb", every(r_blocks))
    r = r.withColumn("_rb", place("_r", r_blocks)).withColumn("_qb", every(q_blocks))

    def best(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return empty.copy()
        ids, mine, carried = right["_r"].to_numpy(), left["_q"].to_numpy(), right["_c"]
        found = list(_nearest(np.stack(left["_v"].to_numpy()), np.stack(right["_v"].to_numpy()), mine, ids, n, metric))
        owner, at, score = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"query": mine[owner], "other": ids[at], "score": score, "_c": carried.iloc[at].to_numpy()})

    schema = f"query {kind}, other {kind}, score double, _c {dict(r.dtypes)['_c']}"
    empty = pd.DataFrame(columns=["query", "other", "score", "_c"])
    keys = ["_cell", "_qb", "_rb", "_size"]
    tasks = min(TASKS, 3 * q_blocks * r_blocks * cells)  # by the work, which the bytes do not tell
    q_dealt, r_dealt = q.repartition(tasks, *keys), r.repartition(tasks, *keys)
    found = q_dealt.groupBy(*keys).cogroup(r_dealt.groupBy(*keys)).applyInPandas(best, schema)
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "other"))).where(F.col("rank") <= n)
    return found.withColumnRenamed("_c", carry) if carry else found.drop("_c")


def _matrix(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as columns, shorter ones filled up, and their lengths; -1 where there is none."""
    sizes = np.array([-1 if v is None else len(v) for v in vectors])
    out = np.zeros((max(0, sizes.max()), len(sizes)))
    for i, v in enumerate(vectors):
        if v is not None:
            out[: sizes[i], i] = v
    return out, sizes


def lag_products(rows: DataFrame, pos: str, vector: str, lags: list[int], block: int | None = None) -> DataFrame:
    """(lag, pos, product): the inner product, summed in order, of the vectors at pos and pos + lag, for all positions that have both.
    It is null where a vector is null, holds a null, or the two differ in length.

    A row is sent once for each block of positions, not for each lag: blocks of ``block`` positions meet in cogroups, LAGS lags at a time,
    in order, so that a slice of lags reaches few blocks. Only products leave a task.
    """
    at, kind = F.col(pos), dict(rows.dtypes)[pos]
    each = rows.where(at.isNotNull()).select(at.alias("_p"), F.when(F.forall(F.col(vector), lambda x: x.isNotNull()), F.col(vector).cast("array<double>")).alias("_v"))
    ends = each.agg(F.min("_p").alias("low"), F.max("_p").alias("high")).first()
    lags = sorted(set(lags))
    if ends.low is None or not lags:
        return rows.sparkSession.createDataFrame([], f"lag long, pos {kind}, product double")
    span = ends.high - ends.low + 1
    block = block or min(ROW_BLOCK, max(SMALL_BLOCK, -(-span // BLOCKS)))
    slices = [lags[i : i + LAGS] for i in range(0, len(lags), LAGS)]
    place = lambda p: F.floor(p / block)
    keys = ["_s", "_x", "_y"]

    def dealt(sign: int, own: str, other: str) -> DataFrame:
        """Rows with the blocks that they meet for each slice of lags."""
        there = lambda x: F.col("_p") + sign * x
        met = F.array_distinct(F.transform(F.filter("_l", lambda x: there(x).between(ends.low, ends.high)), lambda x: place(there(x))))
        sliced = each.withColumn(own, place(F.col("_p"))).select("*", F.posexplode(F.array(*[F.array(*[F.lit(x).cast("long") for x in s]) for s in slices])).alias("_s", "_l"))
        # columns of its own for each side: a cogroup does not tell apart those that both inherit
        return sliced.withColumn(other, F.explode(met)).select(*keys, F.col("_p").alias(f"{own}_at"), F.col("_v").alias(f"{own}_v"))

    def products(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return empty.copy()
        right = right.sort_values("_y_at")
        p, q = left["_x_at"].to_numpy(), right["_y_at"].to_numpy()
        (v, v_size), (w, w_size) = _matrix(left["_x_v"]), _matrix(right["_y_v"])
        out = []
        for lag in slices[key[0]]:
            first = np.searchsorted(q, p + lag)
            n = np.searchsorted(q, p + lag, "right") - first
            a = np.repeat(np.arange(len(p)), n)
            b = np.arange(len(a)) + np.repeat(first - np.cumsum(n) + n, n)
            total = np.zeros(len(a))
            for x, y in zip(v, w):
                total += x[a] * y[b]
            total[(v_size[a] != w_size[b]) | (v_size[a] < 0)] = np.nan
            out.append(pd.DataFrame({"lag": np.full(len(a), lag, np.int64), "pos": p[a], "product": total}))
        return pd.concat(out)

    empty = pd.DataFrame(columns=["lag", "pos", "product"])
    blocks = min(TASKS, -(-span // block))
    tasks = min(TASKS, blocks * (blocks // 2 + len(slices)))
    left, right = dealt(1, "_x", "_y").repartition(tasks, *keys), dealt(-1, "_y", "_x").repartition(tasks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(products, f"lag long, pos {kind}, product double")
