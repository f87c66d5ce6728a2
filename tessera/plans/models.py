"""Queries of the model jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import l2_normalized
from tessera.operators import bayes, kernels, trees
from tessera.operators import models as op
from tessera.operators.ordering import top_similar
from tessera.plans.registry import query


def _rows(embeddings: DataFrame) -> tuple[DataFrame, int, int]:
    shape = embeddings.agg(F.max(F.size("embedding")).alias("d"), F.max("label").alias("c")).first()
    rows = op.feature_rows(embeddings.withColumnRenamed("label", "y"), "embedding", "y").withColumns({"test": F.col("vec_id") % 4 == 0, "fold": (F.floor(F.col("vec_id") / 4) % 5).cast("int")})
    return rows, shape.d, shape.c + 1


def _one(name: str):
    def run(embeddings: DataFrame) -> DataFrame:
        rows, d, c = _rows(embeddings)
        return op.accuracies(op.compared(rows, [name], "test", d, c))

    return run


@query(None, "documents")
def m1_word2vec_titles(documents: DataFrame) -> DataFrame:
    vectors = op.title_vectors(documents.select("doc_id", F.substring_index("text", "\n", 1).alias("title")), "title", keep=["doc_id"])
    unit = vectors.select("doc_id", l2_normalized(F.col("vector")).alias("vector"))
    return top_similar(unit, "doc_id", "vector", unit.where("doc_id % 20 = 0"), 3)


@query(None, "embeddings")
def m2_grid_search_decision_tree(embeddings: DataFrame) -> DataFrame:
    return _one("decision_tree")(embeddings)


@query(None, "embeddings")
def m2_grid_search_random_splits(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select("label", "embedding", (F.floor(F.col("vec_id") / 4) % 5).cast("int").alias("fold"), (F.col("vec_id") % 4 == 0).alias("test"))
    return trees.grid_search(rows, "label", "embedding", "fold", "test")


@query(None, "embeddings")
def m3_grid_search_random_forest(embeddings: DataFrame) -> DataFrame:
    return _one("random_forest")(embeddings)


@query(None, "embeddings")
def m4_grid_search_mlp(embeddings: DataFrame) -> DataFrame:
    return _one("mlp")(embeddings)


@query(None, "embeddings")
def m5_grid_search_svm(embeddings: DataFrame) -> DataFrame:
    return _one("svm")(embeddings)


@query(None, "embeddings")
def m5_grid_search_kernel_svm(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select("label", "embedding", (F.floor(F.col("vec_id") / 4) % 5).cast("int").alias("fold"), (F.col("vec_id") % 4 == 0).alias("test"))
    return kernels.grid_search(rows, "label", "embedding", "fold", "test")


#: Grid points and folds of Gaussian naive Bayes by moments: what the query does in two passes, in plain SQL.
_BAYES = """
with r as (select vec_id, label, cast(vec_id // 4 % 5 as int) as fold, vec_id % 4 = 0 as test, embedding from embeddings),
x as (select vec_id, label, fold, test, unnest(range(len(embedding))) as i, unnest(embedding)::double as x from r),
folds as (select unnest([-1, 0, 1, 2, 3, 4]) as held),
m as (select held, label, i, count(*) as n, sum(x) as s, sum(x * x) as q from x, folds where not test and fold <> held group by all),
w as (select held, max(v) as v from (select held, i, sum(q) / sum(n) - pow(sum(s) / sum(n), 2) as v from m group by all) group by 1),
g as (select * from (values (1e-9::double), (1e-2::double), (1.0::double)) a(smoothing), (values ('empirical'), ('uniform')) b(priors)),
c as (select m.held, label, i, s / n as mean, greatest(q / n - pow(s / n, 2), 0) as v, w.v as largest, n,
    sum(n) over (partition by m.held, i) as total, count(*) over (partition by m.held, i) as classes from m join w on w.held = m.held),
asked as (select x.vec_id, x.label, case when test then -1 else fold end as held, i, x from x),
joint as (select a.vec_id, a.label, a.held, smoothing, priors, c.label as guess,
    max(ln(case priors when 'empirical' then c.n / c.total else 1 / c.classes end)) - 0.5 * sum(ln(2 * pi() * (c.v + smoothing * largest)) + pow(a.x - mean, 2) / (c.v + smoothing * largest)) as l
  from asked a join c on c.held = a.held and c.i = a.i, g group by all),
best as (select vec_id, label, held, smoothing, priors, arg_max(guess, (l, -guess)) as guess from joint group by all)
select smoothing, priors, cast(held as int) as fold, count(*)::bigint as n, count(*) filter (guess = label)::bigint as hits from best group by all"""


@query(_BAYES, "embeddings")
def m6_grid_search_naive_bayes(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select("label", "embedding", (F.floor(F.col("vec_id") / 4) % 5).cast("int").alias("fold"), (F.col("vec_id") % 4 == 0).alias("test"))
    return bayes.grid_search(rows, "label", "embedding", "fold", "test")


_NEIGHBOURS = """
with p as (select a.vec_id, a.label as own, b.vec_id as t, b.label, round(list_sum([pow(x[1]::double - x[2]::double, 2) for x in list_zip(a.embedding, b.embedding)]), 6) as euclidean,
    round(list_sum([abs(x[1]::double - x[2]::double) for x in list_zip(a.embedding, b.embedding)]), 6) as manhattan from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
d as (select vec_id, own, t, label, 'euclidean' as metric, euclidean as d from p union all select vec_id, own, t, label, 'minkowski', euclidean from p union all select vec_id, own, t, label, 'manhattan', manhattan from p),
r as (select *, row_number() over (partition by metric, vec_id order by d, t) as r from d),
v as (select metric, k, vec_id, own, label, count(*) as n, min(r) as r from r, (values (1), (3), (5), (7)) k(k) where r <= k group by all),
b as (select metric, k, vec_id, own, arg_max(label, (n, -r)) as predicted from v group by all)
select metric, k, count(*)::bigint as n, count(*) filter (predicted = own)::bigint as hits from b group by all"""


@query(_NEIGHBOURS, "embeddings")
def m7_knn_classifier(embeddings: DataFrame) -> DataFrame:
    return op.neighbour_grid(embeddings, embeddings.where("vec_id % 20 = 0"), "vec_id", "embedding", "label")


@query(None, "embeddings")
def m8_compare_models(embeddings: DataFrame) -> DataFrame:
    rows, d, c = _rows(embeddings)
    return op.compared(rows, [*op.grids(d, c), "naive_bayes"], "test", d, c)
