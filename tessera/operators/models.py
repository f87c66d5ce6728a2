"""Model jobs with Spark ML: embeddings of titles, grid searches, nearest neighbours, comparison."""

from __future__ import annotations

from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import bayes, forests
from tessera.operators.blocks import PIVOTS, nearest
from tessera.operators.embeddings import Word2Vec
from tessera.sources.scratch import scratch


#: Numbers of neighbours, metrics and the distance that orders each of them.
NEIGHBOURS, METRICS = (1, 3, 5, 7), ("euclidean", "manhattan", "minkowski")
DISTANCES = {"euclidean": "euclidean", "manhattan": "manhattan", "minkowski": "euclidean"}

#: The forests' grid.
DEPTHS, TREES = (5, 10, 30), (10, 20)

#: Words that one task learns vectors from.
PART_WORDS = 1_000_000

#: Fits of a search at the same time, and classes of each that are.
PARALLEL, CLASSES = 12, 4

#: Training rows that a partition holds: a fit runs hundreds of jobs, each with a task a partition.
PART_ROWS = 25_000


def title_vectors(df: DataFrame, text_col: str, dims: int = 100, window: int = 5, seed: int = 1, keep: list[str] | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with ``vector``: the mean word vector of each tokenised lower-case text; null as empty, which has zeros. Each PART_WORDS words
    are learnt from in a task of their own. Words are named by 64-bit hashes; rows' words and their vectors are written once."""

    def written(rows: DataFrame, name: str) -> DataFrame:
        path = scratch(df.sparkSession, name)
        rows.write.parquet(path)
        return df.sparkSession.read.schema(rows.schema).parquet(path)

    words = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"\W+"), lambda w: w != "")
    words = written(df.select(*(df.columns if keep is None else keep), F.transform(words, lambda w: F.xxhash64(w)).alias("_words")), "title-words")
    parts = -(-max(1, words.agg(F.sum(F.size("_words"))).first()[0] or 0) // PART_WORDS)
    model = Word2Vec(vectorSize=dims, windowSize=window, seed=seed, numPartitions=parts, inputCol="_words", outputCol="vector")
    return written(model.fit_transform(words).drop("_words"), "title-vectors")


def feature_rows(df: DataFrame, features: str, label: str) -> DataFrame:
    """(features vector, label double) with the other columns."""
    return df.withColumns({"features": array_to_vector(F.col(features).cast("array<double>")), "label": F.col(label).cast("double")})


def grids(features: int, classes: int) -> dict:
    """Estimator and parameter grid by name; naive Bayes is searched by ``operators/bayes.py``, and the forests of ``compared`` by ``operators/forests.py``."""
    tree, forest = DecisionTreeClassifier(seed=1), RandomForestClassifier(seed=1)
    mlp = MultilayerPerceptronClassifier(seed=1, maxIter=30)
    svc = LinearSVC(maxIter=10, featuresCol="scaled")
    svm = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), OneVsRest(classifier=svc, featuresCol="scaled", parallelism=CLASSES)])
    return {
        "decision_tree": (tree, ParamGridBuilder().addGrid(tree.impurity, ["gini", "entropy"]).addGrid(tree.maxDepth, [3, 6]).build()),
        "random_forest": (forest, ParamGridBuilder().addGrid(forest.maxDepth, list(DEPTHS)).addGrid(forest.numTrees, list(TREES)).build()),
        "mlp": (mlp, ParamGridBuilder().addGrid(mlp.layers, [[features, 16, classes], [features, 32, classes]]).addGrid(mlp.solver, ["l-bfgs", "gd"]).build()),
        "svm": (svm, ParamGridBuilder().addGrid(svc.regParam, [0.01, 0.1]).build()),
    }


def searched(train: DataFrame, name: str, features: int, classes: int):
    """(best model, its parameters as text, (parameters, accuracy) by grid point): each grid point's mean accuracy over the ``fold``s that
    ``train`` has, two at least; the first of equally good ones wins."""
    estimator, grid = grids(features, classes)[name]
    folds = sorted(r.fold for r in train.select("fold").distinct().collect())  # bayes.FOLDS at most
    if len(folds) < 2:
        raise ValueError("a search needs rows in two folds")
    evaluator = MulticlassClassificationEvaluator(metricName="accuracy")

    def judged(at: tuple) -> float:
        point, fold = at
        model = estimator.fit(train.where(F.col("fold") != fold), point)
        return evaluator.evaluate(model.transform(train.where(F.col("fold") == fold)))

    with ThreadPool(PARALLEL) as pool:  # all folds and points, as their jobs are short
        metrics = pool.map(inheritable_thread_target(train.sparkSession)(judged), product(grid, folds), 1)
    means = [sum(metrics[i : i + len(folds)]) / len(folds) for i in range(0, len(metrics), len(folds))]
    texts = [", ".join(sorted(f"{p.name}={v}" for p, v in point.items())) for point in grid]
    best = max(range(len(grid)), key=lambda i: means[i])
    return estimator.fit(train, grid[best]), texts[best], list(zip(texts, means, strict=True))


def compared(rows: DataFrame, names: list[str], test: str, features: int, classes: int) -> DataFrame:
    """(model, parameters, label, prediction, n): each best model's confusion counts on the test rows. ``rows`` have
    features, label, the test flag, and may have a ``fold``; else a hash of the features gives it."""
    if "fold" not in rows.columns:
        rows = rows.withColumn("fold", F.pmod(F.xxhash64(vector_to_array("features")), F.lit(bayes.FOLDS)).cast("int"))
    train, held = rows.where(~F.col(test)), rows.where(F.col(test))
    train = train.coalesce(-(-max(1, train.count()) // PART_ROWS)).cache()
    out = None
    for name in names:
        if name == "naive_bayes":
            asked = rows.withColumn("features", vector_to_array("features"))
            parameters, counts = bayes.best_confusion(asked, "label", "features", "fold", test)
        elif name == "random_forest":
            asked = rows.withColumn("features", vector_to_array("features"))
            parameters, counts = forests.best_confusion(asked, "label", "features", "fold", test, DEPTHS, TREES)
        else:
            model, parameters, _ = searched(train, name, features, classes)
            counts = model.transform(held).groupBy("label", "prediction").agg(F.count("*").alias("n"))
        one = counts.select(F.lit(name).alias("model"), F.lit(parameters).alias("parameters"), "label", "prediction", "n")
        out = one if out is None else out.unionByName(one)
    train.unpersist()
    return out


def accuracies(confusion: DataFrame) -> DataFrame:
    """(model, parameters, accuracy), best first."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    return confusion.groupBy("model", "parameters").agg(F.round(F.sum(hit) / F.sum("n"), 4).alias("accuracy")).orderBy(F.desc("accuracy"), "model")


def nearest_labels(train: DataFrame, queries: DataFrame, id_col: str, vector: str, label: str, k: int, metric: str = "euclidean") -> DataFrame:
    """(id, predicted): the label most of the k nearest training rows have; ties go to the nearer, then smaller label.
    The queries are a stated set, compared with all training rows in blocks."""
    best = nearest(queries, train, id_col, vector, k, metric, carry=label)
    votes = best.groupBy("query", label).agg(F.count("*").alias("n"), F.min("rank").alias("r"))
    return votes.groupBy(F.col("query").alias(id_col)).agg(F.max_by(label, F.struct("n", -F.col("r"))).alias("predicted"))


def neighbour_grid(train: DataFrame, queries: DataFrame, id_col: str, vector: str, label: str, ks=NEIGHBOURS, metrics=METRICS) -> DataFrame:
    """(metric, k, n, hits): per metric and number of neighbours, the queries that have neighbours and those whose own label wins the vote.

    The nearest ``max(ks)`` rows are found once per distance, for they hold those of every smaller k; minkowski is the one of
    power 2, whose order is euclidean. Ties go to the nearer, then smaller label. Queries without a label hit nothing.
    """
    found = None
    for distance in dict.fromkeys(DISTANCES[m] for m in metrics):
        best = nearest(queries, train, id_col, vector, max(ks), distance, carry=label, pivots=PIVOTS).select("query", "rank", label)
        best = best.withColumn("metric", F.explode(F.array(*[F.lit(m) for m in metrics if DISTANCES[m] == distance])))
        found = best if found is None else found.unionByName(best)
    votes = found.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))
    votes = votes.groupBy("metric", "k", "query", label).agg(F.count("*").alias("n"), F.min("rank").alias("r"))
    won = votes.groupBy("metric", "k", "query").agg(F.max_by(label, F.struct("n", -F.col("r"))).alias("_predicted"))
    own = queries.select(F.col(id_col).alias("query"), F.col(label).alias("_own"))
    hit = F.coalesce(F.col("_predicted") == F.col("_own"), F.lit(False))
    return won.join(own, "query").groupBy("metric", "k").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
