"""Work, memory and shuffles of jobs that grew faster than their input; results against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import l2_normalized
from tessera.operators import aggregates, blocks, embeddings, forests, joins, models, sequences, sketches


def test_a_norm_is_computed_once_a_vector(spark):
    """Not again for every element: the plan holds one sum a vector."""
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],)], "v array<double>")
    sums = lambda c: df.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")
    assert sums(l2_normalized(F.col("v"))) == 1 and sums(sequences.combined([F.col("v"), F.col("v")])) == 3
    assert [r.c for r in df.select(l2_normalized(F.col("v")).alias("c")).collect()] == [[0.6, 0.8], [0.0, 0.0], None, []]


def test_groups_name_all_their_members(spark, monkeypatch):
    """Over many stretches, with negative and repeated members, null keys and keys of one row."""
    monkeypatch.setattr(aggregates, "STRETCH", 7)
    rows = [("a", int(i)) for i in np.random.default_rng(1).integers(-60, 60, 90)] + [(None, 5), (None, -3), ("one", 1)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(4)
    got = {r.k: (r.n, r.representative, r.members) for r in aggregates.duplicate_groups(df, "k", "v").collect()}
    values = sorted(v for k, v in rows if k == "a")
    assert got == {"a": (90, values[0], ",".join(map(str, values))), None: (2, -3, "-3,5")}


def test_equal_contents_name_all_their_rows(spark):
    rows = [(5, "x"), (70_000, "x"), (-2, "x"), (1, ""), (2, ""), (3, "y"), (8, "é")]
    df = spark.createDataFrame(rows, "i long, t string").repartition(3)
    got = sorted((r.size, r.n, r["first"], r.ids) for r in sequences.equal_content(df, "i", "t").collect())
    assert got == [(0, 2, 1, "1,2"), (1, 3, -2, "-2,5,70000")]


def test_tasks_of_agreeing_sources_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "TASK_ROWS", 50)
    rows = [(i % 7, i % 3, i % 11) for i in range(600)] + [(7, 1, 1), (8, None, 2), (8, None, 3), (None, 4, None)]
    found = aggregates.agreeing_sources(spark.createDataFrame(rows, "k long, v long, s long"), "k", "v", "s")
    assert found._jdf.queryExecution().optimizedPlan().toString().count(", 13") == 2  # tasks of both shuffles
    got = {r.k: (r.v, r.sources, r.report) for r in found.collect()}
    assert got == {k: (0, 11, "different") for k in range(7)} | {7: (None, 1, "same"), 8: (None, 2, "same"), None: (None, 0, "same")}


@pytest.mark.parametrize("metric", ["dot", "euclidean", "manhattan"])
def test_rows_are_sent_once_a_block_of_queries(spark, monkeypatch, metric):
    """Tiles give what all pairs give, with ties and repeated ids; an index that leaves nothing out multiplies no rows."""
    monkeypatch.setattr(blocks, "QUERY_TILE", 5), monkeypatch.setattr(blocks, "ROW_TILE", 7)
    rng = np.random.default_rng(3)
    x, y, a, b = rng.integers(-1, 2, (23, 3)).astype(float), rng.integers(-1, 2, (40, 3)).astype(float), np.arange(23), rng.integers(0, 35, 40)
    got = {}
    for owner, at, score in blocks._nearest(x, y, a, b, 4, metric):
        for o, i, s in zip(owner, at, score):
            got.setdefault(int(o), []).append((-float(s), int(b[i])))
    s = blocks._scores(x, y, metric)
    assert got == {i: sorted((-float(s[i, j]), int(b[j])) for j in range(40) if b[j] != i)[:4] for i in range(23)}
    df = spark.createDataFrame([(i, rng.normal(0, 1, 16).tolist()) for i in range(300)], "i int, v array<double>")
    sent = []
    place = blocks._pairs
    monkeypatch.setattr(blocks, "_pairs", lambda q, r: (sent.append((q.count(), r.count())), place(q, r))[1])
    found = blocks.nearest(df.where("i % 10 = 0"), df, "i", "v", 3, metric, pivots=8)
    read = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 90 and (metric == "dot" or sent[0][1] > 600) and "filter(" not in read  # the cells' rows are not exploded


def test_word_vectors_are_learnt_in_parts(spark, monkeypatch):
    """The number of tasks follows the words; all words get vectors."""
    monkeypatch.setattr(models, "PART_WORDS", 100)
    asked = []
    plain = models.Word2Vec
    monkeypatch.setattr(models, "Word2Vec", lambda **k: (asked.append(k["numPartitions"]), plain(**k))[1])
    df = spark.createDataFrame([(f"w{i % 9} x{i % 5} common",) for i in range(120)] + [(None,)], "t string")
    got = models.title_vectors(df, "t", dims=4)
    assert asked == [4] and got.where("exists(vector, x -> x <> 0)").count() == 120


def test_vectors_meet_those_some_lags_on_without_a_broadcast(spark, monkeypatch):
    """Lags of any sign over many blocks, slices and gaps, with repeated positions, null ones, null and uneven vectors, equal sums made in pairs; what is exploded is never broadcast."""
    monkeypatch.setattr(blocks, "LAGS", 3)
    rng = np.random.default_rng(5)
    rows = [(int(p), rng.normal(0, 1, 4).tolist()) for p in rng.integers(-40, 90, 110)] + [(3, None), (None, [1.0] * 4), (7, [1.0, None, 2.0, 0.5]), (8, [1.0, 2.0]), (500, [0.5] * 4), (513, [2.0] * 4)]
    df = spark.createDataFrame(rows, "p long, v array<double>").repartition(3)
    lags = [1, 2, 5, 13, 40, -4, 0, 13]
    want = []
    for p, a in rows:
        for q, b in rows:
            for lag in set(lags):
                if p is not None and q is not None and q - p == lag:
                    total = None
                    if a is not None and b is not None and len(a) == len(b) and None not in a + b:
                        total = 0.0
                        for x, y in zip(a, b):
                            total += x * y
                    want.append((lag, p, total))
    for block in (None, 7, 64):
        assert sorted(map(tuple, blocks.lag_products(df.select(F.col("p").alias("p"), F.transform("v", lambda x: x).alias("v")), "p", "v", lags, block).collect()), key=str) == sorted(want, key=str)
    assert blocks.lag_products(df, "p", "v", []).count() == blocks.lag_products(df.limit(0), "p", "v", lags).count() == 0
    assert "BroadcastHashJoin" not in joins.lag_pairs(df, "p", "v", list(range(1, 100)))._jdf.queryExecution().executedPlan().toString()


def test_cells_of_records_are_not_broadcast(spark):
    """Spark counts a record of many cells once."""
    records = spark.createDataFrame([(1, 5, i, i + 40, 1.0) for i in range(50)], "file long, offset long, first long, last long, confidence double")
    pairs = sequences._rivals(records.withColumn("_rank", F.col("first")), "file", 1.5, 0.8)
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString() and pairs.count() > 0


def test_forests_equal_trees_grown_node_by_node(spark, monkeypatch):
    """Every grid point and fold against a plain recursion over the same bins, bootstrap numbers and drawn features, whatever the part grown from histograms; null and short rows are left out."""
    rng = np.random.default_rng(11)
    x = rng.integers(0, 12, (160, 5)).astype(float)
    y = (x[:, 0] > 5).astype(int) + (x[:, 1] > 7) + (rng.random(160) < 0.2)
    rows = [(i, float(v), r.tolist(), i % 4 == 0, i // 4 % 3) for i, (v, r) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows + [(900, 1.0, None, False, 1), (901, 1.0, [1.0], False, 1), (902, None, [1.0] * 5, False, 1), (903, 1.0, [1.0, None, 1.0, 1.0, 1.0], True, 1)], "i int, y double, v array<double>, test boolean, f int").coalesce(1)
    depths, numbers, seen, got = (0, 2, 9), (2, 3), [], []
    for local in (10**6, 20, 1):
        monkeypatch.setattr(forests, "LOCAL", local)
        got.append({tuple(r) for r in forests.judged(df, "y", "v", "f", "test", depths, numbers).collect()})
    assert got[0] == got[1] == got[2]
    limits = [np.unique([sorted(x[[not r[3] for r in rows], j])[int(np.ceil(k / 32 * 120)) - 1] for k in range(1, 32)]) for j in range(5)]
    bins = np.stack([np.searchsorted(q, x[:, j]) for j, q in enumerate(limits)], 1)
    ids = [r.i for r in df.where("y is not null and v is not null and forall(v, e -> e is not null)").where("size(v) = 5").withColumn("n", F.monotonically_increasing_id()).orderBy("n").collect()]
    assert ids == list(range(160))
    draws = spark.range(160).select(F.col("id"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("g")).withColumn("d", F.pmod(F.xxhash64("id", "g", F.lit(1)), F.lit(2**40)) / F.lit(float(2**40))).collect()
    cdf = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(9)])
    times = {(r.id, r.g): int((r.d >= cdf).sum()) for r in draws}

    def share(tree, node, depth, limit, mine, row):
        """The shares that ``row`` finds below a node of bootstrap rows (with repetitions)."""
        counts = np.bincount(y[mine], minlength=4)
        if depth == limit or (counts > 0).sum() < 2:
            return counts / counts.sum()
        best = (1e-6, None, None)
        for j in forests.drawn_features(np.array([tree]), np.array([node]), 5)[0]:
            for cut in range(32):
                a, b = [i for i in mine if bins[i, j] <= cut], [i for i in mine if bins[i, j] > cut]
                if a and b:
                    square = lambda part: (np.bincount(y[part], minlength=4) ** 2).sum() / len(part)
                    gain = round(square(a) + square(b) - square(mine), 9)
                    if gain > best[0]:
                        best = gain, j, cut
        _, j, cut = best
        if j is None:
            return counts / counts.sum()
        side = bins[row, j] > cut
        return share(tree, 2 * node + side, depth + 1, limit, [i for i in mine if (bins[i, j] > cut) == side], row)

    want = {}
    for k, fold in enumerate((-1, 0, 1, 2)):
        asked = [r[0] for r in rows if (r[3] if fold < 0 else not r[3] and r[4] == fold)]
        taught = [r[0] for r in rows if not r[3] and (fold < 0 or r[4] != fold)]
        for depth in depths:
            for row in asked[::3]:
                p = [share(3 * k + t, 1, 0, depth, [i for i in taught for _ in range(times[i, 3 * k + t])], row) for t in range(3)]
                for n in numbers:
                    seen.append((fold, depth, n, float(y[row]), float(np.sum(p[:n], axis=0).round(6).argmax())))
    for key in set(seen):
        want[key] = seen.count(key)
    found = {g[:5]: g[5] for g in got[0]}
    assert all(found.get(key, 0) >= n for key, n in want.items()) and len(want) > 40
    assert sum(found.values()) == 160 * 6
    hits = sum(n for k, n in found.items() if k[0] == -1 and k[1] == 9 and k[2] == 3 and k[3] == k[4])
    assert hits >= 22  # of 40
    with pytest.raises(ValueError):
        forests.judged(df.where("f = 1"), "y", "v", "f", "test", depths, numbers)


def test_texts_meet_their_terms_by_blocks(spark, monkeypatch):
    """Blocks of a few terms give what one block gives; terms are not sent once a text."""
    monkeypatch.setattr(sketches, "BLOCK_TERMS", 300)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.5, 60) if i < 500) for _ in range(200)] + [None, "", "one more"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    rows, terms = sketches.term_blocks(df, "t")
    n = rows.select("block").distinct().count()
    assert rows.count() == 201 and 5 < n < 60 and terms.count() < 0.6 * rows.select(F.explode("terms")).count()
    assert terms.agg(F.sum("n")).first()[0] == rows.select(F.explode("terms")).count() == sum(len({w for w in (t or "").split() if len(w) > 1}) for t in texts)
    small = sketches.text_similarity(df, "t").first()
    monkeypatch.setattr(sketches, "BLOCK_TERMS", 10**6)
    assert np.allclose(small, sketches.text_similarity(df, "t").first(), rtol=1e-9)


def test_word_vectors_are_the_mean_of_their_parts(spark, monkeypatch):
    """Against parts learnt here, one by one; the same rows give the same vectors however they are dealt, none passes the driver."""
    monkeypatch.setattr(models, "PART_WORDS", 150), monkeypatch.setattr(embeddings, "SLICE", 7)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{w}" for w in rng.integers(0, 24, 6))) for i in range(150)] + [(900, None), (901, "-- !"), (902, "w3")]
    df = spark.createDataFrame(rows, "i int, t string")
    got = [{r.i: r.vector for r in models.title_vectors(df.repartition(n), "t", dims=8).collect()} for n in (1, 5)]
    assert got[0] == got[1] and got[0][900] == got[0][901] == [0.0] * 8
    assert "pyspark" not in models.Word2Vec.__module__
    words = df.withColumn("_words", F.transform(F.filter(F.split(F.coalesce("t", F.lit("")), r"\W+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    parts, total, n = {}, {}, {}
    for r in words.withColumn("at", F.xxhash64("i", "t", "_words")).orderBy("at").collect():
        parts.setdefault(r.at % 7, []).append(r._words)
    assert len(parts) == 7  # 901 words
    for part, titles in parts.items():
        known, tokens = np.unique(np.array(sum(titles, []), np.int64), return_inverse=True)
        start = embeddings.first_vectors(known, 8, 2, 1 / 8), embeddings.first_vectors(known, 8, 3, 2 * (3 / 8) ** 0.5)
        found = embeddings.skip_grams(tokens, np.repeat(np.arange(len(titles)), [len(t) for t in titles]), *start, 5, np.random.default_rng([1, part]))
        for w, v, k in zip(known.tolist(), found, np.bincount(tokens)):
            total[w], n[w] = total.get(w, 0) + v * float(k), n.get(w, 0) + k
    for r in words.collect():
        want = np.mean([total[w] / n[w] for w in r._words], 0) if r._words else np.zeros(8)
        assert np.allclose(got[0][r.i], want, atol=1e-5)
    assert models.title_vectors(df.limit(0), "t", dims=8).count() == 0


@pytest.mark.parametrize("words, n", [(2, 3), (2, 5000), (40, 20_000)])
def test_steps_of_frequent_words_stay_bounded(words, n):
    """And words of the same titles end up near: every second title has the upper half of the words."""
    half = words // 2
    tokens = np.random.default_rng(0).integers(0, max(1, half), n) + half * (np.arange(n) // 9 % 2)
    start = [embeddings.first_vectors(np.arange(words), 16, i, w) for i, w in ((2, 1 / 16), (3, 0.9))]
    found = embeddings.skip_grams(tokens, np.arange(n) // 9, *start, 5, np.random.default_rng(1))
    assert np.isfinite(found).all() and np.abs(found).max() < 10
    if words > 2:
        unit = found / np.linalg.norm(found, axis=1, keepdims=True)
        assert ((unit @ unit.T - 2 * np.eye(words)).argmax(1) // half == np.arange(words) // half).all()


@pytest.mark.parametrize("kind", range(6))
def test_products_in_single_precision_first_lose_nothing(monkeypatch, kind):
    """Scores closer than single precision tells, copies, large, tiny and missing numbers: what all exact scores give."""
    monkeypatch.setattr(blocks, "QUERY_TILE", 5), monkeypatch.setattr(blocks, "ROW_TILE", 11)
    rng = np.random.default_rng(kind)
    x, y, a, b = rng.normal(size=(23, 6)), rng.normal(size=(120, 6)), rng.integers(0, 30, 23), rng.integers(0, 60, 120)
    x, y = [(x, y), (np.round(x), np.round(y)), (x * 1e6, np.repeat(y[:12], 10, axis=0)), (x * 1e-9, y * 1e3), (1 + x * 1e-7, 1 + y * 1e-7), (x * 1e20, y * 1e20)][kind]
    dense, s, got = [], blocks._scores(x, y, "dot"), {}
    monkeypatch.setattr(blocks, "_scores", lambda q, r, m, plain=blocks._scores: (dense.append(len(r)), plain(q, r, m))[1])
    for owner, at, score in blocks._nearest(x, y, a, b, 4, "dot"):
        for o, i, v in zip(owner, at, score):
            got.setdefault(int(o), []).append((-float(v), int(b[i])))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted((-float(s[i, j]), int(b[j])) for j in range(120) if b[j] != a[i])[:4] for i in range(23)}
    assert kind != 0 or len(dense) < 50  # of 55 tiles; small as they are
