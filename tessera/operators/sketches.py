"""Tensor sketches: powers of inner products as inner products of short vectors, and what follows from their sums."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import scratch

#: Buckets of a sketch of texts. The relative error of a sum of squares is about the root of 8 / SIZE (3 %), that of a deviation half of it.
SIZE = 8192

#: Different terms of texts that a block holds, and texts whose sketches it makes at a time.
BLOCK_TERMS, ROWS = 500_000, 64

#: Blocks that are dealt to tasks of their own.
TASKS = 2000

#: A term is a run of two word characters or more.
TERM = r"[\p{L}\p{N}_]{2,}"


def places(hashes: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket and a sign (1.0 or -1.0) for each 64-bit hash; other seeds give independent ones."""
    with np.errstate(over="ignore"):
        x = hashes.astype(np.int64).view(np.uint64) + np.uint64(seed + 1) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x % np.uint64(size)).astype(np.int64), np.where(x >> np.uint64(63), 1.0, -1.0)


def tensor_sketch(x: np.ndarray, degree: int, size: int, seed: int = 0) -> np.ndarray:
    """A row of ``size`` numbers for each row of ``x``; their inner products estimate those of ``x`` raised to ``degree``, without bias."""
    product = np.ones((len(x), size // 2 + 1), complex)
    for i in range(degree):
        bucket, sign = places(np.arange(x.shape[1]), size, seed + i)
        counts = np.zeros((size, x.shape[1]))
        counts[bucket, np.arange(x.shape[1])] = sign
        product *= np.fft.rfft(x @ counts.T, axis=1)
    return np.fft.irfft(product, size, axis=1)


def term_blocks(df: DataFrame, text: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(block, terms, tf): each text's different terms, as hashes, and their numbers; (block, term, n): the texts of a block that hold a term. Both written once.

    A block is neighbouring texts of some ``most`` terms: what texts share is joined to a block's different terms, not to each text's. Texts without a term have no row.
    Terms are lower-case and named by 64 bits.
    """
    most, spark = most or BLOCK_TERMS, df.sparkSession
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TERM), F.lit(0))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held = 0, 0
        for batch in batches:
            out = []
            for part, hashes in zip(batch["part"], batch["h"], strict=True):
                if len(hashes):
                    terms, tf = np.unique(hashes, return_counts=True)
                    out.append(((part << 32) + block, terms, tf.astype(np.int32)))
                    held += len(terms)
                    if held >= most:
                        block, held = block + 1, 0
            yield pd.DataFrame(out, columns=["block", "terms", "tf"])

    texts, terms = scratch(spark, "text-terms"), scratch(spark, "block-terms")
    hashed = df.select(F.spark_partition_id().cast("long").alias("part"), F.transform(words, lambda w: F.xxhash64(w)).alias("h"))
    hashed.mapInPandas(counted, "block long, terms array<long>, tf array<int>").write.parquet(texts)
    texts = spark.read.schema("block long, terms array<long>, tf array<int>").parquet(texts)
    texts.select("block", F.explode("terms").alias("term")).groupBy("block", "term").agg(F.count("*").alias("n")).write.parquet(terms)
    return texts, spark.read.schema("block long, term long, n long").parquet(terms)


def _unit(texts: pd.DataFrame, terms: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place of the term in ``terms``, weight) of a block's texts, whose vectors have unit length."""
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts["terms"]])
    order = np.argsort(terms["term"].to_numpy())
    at = order[np.searchsorted(terms["term"].to_numpy()[order], np.concatenate(list(texts["terms"])))]
    weight = np.concatenate(list(texts["tf"])) * terms["idf"].to_numpy()[at]
    return row, at, weight / np.sqrt(np.bincount(row, weight * weight))[row]


def _block_sums(texts: pd.DataFrame, terms: pd.DataFrame, size: int) -> np.ndarray:
    """Sums over a block's texts: two count sketches and their tensor product, of ``size`` numbers each, the texts' inner products with the mean vector, those squared, and the texts."""
    row, at, weight = _unit(texts, terms)
    a = np.bincount(row, weight * terms["mean"].to_numpy()[at])
    hashes, total, product = terms["term"].to_numpy(), [], np.zeros(size // 2 + 1, complex)
    both = [(bucket[at], sign[at] * weight) for bucket, sign in (places(hashes, size, i) for i in range(2))]
    total = [np.bincount(bucket, w, size) for bucket, w in both]
    for first in range(0, len(texts), ROWS):
        n = min(ROWS, len(texts) - first)
        mine = slice(*np.searchsorted(row, [first, first + n]))
        waves = [np.fft.rfft(np.bincount((row[mine] - first) * size + bucket[mine], w[mine], n * size).reshape(n, size), axis=1) for bucket, w in both]
        product += (waves[0] * waves[1]).sum(0)
    return np.concatenate([*total, np.fft.irfft(product, size), [a.sum(), (a * a).sum(), len(texts)]])


def text_similarity(df: DataFrame, text: str, confidence: float = 0.95, size: int = SIZE) -> DataFrame:
    """(n_pairs, mean, deviation, low, high) of the cosines of all pairs of texts' TF-IDF vectors, without making pairs.

    With m the mean vector, a pair's cosine is g + b + b' where g is the inner product of the two vectors less m, and b is a text's
    inner product with m less half of |m|^2. As the g of a text sum to 0, the squares' sum is that of b's part, which is exact,
    and that of g, which a tensor sketch of fixed size estimates. So number and mean are exact, and the deviation has the error that
    SIZE names, times g's share of it; copies of one text deviate by 0. Terms are counted within their text, without a shuffle; a text meets what
    terms share by blocks of texts, in two cogroups: the first gives the mean vector, the second the sums. ``low`` and ``high`` are Student's interval of the mean.

    A text that is null or has no term is like nothing, itself too. Fewer than two texts give zeros.
    """
    spark, n = df.sparkSession, df.count()
    schema = "n_pairs long, mean double, deviation double, low double, high double"
    if n < 2:
        return spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0)], schema)
    texts, terms = term_blocks(df, text)
    tasks = max(1, min(TASKS, texts.select("block").distinct().count()))
    idf = terms.groupBy("term").agg((F.log((1 + F.lit(n)) / (1 + F.sum("n"))) + 1).alias("idf"))
    weighed = terms.select("block", "term").join(idf, "term")
    nothing = lambda a, b: not len(a) or not len(b)

    def by_term(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if nothing(left, right):
            return pd.DataFrame({"term": [], "x": []})
        _, at, weight = _unit(left, right)
        return pd.DataFrame({"term": right["term"], "x": np.bincount(at, weight, len(right))})

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sums": [] if nothing(left, right) else [_block_sums(left, right, size).tolist()]})

    dealt = lambda rows: rows.repartition(tasks, "block").groupBy("block")
    means = dealt(texts).cogroup(dealt(weighed)).applyInPandas(by_term, "term long, x double").groupBy("term").agg((F.sum("x") / n).alias("mean"))
    blocks = dealt(texts).cogroup(dealt(weighed.join(means, "term"))).applyInPandas(sums, "sums array<double>")
    values = np.zeros(3 * size + 3)
    for r in blocks.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():  # 3 * size + 3 rows
        values[r.i] = r.x
    first, second, product = values[:-3].reshape(3, size)
    total, total2, whole = values[-3:].tolist()
    centred = product - np.fft.irfft(np.fft.rfft(first) * np.fft.rfft(second), size) / n
    # the texts' own sum is n times the mean's squared length
    square = total / n
    squares = float(centred @ centred) + 2 * n * (total2 - 0.75 * n * square * square) + n * n * square * square / 2
    pairs = n * (n - 1) // 2
    mean = (n * total - whole) / 2 / pairs
    free = max(pairs - 1, 1)
    deviation = max(0.0, ((squares - whole) / 2 - pairs * mean * mean) / free) ** 0.5
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    t = z + (z**3 + z) / 4 / free + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / free**2  # its expansion about the normal quantile
    half = t * deviation / pairs**0.5
    return spark.createDataFrame([(pairs, mean, deviation, mean - half, mean + half)], schema)
