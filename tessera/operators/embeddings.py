"""Word vectors learnt in parts: neither the words nor their vectors pass the driver, are broadcast or meet in one task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Centre words whose windows meet in one product, with the same drawn words; products whose steps are made at once.
TILE, TILES, DRAWN = 64, 8, 32
#: Drawn words that count against each pair, the power of their frequencies, and the step's size at a part's start and end.
NEGATIVES, POWER, RATE, LEAST_RATE = 5, 0.75, 0.025, 0.0001
#: A word's step at once is that of so many pairs at most, and so long: steps of a frequent word that are not made one after another overshoot.
PAIRS, STEP = 8, 0.5
#: Words whose vectors are summed up at a time, and tasks of a shuffle.
SLICE, TASKS = 16_384, 2000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def first_vectors(words: np.ndarray, dims: int, seed: int, width: float) -> np.ndarray:
    """Numbers of half the width at most, at random by the words' hashes: what words start with, the same in every part."""
    at = np.uint64(seed % (1 << 32)) * np.uint64(1_000_003) + np.arange(dims, dtype=np.uint64)
    x = _mixed(words.view(np.uint64)[:, None] ^ _mixed(at * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
    return (((x >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) / np.float32(1 << 24) - np.float32(0.5)) * np.float32(width)


def _step(table: np.ndarray, ids: np.ndarray, steps: np.ndarray, pairs: np.ndarray) -> None:
    """Adds each row's steps to it; those of more than PAIRS pairs as of so many, and STEP at most."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    total = np.add.reduceat(steps[order], first, axis=0)
    n = np.add.reduceat(pairs[order], first)
    total *= np.minimum(1, PAIRS / np.maximum(n, 1)).astype(np.float32)[:, None]
    table[ids[first]] += total * (STEP / np.maximum(np.sqrt(np.einsum("ij,ij->i", total, total)), STEP)).astype(np.float32)[:, None]


def _likely(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def skip_grams(tokens: np.ndarray, title: np.ndarray, vectors: np.ndarray, outward: np.ndarray, window: int, rng: np.random.Generator) -> np.ndarray:
    """The vectors after one pass over a part: ``tokens`` (rows of ``vectors``) in order, ``title`` their title's number. Each word predicts those
    at most ``window`` places off in its title, drawn nearer for each centre, against NEGATIVES drawn words. Both tables of vectors are changed."""
    tiles = -(-len(tokens) // TILE)
    behind = tiles * TILE - len(tokens) + window
    tokens, title = np.pad(tokens, (window, behind)), np.pad(title, (window, behind), constant_values=-1)
    often = np.bincount(tokens[window : len(tokens) - behind], minlength=len(vectors)) ** POWER
    drawn = np.minimum(np.searchsorted(np.cumsum(often) / often.sum(), rng.random((tiles, DRAWN))), len(vectors) - 1)
    reach = rng.integers(1, window + 1, (tiles, TILE))
    gap = np.abs(np.arange(TILE + 2 * window)[None, :] - window - np.arange(TILE)[:, None])
    gap[gap == 0] = window + 1
    for a in range(0, tiles, TILES):
        rate = np.float32(max(LEAST_RATE, RATE * (1 - a / tiles)))
        at = np.arange(a, min(tiles, a + TILES))[:, None] * TILE
        centre, around, other = at + window + np.arange(TILE), at + np.arange(TILE + 2 * window), drawn[a : a + TILES]
        met = (gap <= reach[a : a + TILES, :, None]) & (title[centre][:, :, None] == title[around][:, None, :]) & (title[centre] >= 0)[:, :, None]
        x, y, z = vectors[tokens[around]], outward[tokens[centre]], outward[other]
        near = np.where(met, rate * (1 - _likely(y @ x.transpose(0, 2, 1))), np.float32(0))
        pairs = met.sum(1)
        far = -rate * np.float32(NEGATIVES / DRAWN) * pairs[:, :, None].astype(np.float32) * _likely(x @ z.transpose(0, 2, 1))
        flat = lambda s: s.reshape(-1, s.shape[-1])
        _step(vectors, tokens[around].ravel(), flat(near.transpose(0, 2, 1) @ y + far @ z), pairs.ravel())
        against = np.broadcast_to(pairs.sum(1, keepdims=True) * NEGATIVES // DRAWN, other.shape)
        _step(outward, np.concatenate([tokens[centre].ravel(), other.ravel()]), np.concatenate([flat(near @ x), flat(far.transpose(0, 2, 1) @ x)]), np.concatenate([met.sum(2).ravel(), against.ravel()]))
    return vectors


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists in one array, and how many each row has."""
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _packed(vectors: np.ndarray) -> pa.Array:
    """A row's numbers as bytes."""
    size = vectors.shape[1] * 4
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(vectors), [None, pa.py_buffer(np.ascontiguousarray(vectors, np.float32))]).cast(pa.binary())


def _unpacked(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(c.cast(pa.binary(dims * 4)).buffers()[1], np.float32, len(c) * dims, c.offset * dims * 4).reshape(-1, dims) for c in column.chunks] or [np.zeros((0, dims), np.float32)])


@dataclass(frozen=True)
class Word2Vec:
    """Skip-grams with drawn words (``NEGATIVES``), in one pass over ``numPartitions`` parts.

    ``inputCol`` has a title's words as 64-bit hashes. Rows go to parts by their hash; a part's task learns the vectors of its own words, which
    start from the same vectors everywhere; a word's vector is the mean over its parts, weighted by its occurrences, and goes back to the parts that have the word.
    So a task holds a part's words or a share of all words, whatever the size of the table. The same rows give the same vectors.
    """

    vectorSize: int = 100
    windowSize: int = 5
    seed: int = 1
    numPartitions: int = 1
    inputCol: str = "words"
    outputCol: str = "vector"

    def _placed(self, df: DataFrame) -> DataFrame:
        """With ``_at``, a hash of the row, and ``_part``."""
        named = [c for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]
        return df.withColumn("_at", F.xxhash64(*named)).withColumn("_part", F.pmod("_at", F.lit(self.numPartitions)).cast("int"))

    def _tasks(self) -> int:
        return min(TASKS, 3 * self.numPartitions)

    def word_vectors(self, df: DataFrame) -> DataFrame:
        """(part, word, n, vector as bytes): the mean vector of each word, for each part that has it."""
        dims, window, seed = self.vectorSize, self.windowSize, self.seed

        def learnt(key, rows):
            words, sizes = _lists(rows.column("_words"))
            order = np.argsort(rows.column("_at").to_numpy(), kind="stable")  # equal hashes are equal rows
            begin = np.cumsum(sizes) - sizes
            sizes = sizes[order]
            title = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(words)) + np.repeat(begin[order] - (np.cumsum(sizes) - sizes), sizes)
            known, tokens, n = np.unique(words[at], return_inverse=True, return_counts=True)
            part = key[0].as_py()
            found, outward = first_vectors(known, dims, 2 * seed, 1 / dims), first_vectors(known, dims, 2 * seed + 1, 2 * (3 / dims) ** 0.5)
            if len(words):
                found = skip_grams(tokens.ravel(), title, found, outward, window, np.random.default_rng([seed % (1 << 32), part]))
            return pa.table({"part": pa.array(np.full(len(known), part, np.int32)), "word": pa.array(known), "n": pa.array(n.astype(np.int64)), "vector": _packed(found)})

        def mean(_, rows):
            rows = rows.sort_by([("word", "ascending"), ("part", "ascending")])
            word, n = rows.column("word").to_numpy(), rows.column("n").to_numpy()
            vector = _unpacked(rows.column("vector"), dims) * n[:, None].astype(np.float32)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(word))))
            total = np.add.reduceat(vector, first, axis=0) / np.add.reduceat(n, first)[:, None].astype(np.float32)
            return pa.table({"part": rows.column("part"), "word": rows.column("word"), "n": rows.column("n"), "vector": _packed(total[of])})

        schema = "part int, word long, n long, vector binary"
        rows = self._placed(df).select("_part", "_at", F.col(self.inputCol).alias("_words"))
        parts = rows.repartition(self._tasks(), "_part").groupBy("_part").applyInArrow(learnt, schema)
        shares = parts.withColumn("_share", F.pmod("word", F.lit(self.numPartitions)))
        return shares.repartition(self._tasks(), "_share").groupBy("_share").applyInArrow(mean, schema)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the mean vector of each row's words; of none, zeros."""
        dims, names = self.vectorSize, df.columns

        def judged(_, rows, known):
            known = known.sort_by("word")
            word, vector = known.column("word").to_numpy(), _unpacked(known.column("vector"), dims)
            tokens, sizes = _lists(rows.column(self.inputCol))
            at, of = np.searchsorted(word, tokens), np.repeat(np.arange(len(sizes)), sizes)
            out = np.zeros((len(sizes), dims))
            for a in range(0, len(at), SLICE):
                own = of[a : a + SLICE]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                out[own[first]] += np.add.reduceat(vector[at[a : a + SLICE]], first, axis=0, dtype=np.float64)
            out /= np.maximum(sizes, 1)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * np.int32(dims)), pa.array(out.ravel()))
            return pa.table({**{c: rows.column(c) for c in names}, self.outputCol: lists})

        placed = self._placed(df).drop("_at").repartition(self._tasks(), "_part")
        known = self.word_vectors(df).select("part", "word", "vector").repartition(self._tasks(), "part")
        schema = df.withColumn(self.outputCol, F.lit(None).cast("array<double>")).schema
        return placed.groupBy("_part").cogroup(known.groupBy("part")).applyInArrow(judged, schema)
