"""Helpers that several training-data operators share: shared tables, word shingles, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes in an Arrow batch of the operators that read whole texts in a worker.
TEXT_BATCH, TEXT_BATCH_BYTES = 1000, 32 << 20
#: Bytes of texts that are worked on at once; a longer text is taken alone.
BLOCK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session may leave it unset and gets a temporary folder; elsewhere other machines could not read that.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-tessera-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut and any executor can read it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the texts that a worker holds at once, for this session: by rows, and by bytes where Spark can."""
    for key, most in (("maxRecordsPerBatch", TEXT_BATCH), ("maxBytesPerBatch", TEXT_BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        if now is not None and not 0 < int(re.sub("[^0-9-].*", "", now)) <= most:
            spark.conf.set(key, str(most))


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores before it as long as a column is called so."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def with_columns_of(schema: T.StructType, *extra: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, *extra])


def hash128(value: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes: together a key that stays unique over 10^12 lines."""
    return F.xxhash64(value), F.xxhash64(F.lit(0x5EED), value)


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit; another one for each seed."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Returns what a task has freed to the system: a worker lives on and other stages need the room."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


#: White space of ASCII, and per byte its lower case.
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
#: Longer strings are hashed one by one.
_LONG = 256


def text_blocks(column, size: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds of each text in them) of an Arrow column of strings or binaries;
    nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.binary()), b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + (size or BLOCK_BYTES), "right")) - 1)
        yield a, b, raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        a = b


def string_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each string raw[start:end]."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    size = end - start
    out = size.astype(np.uint64) * _ODD[2]
    for i in (size > _LONG).nonzero()[0].tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]].tobytes())
    left, at = ((size > 0) & (size <= _LONG)).nonzero()[0], 0
    while len(left):
        piece = lanes[start[left] + at] & _KEEP[np.minimum(size[left] - at, 8)]
        out[left] = mix64(out[left] ^ piece * _ODD[0], 3)
        at += 8
        left = left[size[left] > at]
    return out


def words_of(raw: np.ndarray, bounds: np.ndarray, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the words in each text: runs of bytes that ``spaces`` does not name; text i has the
    words first[i]..first[i + 1] - 1."""
    blank = spaces[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[bounds] = True
    before, after = np.append(True, blank), np.append(blank, True)
    start = (~after[:-1] & (before[:-1] | cut[:-1])).nonzero()[0]
    end = (~before[1:] & (after[1:] | cut[1:])).nonzero()[0] + 1
    return start, end, np.searchsorted(start, bounds)


def lower_words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words between ASCII white space, A-Z in lower case, and each text's first one, as ``words_of``."""
    low = LOWER[raw]
    start, end, first = words_of(low, bounds)
    return string_hashes(low, start, end), first


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    words = list(words)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return string_hashes(np.frombuffer(b"".join(words), np.uint8), np.append(0, ends)[:-1], ends)


def ascii_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; none of a null text."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, in order; of all words together where there are fewer; none without words."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    out = words[: n - k + 1] * _ODD[0]
    for i in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * _ODD[1] + words[i : n - k + 1 + i] * _ODD[i % 5]
    return mix64(out, k)


def group_shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of each group of words, sorted; each group's bounds in them); see ``shingle_hashes``."""
    n = np.diff(first)
    of = np.repeat(np.arange(len(n)), n)
    keep = np.arange(len(words)) + k <= first[1:][of]
    found, group = [], []
    if keep.any():
        found, group = [shingle_hashes(words, k)[keep[: len(words) - k + 1]]], [of[keep]]
    for short in range(1, k):
        at = (n == short).nonzero()[0]
        if len(at):
            found.append(shingle_hashes(words, short)[first[at]])
            group.append(at)
    tokens, of = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((found, np.uint64), (group, np.int64)))
    order = np.lexsort((tokens, of))
    tokens, of = tokens[order], of[order]
    new = np.append(True, (tokens[1:] != tokens[:-1]) | (of[1:] != of[:-1]))[: len(tokens)]
    return tokens[new], np.append(0, np.cumsum(np.bincount(of[new], minlength=len(n))))


def set_names(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each non-empty set of tokens; 0 of an empty one."""
    total = np.append(np.uint64(0), np.cumsum(mix64(tokens, 77)))
    size = np.diff(bounds)
    return np.where(size > 0, mix64(total[bounds[1:]] - total[bounds[:-1]] + size.astype(np.uint64), 78), np.uint64(0)).view(np.int64)


def set_keys(tokens: np.ndarray, bounds: np.ndarray):
    """A name of 128 bits, as 16 bytes, of each set of tokens; null of an empty one. An Arrow array."""
    import pyarrow as pa
    import pyarrow.compute as pc

    size = np.diff(bounds)
    halves = np.empty((len(size), 2), np.uint64)
    for i in (0, 1):
        total = np.append(np.uint64(0), np.cumsum(mix64(tokens, 81 + i)))
        halves[:, i] = mix64(total[bounds[1:]] - total[bounds[:-1]] + size.astype(np.uint64), 83 + i)
    names = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(size), [None, pa.py_buffer(halves)]).cast(pa.binary())
    return pc.if_else(pa.array(size > 0), names, pa.scalar(None, pa.binary()))


def ragged(values: np.ndarray, bounds: np.ndarray, kind, null: np.ndarray | None = None):
    """An Arrow array of lists; null where the flags say so."""
    import pyarrow as pa

    bounds = pa.array(bounds.astype(np.int32), pa.int32(), mask=None if null is None else np.append(null, False))
    return pa.ListArray.from_arrays(bounds, pa.array(values, kind))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``edges``: (node, root), one row per node that has an edge.

    Contraction: each node joins the neighbour (or itself) whose hashed id is smallest, the edges are
    rewritten to these, and so on until no edge is left; the hash makes each round drop a constant
    share of the nodes whatever the shape. The minimum is aggregated before the shuffle, so a hub costs
    one row per task. ``root`` is some node of the component. Self-loops give a component of their own;
    edges with a null end are left out.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    steps: list[DataFrame] = []
    edges = written(edges, "edges")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v"))
        to = written(nearest.select(F.col("a").alias("node"), F.least(own, "m")["v"].alias("root")), "parents")
        steps.append(to)
        left = to.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = written(
            edges.where("a <> b").join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
        if edges.isEmpty():
            break
    else:
        raise RuntimeError(f"components: edges are left after {rounds} rounds")
    found = steps[0]
    for step in steps[1:]:
        up = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
        found = found.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return written(found, "components") if len(steps) > 1 else found


def _reading(df: DataFrame, text_col: str, keep: list[str], fields: list[T.StructField]):
    """The rows to read, the text's place in them, and the result's schema."""
    small_batches(df.sparkSession)
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    if text_col in keep:
        return df.select(*keep), keep.index(text_col), schema
    return df.select(*keep, F.col(text_col).alias(free_names(keep, "text")[0])), len(keep), schema


def map_texts(df: DataFrame, text_col: str, keep: list[str], fields: list[T.StructField], make) -> DataFrame:
    """The ``keep`` columns and ``fields`` that ``make()`` computes from the texts, batch by batch through Arrow.

    ``make`` runs once per task and returns a function from a list of texts (None for null) to one list
    or numpy array per field.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    rows, at, schema = _reading(df, text_col, keep, fields)
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in schema.fields]

    def run(batches):
        work = make()
        for batch in batches:
            found = work(batch.column(at).to_pylist())
            made = [pa.array(x, kind, from_pandas=False) for x, kind in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=names)
        give_back()

    return rows.mapInArrow(run, schema)


def map_blocks(df: DataFrame, text_col: str, keep: list[str], fields: list[T.StructField], make, prepare=None) -> DataFrame:
    """Like ``map_texts``, over arrays of bytes: ``make()`` gives a function from (bytes, bounds) of some texts to
    (rows, columns): Arrow or numpy arrays of equal length and the text that each of their entries belongs to;
    None where there is one entry per text. ``prepare`` changes the Arrow column of texts before."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    rows, at, schema = _reading(df, text_col, keep, fields)
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in schema.fields]

    def run(batches):
        work = make()
        for batch in batches:
            for a, b, raw, bounds in text_blocks(prepare(batch.column(at)) if prepare else batch.column(at)):
                of, found = work(raw, bounds)
                kept = [c.slice(a, b - a) for c in batch.columns[: len(keep)]]
                kept = kept if of is None else [c.take(pa.array(of)) for c in kept]
                made = [x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=names)
        give_back()

    return rows.mapInArrow(run, schema)
