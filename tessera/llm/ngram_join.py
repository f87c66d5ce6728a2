"""Exact Jaccard self-join over word shingles by prefix filters under several global token orders.

Two sets of similarity t share a token among the first |s| - ceil(t |s|) + 1 of each, under every order of
all tokens. Each order here puts frequent tokens last, by a count sketch over all documents, and shuffles
tokens of one frequency class by a hash of its own. Pairs come from the first order's posting lists; the
tokens that two prefixes share bound what the whole sets can share, and a pair must pass that bound under
each order before its sets are compared.

A token that many sets carry in their prefix (a group of near copies) does not give all pairs: its sets are
first compared with the one in which the token comes earliest, components are formed, and only pairs of
different components that their positions still allow are compared after that. No link is lost.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import ascii_words, components, free_names, give_back, group_shingles, lower_words, map_blocks, mix64, ragged, set_keys, shingle_hashes, small_batches, text_blocks, word_hashes, written

#: Counters of the frequency sketch and of one of its blocks: a fixed size, whatever the input.
COUNTERS, BLOCK = 1 << 22, 1 << 16
#: Sketches that one task adds up, and how often: the driver adds one per block and 64^3 tasks.
FAN_IN, LEVELS = 64, 3
ORDERS = 3
#: Longest posting list whose pairs are all compared at once.
SHORT_LIST = 32
#: Sets of a long list that are compared in one go with as many others.
LIST_BLOCK = 512


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles; of all its words where there are fewer."""
    return np.unique(shingle_hashes(word_hashes(ascii_words(text)), k))


def frequency_classes(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """A class per counter: 0 for what stands out of the mean by less than six deviations, then by powers of two."""
    small_batches(docs.sparkSession)

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for _, _, raw, bounds in text_blocks(batch.column(0)):
                np.add.at(total, group_shingles(*lower_words(raw, bounds), k)[0] >> np.uint64(64 - 22), np.uint32(1))
        task = TaskContext.get().partitionId()
        for at in range(0, COUNTERS, BLOCK):
            part = total[at : at + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_pylist([{"block": at // BLOCK, "task": task, "counts": zlib.compress(part.astype("<i8").tobytes(), 1)}], schema=schema)
        give_back()

    import pyarrow as pa

    schema = pa.schema([("block", pa.int32()), ("task", pa.int32()), ("counts", pa.binary())])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.int64)
        for counts in group["counts"]:
            total += np.frombuffer(zlib.decompress(counts), "<i8")
        return pd.DataFrame({"block": group["block"].iloc[:1], "task": group["task"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    kind = "block int, task int, counts binary"
    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, kind)
    for level in range(1, LEVELS + 1):
        parts = parts.groupBy("block", (F.col("task") / FAN_IN**level).cast("int")).applyInPandas(add, kind)
    total = np.zeros(COUNTERS, np.int64)
    for row in parts.toLocalIterator():  # COUNTERS / BLOCK rows for each FAN_IN^LEVELS tasks
        total[row.block * BLOCK : (row.block + 1) * BLOCK] += np.frombuffer(zlib.decompress(row.counts), "<i8")
    mean = max(total.mean(), 1.0)
    over = (total - mean) / (6 * np.sqrt(mean))
    return np.where(over < 1, 0, np.floor(np.log2(np.maximum(over, 1))) + 1).astype(np.uint8)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def order_keys(tokens: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """The tokens' ranks under an order: the frequency class, then a hash."""
    return (classes[tokens >> np.uint64(64 - 22)].astype(np.uint64) << np.uint64(56)) | (mix64(tokens, order) >> np.uint64(8))


def prefix(tokens: np.ndarray, classes: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first tokens under an order, in that order."""
    keys = order_keys(tokens, classes, order)
    p = prefix_size(len(tokens), percent)
    first = np.argpartition(keys, p - 1)[:p] if p < len(keys) else np.arange(len(keys))
    return tokens[first[np.argsort(keys[first])]]


def _bound(a: str, b: str, shared: Column, percent: int) -> Column:
    """Whether two sets whose prefixes share ``shared`` tokens can reach the similarity."""
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    rest = lambda n: F.floor((n * percent + 99) / 100) - 1  # noqa: E731  what a prefix leaves out
    most = F.least(shared + F.greatest(rest(n_a), rest(n_b)), n_a, n_b)
    return most * (100 + percent) >= (n_a + n_b) * percent


class Join:
    """One self-join: its tables and steps. ``found`` has a row per document, ``links`` the pairs of distinct sets, each named by 128 bits."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> None:
        self.spark, self.k, self.percent = docs.sparkSession, k, percent
        self.docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
        self.classes = self.spark.sparkContext.broadcast(frequency_classes(self.docs, "text", k))
        self.sets = written(self._sets(), "sets")
        first = self._first_pairs(shared := written(self._shared(), "postings"))
        links = written(self._verified(first), "links")
        groups = components(links)
        late = self._verified(self._late_pairs(shared, groups))
        self.links = written(links.unionByName(late), "links")

    def _sets(self) -> DataFrame:
        """(id, key, n, set, prefix) of every document; ``key`` is its text's hash; the prefix once per set and task."""
        k, percent, shared = self.k, self.percent, self.classes
        fields = [T.StructField("n", T.LongType()), T.StructField("set", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))]

        def make():
            import pyarrow as pa

            seen: set[bytes] = set()

            def work(raw, bounds):
                tokens, of = group_shingles(*lower_words(raw, bounds), k)
                names = set_keys(tokens, of)
                found, size, again = [], [0], []
                for name, a, b in zip(names.to_pylist(), of[:-1].tolist(), of[1:].tolist(), strict=True):
                    again.append(name is None or name in seen)
                    if not again[-1]:
                        seen.add(name)
                        found.append(prefix(tokens[a:b], shared.value, 0, percent).view(np.int64))
                    size.append(0 if again[-1] else len(found[-1]))
                prefixes = ragged(np.concatenate(found) if found else np.zeros(0, np.int64), np.cumsum(size), pa.int64(), np.array(again))
                return None, [np.diff(of), names, prefixes]

            return work

        return map_blocks(self.docs, "text", ["id", "key"], fields, make)

    def _shared(self) -> DataFrame:
        """Postings (token, set, n, pos) of tokens in the prefix of several sets, with the list's length and pivot."""
        postings = self.sets.where("prefix is not null").select("set", "n", F.posexplode("prefix").alias("pos", "token"))
        lists = (
            postings.groupBy("token").agg(F.min(F.xxhash64("set")).alias("low"), F.max(F.xxhash64("set")).alias("high"), F.count("*").alias("length"))
            .where("low <> high").select("token", "length")
        )
        return postings.join(lists, "token").select("token", "set", "n", "pos", (F.col("length") > SHORT_LIST).alias("long")).distinct()

    def _near(self) -> Column:
        return (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent)

    def _reachable(self) -> Column:
        """Whether sets whose first common token stands at pos_a and pos_b can reach the similarity."""
        most = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
        return most * (100 + self.percent) >= (F.col("n_a") + F.col("n_b")) * self.percent

    @staticmethod
    def _side(postings: DataFrame, side: str, *more: str) -> DataFrame:
        return postings.select("token", F.col("set").alias(side), F.col("n").alias(f"n_{side}"), F.col("pos").alias(f"pos_{side}"), *more)

    def _first_pairs(self, shared: DataFrame) -> DataFrame:
        """All pairs of short lists within the first order's bound; of long lists those with the pivot."""
        short, long = shared.where("not long"), shared.where("long")
        counted = (
            self._side(short, "a").join(self._side(short, "b"), "token").where((F.col("a") < F.col("b")) & self._near())
            .groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared"))
        )
        in_long = written(long.groupBy("set").agg(F.count("*").alias("more")), "long-postings")
        counted = counted.join(in_long.select(F.col("set").alias("a"), F.col("more").alias("more_a")), "a", "left")
        counted = counted.join(in_long.select(F.col("set").alias("b"), F.col("more").alias("more_b")), "b", "left")
        both_long = F.when(F.col("more_a").isNotNull() & F.col("more_b").isNotNull(), F.least("more_a", "more_b")).otherwise(0)
        counted = counted.where(_bound("a", "b", F.col("shared") + both_long, self.percent)).select("a", "b", "n_a", "n_b")
        pivots = long.groupBy("token").agg(F.min(F.struct("pos", "set", "n")).alias("p"))
        pivots = written(pivots.select("token", F.col("p.set").alias("a"), F.col("p.n").alias("n_a"), F.col("p.pos").alias("pos_a")), "pivots")
        stars = pivots.join(self._side(long, "b"), "token").where((F.col("a") != F.col("b")) & self._near() & self._reachable()).select("a", "b", "n_a", "n_b")
        return self._ordered(counted.unionByName(stars))

    def _late_pairs(self, shared: DataFrame, groups: DataFrame) -> DataFrame:
        """Pairs of long lists in different components that their positions allow."""
        groups = groups.select(F.col("node").alias("set"), "root")
        long = shared.where("long").join(groups, "set", "left").select("token", "set", "n", "pos", F.coalesce("root", "set").alias("group"))
        name = F.xxhash64("group")
        mixed = long.groupBy("token").agg(F.min(name).alias("low"), F.max(name).alias("high"), F.count("*").alias("k")).where("low <> high")
        long = long.join(mixed.select("token", F.ceil(F.col("k") / LIST_BLOCK).cast("int").alias("blocks")), "token")
        long = written(long.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")), "long-lists")
        # Every block of a list meets every other one, and itself, in a group of its own.
        a = self._side(long, "a", F.col("group").alias("group_a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        b = self._side(long, "b", F.col("group").alias("group_b"), "block")
        pairs = a.join(b, ["token", "block"]).where((F.col("a") < F.col("b")) & (F.col("group_a") != F.col("group_b")) & self._near() & self._reachable())
        return pairs.select("a", "b", "n_a", "n_b").distinct()

    @staticmethod
    def _ordered(pairs: DataFrame) -> DataFrame:
        turned = F.col("a") > F.col("b")
        return pairs.select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
            F.when(turned, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(turned, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
        ).distinct()

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that pass every other order's bound, then the comparison of the whole sets."""
        pairs = written(pairs, "candidates")
        k, percent, shared = self.k, self.percent, self.classes
        wanted = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
        ids = self.sets.where("prefix is not null and id is not null").join(wanted, "set", "left_semi").groupBy("set").agg(F.min("id").alias("id"))
        nameless = self.sets.where("id is null").select("set").distinct()
        texts = self.docs.join(ids, "id").select("set", "text").unionByName(
            self._nameless(wanted.join(nameless, "set", "left_semi").join(ids.select("set"), "set", "left_anti"))
        )
        orders = [T.StructField(f"order{i}", T.ArrayType(T.IntegerType())) for i in range(1, ORDERS)]

        def make():
            import pyarrow as pa

            def work(raw, bounds):
                tokens, of = group_shingles(*lower_words(raw, bounds), k)
                each = np.split(tokens, of[1:-1])
                found = []
                for i in range(1, ORDERS):
                    parts = [(prefix(t, shared.value, i, percent) >> np.uint64(32)).astype(np.uint32).view(np.int32) if len(t) else np.zeros(0, np.int32) for t in each]
                    found.append(ragged(np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts])), pa.int32()))
                whole = pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer((of * 8).astype(np.int32)), pa.py_buffer(tokens)])
                return None, [set_keys(tokens, of), whole, *found]

            return work

        fields = [T.StructField("set", T.BinaryType()), T.StructField("tokens", T.BinaryType()), *orders]
        found = map_blocks(texts.withColumn("wanted", F.col("set")), "text", ["wanted"], fields, make)
        found = written(found.where("set = wanted").drop("wanted").dropDuplicates(["set"]), "candidate-sets")
        names = [f.name for f in orders]
        light = pairs
        for side in "ab":
            light = light.join(found.select(F.col("set").alias(side), *[F.col(o).alias(f"{o}_{side}") for o in names]), side)
        for o in names:
            light = light.where(_bound("a", "b", F.size(F.array_intersect(f"{o}_a", f"{o}_b")) + self._repeats(o), percent))
        left = written(light.select("a", "b"), "filtered")
        for side in "ab":
            left = left.join(found.select(F.col("set").alias(side), F.col("tokens").alias(f"tokens_{side}")), side)

        def compare(batches):
            import pyarrow as pa

            for batch in batches:
                rows = zip(*(batch.column(c).to_pylist() for c in ("tokens_a", "tokens_b")), strict=True)
                keep = []
                for x, y in rows:
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return left.select("a", "b", "tokens_a", "tokens_b").mapInArrow(compare, "a binary, b binary")

    @staticmethod
    def _repeats(order: str) -> Column:
        """What array_intersect leaves out where 32-bit tokens of a prefix coincide."""
        return F.greatest(*(F.size(f"{order}_{s}") - F.size(F.array_distinct(f"{order}_{s}")) for s in "ab"))

    def _nameless(self, sets: DataFrame) -> DataFrame:
        """Texts of sets that only documents without id have."""
        k = self.k

        def make():
            return lambda raw, bounds: (None, [set_keys(*group_shingles(*lower_words(raw, bounds), k))])

        found = map_blocks(self.docs.where("id is null"), "text", ["text"], [T.StructField("set", T.BinaryType())], make)
        return found.join(sets, "set", "left_semi").select("set", "text")

    def _placed(self) -> DataFrame:
        """(id, key, n, root) of every document; ``root`` names its component and is null for an empty set."""
        roots = components(self.links).withColumnRenamed("node", "set")
        return self.sets.select("id", "key", "n", "set").join(roots, "set", "left").select("id", "key", "n", F.coalesce("root", "set").alias("root"))

    def groups(self) -> DataFrame:
        """(id, n, component): the smallest id that links reach, over documents of equal sets too."""
        placed = self._placed()
        smallest = written(placed.where("root is not null").groupBy("root").agg(F.min("id").alias("component")), "group-ids")
        return placed.join(smallest, "root", "left").select("id", "n", F.coalesce("component", "id").alias("component"))

    def decisions(self) -> DataFrame:
        """(id, key, leaves) of the rows in components of several: the one of smallest id, then smallest text hash, does
        not leave; a null id comes after all others."""
        placed = self._placed().where("root is not null").select("root", "id", "key")
        place = F.struct(F.col("id").isNull().alias("nameless"), "id", "key")
        firsts = written(placed.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("rows")).where("rows > 1").select("root", "first"), "group-firsts")
        leaves = ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key")))
        judged = placed.join(firsts, "root").groupBy("id", "key").agg(F.bool_or(leaves).alias("leaves"), F.count("*").alias("rows"))
        return written(judged.where("leaves or rows > 1").select("id", "key", "leaves"), "group-decisions")


def similarity_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) of every row: documents linked where the Jaccard similarity of their
    k-word shingle sets reaches ``percent`` / 100, and the smallest id of each one's component.

    Words end at ASCII white space; A-Z count as a-z. A text with fewer words is one shingle; null, empty and
    blank texts have none and are linked with nothing. Repeated rows fall into one component; a null id is
    passed over as the smallest one. Other columns are not read.
    """
    return Join(docs, id_col, text_col, k, percent).groups().select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one of each component of ``similarity_groups``: that of the smallest id.

    Of several texts with that id the one of smallest hash stays, of repeated rows any one; a null id comes after all
    others. Null, empty and blank texts are in no group and stay, however often. All columns pass.
    """
    decided = Join(docs, id_col, text_col, k, percent).decisions()
    own, key, leaves = free_names(docs.columns, *decided.columns)
    decided = decided.toDF(own, key, leaves)
    same = F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(text_col) == F.col(key))
    # Only first rows that are repeated are put together again.
    repeated = docs.join(decided.where(~F.col(leaves)), same, "left_semi").dropDuplicates([id_col, text_col])
    return docs.join(decided, same, "left_anti").unionByName(repeated)
