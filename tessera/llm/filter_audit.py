"""Audit of how filters interact: what each of five filters removes in every order of them, kept up to date by a stream.

All files of a folder come in as micro-batches. A document's failures are a mask of five bits; those of its own text are
known at once, but whether it repeats a smaller id's text hangs on documents that may come later. State keyed by text (a
state key holds the texts of one hash place, some hundreds) has the smallest id so far; when a smaller one arrives, the masks counted for the earlier one are taken back from the counters of
its part and counted again as failing. The counters of a batch are one small table; their sum gives every order's report.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from itertools import permutations
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import map_texts, scratch

#: The filters, by bit: short text, few different words, capitals, symbols, repeated text.
FILTERS = "ABCDE"
REPEATED = 1 << 4
#: Least words; least share of different words and most of capitals, in hundredths.
MIN_WORDS, MIN_DIFFERENT, MAX_CAPITALS = 200, 50, 2
SYMBOLS = b"#$%&*|"
#: Micro-batches that the files are dealt to.
BATCHES = 4
#: Texts that lie at one place of the state, on average; places that remember nothing and only pass counts on.
TEXTS, SPREAD = 256, 256
#: What a session is set to while a stream with state starts.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store holds megabytes of disk before it has a row
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
}
_CAPITALS = bytes(range(65, 91))


def text_mask(text: str | None) -> tuple[bytes, int]:
    """(128-bit key of the text, mask of the filters A to D that it fails); a null text is empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes are split at ASCII white space alone
    mask = int(len(words) < MIN_WORDS)
    mask |= (100 * len(set(words)) < MIN_DIFFERENT * len(words)) << 1
    mask |= (100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > MAX_CAPITALS * len(text or "")) << 2
    mask |= (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3
    return blake2b(raw, digest_size=16).digest(), mask


def _masks():
    def work(texts):
        found = [text_mask(t) for t in texts]
        return [[f[0] for f in found], [f[1] for f in found]]

    return work


def _condensed(batches):
    """In each batch of rows: those of a text's smallest id, for the state of their text; the others repeat a smaller id for
    certain and only pass through, as counts. So a text of very many copies gives its state one row a batch."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        missing = batch.column(batch.schema.get_field_index("id")).is_null()
        rows = batch.filter(pc.invert(missing)).to_pandas()  # without nulls, ids stay whole numbers
        nameless = batch.filter(missing).to_pandas()
        repeats = rows["id"] > rows.groupby("key")["id"].transform("min")
        rows.loc[repeats, "mask"] |= REPEATED
        own = rows[~repeats].groupby(["place", "key", "id", *_COUNTER[:-1]], as_index=False).size()
        rest = pd.concat([rows[repeats][_COUNTER[:-1]], nameless[_COUNTER[:-1]]]).groupby(_COUNTER[:-1], as_index=False).size()
        rest_place = [-1 - (crc32(p.encode()) + m) % SPREAD for p, m in zip(rest["part"], rest["mask"], strict=True)]
        kinds = {"part": pa.string(), "mask": pa.int32(), "good": pa.bool_(), "toxic": pa.bool_(), "size": pa.int64()}
        kind = batch.schema.field("id").type
        for some, place, key, ids in (
            (own, own["place"], own["key"], pa.array(own["id"], kind)), (rest, rest_place, [b""] * len(rest), pa.array([0] * len(rest), pa.int32()).cast(kind)),
        ):
            made = [pa.array(some[k], x) for k, x in kinds.items()]
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(key, pa.binary()), ids, *made], names=["place", "key", "id", *_COUNTER])


_COUNTER = ["part", "mask", "good", "toxic", "n"]


def corrected(known: tuple | None, rows: Iterable[tuple]) -> tuple[tuple, list[tuple]]:
    """A text's new state and the counts to add, from its state (smallest id, its counters) and new rows
    (id, part, mask, good, toxic, n). Whatever order the rows come in, the counts add up to the same sum: those of the
    smallest id without ``REPEATED``, all others with it."""
    rows = list(rows)
    least = min([r[0] for r in rows] + ([known[0]] if known else []))
    counts = [(*r[1:2], r[2] | (REPEATED if r[0] > least else 0), *r[3:]) for r in rows]
    held = [list(r[1:]) for r in rows if r[0] == least]
    if known and known[0] > least:
        for part, mask, good, toxic, n in known[1]:
            counts += [(part, mask, good, toxic, -n), (part, mask | REPEATED, good, toxic, n)]
    elif known:
        held = known[1] + held
    total: dict[tuple, int] = {}
    for *key, n in held:  # rows of one id and text, by part and labels
        total[tuple(key)] = total.get(tuple(key), 0) + n
    return (least, [[*key, n] for key, n in total.items()]), counts


def _step(place: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Takes the rows of the texts that lie at one place of the state."""
    if place[0] < 0:  # nothing to remember
        for rows in parts:
            yield rows[_COUNTER]
        return
    known = pickle.loads(state.get[0]) if state.exists else {}
    rows: dict[bytes, list[tuple]] = {}
    for part in parts:
        for key, *row in zip(*(part[c].tolist() for c in ("key", "id", *_COUNTER)), strict=True):
            rows.setdefault(bytes(key), []).append(tuple(row))
    total: Counter = Counter()
    for key, new in rows.items():
        known[key], counts = corrected(known.get(key), new)
        for *counter, n in counts:
            total[tuple(counter)] += n
    state.update((pickle.dumps(known),))
    yield pd.DataFrame([(*k, n) for k, n in total.items() if n], columns=_COUNTER)


def counters(
    spark: SparkSession, folder: str, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", quality_col: str = "quality", toxic_col: str = "toxic",
    batches: int = BATCHES,
) -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters they fail and their labels, over all files of a folder of Parquet.

    Each run reads the folder anew, in ``batches`` micro-batches or fewer. A batch that runs again, after a failure, replaces
    what it wrote. Of labels that come twice for an id, 1 wins. Null texts are empty, null parts the empty string; a null id
    neither repeats nor is repeated; rows of equal id and text repeat one another not.
    """
    rows = spark.read.parquet(folder)
    files = rows.inputFiles()
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, math.ceil(len(files) / batches)))
    # A stream takes a folder, or a pattern of names; one that only a file's own name fits stands for that file.
    alone = len(files) == 1 and files[0].rstrip("/").rpartition("/")[2] == folder.rstrip("/").rpartition("/")[2]
    docs = source.parquet(f"{folder[:-1]}[{folder[-1]}]" if alone else folder)
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    marked = map_texts(docs, "text", ["id", "part"], [T.StructField("key", T.BinaryType()), T.StructField("mask", T.IntegerType())], _masks)
    flags = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(quality_col) == 1).alias("good"), F.max(F.col(toxic_col) == 1).alias("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    place = F.pmod(F.xxhash64("key"), F.lit(max(1, rows.count() // TEXTS))).alias("place")
    judged = marked.join(flags, "id", "left").select(place, "key", "id", "part", "mask", flag("good"), flag("toxic"))
    counts = "part string, mask int, good boolean, toxic boolean, n long"
    condensed = judged.mapInArrow(_condensed, f"place long, key binary, id {judged.schema['id'].dataType.simpleString()}, {counts}")
    changes = condensed.groupBy("place").applyInPandasWithState(_step, counts, "texts binary", "update", "NoTimeout")
    target = scratch(spark, "audit-counters")

    def add(batch: DataFrame, n: int) -> None:
        batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0").write.mode("overwrite").parquet(f"{target}/batch={n}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = changes.writeStream.foreachBatch(add).outputMode("update").option("checkpointLocation", scratch(spark, "audit-progress")).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    spark.createDataFrame([], counts).write.mode("overwrite").parquet(f"{target}/batch=-1")  # a table without files has no batch
    total = spark.read.schema(f"{counts}, batch int").parquet(target)
    return total.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")


def _orders(spark: SparkSession) -> DataFrame:
    """(filter_order, step, bit, before): the 120 orders with, for each step, its filter's bit and the mask of those before."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = FILTERS.index(name)
            rows.append(("".join(order), step, bit, before))
            before |= 1 << bit
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")


def report(counted: DataFrame) -> DataFrame:
    """One row per part, order and step from counters by (part, mask, good, toxic): documents kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, and shapley, the filter's removals summed over all orders.

    What a step does hangs on its filter and the set of those before, not their order: 80 sums per part, laid out over 600
    rows. Over all orders, a document that fails k filters is removed by each of them in 120 / k.
    """
    others = [(bit, before) for bit in range(len(FILTERS)) for before in range(1 << len(FILTERS)) if not before >> bit & 1]
    sets = F.array(*[F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before")) for bit, before in others])
    each = counted.withColumn("at", F.explode(sets)).select("*", "at.*")
    bit = F.expr("shiftleft(1, bit)")
    fails, earlier = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    gone = fails & ~earlier
    orders = math.factorial(len(FILTERS))
    when = lambda c, n="n": F.sum(F.when(c, F.expr(n)).otherwise(0))
    sums = each.groupBy("part", "bit", "before").agg(
        when(~fails & ~earlier).alias("kept"), when(gone).alias("removed"), when(fails & earlier).alias("redundant"), when(F.col("mask") == bit).alias("unique_fails"),
        when(gone & F.col("good")).alias("good_lost"), when(gone & F.col("toxic")).alias("toxic_lost"), when(fails, f"n * cast({orders} / bit_count(mask) as long)").alias("shapley"),
    )
    return sums.join(F.broadcast(_orders(counted.sparkSession)), ["bit", "before"]).drop("bit", "before")  # 600 rows


def audit(spark: SparkSession, folder: str, labels: DataFrame, batches: int = BATCHES, **columns: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of the documents in a folder.

    ``columns`` names the columns as ``counters`` does, whose statement on nulls and repeated rows holds; an empty table has no part and gives no row.
    """
    columns_out = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return report(counters(spark, folder, labels, batches=batches, **columns)).select(*columns_out)
