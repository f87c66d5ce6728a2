"""Deduplication by any of several keys with keyed state between batches.

Known keys live in Spark's state store, so that an arrival reads the state of its own keys and no table of what came before:
each row asks once per key, and rows that no answer turns down are left. What a batch accepts is written to the target, and
the target is the stream's second source: the next batch reads it as news for the states. A row that another key turns down
so leaves no trace.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.scratch import scratch

#: Places of the state; the keys of one place are read and written together.
PLACES = 1024
#: What a session is set to while a stream with state starts.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def known_keys_step(columns: list[str]):
    """A step over the keys of one place: those of rows marked ``_known`` enter the state; the other rows pass, with ``_hit``
    where their key is known. Within a batch, known rows come first, whatever their place."""

    def step(_, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True)
        known = pickle.loads(state.get[0]) if state.exists else set()
        new = set(rows.loc[rows["_known"], "_key"].dropna()) - known
        if new:
            known |= new
            state.update((pickle.dumps(known),))
        asking = rows[~rows["_known"]]
        yield asking.assign(_hit=asking["_key"].isin(known) & asking["_key"].notna())[[*columns, "_hit"]]

    return step


def accepted(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of one batch, by one key after the other, the first of each value in ``order``; null keys part nothing."""
    out = batch
    for key in keys:
        firsts = out.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
        out = out.join(firsts, key, "left").where(F.col("_first").isNull() | (F.col("_first") == F.col(order))).select(*batch.columns)
    return out


class KeyedDeduplication:
    """A stream from a folder of arrivals to a target table: rows none of whose ``keys`` stands in the target yet.

    ``run()`` works on all files that came since it ran last, as one batch. Of the rows of a batch the first in ``order``
    counts, by the keys in turn. Only rows that are ``complete`` make their keys known. A batch that runs again replaces what
    it wrote, and its news reach the states once. An arrival without rows changes nothing; null keys match nothing; of equal rows
    in a batch one counts. Columns can't be maps.
    """

    def __init__(self, spark: SparkSession, source: str, target: str, schema: T.StructType, keys: list[str], order: str, complete: Column, progress: str | None = None) -> None:
        self.spark, self.source, self.target, self.schema = spark, source, target, schema
        self.keys, self.order, self.complete = keys, order, complete
        self.progress = progress or scratch(spark, "progress")
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{target}/batch=-1")
        spark.createDataFrame([], schema).write.mode("append").parquet(source)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.target).select(*self.schema.names)

    def _stream(self) -> DataFrame:
        news = self.spark.readStream.schema(T.StructType([*self.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(self.target)
        news = news.where(self.complete).select(*self.schema.names, F.lit(True).alias("_known"))
        rows = self.spark.readStream.schema(self.schema).parquet(self.source).withColumn("_known", F.lit(False)).unionByName(news)
        keys = F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i} "), F.col(k).cast("string"))) for i, k in enumerate(self.keys)])
        asked = rows.withColumn("_key", F.explode(keys)).where(F.col("_key").isNotNull() | ~F.col("_known"))
        # Keys that are null have places of their own.
        place = F.when(F.col("_key").isNotNull(), F.pmod(F.xxhash64("_key"), F.lit(PLACES))).otherwise(-1 - F.pmod(F.xxhash64(self.order), F.lit(PLACES)))
        answers = T.StructType([*self.schema.fields, T.StructField("_hit", T.BooleanType())])
        return asked.withColumn("_place", place).groupBy("_place").applyInPandasWithState(known_keys_step(self.schema.names), answers, "keys binary", "append", "NoTimeout")

    def run(self) -> None:
        def add(batch: DataFrame, n: int) -> None:
            free = batch.groupBy(*self.schema.names).agg(F.max("_hit").alias("_hit")).where(~F.col("_hit")).drop("_hit")
            accepted(free, self.keys, self.order).write.mode("overwrite").parquet(f"{self.target}/batch={n}")

        before = {k: self.spark.conf.get(k, None) for k in STATE}
        for k, v in STATE.items():
            self.spark.conf.set(k, v)
        try:
            query = self._stream().writeStream.foreachBatch(add).outputMode("append").option("checkpointLocation", self.progress).trigger(availableNow=True).start()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        query.awaitTermination()


def deduplicated_stream(spark: SparkSession, arrivals: list[DataFrame], schema: T.StructType, target: str, keys: list[str], order: str, complete: Column) -> DataFrame:
    """The target table after the arrivals came into a folder one after the other, each followed by a run."""
    source = scratch(spark, "arrivals")
    job = KeyedDeduplication(spark, source, target, schema, keys, order, complete)
    for arrival in arrivals:
        arrival.write.mode("append").parquet(source)
        job.run()
    return job.table()
