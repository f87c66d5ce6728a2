"""Chronological indexes of groups that grow by arrivals, kept as sorted runs.

Each batch writes a run: its new records and those records of their groups that stand behind the earliest new one, with their
places; and one cut per group: how many earlier records keep their places, and how many there are now. A record of an older
run is in force as long as no later cut of its group lies before it. Groups without new records are not written, and records
before the earliest new one neither, so that arrivals in time order only append.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.operators.numbering import numbered
from tessera.sources.scratch import scratch
from tessera.streaming.incremental import replayed

#: Folders of a run, by the groups' hash; a batch reads those of its groups alone.
BUCKETS = 64
#: Places of one group that are written by one task.
STRETCH = 1_000_000


class GroupedIndex:
    """Index by time of each ``group``; rows without time come last, then ``ties`` decide, then arrival. Null groups are one.

    ``add(batch, n)`` can run again with the same number and replaces what it wrote. Equal rows all count. Columns can't be maps.
    """

    def __init__(self, spark: SparkSession, target: str, schema: T.StructType, group: str, ts: str, ties: list[str]) -> None:
        self.spark, self.target, self.schema, self.group = spark, target, schema, group
        self.key = F.struct(F.col(ts).isNull().alias("late"), F.col(ts).alias("ts"), *[F.col(t).alias(f"tie{i}") for i, t in enumerate(ties)])
        self.bucket = F.pmod(F.xxhash64(group), F.lit(BUCKETS)).cast("int")
        place, batch = T.StructField("_place", T.LongType()), T.StructField("_batch", T.IntegerType())
        self.runs = T.StructType([*schema.fields, place, batch, T.StructField("_bucket", T.IntegerType())])
        self.cuts = T.StructType([T.StructField("_group", schema[group].dataType), T.StructField("_kept", T.LongType()), T.StructField("_total", T.LongType()), batch])
        for name in ("runs", "cuts"):
            spark.createDataFrame([], schema).limit(0).write.mode("ignore").parquet(f"{target}/{name}/_empty")

    def _read(self, name: str, schema: T.StructType, before: int | None) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.target}/{name}")
        return rows if before is None else rows.where(F.col("_batch") < before)

    def _of_group(self) -> Column:
        return F.col(self.group).eqNullSafe(F.col("_group"))

    def live(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Records in force with ``_place``; with ``before`` as they stood when that batch began."""
        later = W.partitionBy("_group").orderBy(F.desc("_batch")).rowsBetween(W.unboundedPreceding, -1)
        limits = self._read("cuts", self.cuts, before).select("_group", F.col("_batch").alias("_of"), F.min("_kept").over(later).alias("_upto"))
        rows = self._read("runs", self.runs, before)
        rows = rows if buckets is None else rows.where(F.col("_bucket").isin(buckets))
        rows = rows.join(limits, self._of_group() & (F.col("_batch") == F.col("_of")))
        return rows.where(F.col("_upto").isNull() | (F.col("_place") <= F.col("_upto"))).select(*self.schema.names, "_place")

    def totals(self, before: int | None = None) -> DataFrame:
        return self._read("cuts", self.cuts, before).groupBy("_group").agg(F.max_by("_total", "_batch").alias("_before"))

    def add(self, batch: DataFrame, n: int) -> None:
        rows = batch.select(*self.schema.names)
        firsts = rows.groupBy(F.col(self.group).alias("_group")).agg(F.min(self.key).alias("_earliest"), F.count("*").alias("_new"))
        buckets = [r[0] for r in rows.select(self.bucket.alias("b")).distinct().collect()]  # BUCKETS at most
        moved = self.live(n, buckets).join(firsts.select("_group", "_earliest"), self._of_group()).where(self.key > F.col("_earliest"))
        # Behind its equals that were there: those kept their places.
        every = moved.select(*self.schema.names, F.col("_place").alias("_old")).unionByName(rows.withColumn("_old", F.lit(None).cast("long")))
        placed = numbered(every.withColumn("_key", self.key), [self.group, "_key", F.asc_nulls_last("_old")], "_n")
        groups = placed.groupBy(F.col(self.group).alias("_group")).agg(F.min("_n").alias("_first"), F.count("_old").alias("_moved"), F.count("*").alias("_rows"))
        totals = self.totals(n).withColumnRenamed("_group", "_known")
        cuts = groups.join(totals, F.col("_group").eqNullSafe(F.col("_known")), "left").withColumn("_kept", F.coalesce("_before", F.lit(0)) - F.col("_moved"))
        run = placed.join(cuts.select("_group", "_first", "_kept"), self._of_group()).withColumn("_place", F.col("_kept") + F.col("_n") - F.col("_first") + 1)
        run = run.select(*self.schema.names, "_place", self.bucket.alias("_bucket")).repartition("_bucket", F.floor(F.col("_place") / STRETCH))
        run.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.target}/runs/_batch={n}")
        # A run is in force by its cuts, which come last.
        cuts.select("_group", "_kept", (F.col("_kept") + F.col("_rows")).alias("_total")).write.mode("overwrite").parquet(f"{self.target}/cuts/_batch={n}")

    def index(self) -> DataFrame:
        """All records with ``index``, the place padded with zeros to the width of the group's number of records, two at least."""
        width = F.greatest(F.lit(2), F.length(F.col("_before").cast("string")))
        return self.live().join(self.totals(), self._of_group()).withColumn("index", F.lpad(F.col("_place").cast("string"), width, F.lit("0"))).select(*self.schema.names, "index")


def reindexed_stream(spark: SparkSession, arrivals: list[DataFrame], schema: T.StructType, target: str, group: str, ts: str, ties: list[str]) -> DataFrame:
    """Each group's index after the arrivals came into a folder one after the other, each followed by a run."""
    job = GroupedIndex(spark, target, schema, group, ts, ties)
    replayed(arrivals, schema, job.add, spark)
    return job.index()
