"""Running numbers over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.sources.scratch import scratch


def placed_by_ranges(df: DataFrame, ranges: list[Column | str], order: list[Column | str]) -> DataFrame:
    """``df`` sorted by ranges and written once, with its range's number ``_part`` and its place ``_inside`` that range."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = df.repartitionByRange(*ranges).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_inside": inside})
    path = scratch(df.sparkSession, "numbered")
    placed.write.parquet(path)
    return df.sparkSession.read.schema(placed.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column | str], number: str = "number") -> DataFrame:
    """``df`` with 1, 2, … in the given order: rows are sorted by ranges and counted per partition, and each
    partition's numbers begin where the ones before it end. What is broadcast is one row per partition."""
    placed = placed_by_ranges(df, order, order)
    earlier = F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counts = placed.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(earlier, F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(counts), "_part").withColumn(number, F.col("_before") + F.col("_inside") + 1).drop("_part", "_inside", "_before")


def numbered_within(df: DataFrame, keys: list[str], order: list[str], number: str = "place", total: str = "n") -> DataFrame:
    """``df`` with each row's number 1, 2, … in the given order among the rows of its keys (null is a key) and with their number.

    Rows are sorted by ranges of keys and order, so that a key of any size is spread; what is joined to a range's rows is one row
    for each key that it holds.
    """
    placed = placed_by_ranges(df, [*keys, *order], [*keys, *order])
    inside = placed.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_of")).agg(F.min("_inside").alias("_lowest"), F.count("*").alias("_rows"))
    key = W.partitionBy(*[f"_k{i}" for i in range(len(keys))])  # a row for each range that holds the key
    earlier = F.sum("_rows").over(key.orderBy("_of").rowsBetween(W.unboundedPreceding, -1))
    starts = inside.select(*inside.columns, F.coalesce(earlier, F.lit(0)).alias("_before"), F.sum("_rows").over(key).alias("_total"))
    same = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = placed.join(starts, same).withColumns({number: F.col("_before") + F.col("_inside") - F.col("_lowest") + 1, total: F.col("_total")})
    return out.select(*df.columns, number, total)
