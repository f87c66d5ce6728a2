"""Incremental jobs: folders replayed as streams, saved states, finished units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import scratch


def catch_up(source: str, schema, run: Callable[[DataFrame, int], None], spark: SparkSession, progress: str) -> None:
    """Runs a batch function once over all files that came into a folder since ``progress`` was last written."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()


def replayed(arrivals: list[DataFrame], schema, run: Callable[[DataFrame, int], None], spark: SparkSession) -> None:
    """Lets the arrivals come into a folder one after the other, each followed by a run over it."""
    source, progress = scratch(spark, "arrivals"), scratch(spark, "progress")
    for arrival in arrivals:
        arrival.write.mode("append").parquet(source)
        catch_up(source, schema, run, spark, progress)


def state_reason(state: str = "", now: str = "now_") -> Column:
    """Why a saved state is not valid, else 'valid': version, target, count and fingerprints in this order."""
    parts = [("version", "other version"), ("target", "other target"), ("blocks", "other number of blocks"), ("content", "content changed"), ("prefix", "finished part changed")]
    out = F.lit("valid")
    for name, reason in reversed(parts):
        out = F.when(~F.col(f"{state}{name}").eqNullSafe(F.col(f"{now}{name}")), reason).otherwise(out)
    return out


def unfinished(expected: DataFrame, present: DataFrame, unit: str, output: str) -> DataFrame:
    """Units of which an expected output is absent; a unit without any output is one of them."""
    return expected.join(present.select(unit, output), [unit, output], "left_anti").select(unit).distinct()
