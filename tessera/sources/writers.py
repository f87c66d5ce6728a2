"""Writers: every part is written by Spark's committers, so a lost task leaves nothing half done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.numbering import numbered, numbered_within


def write_csv(df: DataFrame, path: str, sep: str = ",", columns: list[str] | None = None) -> None:
    """Header and rows; with ``columns`` only these (the simplified form)."""
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_json_report(df: DataFrame, path: str, group: list[str], items: list[str], order: list[str]) -> None:
    """Two folders of JSON lines: ``summary`` with a group's keys and its number of items, and ``items`` with the keys, the item's place in
    the group and the item. A group of any size is spread over files, which stand in the order of groups and places."""
    placed = numbered_within(df.select(*dict.fromkeys([*group, *order, *items])), group, order, "place", "n_items")
    item = F.struct(*order, *[c for c in items if c not in order]).alias("item")
    placed.select(*group, "place", item).repartitionByRange(*group, "place").sortWithinPartitions(*group, "place").write.mode("overwrite").json(f"{path}/items")
    summary = placed.where("place = 1").select(*group, F.struct(F.col("n_items").alias("n")).alias("summary"))
    summary.repartitionByRange(*group).sortWithinPartitions(*group).write.mode("overwrite").json(f"{path}/summary")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")


def write_split_by_key(df: DataFrame, path: str, key: str, order: str) -> None:
    """One directory per key, ``{ordinal}-{key}``, numbered by the key's first row; only the keys are ordered, by ranges, not the rows."""
    firsts = df.groupBy(key).agg(F.min(order).alias("_first"))
    ordinal = numbered(firsts, ["_first", key], "_ordinal").select(key, F.concat_ws("-", "_ordinal", safe_name(F.col(key))).alias("part"))
    df.join(ordinal, key).write.mode("overwrite").partitionBy("part").option("header", True).csv(path)


def write_text_lines(df: DataFrame, path: str, line: Column) -> None:
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def write_diffs(df: DataFrame, path: str) -> None:
    """One text per (number, hash, file), below ``commit={number}-{hash}``."""
    df.select(F.concat_ws("-", "number", "hash").alias("commit"), F.concat(F.lit("--- "), "file", F.lit("\n"), "diff").alias("value")).write.mode("overwrite").partitionBy("commit").text(path)
