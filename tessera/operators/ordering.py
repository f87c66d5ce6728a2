"""Sorting, limits, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import nearest


def sorted_as_text(df: DataFrame, col: str) -> DataFrame:
    return df.orderBy(F.col(col).cast("string"))


def sorted_desc(df: DataFrame, col: str, ties: list[str]) -> DataFrame:
    return df.orderBy(F.desc(col), *ties)


def natural_key(text: Column, width: int = 12) -> Column:
    """A key by which digit runs compare as numbers and text in lower case; a peeled tag's ``^{}`` is left out."""
    runs = F.regexp_extract_all(F.lower(F.replace(text, F.lit("^{}"), F.lit(""))), F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(r, F.greatest(F.lit(width), F.length(r)), F.lit("0"))).otherwise(r)), "")


def natural_sort(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(natural_key(F.col(col)), col)


def by_last_segment(df: DataFrame, url: str) -> DataFrame:
    """By what follows the last slash, each word of it capitalised."""
    return df.withColumn("segment", F.initcap(F.substring_index(url, "/", -1))).orderBy("segment", url)


def case_insensitive(df: DataFrame, col: str) -> DataFrame:
    return df.orderBy(F.lower(col), col)


def top_by_votes(df: DataFrame, item: str, least: int, most: int = 512) -> DataFrame:
    return df.groupBy(item).agg(F.count("*").alias("votes")).where(F.col("votes") >= least).orderBy(F.desc("votes"), item).limit(most)


def first_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in order; all of them where n is 0."""
    ordered = df.orderBy(order)
    return ordered.limit(n) if n else ordered


def top_similar(items: DataFrame, id_col: str, vector: str, queries: DataFrame, n: int) -> DataFrame:
    """(query, other, similarity): each query's n most similar other items of positive similarity. The queries are a
    stated set that is compared with all items in blocks."""
    return nearest(queries, items, id_col, vector, n).where("score > 0").select("query", "other", F.col("score").alias("similarity"))


def union_inputs(inputs: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in inputs.items():
        one = df.withColumn("input", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def distinct_keep_first(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value) of each key's first row."""
    return df.groupBy(key).agg(F.min(order).alias("first"), F.min_by(value, order).alias(value))
