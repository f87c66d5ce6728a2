"""Window operators: running values, intervals, islands and numbering. Every window has a partition key of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def running_total(df: DataFrame, key: str, order: list[str], value: Column, name: str = "running") -> DataFrame:
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(name, F.sum(value).over(w))


def tiered_rate(total: Column) -> Column:
    """Cashback by the running total: nothing to 1500, then 0.5 %, 1 % and 1.1 %."""
    return F.when(total <= 1500, F.lit("0.000")).when(total <= 3000, F.lit("0.005")).when(total <= 7500, F.lit("0.010")).otherwise(F.lit("0.011")).cast("decimal(4,3)")


def largest_drop(df: DataFrame, key: str, order: str, value: str, least: float = 0.2) -> DataFrame:
    """(key, from, to, drop, order, previous) of each key's largest relative drop over ``least``; the first of equal ones."""
    w = W.partitionBy(key).orderBy(order)
    before = df.select(key, order, F.col(value).alias("to"), F.lag(value).over(w).alias("from"), F.lag(order).over(w).alias("previous"))
    drops = before.where("`from` <> 0").withColumn("drop", F.round((F.col("from") - F.col("to")) / F.col("from"), 3)).where(F.col("drop") > least)
    best = F.min(F.struct((-F.col("drop")).alias("_d"), order, "from", "to", "drop", "previous")).alias("b")
    return drops.groupBy(key).agg(best).select(key, "b.from", "b.to", "b.drop", f"b.{order}", "b.previous")


def segment_ends(df: DataFrame, key: str, start: str) -> DataFrame:
    """Each start with the next one as its end (the last open) and a two-digit number."""
    w = W.partitionBy(key).orderBy(start)
    return df.withColumns({"end": F.lead(start).over(w), "name": F.lpad(F.row_number().over(w).cast("string"), F.greatest(F.lit(2), F.length(F.row_number().over(w).cast("string"))), F.lit("0"))})


def paired_intervals(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, start, end): values paired in order, starts moved up to the last accepted end, empty ones dropped.
    Accepted ends only grow, so the last accepted end is the largest end of the valid pairs before."""
    rows = df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order)) - 1).withColumn("_p", F.floor(F.col("_n") / 2))
    pairs = rows.groupBy(key, "_p").agg(F.min_by(value, "_n").alias("start"), F.max_by(value, "_n").alias("end"), F.count("*").alias("_k")).where("_k = 2 and start < end")
    before = F.max("end").over(W.partitionBy(key).orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    return pairs.withColumn("start", F.greatest("start", before)).where("start < end").select(key, "start", "end")


def first_by_priority(df: DataFrame, parent: str, identity: list[str], source: str, priority: list[str], order: str, most: int = 500) -> DataFrame:
    """The first row per identity by source priority (unknown sources last), at most ``most`` per parent."""
    rank = F.coalesce(*[F.when(F.col(source) == s, i) for i, s in enumerate(priority)], F.lit(9))
    one = df.withColumn("_rank", rank).withColumn("_i", F.row_number().over(W.partitionBy(parent, *identity).orderBy("_rank", order))).where("_i = 1")
    return one.withColumn("_i", F.row_number().over(W.partitionBy(parent).orderBy("_rank", order))).where(F.col("_i") <= most).drop("_i", "_rank")


def priority_pick(df: DataFrame, parent: str, value: str, preferred: list, order: list[str]) -> DataFrame:
    """One row per parent: by its value's place in the list, then by order; without a preferred value the first row."""
    rank = F.coalesce(*[F.when(F.col(value) == v, i) for i, v in enumerate(preferred)], F.lit(len(preferred)))
    best = F.min(F.struct(rank.alias("_r"), *order, value)).alias("b")
    return df.groupBy(parent).agg(best).select(parent, *[F.col(f"b.{c}").alias(c) for c in [*order, value]])


def relative_position(df: DataFrame, parent: str, kind: str, order: list[str]) -> DataFrame:
    """Position, from 0, of a row among its parent's rows of its kind."""
    return df.withColumn("type_position", (F.row_number().over(W.partitionBy(parent, kind).orderBy(*order)) - 1).cast("long"))


def section_fill(df: DataFrame, key: str, order: str, line: str, header: str, skipped: list[str]) -> DataFrame:
    """Lines with the last header before them; header lines and fixed ones go, lines before any header have none."""
    found = F.nullif(F.regexp_extract(line, header, 1), F.lit(""))
    filled = df.withColumn("_h", found).withColumn("section", F.last("_h", ignorenulls=True).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    return filled.where(F.col("_h").isNull() & ~F.col(line).isin(skipped)).drop("_h")


def downsampled(df: DataFrame, key: str, order: str, step: int, over: int = 100) -> DataFrame:
    """Every ``step``-th row of keys with more than ``over`` rows; all rows of the others."""
    w = W.partitionBy(key)
    rows = df.withColumns({"_n": F.count("*").over(w), "_r": F.row_number().over(w.orderBy(order)) - 1})
    return rows.where((F.col("_n") <= over) | (F.col("_r") % step == 0)).drop("_n", "_r")


def first_appearance(df: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """The ordinal, within its group, of a key's first row."""
    firsts = df.groupBy(group, key).agg(F.min(order).alias("_first"))
    return df.join(firsts.withColumn("ordinal", F.row_number().over(W.partitionBy(group).orderBy("_first", key)).cast("long")).drop("_first"), [group, key])


def collision_suffix(df: DataFrame, name: str, order: str) -> DataFrame:
    """Target names made unique: later rows of a name get `` (1)``, `` (2)``, …; the hot name is numbered per name only."""
    n = F.row_number().over(W.partitionBy(name).orderBy(order)) - 1
    return df.withColumn("target", F.when(n == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), n.cast("string"), F.lit(")"))))


def capped_sample(df: DataFrame, key: str, order: str, line: str, repeats: int, length: int) -> DataFrame:
    """At most ``repeats`` of each lower-cased line, until the lines taken reach ``length`` characters."""
    once = df.withColumn("_r", F.row_number().over(W.partitionBy(key, F.lower(line)).orderBy(order))).where(F.col("_r") <= repeats)
    before = F.coalesce(F.sum(F.length(line) + 1).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return once.withColumn("_b", before).where(F.col("_b") < length).drop("_r", "_b")


def size_ranked_names(df: DataFrame, group: str, name: str, size: str, descending: bool = True) -> DataFrame:
    """``i. name 1.23GB`` by size within a group."""
    w = W.partitionBy(group).orderBy(F.desc(size) if descending else F.asc(size), name)
    return df.withColumn("ranked", F.format_string("%d. %s %.2fGB", F.row_number().over(w), F.col(name), F.col(size) / F.lit(1024.0**3)))


def chronological_index(df: DataFrame, group: str, ts: str, ties: list[str]) -> DataFrame:
    """A zero-padded index by time, rows without time last."""
    i, n = F.row_number().over(W.partitionBy(group).orderBy(F.asc_nulls_last(ts), *ties)), F.count("*").over(W.partitionBy(group))
    width = F.greatest(F.lit(2), F.length(n.cast("string")))
    return df.withColumn("index", F.lpad(i.cast("string"), width, F.lit("0")))


def rolling_mean(df: DataFrame, key: str, order: str, value: Column, n: int) -> DataFrame:
    """Rows at which ``n`` values begin, with their mean."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(0, n - 1)
    return df.withColumns({"_k": F.count("*").over(w), "mean": F.avg(value).over(w)}).where(F.col("_k") == n).drop("_k")


def islands(df: DataFrame, key: str, pos: str, gap: int) -> DataFrame:
    """(key, first, last, n): runs of positions with at most ``gap`` missing ones between neighbours."""
    w = W.partitionBy(key).orderBy(pos)
    fresh = F.coalesce((F.col(pos) - F.lag(pos).over(w) - 1 > gap).cast("int"), F.lit(0))
    runs = df.withColumn("_f", fresh).withColumn("island", F.sum("_f").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(key, "island").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("n")).drop("island")


def numbered_with_defaults(df: DataFrame, group: str, order: str, defaults: dict[str, str]) -> DataFrame:
    """Numbers from 1, and texts for missing values."""
    out = df.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)) for c, v in defaults.items()})
    return out.withColumn("number", F.row_number().over(W.partitionBy(group).orderBy(order)).cast("long"))
