"""Aggregations: counts, groups, reports and trends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.numbering import numbered_within

#: Rows dealt to a task where their number follows the table.
TASK_ROWS = 250_000

#: Numbers whose holders are put in order together.
STRETCH = 65_536


def money(c: Column) -> Column:
    """Exact sums of amounts with cents."""
    return c.cast("decimal(18,2)")


def with_members(df: DataFrame, keys: list[str], member: str, first: str, members: str) -> DataFrame:
    """(keys, n, first, members) of keys that occur more than once: their smallest member and all of them in order, comma-joined.

    Members are whole numbers. Each stretch of STRETCH numbers is sorted and joined by itself, so that a key's list of any length is
    put together from texts; what stands in one row is the list itself.
    """
    part = df.groupBy(*keys, F.floor(F.col(member) / STRETCH).alias("_part")).agg(F.count("*").alias("_n"), F.min(member).alias("_first"), F.sort_array(F.collect_list(member)).alias("_l"))
    texts = part.withColumn("_l", F.array_join(F.transform("_l", lambda x: x.cast("string")), ","))
    whole = texts.groupBy(*keys).agg(F.sum("_n").alias("n"), F.min("_first").alias(first), F.sort_array(F.collect_list(F.when(F.col("_part").isNotNull(), F.struct("_part", "_l")))).alias("_l")).where("n > 1")
    return whole.select(*keys, "n", first, F.array_join(F.col("_l._l"), ",").alias(members))


def duplicate_groups(df: DataFrame, key: str, member: str) -> DataFrame:
    """(key, n, representative, members) of keys that occur more than once."""
    return with_members(df, [key], member, "representative", "members")


def duplicate_members(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """(keys, place, member): the members of keys that occur more than once, numbered in order; a row each, whatever the key's size."""
    return numbered_within(df.select(*keys, member), keys, [member]).where("n > 1").select(*keys, "place", member)


def repeated_directories(df: DataFrame, url: str) -> DataFrame:
    """(directory, n): the path between the third and the last part of a url, where it repeats."""
    parts = F.split(url, "/")
    directory = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 3, F.lit(0))), "/")
    return df.groupBy(directory.alias("directory")).agg(F.count("*").alias("n")).where("n > 1")


def group_report(df: DataFrame, keys: list[str], place: str, variant: str, name: str) -> DataFrame:
    """Per key: entries, distinct places, sorted distinct variants and the representative, the shortest name, then the first."""
    best = F.min(F.struct(F.length(name).alias("n"), F.lower(name).alias("l"), F.col(name).alias("name")))
    return df.groupBy(*keys).agg(
        F.count("*").alias("occurrences"), F.count_distinct(place).alias("places"), F.array_sort(F.collect_set(variant)).alias("variants"), best["name"].alias("representative"),
    )


def cross_input_groups(df: DataFrame, key: str, source: str, ordinal: str) -> DataFrame:
    """(key, scope, n): keys found in two inputs or more, with the inputs' names in input order."""
    scope = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(ordinal, source))), lambda x: x[source]), "+")
    return df.groupBy(key).agg(scope.alias("scope"), F.count("*").alias("n"), F.count_distinct(source).alias("_k")).where("_k >= 2").drop("_k")


def variant_duplicates(df: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """Keys with several rows and several variants; null parts are a variant too."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.size(F.collect_set(F.struct(*parts))).cast("long").alias("n_variants")).where("n > 1 and n_variants > 1")


def metric_statistics(df: DataFrame, keys: list[str], metric: str, order: str, commit: str, least: int) -> DataFrame:
    """Per key: min, max, mean and third quartile (linear) rounded to 3, the number of changes, first and last commit."""
    r = lambda c: F.round(c, 3)
    return df.groupBy(*keys).agg(
        F.count("*").alias("changes"), r(F.min(metric)).alias("low"), r(F.max(metric)).alias("high"), r(F.avg(money(F.col(metric))).cast("double")).alias("mean"),
        r(F.percentile(metric, 0.75)).alias("q3"), F.min_by(commit, order).alias("first_commit"), F.max_by(commit, order).alias("last_commit"),
    ).where(F.col("changes") >= least)


def change_history(df: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """(key, place, order, values, changes): the ordered values of a key, a row each, kept together with their commit, and their number."""
    return numbered_within(df.select(key, order, *values), [key], [order, *values], total="changes")


def linear_trend(df: DataFrame, key: str, order: list[str], metric: str) -> DataFrame:
    """(key, n, slope, intercept) of the metric against the row's ordinal; keys of one row are left out."""
    numbered = df.withColumn("_x", (F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1).cast("double"))
    return numbered.groupBy(key).agg(F.count("*").alias("n"), F.regr_slope(metric, "_x").alias("slope"), F.regr_intercept(metric, "_x").alias("intercept")).where("n >= 2")


def category_report(df: DataFrame, text: str, pattern: str, size: str, item: str) -> DataFrame:
    """Per token that matches: rows, total size and sorted items; rows without a match and with size fall under 'none'."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0))
    found = F.when(F.size(found) > 0, found).when(F.col(size) > 0, F.array(F.lit("none")))
    each = df.select(F.explode(found).alias("category"), size, item)
    return each.groupBy("category").agg(F.count("*").alias("n"), F.sum(money(F.col(size))).cast("double").alias("total"), F.array_sort(F.collect_set(item)).alias("items"))


def collection_counters(df: DataFrame, section: str, owned: Column) -> DataFrame:
    """Per section: owned, total and percent."""
    return df.groupBy(section).agg(F.count_if(owned).alias("owned"), F.count("*").alias("total")).withColumn("percent", F.round(F.col("owned") * 100.0 / F.col("total"), 2))


def most_common(df: DataFrame, value: str, order: str) -> DataFrame:
    """The most frequent value; of equally frequent ones that seen first."""
    return df.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("_first")).orderBy(F.desc("n"), "_first").limit(1).drop("_first")


def similarity_interval(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """(n_pairs, mean, low, high) of the cosines of all pairs of rows, and the 95 % interval, without making pairs.

    For unit vectors the pairs' sum is (|sum|^2 - n) / 2 and the sum of squares (|Gram|^2 - n) / 2, where
    Gram = sum of outer products has a fixed number of entries, summed first within each task. Rows of another
    length than ``dims``, with a null or all zero are left out. At most one row: zeros.
    """
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row a task: its number of vectors, then their sum and their Gram matrix in one array."""
        n, total = 0, np.zeros(dims + dims * dims)
        for batch in batches:
            if len(batch):
                v = np.stack(batch["v"].to_numpy())
                v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
                n += len(v)
                total += np.concatenate([v.sum(axis=0), (v.T @ v).ravel()])
        yield pd.DataFrame({"n": [n], "sums": [total.tolist()]})

    v = df.select(F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == dims)
    v = v.where(F.forall("v", lambda x: x.isNotNull()) & F.exists("v", lambda x: x != 0))
    entries = v.mapInPandas(sums, "n long, sums array<double>").select("n", F.posexplode("sums").alias("i", "x"))
    summed = entries.groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    squares = lambda where: F.coalesce(F.sum(F.when(where, F.col("x") * F.col("x"))), F.lit(0.0))
    both = summed.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), squares(F.col("i") < dims).alias("s2"), squares(F.col("i") >= dims).alias("g2"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    mean = (F.col("s2") - F.col("n")) / 2 / pairs
    variance = ((F.col("g2") - F.col("n")) / 2 - pairs * mean * mean) / F.greatest(pairs - 1, F.lit(1.0))
    # Student's t at 97.5 % by its expansion about the normal quantile.
    z, k = 1.959963984540054, F.greatest(pairs - 1, F.lit(1.0))
    t = z + (z**3 + z) / 4 / k + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (k * k)
    half = t * F.sqrt(F.greatest(variance, F.lit(0.0)) / pairs)
    some = lambda c: F.when(F.col("n") > 1, c).otherwise(0.0)
    return both.select(F.greatest(pairs, F.lit(0.0)).cast("long").alias("n_pairs"), some(mean).alias("mean"), some(mean - half).alias("low"), some(mean + half).alias("high"))


def class_balance(df: DataFrame, label: str, split: str) -> DataFrame:
    """(label, train, test, equal)."""
    counted = df.groupBy(label).agg(F.count_if(F.col(split) == "train").alias("train"), F.count_if(F.col(split) == "test").alias("test"))
    return counted.withColumn("equal", F.col("train") == F.col("test"))


def ancestors(path: Column) -> Column:
    """Every directory above a path's last part."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


def directory_sizes(df: DataFrame, path: str, size: str) -> DataFrame:
    """(directory, bytes, gb): what lies below every directory."""
    sized = df.select(F.explode(ancestors(F.col(path))).alias("directory"), size).groupBy("directory").agg(F.sum(size).alias("bytes"))
    return sized.withColumn("gb", F.round(F.col("bytes") / F.lit(1024.0**3), 2))


def top_level_sizes(df: DataFrame, path: str, size: str, ignored: list[str]) -> DataFrame:
    top = F.split(path, "/")[0]
    return df.groupBy(top.alias("top")).agg(F.sum(size).alias("bytes")).where(~F.col("top").isin(ignored))


def empty_directories(directories: DataFrame, files: DataFrame, key: str, size: str) -> DataFrame:
    """Directories without a file, or whose files are all empty."""
    filled = files.groupBy(key).agg(F.sum(size).alias("_s")).where("_s > 0").select(key)
    return directories.select(key).distinct().join(filled, key, "left_anti")


def sorted_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, place, value, n): the distinct values of a key in order, a row each, and their number; nulls are no values."""
    return numbered_within(df.where(F.col(value).isNotNull()).select(key, value).distinct(), [key], [value])


def command_batches(df: DataFrame, key: str, value: str, prefix: str, size: int = 50) -> DataFrame:
    """(key, batch, command): the key's sorted values in groups of ``size``, joined behind a prefix."""
    numbered = df.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(key).orderBy(value)) - 1) / size))
    values = F.transform(F.array_sort(F.collect_list(value)), lambda x: x.cast("string"))
    return numbered.groupBy(key, "batch").agg(F.concat(F.lit(prefix), F.array_join(values, ", a/")).alias("command"))


def scan_rollup(df: DataFrame, root: str, failed: Column, errors: Column, line: str, most: int = 500) -> DataFrame:
    """Per root: scanned, clean, corrupt and failed rows, and the first error lines with a mark where more were dropped.
    Lines are ranked before they are gathered, so that a root's list stays short whatever its size."""
    states = df.groupBy(root).agg(F.count_if(~failed).alias("scanned"), F.count_if(~failed & ~errors).alias("clean"), F.count_if(~failed & errors).alias("corrupt"), F.count_if(failed).alias("failed"))
    ranked = df.where(errors).select(root, line, F.row_number().over(W.partitionBy(root).orderBy(line)).alias("_r")).where(F.col("_r") <= most + 1)
    lines = ranked.groupBy(root).agg(F.count_if(F.col("_r") <= most).alias("error_lines"), (F.max("_r") > most).alias("truncated"))
    return states.join(lines, root, "left").na.fill({"error_lines": 0, "truncated": False})


def throughput(df: DataFrame, key: str, size: str, start: str, end: str) -> DataFrame:
    """(key, bytes, seconds, rate): bytes by the time between first start and last end; no rate where none passed."""
    out = df.groupBy(key).agg(F.sum(size).alias("bytes"), F.expr(f"timestampdiff(SECOND, min({start}), max({end}))").alias("seconds"))
    return out.withColumn("rate", F.when(F.col("seconds") > 0, F.round(F.col("bytes") / F.col("seconds"), 4)))


def subset_aggregates(df: DataFrame, columns: list[str], value: str) -> DataFrame:
    """Count and sum over every non-empty subset of the columns."""
    cube = df.cube(*columns).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.grouping_id().alias("_g"))
    return cube.where(F.col("_g") < (1 << len(columns)) - 1).drop("_g")


def agreeing_sources(df: DataFrame, key: str, value: str, source: str) -> DataFrame:
    """(key, value, sources, report): the value that most sources share, at least two; ties go to the first source.
    The number of tasks follows the rows, each of which is dealt before anything is gathered: what a task holds stays the same."""
    tasks = -(-max(1, df.count()) // TASK_ROWS)
    groups = df.select(key, value, source).repartition(tasks, key, value).groupBy(key, value).agg(F.count_distinct(source).alias("sources"), F.min(source).alias("_s"))
    best = groups.repartition(tasks, key).groupBy(key).agg(F.min(F.struct((-F.col("sources")).alias("n"), "_s", value, "sources")).alias("b"), F.count("*").alias("_k"))
    some = F.col("b.sources") >= 2
    return best.select(key, F.when(some, F.col(f"b.{value}")).alias(value), F.col("b.sources").alias("sources"), F.when(F.col("_k") == 1, "same").otherwise("different").alias("report"))


def import_inventory(symbols: DataFrame) -> DataFrame:
    """(library, files, paths) of the imported top-level libraries."""
    top = F.split("name", r"\.")[0]
    return symbols.where("kind = 'import' and name <> '.'").groupBy(top.alias("library")).agg(F.count_distinct("file").alias("files"), F.array_sort(F.collect_set("file")).alias("paths"))


def status_totals(df: DataFrame, group: str, status: str, values: list[str]) -> DataFrame:
    """(group, a count per status, issues): issues are all but 'correct'."""
    out = df.groupBy(group).agg(*[F.count_if(F.col(status) == v).alias(v) for v in values])
    return out.withColumn("issues", sum((F.col(v) for v in values if v != "correct"), F.lit(0)))
