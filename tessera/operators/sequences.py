"""Sequence and similarity search: offsets, repeated segments, lags and equal content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.text import l2_normalized
from tessera.operators.aggregates import duplicate_members, with_members
from tessera.operators.blocks import nearest
from tessera.operators.numbering import numbered
from tessera.operators.windows import islands, rolling_mean
from tessera.sources.scratch import scratch

#: Rows of a series that one window holds, and positions in which rows and runs meet.
STRETCH, BLOCK = 100_000, 256


def combined(vectors: list[Column], dims: int = 24) -> Column:
    """Vectors cut to ``dims``, made unit, scaled by the root of their number, joined and made unit again."""
    parts = [F.transform(l2_normalized(F.slice(v, 1, dims)), lambda x: x / F.sqrt(F.lit(float(len(vectors))))) for v in vectors]
    return l2_normalized(F.concat(*parts))


def offset_votes(queries: DataFrame, rows: DataFrame, pos: str, vector: str, neighbours: int, least: float, ahead: int) -> DataFrame:
    """(offset, votes): of each query's nearest rows those at least ``ahead`` later and similar enough vote for their offset.
    The queries are a stated set, compared with all rows in blocks."""
    offset = F.col("other") - F.col("query")
    best = nearest(queries, rows, pos, vector, neighbours)
    return best.where((offset >= ahead) & (F.col("score") >= least)).groupBy(offset.alias("offset")).agg(F.count("*").alias("votes"))


def repeated_segments(series: DataFrame, pos: str, similarity: str, n: int, least: float, gap: int, edge: float, stretch: int = STRETCH, block: int = BLOCK) -> DataFrame:
    """(offset, first, last, confidence): stretches of ``series`` (offset, pos, similarity) whose rolling mean holds,
    joined over small gaps, with weak edges cut off.

    The series is numbered by ranges and worked on in parts of ``stretch`` rows (``n`` at least), each with the first rows of the
    next part besides. Runs that touch a part's ends are joined afterwards: two rows a part at most go through one window.
    Rows meet runs by blocks of ``block`` positions; what is exploded to blocks is not broadcast, for Spark counts it as before.
    """
    rows = numbered(series.select("offset", pos, similarity), ["offset", pos], "_n").withColumns({"_part": F.floor(F.col("_n") / stretch), "_own": F.lit(True)})
    ahead = rows.where(F.pmod("_n", F.lit(stretch)) < n - 1).withColumns({"_part": F.col("_part") - 1, "_own": F.lit(False)})
    parts = rows.unionByName(ahead).withColumn("_key", F.struct("offset", "_part"))
    strong = rolling_mean(parts, "_key", "_n", F.col(similarity), n).where(F.col("_own") & (F.col("mean") >= least))
    inside = W.partitionBy("_key")
    pieces = islands(strong, "_key", pos, gap).withColumn("_outer", (F.col("first") == F.min("first").over(inside)) | (F.col("last") == F.max("last").over(inside)))
    pieces = pieces.select("_key.offset", "first", "last", "_outer")
    in_order = W.partitionBy("offset").orderBy("first")  # a part's first and last piece only
    seams = pieces.where("_outer").withColumn("_fresh", F.coalesce((F.col("first") - F.lag("last").over(in_order) > gap + 1).cast("int"), F.lit(0)))
    joined = seams.withColumn("_run", F.sum("_fresh").over(in_order)).groupBy("offset", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    runs = joined.drop("_run").unionByName(pieces.where("not _outer").drop("_outer")).withColumn("last", F.col("last") + n - 1)
    blocks = lambda first, last: F.explode(F.sequence(F.floor(first / block), F.floor(last / block)))
    placed = rows.select("offset", pos, similarity, F.floor(F.col(pos) / block).alias("_block"))
    held = placed.join(runs.withColumn("_block", blocks(F.col("first"), F.col("last"))).hint("merge"), ["offset", "_block"]).where(F.col(pos).between(F.col("first"), F.col("last")))
    ends = held.where(F.col(similarity) >= edge).groupBy("offset", "first", "last").agg(F.min(pos).alias("from"), F.max(pos).alias("to"))
    ends = ends.withColumn("_block", blocks(F.col("from"), F.col("to")))
    trimmed = held.join(ends.hint("merge"), ["offset", "first", "last", "_block"]).where(F.col(pos).between(F.col("from"), F.col("to")))
    return trimmed.groupBy("offset", F.col("from").alias("first"), F.col("to").alias("last")).agg(F.round(F.avg(similarity) * 100, 2).alias("confidence"))


def _overlap(shift: str) -> Column:
    """How long a pair of records (a, b) overlaps, in the first occurrence or in the one ``offset`` further on."""
    at = lambda end: [F.col(f"{r}.{end}") + (F.col(f"{r}.{shift}") if shift else 0) for r in ("a", "b")]
    return F.least(*at("last")) - F.greatest(*at("first"))


def _rivals(ranked: DataFrame, key: str, near: float, share: float) -> DataFrame:
    """(better, worse): ranks of records of a key that begin near each other or overlap, in both occurrences.

    Records that begin near each other meet in cells of both beginnings. Where two overlap by more than half of the shorter one, the
    longer one holds its middle: the middle meets the longer one in cells of the longer one's size, again in both occurrences.
    The records of all cells are not broadcast, for Spark counts them as one a record.
    """
    one = ranked.select(F.struct(F.col(key).alias("key"), "_rank", "offset", "first", "last").alias("r"))
    first, last, second, long = F.col("r.first"), F.col("r.last"), F.col("r.first") + F.col("r.offset"), F.col("r.last") - F.col("r.first")
    width = max(float(near), 1.0)
    cell = lambda x, size: F.floor(x / size).cast("long")
    nothing = F.lit(None).cast("int")

    def cells(x: Column, y: Column, size: Column) -> Column:
        return F.explode(F.sequence(cell(x, size), cell(y, size)))

    w = F.lit(width)
    left = one.select("r", nothing.alias("_level"), cell(first, w).alias("_x"), cell(second, w).alias("_y"))
    right = one.withColumn("_x", cells(first - near, first + near, w)).withColumn("_y", cells(second - near, second + near, w)).select("r", nothing.alias("_level"), "_x", "_y")
    positive = one.where(long > 0).withColumn("_level", F.ceil(F.log2(long)).cast("int"))
    top = positive.agg(F.max("_level")).first()[0]
    if top is not None:
        size = F.pow(F.lit(2.0), F.col("_level"))
        middle = (first + last) / 2
        short = positive.withColumn("_level", F.explode(F.sequence(F.col("_level"), F.lit(top))))
        left = left.unionByName(short.select("r", "_level", cell(middle, size).alias("_x"), cell(middle + F.col("r.offset"), size).alias("_y")))
        wide = positive.withColumn("_x", cells(first, last, size)).withColumn("_y", cells(second, last + F.col("r.offset"), size))
        right = right.unionByName(wide.select("r", "_level", "_x", "_y"))
    left, right = left.withColumnsRenamed({"r": "a"}), right.withColumnsRenamed({"r": "b", "_level": "_l", "_x": "_u", "_y": "_v"})
    same = F.col("a.key").eqNullSafe(F.col("b.key")) & F.col("_level").eqNullSafe(F.col("_l")) & (F.col("_x") == F.col("_u")) & (F.col("_y") == F.col("_v"))
    start = F.abs(F.col("a.first") - F.col("b.first"))
    later = F.abs(F.col("a.first") + F.col("a.offset") - F.col("b.first") - F.col("b.offset"))
    need = share * F.greatest(F.lit(1e-9), F.least(F.col("a.last") - F.col("a.first"), F.col("b.last") - F.col("b.first")))
    meet = ((start <= near) & (later <= near)) | ((_overlap("") >= need) & (_overlap("offset") >= need))
    pairs = left.join(right.hint("merge"), same & (F.col("a._rank") != F.col("b._rank"))).where(meet)
    return pairs.select(F.least("a._rank", "b._rank").alias("better"), F.greatest("a._rank", "b._rank").alias("worse")).distinct()


def without_overlaps(records: DataFrame, key: str, most: int | None = None, near: float = 1.5, share: float = 0.8) -> DataFrame:
    """Records (key, offset, first, last, confidence) of each key, longest and surest first, that neither begin
    near nor overlap, in both occurrences, with a kept one; ``most`` of a key where it is given. Of repeated records one stays;
    those with a null place meet nothing. ``share`` must be more than a half.

    Pairs that meet are found once. Then, in rounds, a record that no better one can still turn down stays and turns down those
    that it meets, which is what taking them one by one would give; pairs that are decided leave.
    """
    if share <= 0.5:
        raise ValueError("share must be more than a half")
    spark = records.sparkSession
    ranked = numbered(records.withColumn("_d", F.col("last") - F.col("first")), [key, F.desc("_d"), F.desc("confidence"), "offset", "first"], "_rank")

    def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    pairs, _ = written(_rivals(ranked, key, near, share), "rivals")
    lost: list[str] = []
    while not pairs.isEmpty():
        stay = pairs.select("better").distinct().join(pairs.select(F.col("worse").alias("better")).distinct(), "better", "left_anti")
        gone, path = written(pairs.join(stay, "better", "left_semi").select("worse").distinct(), "lost")
        lost.append(path)
        open_pairs = pairs.join(gone, "worse", "left_anti").join(gone.withColumnRenamed("worse", "better"), "better", "left_anti")
        pairs, _ = written(open_pairs.select("better", "worse"), "rivals")
    kept = ranked.join(spark.read.schema("worse long").parquet(*lost), F.col("_rank") == F.col("worse"), "left_anti") if lost else ranked
    if most is not None:
        kept = kept.withColumn("_place", F.row_number().over(W.partitionBy(key).orderBy("_rank"))).where(F.col("_place") <= most)
    return kept.select(*records.columns)


def sign_bits(vector: Column) -> Column:
    """The signs of up to 64 numbers as one integer."""
    return F.aggregate(F.slice(vector, 1, 64), F.lit(0).cast("long"), lambda h, x: F.shiftleft(h, 1).bitwiseOR((x >= 0).cast("long")))


def hash_similarity(a: DataFrame, b: DataFrame, keys: list[str], close: int = 5, least: float = 0.75) -> DataFrame:
    """(group, ratio, similar) of two hash sequences (group, pos, hash): positions whose hashes differ in fewer than ``close`` bits."""
    group = keys[0]
    pairs = a.join(b.withColumnRenamed("hash", "_other"), keys)
    near = (F.bit_count(F.col("hash").bitwiseXOR(F.col("_other"))) < close).cast("int")
    return pairs.groupBy(group).agg(F.round(F.avg(near), 4).alias("ratio")).withColumn("similar", F.col("ratio") >= least)


def best_lag(series: DataFrame, a: str, b: str, pos: str, lags: int) -> DataFrame:
    """(lag, correlation) of the largest absolute cross-correlation of two mean-centred, peak-scaled series within ±lags."""
    means = series.agg(F.avg(a).alias("_ma"), F.avg(b).alias("_mb"))
    centred = series.join(means).select(pos, (F.col(a) - F.col("_ma")).alias("x"), (F.col(b) - F.col("_mb")).alias("y"))  # means: one row
    peaks = centred.agg(F.max(F.abs("x")).alias("_px"), F.max(F.abs("y")).alias("_py"))
    scaled = centred.join(peaks).select(pos, (F.col("x") / F.col("_px")).alias("x"), (F.col("y") / F.col("_py")).alias("y"))
    shifted = scaled.select(F.explode(F.sequence(F.lit(-lags), F.lit(lags))).alias("lag"), F.col(pos).alias("_p"), "y")
    sums = scaled.select(F.col(pos).alias("_s"), "x").join(shifted, F.col("_s") == F.col("_p") - F.col("lag")).groupBy("lag").agg(F.sum(F.col("x") * F.col("y")).alias("c"))
    return sums.agg(F.max_by(F.struct("lag", "c"), F.struct(F.round(F.abs("c"), 6), -F.col("lag"))).alias("b")).select(F.col("b.lag").alias("lag"), F.round("b.c", 4).alias("correlation"))


def _by_content(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(id_col, F.octet_length(text_col).alias("size"), F.md5(text_col).alias("digest"))


def equal_content(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(size, digest, n, first, ids) of contents that several rows have."""
    return with_members(_by_content(df, id_col, text_col), ["size", "digest"], id_col, "first", "ids")


def equal_members(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(size, digest, place, id): the rows of contents that several rows have, numbered by id."""
    return duplicate_members(_by_content(df, id_col, text_col), ["size", "digest"], id_col)
