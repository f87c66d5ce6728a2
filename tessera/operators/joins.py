"""Joins: semi, anti, set, fuzzy, tiered, interval and alignment joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.operators.numbering import numbered, numbered_within, placed_by_ranges
from tessera.sources.scratch import scratch

#: Characters of a stem that the key of a prefix join holds at most.
BEGINNING = 4


def changed_only(rows: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys stand in ``changed``."""
    return rows.join(changed.select(*keys), keys, "left_semi")


def divergent(rows: DataFrame, original: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key the original lacks (null keys too), numbered from the oldest, which the input has last."""
    return numbered(rows.join(original.select(key), key, "left_anti"), [F.desc(order)])


def two_way_anti(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(side, keys): what only one of both has, after lower-casing and trimming."""
    norm = lambda d: d.select(*[F.lower(F.trim(k)).alias(k) for k in keys]).distinct()
    a, b = norm(a), norm(b)
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("first")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("second")))


def three_way_compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, place): in both, only left or only right."""
    left, right = a.select(key).distinct().withColumn("_l", F.lit(True)), b.select(key).distinct().withColumn("_r", F.lit(True))
    place = F.when(F.col("_l") & F.col("_r"), "common").when(F.col("_l"), "left").otherwise("right")
    return left.join(right, key, "full_outer").select(key, place.alias("place"))


def one_way_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_anti")


def word_containment(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, name_col: str) -> DataFrame:
    """(id, name): texts that hold all of a name's words in a row, in any case. An equi join of the texts' distinct
    words with the names' first words finds candidates, whose texts are then searched: no comparison of every
    text with every name."""
    names = names.select(name_col).distinct().withColumn("_first", F.substring_index(F.lower(name_col), " ", 1))
    words = texts.select(id_col, F.explode(F.array_distinct(F.split(F.lower(text_col), r"\s+"))).alias("_first"))
    hits = words.join(names, "_first").select(id_col, name_col).distinct()
    padded = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"\s+", " "), F.lit(" "))
    texts = texts.select(id_col, padded(F.col(text_col)).alias("_text"))
    return hits.join(texts, id_col).where(F.contains("_text", padded(F.col(name_col)))).select(id_col, name_col).distinct()


def _ratio(a: str, b: str) -> float:
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def _near_titles(titles: DataFrame, block: str, title: str, least: float) -> DataFrame:
    """(title_a, title_b), both ways: titles of a block that may reach the ratio; no pair that reaches it is missing.

    A ratio of ``least`` leaves at most ``(1 - least) * both lengths`` characters unmatched. Where the shorter title
    is cut into one piece more than that, a piece stands unchanged in the longer one, moved by no more than that
    number: the two join on the piece. (Empty titles have one empty piece.)
    """
    longest = lambda n: F.floor(n * (2 - least) / least + 1e-9)
    spare = lambda n: F.floor((1 - least) * (n + longest(n)) + 1e-9).cast("int")
    cut = lambda df: df.withColumn("_i", F.explode(F.sequence(F.lit(0), spare(F.col("_n"))))).withColumns({
        "_from": F.floor(F.col("_i") * F.col("_n") / (spare(F.col("_n")) + 1)).cast("int"),
        "_to": F.floor((F.col("_i") + 1) * F.col("_n") / (spare(F.col("_n")) + 1)).cast("int")})
    piece = lambda c, at: F.substring(c, at + 1, F.col("_to") - F.col("_from")).alias("_piece")
    short = cut(titles.select(block, F.col(title).alias("_short"), F.length(title).alias("_n")))
    short = short.select(block, "_short", "_n", "_i", piece(F.col("_short"), F.col("_from")))
    size = F.length(title)
    shorter = F.sequence(F.ceil(size * least / (2 - least) - 1e-9).cast("int"), size)
    long = cut(titles.select(block, F.col(title).alias("_long"), F.explode(shorter).alias("_n")))
    long = long.withColumn("_shift", F.explode(F.sequence(-spare(F.col("_n")), spare(F.col("_n"))))).withColumn("_at", F.col("_from") + F.col("_shift"))
    inside = (F.col("_at") >= 0) & (F.col("_at") + F.col("_to") - F.col("_from") <= F.length("_long"))
    long = long.where(inside).select(block, "_long", "_n", "_i", piece(F.col("_long"), F.col("_at"))).distinct()
    pairs = short.join(long, [block, "_n", "_i", "_piece"]).select("_short", "_long").distinct()
    return pairs.toDF("title_a", "title_b").union(pairs.select("_long", "_short")).distinct()


def fuzzy_pairs(rows: DataFrame, block: str, source: str, title: str, least: float = 0.9) -> DataFrame:
    """(block, title_a, source_a, title_b, source_b, ratio) of different sources' titles in a block whose
    matcher ratio reaches ``least``. The ratio is computed once for each
    two titles that share a piece."""
    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    one = rows.select(block, source, title).where(F.col(title).isNotNull()).distinct()
    titles = one.select(block, title).distinct()
    near = _near_titles(titles, block, title, least).withColumn("ratio", ratio("title_a", "title_b")).where(F.col("ratio") >= least)
    a = one.select(block, F.col(source).alias("source_a"), F.col(title).alias("title_a"))
    b = one.select(block, F.col(source).alias("source_b"), F.col(title).alias("title_b"))
    return a.join(near, "title_a").join(b, [block, "title_b"]).where(F.col("source_a") < F.col("source_b")).select(block, "source_a", "title_a", "source_b", "title_b", "ratio")


def assemble_groups(pairs: DataFrame, block: str) -> DataFrame:
    """(block, group, source, title): pairs merged from the most similar down, ties by sources and titles, into groups that hold each
    source once; groups are numbered from 0 in a block, by their smallest member.

    In rounds: pairs whose groups share a source leave; a pair that comes first at both of its groups merges them. What comes before it
    elsewhere can't touch its groups, so that the groups are those of taking the pairs one by one. Each round writes its pairs and the
    groups that they touch; a group's members, one a source at most, stand in one row until the end.
    """
    spark = pairs.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    end = lambda side: pairs.select(F.col(block).alias("_block"), F.col(f"source_{side}").alias("source"), F.col(f"title_{side}").alias("title"))
    members = written(numbered(end("a").union(end("b")).distinct(), ["_block", "source", "title"], "_id"), "members")
    edges = numbered(pairs, [F.desc("ratio"), "source_a", "source_b", "title_a", "title_b"], "_rank")
    for side, name in (("a", "x"), ("b", "y")):
        one = members.select("_block", F.col("source").alias(f"source_{side}"), F.col("title").alias(f"title_{side}"), F.col("_id").alias(name))
        same = [edges[c].eqNullSafe(one[d]) for c, d in ((block, "_block"), (f"source_{side}", f"source_{side}"), (f"title_{side}", f"title_{side}"))]
        edges = edges.join(one.select("_block", f"source_{side}", f"title_{side}", name), same[0] & same[1] & same[2]).select(edges["*"], name)
    edges = written(edges.select("_rank", "x", "y"), "edges")
    groups = members.select(F.col("_id").alias("g"), F.array(F.struct(F.col("_id").alias("id"), "source")).alias("held"))
    done = []
    while True:
        sources = lambda name: groups.select(F.col("g").alias(name), F.col("held.source").alias(f"_{name}"))
        live = edges.join(sources("x"), "x").join(sources("y"), "y").where((F.col("x") != F.col("y")) & ~F.arrays_overlap("_x", "_y"))
        live = written(live.groupBy("x", "y").agg(F.min("_rank").alias("_rank")), "edges")
        touched = live.select(F.explode(F.array("x", "y")).alias("g"), "_rank").groupBy("g").agg(F.min("_rank").alias("_best"))
        done.append(written(groups.join(touched, "g", "left_anti").where(F.size("held") > 1), "groups"))
        if live.isEmpty():
            break
        best = lambda name: touched.select(F.col("g").alias(name), F.col("_best").alias("_rank"))
        moves = written(live.join(best("x"), ["x", "_rank"]).join(best("y"), ["y", "_rank"]).select("x", "y"), "moves")
        to = lambda name: moves.select(F.col("y").alias(name), F.col("x").alias(f"_{name}"))
        merged = groups.join(touched.select("g"), "g", "left_semi").join(to("g"), "g", "left").groupBy(F.coalesce("_g", "g").alias("g"))
        groups = written(merged.agg(F.flatten(F.collect_list("held")).alias("held")), "groups")
        x, y = F.coalesce("_x", "x"), F.coalesce("_y", "y")
        edges = live.join(to("x"), "x", "left").join(to("y"), "y", "left").select("_rank", F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
    found = reduce(DataFrame.unionByName, done).select(F.array_min("held.id").alias("_first"), F.explode("held.id").alias("_id")).join(members, "_id")
    heads = numbered_within(found.where("_first = _id").select("_block", "_first"), ["_block"], ["_first"], "group").select("_first", (F.col("group") - 1).alias("group"))
    return found.join(heads, "_first").select(F.col("_block").alias(block), "group", "source", "title")


def tiered_match(rows: DataFrame, candidates: DataFrame, id_col: str, tiers: list[tuple[Column, Column]], hit: str) -> DataFrame:
    """(id, hit, tier, status): the candidates of the first tier that has any; more than one makes the match ambiguous."""
    found = None
    for n, (left, right) in enumerate(tiers, 1):
        # Candidates of one key are counted first, so that a frequent key makes no pairs.
        counted = candidates.select(F.col(hit), right.alias("_k")).groupBy("_k").agg(F.count("*").alias("n"), F.min(hit).alias(hit))
        keyed = rows.select(F.col(id_col), left.alias("_k")).join(counted, "_k").select(id_col, F.lit(n).alias("tier"), "n", hit)
        found = keyed if found is None else found.unionByName(keyed)
    best = found.groupBy(id_col).agg(F.min(F.struct("tier", "n", hit)).alias("b"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("b.n") > 1, "ambiguous").otherwise("matched")
    return rows.select(id_col).join(best, id_col, "left").select(id_col, F.when(status == "matched", F.col(f"b.{hit}")).alias(hit), F.col("b.tier").cast("long").alias("tier"), status.alias("status"))


def prefix_join(files: DataFrame, sides: DataFrame, directory: str, stem: str, side: str, strict: bool = False) -> DataFrame:
    """Side files of the same directory whose stem starts with the main one's, case aside; strictly: equal, or a prefix before
    one of ``. -_``. Null stems match nothing.

    The join's key is the directory with a beginning of the stem. Strictly, a side file has one row for each beginning that
    ends before such a character, so that all that meet match; else one for each of its first ``BEGINNING`` characters.
    """
    a, b = F.lower(stem), F.lower(side)
    if strict:
        ends = F.filter(F.sequence(F.lit(1), F.length(b)), lambda i: F.substring(b, i + 1, F.lit(1)).isin(".", " ", "-", "_"))
        beginnings = F.array_distinct(F.concat(F.array(b), F.when(b != "", F.transform(ends, lambda i: F.left(b, i))).otherwise(F.array()), F.when(F.left(b, F.lit(1)).isin(".", " ", "-", "_"), F.array(F.lit(""))).otherwise(F.array())))
        key = a
    else:
        beginnings = F.array_distinct(F.array(*[F.left(b, F.lit(n)) for n in range(BEGINNING + 1)]))
        key = F.left(a, F.lit(BEGINNING))
    joined = files.where(F.col(stem).isNotNull()).withColumn("_beginning", key).join(sides.where(F.col(side).isNotNull()).withColumn("_beginning", F.explode(beginnings)), [directory, "_beginning"])
    return (joined if strict else joined.where(F.startswith(b, a))).drop("_beginning")


def name_or_episode(movies: DataFrame, subtitles: DataFrame, directory: str) -> DataFrame:
    """(dir, movie, subtitle): of the subtitles whose stem holds the movie's or whose episode equals it, the first in order.
    Both tables: (dir, stem, episode, pos). Only the first subtitle of an episode or stem can be one's first. A stem
    that holds the movie's holds its first four characters too: they are the join's key, not the directory alone.
    Subtitles without a stem are left out."""
    m = movies.select(directory, F.col("stem").alias("movie"), F.col("episode").alias("_e"))
    s = subtitles.where(F.col("stem").isNotNull()).select(directory, F.col("stem").alias("subtitle"), F.col("episode").alias("_e"), "pos")
    firsts = s.groupBy(directory, "_e").agg(F.min_by("subtitle", "pos").alias("subtitle"), F.min("pos").alias("pos"))
    by_episode = m.distinct().join(firsts, [directory, "_e"]).select(directory, "movie", "subtitle", "pos")
    pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("subtitle") - n + 1)), lambda i: F.substring(F.col("subtitle"), i, n))))
    stems = s.groupBy(directory, "subtitle").agg(F.min("pos").alias("pos")).select("*", F.explode(F.array_distinct(pieces)).alias("_piece"))
    names = m.select(directory, "movie", F.left("movie", F.lit(4)).alias("_piece")).distinct()
    by_name = names.join(stems, [directory, "_piece"]).where(F.contains("subtitle", "movie")).select(directory, "movie", "subtitle", "pos")
    return by_episode.union(by_name).groupBy(directory, "movie").agg(F.min_by("subtitle", "pos").alias("subtitle"))


def first_exact(rows: DataFrame, results: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first result, in order, of each row's key."""
    return rows.join(results.groupBy(key).agg(F.min_by(value, order).alias(value)), key, "left")


def aligned(a: DataFrame, b: DataFrame, group: str, pos: str, value: str) -> DataFrame:
    """(group, complete): equal counts and equal values at every position."""
    left, right = a.select(group, pos, F.col(value).alias("_a"), F.lit(1).alias("_in_a")), b.select(group, pos, F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    same = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull() & F.col("_a").eqNullSafe(F.col("_b"))
    return left.join(right, [group, pos], "full_outer").groupBy(group).agg(F.bool_and(same).alias("complete"))


def reconcile(log: DataFrame, inventory: DataFrame) -> DataFrame:
    """Rename log (src, dst) against the present names (path): (status, n)."""
    here = inventory.select("path").distinct().withColumn("_here", F.lit(True))
    both = log.join(here.select(F.col("path").alias("src"), F.col("_here").alias("_src")), "src", "left").join(here.select(F.col("path").alias("dst"), F.col("_here").alias("_dst")), "dst", "left")
    status = F.when(F.col("_dst").isNull() & F.col("_src").isNotNull(), "already_reverted").when(F.col("_dst").isNull(), "missing").when(F.col("_src").isNotNull(), "conflict").otherwise("reverted")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def assign_intervals(rows: DataFrame, cuts: DataFrame, value: str, cut: str, name: str) -> DataFrame:
    """Rows with ``name`` of the interval (previous cut, cut] they fall into (null past the last cut) and their number
    inside, in the order of values. Of equal cuts the first name counts; rows without a value get neither.

    Rows and cuts are sorted together by ranges and written. Within a range the next cut and the rows since the last
    one are found by windows; what spans ranges comes from a table of one row a range, which is broadcast.
    """
    row_type, kind = T.StructType(rows.schema.fields).simpleString(), dict(cuts.dtypes)[name]
    seen = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("_v"), F.lit(0).alias("_cut"), F.xxhash64(*rows.columns).alias("_tie"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(kind).alias("_name"))
    marks = cuts.where(F.col(cut).isNotNull()).select(F.col(cut).alias("_v"), F.lit(1).alias("_cut"), F.lit(0).cast("long").alias("_tie"), F.lit(None).cast(row_type).alias("_row"), F.col(name).alias("_name"))
    placed = placed_by_ranges(seen.unionByName(marks), ["_v", "_cut", "_tie"], ["_v", "_cut", "_tie", "_name"])
    so_far = W.partitionBy("_part").orderBy("_inside").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy("_part").orderBy(F.desc("_inside")).rowsBetween(W.unboundedPreceding, 0)
    is_cut = F.col("_cut") == 1
    placed = placed.withColumn("_n", F.sum(1 - F.col("_cut")).over(so_far))
    placed = placed.withColumns({
        "_since": F.last(F.when(is_cut, F.col("_n")), ignorenulls=True).over(so_far),
        "_next": F.last(F.when(is_cut, F.struct("_name")), ignorenulls=True).over(ahead),
    })
    ranges = placed.groupBy("_part").agg(
        F.max("_n").alias("_rows"), F.max(F.when(is_cut, F.col("_n"))).alias("_last"),
        F.min_by(F.when(is_cut, F.struct("_name")), F.when(is_cut, F.col("_inside"))).alias("_first"),
    )
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    later = W.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    opened = F.last(F.col("_before") + F.col("_last"), ignorenulls=True).over(earlier)
    ranges = ranges.select("_part", (F.col("_before") - F.coalesce(opened, F.lit(0))).alias("_carried"), F.last("_first", ignorenulls=True).over(later).alias("_follows"))
    found = placed.where(~is_cut).join(F.broadcast(ranges), "_part")
    number = F.col("_n") - F.coalesce(F.col("_since"), -F.col("_carried"))
    out = found.select("_row.*", F.coalesce("_next", "_follows")["_name"].alias(name), number.alias("number"))
    without = rows.where(F.col(value).isNull()).select(*rows.columns, F.lit(None).cast(kind).alias(name), F.lit(None).cast("long").alias("number"))
    return out.unionByName(without)


def unused_definitions(symbols: DataFrame) -> DataFrame:
    """Definitions never called anywhere. ``symbols``: (file, kind, name, pos, container)."""
    return symbols.where("kind = 'def'").join(symbols.where("kind = 'call'").select("name"), "name", "left_anti").select("file", "name")


def called_before_definition(symbols: DataFrame) -> DataFrame:
    """(file, caller, callee): a function that calls one which its file defines later, or itself."""
    defs = symbols.where("kind = 'def'").groupBy("file", "name").agg(F.min("pos").alias("at"))
    calls = symbols.where("kind = 'call' and container is not null").select("file", F.col("container").alias("caller"), F.col("name").alias("callee")).distinct()
    callee, caller = defs.select("file", F.col("name").alias("callee"), F.col("at").alias("callee_at")), defs.select("file", F.col("name").alias("caller"), F.col("at").alias("caller_at"))
    return calls.join(callee, ["file", "callee"]).join(caller, ["file", "caller"]).where("callee_at >= caller_at").select("file", "caller", "callee")


def required_tracks(videos: DataFrame, embedded: DataFrame, external: DataFrame, key: str, required: list[str]) -> DataFrame:
    """(key, language, source): external before embedded, null where a required language is missing."""
    wanted = videos.select(key).distinct().withColumn("language", F.explode(F.array(*map(F.lit, required))))
    mark = lambda d, n: d.select(key, "language").distinct().withColumn(n, F.lit(n))
    joined = wanted.join(mark(external, "external"), [key, "language"], "left").join(mark(embedded, "embedded"), [key, "language"], "left")
    return joined.select(key, "language", F.coalesce("external", "embedded").alias("source"))


def position_pairs(a: DataFrame, b: DataFrame, pos: str, value: str, compare: Callable[[Column, Column], Column]) -> DataFrame:
    """(pos, compared) up to the shorter sequence's length."""
    return a.select(pos, F.col(value).alias("_a")).join(b.select(pos, F.col(value).alias("_b")), pos).select(pos, compare(F.col("_a"), F.col("_b")).alias("compared"))


def lag_pairs(rows: DataFrame, pos: str, value: str, lags: list[int]) -> DataFrame:
    """(lag, pos, a, b) of the values at pos and pos + lag. The rows of all lags are never broadcast: Spark counts them as one row each."""
    shifted = rows.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).select("lag", (F.col(pos) - F.col("lag")).alias(pos), F.col(value).alias("b"))
    return rows.select(pos, F.col(value).alias("a")).join(shifted.hint("merge"), pos).select("lag", pos, "a", "b")
