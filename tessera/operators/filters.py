"""Filters and predicates."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.numbering import numbered


def exclude_values(df: DataFrame, col: str, values: list) -> DataFrame:
    """Rows whose value is none of these; null stays."""
    return df.where(F.col(col).isNull() | ~F.col(col).isin(values))


def below_renumbered(df: DataFrame, col: str, limit: float, order: str, number: str = "number") -> DataFrame:
    """Rows below ``limit``, numbered in input order."""
    return numbered(df.where(F.col(col).cast("double") < limit), [order], number)


def glob_regex(pattern: str) -> str:
    """A shell pattern (* ? [..]) as a regular expression over the whole text, in any case."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[at + 1 :]:
            end = pattern.index("]", at + 1)
            body = pattern[at:end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            at = end + 1
        else:
            out += "\\" + c if not c.isalnum() and c not in "_ " else c
    return f"(?is)^{out}$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Whether the path or its last part fits one of the shell patterns."""
    base = F.substring_index(path, "/", -1)
    return reduce(or_, [path.rlike(glob_regex(p)) | base.rlike(glob_regex(p)) for p in patterns], F.lit(False))


def should_track(path: Column, track: list[str], ignore: list[str]) -> Column:
    """Ignored patterns win; an empty track list tracks everything else."""
    return ~matches_any(path, ignore) & (matches_any(path, track) if track else F.lit(True))


def contains_but_not(text: Column, included: str, excluded: str) -> Column:
    return text.contains(included) & ~text.contains(excluded)


def without_extension(path: Column, ignored: str) -> Column:
    """The last part has no dot, and no folder on the ignore list stands in the path."""
    return ~F.substring_index(path, "/", -1).contains(".") & ~F.lower(path).rlike(ignored)


def is_copy_name(name: Column) -> Column:
    return name.rlike(r"\(\d+\)") | name.contains("copy")


def removal_candidate(path: Column, extensions: list[str], names: list[str], kept: str) -> Column:
    """An extension or exact name on the lists, outside of kept names and folders."""
    base = F.substring_index(path, "/", -1)
    ext = F.lower(F.regexp_extract(base, r"\.([A-Za-z0-9]+)$", 1))
    return (ext.isin(extensions) | base.isin(names)) & ~path.rlike(kept)


def has_year(text: Column) -> Column:
    return text.rlike(r"(?<!\d)(19|20)\d{2}(?!\d)")


def first_tag(name: Column, tags: list[str]) -> Column:
    """The first tag, in list order, that stands in the name in any case."""
    return F.coalesce(*[F.when(F.lower(name).contains(t.lower()), F.lit(t)) for t in tags])


def placement(found: Column, folder: Column) -> Column:
    return F.when(found.isNull(), "unfound").when(found == folder, "correct").otherwise("misplaced")


def unhealthy(size: Column, length: Column, bitrate: Column) -> Column:
    return (size == 0) | (length <= 0) | (bitrate <= 0)


def suspicious(name: Column, size: Column, system: list[str]) -> Column:
    return (name.startswith(".") | F.lower(name).isin(system)) & (size > 0)


def plausible_time(ts: Column, first: str, now: str) -> Column:
    return (ts >= F.lit(first).cast("timestamp_ntz")) & (ts <= F.lit(now).cast("timestamp_ntz") + F.expr("interval 1 day"))


def without_keywords(cols: list[Column], keywords: list[str]) -> Column:
    """No keyword occurs in any of the columns, in any case; null columns hold none."""
    return ~reduce(or_, [F.coalesce(F.lower(c).contains(k.lower()), F.lit(False)) for c in cols for k in keywords])


def missing_lines(lines: DataFrame, key: str, line: str, required: list[str]) -> DataFrame:
    """(key, line) once for each required line that a key lacks."""
    wanted = lines.select(key).distinct().withColumn(line, F.explode(F.array(*map(F.lit, required))))
    return wanted.join(lines.select(key, line), [key, line], "left_anti")


def missing_fields(text: Column, fields: list[str]) -> Column:
    """Fields whose name does not occur in the text, in any case."""
    return F.filter(F.array(*map(F.lit, fields)), lambda f: ~F.contains(F.lower(text), f))


def bib_entries(df: DataFrame, text_col: str, required: dict[str, list[str]]) -> DataFrame:
    """(type, citekey, missing) of each bibliography entry; entries without a key are dropped."""
    entries = df.select(F.explode(F.split(text_col, "@")).alias("entry")).where(F.trim("entry") != "")
    entries = entries.select(F.lower(F.regexp_extract("entry", r"^\s*(\w+)\s*\{", 1)).alias("type"), F.trim(F.regexp_extract("entry", r"\{\s*([^,\s]+)\s*,", 1)).alias("citekey"), "entry")
    fields = F.create_map(*[x for k, v in required.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    wanted = F.coalesce(F.element_at(fields, F.col("type")), F.array().cast("array<string>"))
    return entries.where("citekey <> '' and type <> ''").select("type", "citekey", F.filter(wanted, lambda f: ~F.contains(F.lower("entry"), f)).alias("missing"))


def class_name(name: Column, path: Column) -> Column:
    """A name with a dot as it is; else the package between ``/src/`` and the last dot of the path."""
    package = F.replace(F.regexp_extract(path, r"/src/(.*)\.[^.]*$", 1), F.lit("/"), F.lit("."))
    return F.when(name.contains("."), name).otherwise(package)


FLAG_VALUES = ["1", "true", "yes"]


def stream_flagged(disposition: Column, flag: str, texts: list[Column], tags: Column, keywords: list[str]) -> Column:
    """The disposition sets the flag, or a keyword stands in one of the texts or a tag's value."""
    held = lambda c: reduce(or_, [F.coalesce(F.lower(c).contains(k), F.lit(False)) for k in keywords])
    return F.coalesce(F.lower(F.element_at(disposition, flag)).isin(FLAG_VALUES), F.lit(False)) | reduce(or_, map(held, texts), F.lit(False)) | F.coalesce(F.exists(F.map_values(tags), held), F.lit(False))
