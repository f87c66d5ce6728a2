"""Functions from a row to rows."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "file string, kind string, name string, pos long, container string"


def _symbols(path: str, source: str | None) -> Iterator[tuple]:
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        yield path, "error", "", 0, None
        return

    def walk(node: ast.AST, container: str | None) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            inside = container
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield path, "def", child.name, child.lineno, container
                inside = child.name
            elif isinstance(child, ast.Call):
                name = child.func.id if isinstance(child.func, ast.Name) else child.func.attr if isinstance(child.func, ast.Attribute) else None
                if name:
                    yield path, "call", name, child.lineno, container
            elif isinstance(child, ast.Import):
                for a in child.names:
                    yield path, "import", a.name, child.lineno, container
            elif isinstance(child, ast.ImportFrom):
                yield path, "import", child.module or ".", child.lineno, container
            yield from walk(child, inside)

    yield from walk(tree, None)


def source_symbols(files: DataFrame) -> DataFrame:
    """(file, kind, name, pos, container) of the source files in ``files`` (path, source): definitions, calls
    and imports, ``container`` being the function around; a source that does not parse gives one 'error' row."""
    def run(batches):
        for batch in batches:
            rows = [s for p, t in zip(batch["path"], batch["source"], strict=True) for s in _symbols(p, t)]
            yield pd.DataFrame(rows, columns=["file", "kind", "name", "pos", "container"])

    return files.select("path", "source").mapInPandas(run, SYMBOLS)


CUE_TIME = r"^(\d{2}):(\d{2}):(\d{2}),(\d{3}) --> (\d{2}):(\d{2}):(\d{2}),(\d{3})$"


def explode_blocks(df: DataFrame, text_col: str) -> DataFrame:
    """(…, pos, lines) of the blocks that blank lines part."""
    rest = [c for c in df.columns if c != text_col]
    blocks = df.select(*rest, F.posexplode(F.split(text_col, r"\n[ \t]*\n")).alias("pos", "_b"))
    lines = F.filter(F.split("_b", "\n"), lambda x: F.trim(x) != "")
    return blocks.select(*rest, "pos", lines.alias("lines")).where(F.size("lines") > 0)


def explode_cues(df: DataFrame, text_col: str) -> DataFrame:
    """(…, pos, index, start_ms, end_ms, lines, valid): a valid block has a number, a timing and a line at least."""
    rest = [c for c in df.columns if c != text_col]
    first, timing = F.trim(F.get("lines", 0)), F.trim(F.coalesce(F.get("lines", 1), F.lit("")))
    ms = lambda a: (((g(a) * 60 + g(a + 1)) * 60 + g(a + 2)) * 1000 + g(a + 3))
    g = lambda i: F.regexp_extract(timing, CUE_TIME, i).cast("long")
    valid = first.rlike(r"^\d+$") & timing.rlike(CUE_TIME) & (F.size("lines") > 2)
    some = lambda c: F.when(valid, c)
    return explode_blocks(df, text_col).select(*rest, "pos", some(first.cast("int")).alias("index"), some(ms(1)).alias("start_ms"), some(ms(5)).alias("end_ms"), F.when(valid, F.slice("lines", 3, 1 << 30)).otherwise(F.col("lines")).alias("lines"), valid.alias("valid"))


def collection_lines(df: DataFrame, line_col: str) -> DataFrame:
    """``Name (1999) [a][b]`` as name, year and icons; ``accepted`` is false for other lines."""
    pattern = r"^(.+?)\s*\(((?:19|20)\d{2})\)\s*((?:\[[^\]]+\])*)$"
    g = lambda i: F.regexp_extract(line_col, pattern, i)
    ok = F.col(line_col).rlike(pattern)
    return df.withColumns({"accepted": ok, "name": F.when(ok, g(1)), "year": F.when(ok, g(2).cast("int")), "icons": F.when(ok, F.regexp_extract_all(g(3), F.lit(r"\[([^\]]+)\]"), 1))})


def bib_entries(df: DataFrame, text_col: str) -> DataFrame:
    """(…, pos, type, citekey, body) of the entries of a bibliography."""
    rest = [c for c in df.columns if c != text_col]
    entry = df.select(*rest, F.posexplode(F.split(text_col, "@")).alias("pos", "_e")).where("pos > 0")
    g = lambda i: F.regexp_extract("_e", r"(?s)^\s*(\w+)\s*\{\s*([^,\s]*)\s*,(.*)$", i)
    return entry.select(*rest, "pos", F.lower(g(1)).alias("type"), g(2).alias("citekey"), g(3).alias("body")).where("citekey <> ''")
