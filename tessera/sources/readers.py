"""Readers: distributed scans with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ";") -> DataFrame:
    """CSV with a header; a row that does not fit the schema is kept whole in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, {CORRUPT} string").option("sep", sep).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_csv_required_columns(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """The required columns of a CSV, as text; ValueError where the header lacks one."""
    df = spark.read.option("header", True).csv(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*required)


def read_snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files in ``{number}-{hash}`` directories, which ``column=`` may lead, with commit_number and commit_hash from the directory's name."""
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return df.withColumns({"commit_number": F.regexp_extract(name, r"^(?:\w+=)?(\d+)-", 1).cast("int"), "commit_hash": F.regexp_extract(name, r"^(?:\w+=)?\d+-(.+)$", 1)})


def read_nested_json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """JSON documents: one a file, which may span lines, or else one a line."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def nested_issue_titles(issues: DataFrame) -> DataFrame:
    return issues.select(F.col("issue_data.title").alias("title"))


def read_xml_games(spark: SparkSession, path: str) -> DataFrame:
    """(name, app_id, hours) of the ``game`` elements; missing hours are 0, commas go, rows without name or id are dropped."""
    raw = spark.read.format("xml").option("rowTag", "game").schema("name string, appID string, hoursOnRecord string").load(path)
    return games_of(raw)


def games_of(raw: DataFrame) -> DataFrame:
    hours = F.coalesce(F.regexp_replace("hoursOnRecord", ",", "").cast("double"), F.lit(0.0))
    return raw.where((F.coalesce(F.trim("name"), F.lit("")) != "") & (F.coalesce(F.trim("appID"), F.lit("")) != "")).select("name", F.col("appID").alias("app_id"), hours.alias("hours"))


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are not blank."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def nonblank_lines(df: DataFrame, text_col: str) -> DataFrame:
    """(…, pos, line) of each text's lines that are not blank, trimmed."""
    rest = [c for c in df.columns if c != text_col]
    return df.select(*rest, F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")


def scan_file_inventory(spark: SparkSession, path: str, extensions: list[str] | None = None, ignored_dirs: str = "", ignored_names: str = "", glob: str = "*") -> DataFrame:
    """(path, dir, name, ext, size) of the files below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", F.col("length").alias("size"))
    return inventory_of(files, extensions, ignored_dirs, ignored_names)


def inventory_of(files: DataFrame, extensions: list[str] | None = None, ignored_dirs: str = "", ignored_names: str = "") -> DataFrame:
    """The same from a table (path, size). ``ignored_*`` are regular expressions; empty ones ignore nothing."""
    name = F.substring_index("path", "/", -1)
    directory = F.expr("substr(path, 1, greatest(0, length(path) - length(substring_index(path, '/', -1)) - 1))")
    out = files.select("path", directory.alias("dir"), name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), "size")
    if extensions is not None:
        out = out.where(F.col("ext").isin(extensions))
    if ignored_dirs:
        out = out.where(~F.col("dir").rlike(ignored_dirs))
    return out.where(~F.col("name").rlike(ignored_names)) if ignored_names else out


def read_feature_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(label, features) of white-space separated numbers, the label first."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, 0).cast("double").alias("label"), F.transform(F.slice(parts, 2, 1 << 30), lambda x: x.cast("double")).alias("features"))


def dated_file(name: Column, prefix: str = "fatura") -> Column:
    """The date in ``Prefix(YYYY-MM-DD).csv``, in any case; null where there is none or it is no date."""
    return F.try_to_date(F.nullif(F.regexp_extract(name, rf"(?i)^{prefix}\((\d{{4}}-\d{{2}}-\d{{2}})\)\.csv$", 1), F.lit("")), "yyyy-MM-dd")
