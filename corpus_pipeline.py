"""The corpus pipeline: language, boilerplate lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
one's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, language, line_dedup, ngram_join, packing
from tessera.llm.shared import written

#: Least probability of the predicted language.
MIN_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language stays in doubt; lang becomes the prediction."""
    model = language.train(docs.where(~language.held_out()))
    judged = language.predict(docs, model, docs.columns)
    kept = judged.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MIN_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes boilerplate lines; a document of nothing but such lines goes, its lines' first places stay."""
    found = line_dedup.remove_boilerplate(docs)
    kept = found.where((F.col("n_removed") == 0) | (F.btrim("kept_text", F.lit(" \t\r\n")) != ""))
    return kept.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, that of the smallest id, and all rows without words."""
    return ngram_join.one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into token sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", language_stage), ("line_dedup", line_stage), ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage), ("packing", packing_stage),
]

#: Language prediction, edit distances and token ids have no SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
