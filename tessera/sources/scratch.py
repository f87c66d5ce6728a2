"""Where a job writes tables that it reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``). Only a local session may leave
    it unset and gets a temporary one; elsewhere other machines could not read that."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-tessera-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
