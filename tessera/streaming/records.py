"""A log of records as a streaming source whose progress is a record: a stopped job goes on behind the last one it finished.

The log is a folder of Parquet files that are read in the order of their names; what comes later has larger names. Files of a
folder count once its ``_SUCCESS`` is there, and hidden ones never.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


@dataclass
class Rows(InputPartition):
    """Rows ``first`` (counted from 0) up to ``end`` of one file; without ``end`` all that follow."""

    file: str
    first: int
    end: int | None


class RecordLogReader(DataSourceStreamReader):
    """Offsets are a file's name below the log and the number of its rows that are done."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.schema = options["path"], schema
        self.records = int(options["records"]) if options.get("records") is not None else None
        self.reached = json.loads(options.get("reached") or "{}") or self.initialOffset()

    def _files(self) -> list[str]:
        store, root = pafs.FileSystem.from_uri(self.path)
        found = store.get_file_info(pafs.FileSelector(root, recursive=True))
        names = sorted(f.path[len(root.rstrip("/")) + 1 :] for f in found if f.type == pafs.FileType.File)
        done = {n.rpartition("/")[0] for n in names if n.rpartition("/")[2] == "_SUCCESS"}
        seen = [n for n in names if n.endswith(".parquet") and not any(p[0] in "._" for p in n.split("/"))]
        return [n for n in seen if n.rpartition("/")[0] in done]

    def _length(self, file: str) -> int:
        store, root = pafs.FileSystem.from_uri(self.path)
        with store.open_input_file(f"{root.rstrip('/')}/{file}") as f:
            return pq.ParquetFile(f).metadata.num_rows

    def initialOffset(self) -> dict:
        return {"file": "", "row": 0}

    def latestOffset(self) -> dict:
        """The end of the log, or the place behind its first ``records`` records, but nothing before the place reached so far."""
        return max(self._end(), self.reached, key=lambda offset: (offset["file"], offset["row"]))

    def _end(self) -> dict:
        files = self._files()
        if not files:
            return self.initialOffset()
        if self.records is None:
            return {"file": files[-1], "row": self._length(files[-1])}
        left = self.records
        for file in files:
            n = self._length(file)
            if left <= n or file == files[-1]:
                return {"file": file, "row": min(left, n)}
            left -= n

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        out = []
        for file in self._files():
            if start["file"] <= file <= end["file"]:
                first, last = start["row"] if file == start["file"] else 0, end["row"] if file == end["file"] else None
                if last is None or first < last:
                    out.append(Rows(file, first, last))
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(self.path)
        wanted = to_arrow_schema(self.schema)
        with store.open_input_file(f"{root.rstrip('/')}/{partition.file}") as f:
            file, at = pq.ParquetFile(f), 0
            for group in range(file.metadata.num_row_groups):
                n, before = file.metadata.row_group(group).num_rows, at
                at += n
                if at <= partition.first or (partition.end is not None and before >= partition.end):
                    continue
                for batch in file.iter_batches(row_groups=[group], columns=self.schema.names):
                    first = max(0, partition.first - before)
                    end = batch.num_rows if partition.end is None else min(batch.num_rows, partition.end - before)
                    if first < end:
                        yield from pa.Table.from_batches([batch.slice(first, end - first)]).select(self.schema.names).cast(wanted).to_batches()
                    before += batch.num_rows


class RecordLog(DataSource):
    """``spark.readStream.format("record_log")`` with ``path``, a schema, and ``records`` where a run ends early."""

    @classmethod
    def name(cls) -> str:
        return "record_log"

    def schema(self) -> str:
        raise ValueError("record_log needs a schema")

    def streamReader(self, schema: StructType) -> RecordLogReader:
        return RecordLogReader(dict(self.options), schema)


def append_log(df: DataFrame, log: str, name: str, order: list[Column | str]) -> None:
    """Writes ``df`` as the log's files below ``name``, in the given order over all files; names must grow."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{log}/{name}")


def reached(spark: SparkSession, progress: str) -> str:
    """The last offset that a checkpoint plans to reach, as JSON; empty where nothing ran yet. Spark keeps one small file a batch, of the last 100."""
    try:
        planned = spark.read.text(f"{progress}/offsets", wholetext=True).select(F.input_file_name().alias("name"), "value").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        planned = []
    return max(planned, key=lambda r: int(r.name.rpartition("/")[2])).value.splitlines()[-1] if planned else ""


def resume(spark: SparkSession, log: str, schema: StructType, progress: str, run: Callable[[DataFrame, int], None], records: int | None = None) -> None:
    """Runs ``run(batch, number)`` once over the records behind the last finished one, up to the log's end or to its first
    ``records`` records. A run that failed is run again with the same records and number, so that a ``run`` which replaces what
    its number wrote takes each record exactly once. Records never come back, also where ``records`` lies before the progress."""
    spark.dataSource.register(RecordLog)
    stream = spark.readStream.format("record_log").schema(schema).options(path=log, reached=reached(spark, progress))
    stream = stream.load() if records is None else stream.option("records", str(records)).load()
    stream.writeStream.foreachBatch(run).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
