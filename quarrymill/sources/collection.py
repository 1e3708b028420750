"""A collection of rows that runs are added to as a whole: a data source whose commit publishes and whose abort removes.

A run's tasks write Parquet files to a folder of this attempt; the driver's commit puts one small file beside them that names the folder.
Readers see the folders that are named. A failed run's folder is deleted, and so are files of tasks that were tried more than once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

RUNS = "_runs"


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class CollectionWriter(DataSourceArrowWriter):
    def __init__(self, path: str, run_id: str) -> None:
        self.path, self.run_id, self.folder = path.rstrip("/"), run_id, f"{run_id}-{uuid.uuid4().hex}"

    def _system(self) -> tuple[arrow_fs.FileSystem, str]:
        return arrow_fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file a task, batch by batch; an empty task writes none."""
        system, root = self._system()
        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        system.create_dir(f"{root}/{self.folder}")
        try:
            for batch in iterator:
                if batch.num_rows:
                    out = out or pq.ParquetWriter(f"{root}/{self.folder}/{name}", batch.schema, filesystem=system)
                    out.write_batch(batch)
                    rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name if rows else "", rows)

    def commit(self, messages: list[Written | None]) -> None:
        """A run that was committed before adds nothing."""
        system, root = self._system()
        mark, own = f"{root}/{RUNS}/{self.run_id}.json", f"{root}/{self.folder}"
        if system.get_file_info(mark).type != arrow_fs.FileType.NotFound:
            return self._remove()
        kept = {m.name for m in messages if m is not None}
        for info in system.get_file_info(arrow_fs.FileSelector(own, allow_not_found=True)):
            if info.base_name not in kept:
                system.delete_file(info.path)
        system.create_dir(f"{root}/{RUNS}")
        with system.open_output_stream(f"{own}.json") as out:
            out.write(json.dumps({"run_id": self.run_id, "folder": self.folder, "rows": sum(m.rows for m in messages if m is not None)}).encode())
        system.move(f"{own}.json", mark)  # seen as a whole or not at all

    def abort(self, messages: list[Written | None]) -> None:
        self._remove()

    def _remove(self) -> None:
        system, root = self._system()
        if system.get_file_info(f"{root}/{self.folder}").type != arrow_fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.folder}")


class Collection(DataSource):
    """df.write.format("collection").mode("append").option("run", run_id).save(path)"""

    @classmethod
    def name(cls) -> str:
        return "collection"

    def writer(self, schema, overwrite: bool) -> CollectionWriter:
        if overwrite:
            raise ValueError("runs are added to a collection; it isn't overwritten")
        return CollectionWriter(self.options["path"], self.options.get("run") or uuid.uuid4().hex)


def add_run(df: DataFrame, path: str, run_id: str | None = None) -> str:
    """Adds the rows of df to a collection as one run: all of them or none. The same run added again adds nothing. path is a folder
    that driver and executors share."""
    run_id = run_id or uuid.uuid4().hex
    df.sparkSession.dataSource.register(Collection)
    df.write.format("collection").mode("append").option("run", run_id).save(path)
    return run_id


def committed(spark: SparkSession, path: str) -> list[dict]:
    """run_id, folder and rows of the runs that are in the collection."""
    system, root = arrow_fs.FileSystem.from_uri(path.rstrip("/"))
    marks = system.get_file_info(arrow_fs.FileSelector(f"{root}/{RUNS}", allow_not_found=True))
    return [json.loads(system.open_input_stream(m.path).read()) for m in sorted(marks, key=lambda m: m.path)]


def read_collection(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed runs."""
    folders = [f"{path.rstrip('/')}/{run['folder']}" for run in committed(spark, path) if run["rows"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def remove_run(spark: SparkSession, path: str, run_id: str) -> None:
    """Takes a committed run back: its mark first, so that no reader finds a mark without its folder."""
    system, root = arrow_fs.FileSystem.from_uri(path.rstrip("/"))
    for run in committed(spark, path):
        if run["run_id"] == run_id:
            system.delete_file(f"{root}/{RUNS}/{run_id}.json")
            system.delete_dir(f"{root}/{run['folder']}")
