"""A sink of rows with keys: what is written with a known key replaces the older row, and a write is seen as a whole or not at all.

Tasks write files of their own into a folder of their job; only the driver's commit, which adds one entry to the log, makes them
part of the table. So a task that is tried again, runs twice or belongs to a job that fails leaves nothing that a reader
sees, and the files of such a job are removed. Rows carry the number of their write; readers keep a key's last row, of
equal keys in one write the one that is largest as a whole. One job at a time commits: a second one with the same number fails.

The folder is any that pyarrow can open on the driver and all executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "glosswork_keyed"
NUMBER = "__write"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _log(path: str) -> list[str]:
    """The log's entries, oldest first."""
    store, root = _opened(path)
    entries = store.get_file_info(fs.FileSelector(f"{root}/log", allow_not_found=True))
    return sorted(e.path for e in entries if e.path.endswith(".json"))


@dataclass
class Staged(WriterCommitMessage):
    file: str
    rows: int


class KeyedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        self.number = len(_log(path))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root = _opened(self.path)
        name, rows, out = f"data/{self.number:010d}-{self.job}/{uuid.uuid4().hex}.parquet", 0, None
        store.create_dir(f"{root}/data/{self.number:010d}-{self.job}")
        try:
            for batch in iterator:
                batch = batch.append_column(NUMBER, pa.array([self.number] * batch.num_rows, pa.int64()))
                out = out or pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=store)
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Staged(name if out is not None else "", rows)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = _opened(self.path)
        entry = f"{root}/log/{self.number:010d}.json"
        store.create_dir(f"{root}/log")
        if len(_log(self.path)) != self.number:
            self.abort(messages)
            raise RuntimeError(f"another job has committed write {self.number}")
        with store.open_output_stream(f"{entry}.{self.job}") as out:
            out.write(json.dumps({"overwrite": self.overwrite, "files": sorted(m.file for m in messages if m and m.file)}).encode())
        store.move(f"{entry}.{self.job}", entry)

    def abort(self, messages: list[Staged | None]) -> None:
        store, root = _opened(self.path)
        folder = f"{root}/data/{self.number:010d}-{self.job}"
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class KeyedRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> KeyedWriter:
        return KeyedWriter(self.options["path"], overwrite)


def replace(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Adds a write to the table: its rows replace those with their keys, or all rows that were there."""
    spark = rows.sparkSession
    spark.dataSource.register(KeyedRows)
    rows.write.format(NAME).mode("overwrite" if overwrite else "append").save(path)


def read(spark: SparkSession, path: str, keys: list[str], schema: str) -> DataFrame:
    """The last row of each key (null is one), in the order of the schema's columns."""
    store, root = _opened(path)
    files: list[str] = []
    for entry in _log(path):
        with store.open_input_stream(entry) as log:
            found = json.loads(log.read())
        files = [*([] if found["overwrite"] else files), *found["files"]]
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, {NUMBER} long").parquet(*[f"{path.rstrip('/')}/{f}" for f in files])
    columns = [c for c in rows.columns if c != NUMBER]
    last = rows.groupBy(*keys).agg(F.max(F.struct(NUMBER, *[c for c in columns if c not in keys])).alias("last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"last.{c}") for c in columns])
