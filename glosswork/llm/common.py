"""Shared helpers of the training-data operators: Arrow text access, hashing, checkpoints."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), element by element."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def salt(k: int) -> np.uint64:
    """A 64-bit constant for a small number."""
    return U64(k * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as uniform numbers in (0, 1)."""
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def released() -> None:
    """Gives memory that is free in this process back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that gives its memory back at the end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    return wrapped


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    return body, ends - (ends[0] if len(ends) else 0)


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes, one row at least, so that numpy's temporaries stay bounded."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def stable(df: DataFrame) -> DataFrame:
    """The rows written to the cluster's shared checkpoint folder and read back; lineage ends there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


# Written tables of each open `scratch`, the innermost last, after those that are not in any.
_tables: list[list[tuple[SparkSession, str]]] = [[]]
_databases: dict[str, str] = {}
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _database(spark: SparkSession) -> str:
    """A database of the application's own in the shared folder, so that dropping a table deletes its files."""
    app = spark.sparkContext.applicationId
    if app not in _databases:
        name = f"scratch_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {name} LOCATION '{shared_dir(spark).rstrip('/')}/{name}'")
        _databases[app] = name
    return _databases[app]


def written(df: DataFrame) -> DataFrame:
    """The rows written as a table in the shared folder and read back, as DataFrame operations only; lineage ends there.

    The shuffle files of the job go when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    name = f"{_database(spark)}.t_{uuid.uuid4().hex}"
    _tables[-1].append((spark, name))
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        df.write.saveAsTable(name, format="parquet")
    finally:
        spark.conf.set(RELEASE, before)
    table = spark.table(name)
    table.scratch_name = name
    return table


def _dropped(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, name in tables:
        if spark.sparkContext.applicationId in _databases:  # else the application has ended since
            spark.sql(f"DROP TABLE IF EXISTS {name}")


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written within go at the end, but for those of rows that go through the function it gives."""
    _tables.append([])

    def kept(df: DataFrame) -> DataFrame:
        own = _tables.pop()
        try:
            return written(df)
        finally:
            _tables.append(own)

    try:
        yield kept
    finally:
        _dropped(_tables.pop())


def cleared(*keep: DataFrame) -> None:
    """Drops all tables that were written and are not in an open `scratch`, but for those given: call it once the rows made of them have been saved."""
    names = {getattr(df, "scratch_name", None) for df in keep}
    _dropped([x for x in _tables[0] if x[1] not in names])
    _tables[0][:] = [x for x in _tables[0] if x[1] in names]


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where none is set and all runs in one process, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    return configured or tempfile.mkdtemp(prefix="checkpoints-")


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """df with, for each name, the sum of an expression over the rows before in the order, which must be total.

    Rows are dealt by ranges of the order and each range is summed on its own; only the sums of whole ranges are
    ordered in one task, one row a partition.
    """
    ranged = written(df.repartitionByRange(*order).withColumns({**{f"__{k}": x for k, x in sums.items()}, "__range": F.spark_partition_id()}))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    wholes = ranged.groupBy("__range").agg(*[F.sum(f"__{k}").alias(f"__all_{k}") for k in sums])
    starts = wholes.select("__range", *[F.coalesce(F.sum(f"__all_{k}").over(before), F.lit(0)).alias(f"__from_{k}") for k in sums])
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumns({f"__{k}": F.coalesce(F.sum(f"__{k}").over(within), F.lit(0)) for k in sums})
    return rows.join(starts, "__range").select(*df.columns, *[(F.col(f"__{k}") + F.col(f"__from_{k}")).alias(k) for k in sums])


def unused(df: DataFrame) -> str:
    """A prefix that no column of df begins with, for columns beside its own."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
