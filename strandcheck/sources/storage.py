"""Opening byte ranges of files from tasks, and listing files as a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize, ship_package


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a URI or local path."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return pafs.LocalFileSystem(), path


def open_range(path: str) -> pa.NativeFile:
    """The file for random access; each task opens its own."""
    fs, inner = filesystem(path)
    return fs.open_input_file(inner)


def list_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Files below ``paths`` as ``(path, name, size, modified)``, without content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return found.select(
        "path",
        F.element_at(F.split(F.col("path"), "/"), -1).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        F.lit(0).cast("bigint").alias("position"),
    )


def spread(df: DataFrame, per_task: int | None = None) -> DataFrame:
    """Deals small rows, each a piece of reading work, out to all task slots.

    The number is given, so that adaptive execution does not fold the rows,
    tiny as they are, into one task. With ``per_task`` there are as many tasks
    as the rows need; they are written once so that counting them is cheap.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    if per_task:
        df = materialize(df, "work")
        wanted = max(wanted, -(-df.count() // per_task))
    return df.repartition(max(slots, wanted))


#: Bytes of files that a task reads, be it in one range or in thousands of small ones.
TASK_BYTES = 32 << 20


def spread_bytes(df: DataFrame, size: Column, per_task: int = TASK_BYTES) -> DataFrame:
    """Deals ranges out to as many tasks as their bytes need, so that small ranges don't make many tasks; see :func:`spread`."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    df = materialize(df, "work")
    total = df.agg(F.sum(size).cast("bigint")).first()[0] or 0
    return df.repartition(max(slots, wanted, -(-total // per_task)))


Rows = list[dict[str, Any]] | dict[str, Any]


def _column(value: Any, kind: pa.DataType, n: int) -> pa.Array:
    if isinstance(value, pa.Array):
        return value
    if isinstance(value, list | np.ndarray):
        return pa.array(value, kind)
    return pa.nulls(n, kind) if value is None else pa.repeat(pa.scalar(value, kind), n)


def as_batch(rows: Rows, arrow: pa.Schema) -> pa.RecordBatch | None:
    """Rows or columns as a batch of the columns of ``arrow``; None if there are none."""
    if isinstance(rows, dict):
        n = max(len(v) for v in rows.values() if isinstance(v, list | np.ndarray | pa.Array))
        return pa.RecordBatch.from_arrays([_column(rows.get(f.name), f.type, n) for f in arrow], schema=arrow) if n else None
    return pa.RecordBatch.from_pylist(rows, schema=arrow) if rows else None


def per_row(df: DataFrame, work: Callable[[dict[str, Any]], Iterator[Rows]], schema: str) -> DataFrame:
    """Runs ``work`` for each input row inside the tasks.

    ``work`` yields lists of output rows or columns of equal length, a single
    value standing for all rows; each becomes one Arrow batch, so a task holds
    one at a time however many rows it produces. Columns that are not given
    are NULL.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for rows in work(row):
                    if (found := as_batch(rows, arrow)) is not None:
                        yield found

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)
