"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Bytes of files or of shuffled rows that a task of :func:`small_tasks` takes, and rows of the input for each shuffle partition.
TASK_BYTES, TASK_ROWS = 16 << 20, 250_000
#: Shuffle files of a query go when it has ended, not when the driver happens to collect its garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_UNITS = {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}


def build_session(app: str = "strandcheck", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; cluster settings win.

    Values given on the cluster (spark-submit, spark-defaults) are kept because
    only ``conf`` and options without a cluster-side meaning are set here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Without that setting a fresh local folder is made and remembered on the
    session, but only in local mode, where all tasks see the same disk.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        folder = spark.conf.get("strandcheck.scratch", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strandcheck-")
        spark.conf.set("strandcheck.scratch", folder)
    return folder


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new sub-folder name inside :func:`shared_dir`."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application.

    It goes through the shared folder. Tasks that decode bytes import it, wherever the driver was started from.
    """
    context = spark.sparkContext
    if getattr(context, "_strandcheck_shipped", False):
        return
    from .sources.storage import filesystem

    package = Path(__file__).resolve().parent
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as packed:
        for source in sorted(package.rglob("*.py")):
            packed.write(source, source.relative_to(package.parent))
    folder = fresh_dir(spark, "package")
    store, inner = filesystem(folder)
    store.create_dir(inner, recursive=True)
    with store.open_output_stream(f"{inner}/strandcheck_package.zip") as sink:
        sink.write(content.getvalue())
    context.addPyFile(f"{folder}/strandcheck_package.zip")
    context._strandcheck_shipped = True


def _bytes(setting: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([bkmgt]?)b?", setting.strip().lower()).groups()
    return int(number) << _UNITS[unit]


@contextlib.contextmanager
def small_tasks(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside has tasks of bounded size, however many ``rows`` it begins with.

    The hash tables of an aggregation hold all keys of a task, so their memory follows from its rows. Settings of the
    session are only made finer, and are put back at the end.
    """
    files, shuffled, partitions = (
        "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"
    )
    before = {key: spark.conf.get(key) for key in (files, shuffled, partitions)}
    try:
        for key in (files, shuffled):
            spark.conf.set(key, str(min(_bytes(before[key]), TASK_BYTES)))
        spark.conf.set(partitions, str(max(int(before[partitions]), -(-rows // TASK_ROWS))))
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries begun inside leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP_CONF, None)
    try:
        spark.conf.set(CLEANUP_CONF, "true")
        yield
    finally:
        spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table survives the loss of executors and gives every later
    branch the same rows without recomputing the branch below it. With the
    number of ``rows`` that it begins with, it is computed in :func:`small_tasks`.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    with small_tasks(spark, rows) if rows is not None else contextlib.nullcontext(), _shuffles_freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes what :func:`materialize` wrote, once nothing reads these ``tables`` any more, tables made of them included."""
    from .sources.storage import filesystem

    for path in {t.written_to for t in tables}:
        store, inner = filesystem(path)
        store.delete_dir(inner)
