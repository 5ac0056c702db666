"""Progressive sampling: waves of seek points until the sample is stable.

A Structured Streaming query takes waves as they come in and keeps, per file, its running sample in the state store: histograms, seen barcodes,
the last checkpoint. The number of a wave is the order of events: one that comes early is held back in the state until the waves
before it are there, so the times of the wave files don't matter, and no wave is read twice. A file that is stable, or has enough records, lets its
later waves pass unread. The checkpoint makes a restarted run go on where it stopped, and stopping the query cancels it.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.constants import CHECKPOINT_RECORDS, CHECKPOINTS_NEEDED, RECORD_TARGET
from ..operators.convergence import FIELDS, TOLERANCES
from ..session import fresh_dir, ship_package

#: Parts that the barcodes of a file are kept in, so that a wave touches those of its own barcodes only.
BARCODE_PARTS = 256
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SNAPSHOT_SCHEMA = (
    "file string, point_no int, records bigint, exonic_fraction double, barcode_rate double, mapq_median bigint, read_length_median bigint, "
    "checkpoints bigint, crossed bigint, stable boolean, stop_here boolean, past_stop boolean"
)
_TOTALS = (
    "wave int, done boolean, records bigint, exonic bigint, barcodes bigint, stopped boolean, agree boolean, "
    "exonic_fraction double, barcode_rate double, mapq_median bigint, read_length_median bigint"
)

_HISTOGRAM = "value array<bigint>, n array<bigint>"

Take = Callable[[pd.DataFrame], pd.DataFrame]


def write_waves(rows: DataFrame, size: int, folder: str) -> DataFrame:
    """Writes ``rows`` (``file``, ``point_no`` and more) by waves of ``size`` points; gives their schema.

    Each row tells its ``wave``, the wave of its file before that (``after``), and how many rows its file has in the wave (``due``).
    """
    waves = rows.withColumn("wave", F.floor(F.col("point_no") / size).cast("int"))
    sizes = waves.groupBy("file", "wave").agg(F.count(F.lit(1)).alias("due"))
    order = Window.partitionBy("file").orderBy("wave")  # at most as many as a file has points
    numbered = waves.join(sizes.withColumn("after", F.coalesce(F.lag("wave").over(order), F.lit(-1))), ["file", "wave"])
    numbered.withColumn("of_wave", F.col("wave")).repartition("file", "wave").write.partitionBy("of_wave").parquet(folder)
    return numbered


def _lower_median(histogram: dict[int, int]) -> int | None:
    total, seen = sum(histogram.values()), 0
    for value in sorted(histogram):
        seen += histogram[value]
        if 2 * seen > total - 1:
            return value
    return None


class _Sample:
    """The running sample of one file."""

    def __init__(self, state: _State, batch: int):
        self.state, self.batch = state, batch
        self.wave, self.done, self.records, self.exonic, self.barcodes, self.stopped, self.agree, *last = state.totals.get() or (-1, False, 0, 0, 0, False, None, *(None,) * 4)
        self.last = None if self.agree is None else tuple(last)
        self.mapq, self.lengths = (dict(zip(*h.get(), strict=True)) if h.exists() else {} for h in (state.mapq, state.lengths))

    def _new_barcodes(self, found: Iterator[str]) -> int:
        parts: dict[int, set[str]] = {}
        for barcode in found:
            parts.setdefault(zlib.crc32(barcode.encode()) % BARCODE_PARTS, set()).add(barcode)
        new = 0
        for part, barcodes in parts.items():
            known = self.state.barcodes.getValue((part,))[0].split("\n") if self.state.barcodes.containsKey((part,)) else []
            fresh = barcodes.difference(known)
            if fresh:
                self.state.barcodes.updateValue((part,), ("\n".join([*known, *sorted(fresh)]),))
            new += len(fresh)
        return new

    def point(self, rows: pd.DataFrame) -> dict[str, Any]:
        """Takes the records of a point in; gives the snapshot after it."""
        before = self.records // self.batch
        self.records += len(rows)
        self.exonic += int((rows["re"] == "E").sum())
        self.barcodes += self._new_barcodes(b for b in rows["cb"].dropna().unique() if b)
        for histogram, column in ((self.mapq, "mapq"), (self.lengths, "l_seq")):
            for value, n in rows[column].value_counts().items():
                histogram[int(value)] = histogram.get(int(value), 0) + int(n)
        values = (self.exonic / self.records, self.barcodes / self.records, _lower_median(self.mapq), _lower_median(self.lengths))
        checkpoints = self.records // self.batch
        crossed = checkpoints - before
        if crossed:
            near = self.last is not None and all(abs(a - b) <= t for a, b, t in zip(values, self.last, TOLERANCES, strict=True))
            self.agree, self.last = crossed > 1 or near, values
        stable = checkpoints >= CHECKPOINTS_NEEDED and bool(self.agree)
        past, self.stopped = self.stopped, self.stopped or stable
        return dict(zip(FIELDS, values, strict=True)) | {
            "records": self.records, "checkpoints": checkpoints, "crossed": crossed, "stable": stable,
            "stop_here": stable and not past, "past_stop": past,
        }

    def store(self) -> None:
        self.state.totals.update((self.wave, self.done, self.records, self.exonic, self.barcodes, self.stopped, self.agree, *(self.last or (None,) * 4)))
        for kept, histogram in ((self.state.mapq, self.mapq), (self.state.lengths, self.lengths)):
            kept.update((list(histogram), list(histogram.values())))


def _packed(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


class _State(StatefulProcessor):
    """Per file: takes waves in order, emits a snapshot after each point."""

    def __init__(self, take: Take | None, batch: int, target: int):
        self.take, self.batch, self.target = take, batch, target

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", _TOTALS)
        self.mapq = handle.getValueState("mapq", _HISTOGRAM)
        self.lengths = handle.getValueState("lengths", _HISTOGRAM)
        self.barcodes = handle.getMapState("barcodes", "part int", "known string")
        # a part of a wave each, so that taking one in costs no more than its own rows
        self.waiting = handle.getMapState("waiting", "after int", "wave int, rows bigint, due bigint, parts int")
        self.held = handle.getMapState("held", "after int, part int", "rows binary")

    def _hold(self, frames: Iterator[pd.DataFrame], passed: int) -> None:
        for frame in frames:
            for (after, wave, due), rows in frame.groupby(["after", "wave", "due"]):
                if wave <= passed:
                    continue
                key = (int(after),)
                _, n, _, parts = self.waiting.getValue(key) if self.waiting.containsKey(key) else (0, 0, 0, 0)
                self.held.updateValue((int(after), parts), (_packed(rows),))
                self.waiting.updateValue(key, (int(wave), n + len(rows), int(due), parts + 1))

    def _released(self, after: int, parts: int) -> pd.DataFrame:
        """The rows of a wave that is whole, which are held no longer."""
        frames = []
        for part in range(parts):
            frames.append(pa.ipc.open_stream(self.held.getValue((after, part))[0]).read_pandas())
            self.held.removeKey((after, part))
        self.waiting.removeKey((after,))
        return pd.concat(frames)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sample = _Sample(self, self.batch)
        if sample.done:
            for _ in rows:
                pass
            return
        self._hold(rows, sample.wave)
        out: list[dict[str, Any]] = []
        while not sample.done and self.waiting.containsKey((sample.wave,)):
            wave, n, due, parts = self.waiting.getValue((sample.wave,))
            if n < due:
                break  # the rest of the wave is still to come
            points = self._released(sample.wave, parts)
            found = self.take(points) if self.take else points
            for point, records in found.groupby("point_no", sort=True):
                out.append({"file": key[0], "point_no": int(point)} | sample.point(records))
            sample.wave = wave
            sample.done = sample.stopped or sample.records >= self.target
        if sample.done:
            self.held.clear()
            self.waiting.clear()
        sample.store()
        if out:
            names = [c.split()[0] for c in SNAPSHOT_SCHEMA.split(", ")]
            yield pd.DataFrame(out)[names].astype({"point_no": "int32"})

    def close(self) -> None:
        pass


def start(
    rows: DataFrame,
    take: Take | None = None,
    wave_size: int = 4,
    batch: int = CHECKPOINT_RECORDS,
    target: int = RECORD_TARGET["deep"],
    waves: str | None = None,
    files_per_trigger: int = 1,
) -> tuple[StreamingQuery, str]:
    """Starts sampling; gives the running query and the folder of its snapshots.

    ``rows`` has ``file``, ``point_no`` and either the records of the points (``mapq l_seq re cb``), or what ``take`` makes records of: a frame
    with the points of a wave goes in, one with ``point_no mapq l_seq re cb`` comes out. Waves are written to the folder ``waves``; with a folder
    that is there already, only its schema is taken from ``rows``.
    """
    spark = rows.sparkSession
    ship_package(spark)
    # the driver's own Python process for state has no path to this package, so the processor travels with its code
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    folder = fresh_dir(spark, "progressive")
    schema = (write_waves(rows, wave_size, f"{folder}/waves") if waves is None else spark.read.parquet(waves).drop("of_wave")).schema
    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", "true")
        .parquet(waves or f"{folder}/waves")
    )
    snapshots = stream.groupBy("file").transformWithStateInPandas(_State(take, batch, target), SNAPSHOT_SCHEMA, "Append", "None")
    running = (
        snapshots.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/snapshots")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    return running, f"{folder}/snapshots"


def result(spark: SparkSession, snapshots: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Snapshots and stop marks of a finished progressive sample."""
    found = spark.read.schema(SNAPSHOT_SCHEMA).parquet(snapshots)
    return found.select(*columns) if columns else found
