"""Batch analyses that tell how far they are and can be cancelled."""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyarrow.fs import FileType
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from ..sources.storage import filesystem
from . import preflight

Phase = tuple[str, Callable[[], DataFrame]]
STATUS_SCHEMA = "run string, no int, phase string, state string, seconds double, error string"


class Run:
    """Phases of an analysis, each ending in a written table, one after the other in a thread of their own.

    The folder gets a row in ``status`` when a phase begins and when it ends (``started``, ``done``, ``failed`` or ``cancelled``), and the tables, which count
    only once all phases are done: then ``tables.json`` names them. A run that fails or is cancelled leaves its status and no table.
    """

    def __init__(self, spark: SparkSession, folder: str, phases: Sequence[Phase]):
        self.spark, self.folder, self.phases = spark, folder.rstrip("/"), list(phases)
        self.name = uuid.uuid4().hex
        self.tag = f"strandcheck-{self.name}"
        self.state = "waiting"
        self._cancelled = False
        self._rows = 0
        self._thread = InheritableThread(target=self._work, daemon=True)

    def _write(self, place: str, content: dict) -> None:
        store, inner = filesystem(f"{self.folder}/{place}")
        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(inner) as sink:
            sink.write(json.dumps(content).encode() + b"\n")

    def _note(self, phase: str, state: str, since: float, error: str | None = None) -> None:
        row = {"run": self.name, "no": self._rows, "phase": phase, "state": state, "seconds": round(time.time() - since, 3), "error": error}
        self._write(f"status/{self.name}-{self._rows:05d}.json", row)
        self._rows += 1

    def _drop_tables(self) -> None:
        """Removes what was written; tasks that end late may write on for a moment."""
        store, inner = filesystem(f"{self.folder}/{self.name}")
        for _ in range(20):
            if store.get_file_info(inner).type == FileType.NotFound:
                return
            with contextlib.suppress(OSError):
                store.delete_dir(inner)
            time.sleep(0.5)

    def _work(self) -> None:
        self.spark.sparkContext.addJobTag(self.tag)
        phase, since = "", time.time()
        try:
            for phase, build in self.phases:
                since = time.time()
                self._note(phase, "started", since)
                if not self._cancelled:
                    build().write.parquet(f"{self.folder}/{self.name}/{phase}")
                if self._cancelled:
                    raise InterruptedError("cancelled")
                self._note(phase, "done", since)
            self._write("tables.json", {"run": self.name, "tables": [p for p, _ in self.phases]})
            self.state = "done"
        except Exception as problem:  # noqa: BLE001 - whatever ends a phase ends the run and is told
            self._drop_tables()
            self.state = "cancelled" if self._cancelled else "failed"
            self._note(phase, self.state, since, None if self._cancelled else str(problem)[:1000])

    def start(self) -> Run:
        self.state = "running"
        self._thread.start()
        return self

    def cancel(self) -> None:
        """Ends the jobs of this run, and no others; its status says so when it has ended."""
        self._cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def wait(self, seconds: float | None = None) -> str:
        self._thread.join(seconds)
        return self.state

    def progress(self) -> dict[str, int]:
        """Tasks of the jobs that run for this analysis now, and how many of them are done."""
        tracker = self.spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in self.spark._jsparkSession.sparkContext().statusTracker().getJobIdsForTag(self.tag)]
        stages = [tracker.getStageInfo(s) for j in jobs if j and j.status == "RUNNING" for s in j.stageIds]
        return {"tasks": sum(s.numTasks for s in stages if s), "done": sum(s.numCompletedTasks for s in stages if s)}

    def status(self) -> DataFrame:
        return self.spark.read.schema(STATUS_SCHEMA).json(f"{self.folder}/status").filter(f"run = '{self.name}'")

    def table(self, phase: str) -> DataFrame:
        """A table of the run that is done."""
        if self.state != "done":
            raise ValueError(f"the run is {self.state}, so it has no tables")
        return self.spark.read.parquet(f"{self.folder}/{self.name}/{phase}")


def selection_phases(files: DataFrame, mode: str = "quick") -> list[Phase]:
    """The analysis of a mixed selection in phases: status of all files, metrics, contigs."""
    found: list[preflight.SelectionResult] = []

    def result() -> preflight.SelectionResult:
        if not found:
            found.append(preflight.analyze_files(files, mode))
        return found[0]

    return [
        ("status", lambda: result().status),
        ("metrics", lambda: preflight.bam_metrics(result().bams).unionByName(preflight.fastq_metrics(result().fastqs))),
        ("contigs", lambda: result().contig_summary),
    ]
