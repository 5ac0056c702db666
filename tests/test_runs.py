"""Runs in phases: status rows, whole tables or none."""

from __future__ import annotations

import os
import time

import pytest
from factory import record, write_bam
from pyspark.sql import functions as F

from strandcheck.plans import runs
from strandcheck.sources.storage import list_files


def states(run):
    return [(r.phase, r.state) for r in run.status().orderBy("no").collect()]


def slow(spark):
    return spark.range(0, 64, 1, 64).mapInPandas(lambda frames: (time.sleep(1) or f for f in frames), "id bigint")


def test_a_run_leaves_its_tables(spark, tmp_path):
    run = runs.Run(spark, str(tmp_path), [("a", lambda: spark.range(5)), ("b", lambda: spark.range(7))]).start()
    assert run.wait(120) == "done" and run.table("b").count() == 7
    assert states(run) == [("a", "started"), ("a", "done"), ("b", "started"), ("b", "done")]


def test_a_cancelled_run_leaves_its_status_and_no_table(spark, tmp_path):
    run = runs.Run(spark, str(tmp_path), [("a", lambda: spark.range(5)), ("b", lambda: slow(spark)), ("c", lambda: spark.range(1))]).start()
    end = time.time() + 60
    while time.time() < end and not (tmp_path / "status").exists():
        time.sleep(0.1)
    while time.time() < end and not (len(states(run)) == 3 and run.progress()["done"]):
        time.sleep(0.2)
    seen = run.progress()
    assert 0 < seen["done"] < seen["tasks"]
    run.cancel()
    assert run.wait(60) == "cancelled"
    assert states(run) == [("a", "started"), ("a", "done"), ("b", "started"), ("b", "cancelled")]
    assert sorted(os.listdir(tmp_path)) == ["status"]
    assert spark.range(3).count() == 3  # other jobs go on
    with pytest.raises(ValueError, match="cancelled"):
        run.table("a")


def test_a_failed_run_says_why(spark, tmp_path):
    run = runs.Run(spark, str(tmp_path), [("a", lambda: spark.range(5)), ("b", lambda: spark.range(5).select(F.raise_error(F.lit("no good"))))]).start()
    assert run.wait(120) == "failed" and "no good" in run.status().filter("state = 'failed'").first().error
    assert sorted(os.listdir(tmp_path)) == ["status"]


def test_a_selection_as_a_run(spark, tmp_path):
    write_bam(str(tmp_path / "in.bam"), [record(pos=i, read_name=f"r{i}") for i in range(50)])
    run = runs.Run(spark, str(tmp_path / "out"), runs.selection_phases(list_files(spark, str(tmp_path)))).start()
    assert run.wait(300) == "done"
    assert {r.status for r in run.table("status").collect()} == {"pass", "used"} and run.table("metrics").count() > 10
