"""Steps whose tasks must not grow with the input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandcheck import session
from strandcheck.plans import alignment_queries
from strandcheck.plans.registry import all_queries

FOLDER = "/root/testdata/sf0.001"
FILES, SHUFFLED, PARTITIONS = (
    "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"
)


def _settings(spark):
    return [session._bytes(spark.conf.get(FILES)), session._bytes(spark.conf.get(SHUFFLED)), int(spark.conf.get(PARTITIONS))]


def test_settings_become_finer_and_are_put_back(spark):
    before = _settings(spark)
    with session.small_tasks(spark, 10 * session.TASK_ROWS + 1):
        assert _settings(spark) == [session.TASK_BYTES, session.TASK_BYTES, 11]
        spark.conf.set(FILES, "1m")
        with pytest.raises(ValueError), session.small_tasks(spark, 1):
            assert _settings(spark) == [1 << 20, session.TASK_BYTES, 11]  # what is finer already stays
            raise ValueError
    assert _settings(spark) == before


def test_shuffle_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = spark.range(20_000).groupBy((F.col("id") % 9_973).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        found = session.materialize(counts, "counts", 20_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tasks = found.groupBy(F.input_file_name()).count().collect()
    assert len(tasks) == 20 and sum(r["count"] for r in tasks) == 9_973


@pytest.mark.parametrize("name", ["qc_flags", "barcode_shape", "unique_molecules"])
def test_barcode_steps_know_their_rows(spark, monkeypatch, name):
    given = []
    written = session.materialize
    monkeypatch.setattr(alignment_queries, "materialize", lambda df, label, rows=None: given.append(rows) or written(df, label, rows))
    all_queries()[name].build(spark, FOLDER)
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    assert given and all(rows == lines for rows in given)
