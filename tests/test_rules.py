"""File grouping, index selection, interpretation and sampling rules."""

from __future__ import annotations

import glob
import os
import random
import re
from decimal import ROUND_HALF_UP, Decimal
from types import SimpleNamespace

import numpy as np
import pytest
from factory import at
from pyspark.sql import functions as F

from strandcheck.functions import constants as K
from strandcheck.functions import names as N
from strandcheck.functions import reads as R
from strandcheck.operators import alignments, compare, convergence, datasets, inference
from strandcheck.operators import index as index_ops
from strandcheck.plans import report
from strandcheck.streaming import progressive


def file_table(spark, names):
    return spark.createDataFrame(
        [(n, 1, i) for i, n in enumerate(names)], "name string, size long, position long"
    ).withColumn("modified", F.lit(None).cast("timestamp"))


def test_supported_names(spark):
    good = ["a.bam", "a.BAI", "a.fai", "a.fastq", "a.fq", "a.fastq.gz", "a.FQ.GZ"]
    bad = ["a.bam.gz", "a.bai.gz", "reads.gz", "a.txt", "a.zip"]
    kept = datasets.selected_files(file_table(spark, good + bad))
    assert {r.name for r in kept.collect()} == set(good)


def test_fastq_names(spark):
    names = ["PBMC_1_S1_L002_R1_001.fastq.gz", "PBMC_1_S1_L001_I2_001.fastq", "notes.fastq", "dir a\\X_S12.fq"]
    got = {r.name: r for r in datasets.labelled_files(file_table(spark, names)).collect()}
    first = got[names[0]]
    assert (first.role, first.lane, first.dataset_key) == ("r1", "002", "pbmc_1")
    assert first.stem == "PBMC_1_S1_L002_R1_001"
    assert got[names[1]].role == "i2"
    assert (got[names[2]].role, got[names[2]].lane) == ("unknown", None)
    assert got[names[3]].dataset_key == "dir_a/x"


def test_dataset_resolution(spark):
    names = [
        "PBMC_1.bam", "PBMC_1.bai", "PBMC_1_S1_L001_R1_001.fastq.gz", "PBMC_1_S1_L001_R2_001.fastq.gz",
        "PBMC_1_S1_L002_R1_001.fastq.gz", "PBMC_1_S1_L002_R2_001.fastq.gz", "PBMC_1_S1_L001_I1_001.fastq.gz",
        "unrelated.bam", "unrelated.bai", "other_S2_L001_R1_001.fastq.gz",
    ]
    files = file_table(spark, names)
    got = {r.label: r for r in datasets.resolve_datasets(files).collect()}
    assert set(got) == {"PBMC_1", "unrelated", "other"}
    pbmc = got["PBMC_1"]
    assert (pbmc.bam, pbmc.bai, pbmc.r1, pbmc.r2, pbmc.i1) == ("PBMC_1.bam", "PBMC_1.bai", 2, 2, 1)
    assert pbmc.summary == "BAM + BAI + R1 ×2/R2 ×2/I1 across 2 lanes"
    members = datasets.dataset_files(files).filter("dataset_id = 'pbmc_1' and role = 'r1'").orderBy("nth").collect()
    assert [m.name for m in members] == [names[2], names[4]]


def test_unmatched_index_and_shared_keys(spark):
    files = file_table(spark, ["a.bam", "b.bai", "X.bam", "X_S1.bam"])
    loose = datasets.unassigned_bai(files).collect()
    assert [(r.name, r.reason) for r in loose] == [("b.bai", "No uniquely matching BAM")]
    got = datasets.resolve_datasets(files).collect()
    assert sorted(r.bam for r in got) == ["X.bam", "X_S1.bam", "a.bam"]
    assert sum("kept apart" in r.warnings for r in got) == 1


def test_bytes_and_counts(spark):
    sizes = [0, 1023, 1024, 10 * 1024, 200 * 1024, 5 * 1024**3, 3 * 1024**5]
    got = spark.createDataFrame([(s,) for s in sizes], "s long").select(N.format_bytes(F.col("s")).alias("t"))
    assert [r.t for r in got.collect()] == ["0 B", "1023 B", "1.00 KB", "10.0 KB", "200 KB", "5.00 GB", "3072 TB"]
    counts = spark.createDataFrame([(None,), (999,), (12345,), (1_500_000,), (2_000_000_000,)], "c long")
    shown = [r.t for r in counts.select(N.format_count(F.col("c")).alias("t")).collect()]
    assert shown == ["—", "999", "12,345", "1.5M", "2B"]


def test_shown_values_round_the_exact_value(spark):
    """``toFixed``: the nearest number, of two equally near ones the larger; never the shortest decimal rounded."""

    def fixed(value, digits):
        return f"{Decimal(value).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)}%"

    dice = random.Random(6)
    shares = [i / 10_000 for i in range(10_001)] + [dice.randrange(4000) / 4000 * 10.0**e for e in range(-6, 9) for _ in range(50)]
    df = spark.createDataFrame([(s,) for s in shares + [-0.0015, -0.0005]], "s double")
    for digits in (1, 2):
        got = df.select("s", N.format_percent(F.col("s"), digits).alias("t")).collect()
        assert [(r.s, r.t) for r in got if r.t != fixed(r.s * 100, digits)] == []
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-float("inf"),), (-0.0,)], "s double")
    assert [r.t for r in odd.select(N.format_percent(F.col("s")).alias("t")).collect()] == ["—"] * 4 + ["0.0%"]
    ties = spark.createDataFrame([(909824,), (678400,), (97536,), (123392,)], "s long")
    shown = [r.t for r in ties.select(N.format_bytes(F.col("s")).alias("t")).collect()]
    assert shown == ["889 KB", "663 KB", "95.3 KB", "121 KB"]


def test_shares_in_notes_and_receipt(spark):
    columns = "file string, records long, mapped long, duplicate long, gx_share double, gn_share double, mito_median double, knee_confidence string, special_contigs long"
    row = spark.createDataFrame([("a", 10_000, 8005, 15, 0.0, 0.0, 0.0015, "low", 0), ("b", 0, 0, 0, None, None, None, None, 0)], columns)
    notes = {(r.file, r.check): r.note for r in inference.qc_flags(row, ["file"]).collect()}
    assert notes["a", "alignment"].startswith("80.0% of the records read have ")
    assert notes["a", "duplication"].startswith("0.1% of the records read are ")
    assert notes["a", "mitochondrial"].startswith("0.1% is the median ")
    assert notes["b", "alignment"] == notes["b", "duplication"] == "No record was read."
    assert notes["b", "mitochondrial"] == "No barcode to take a mitochondrial share from."
    columns = "file string, strategy string, reads long, median_length long, q30 double, malformed long, quality_encoding string, error string"
    summary = spark.createDataFrame([("a", "whole", 8, 4, 0.8005, 0, "Phred+33", None), ("b", "whole", 0, None, None, 0, None, None)], columns)
    lines = {r.file: r.line for r in report._fastq_lines(SimpleNamespace(summary=summary)).collect() if "Q30" in r.line}
    assert lines["a"].startswith("- Q30: 80.0%; ") and lines["b"].startswith("- Q30: unavailable; ")


def test_illumina_header_and_read_number(spark):
    df = spark.createDataFrame([("@A:12:F:3:1101:5:6 2:Y:0:ACGT",), ("@x/1",), ("@x",), ("@x 3:N",)], "h string")
    got = df.select(R.illumina_fields(F.col("h")).alias("i"), R.read_number(F.col("h")).alias("n")).collect()
    assert got[0].i.asDict() == {
        "instrument": "A", "run": "12", "flowcell": "F", "lane": 3, "tile": 1101, "read": 2, "filtered": True,
        "control": 0, "index": "ACGT",
    }
    assert [r.n for r in got] == ["2", "1", None, None]
    assert got[1].i is None


# Seek points


def index_tables(spark, refs, size=1 << 30):
    chunks = [
        ("f", r, b, i, beg, end)
        for r, ref in enumerate(refs)
        for b, cs in ref.get("bins", [])
        for i, (beg, end) in enumerate(cs)
    ]
    linear = [("f", r, i, v) for r, ref in enumerate(refs) for i, v in enumerate(ref.get("linear", []))]
    return (
        spark.createDataFrame(chunks, "file string, ref_id int, bin int, chunk_index int, beg long, end long"),
        spark.createDataFrame(linear, "file string, ref_id int, interval int, voffset long"),
        spark.createDataFrame([("f", len(refs), size)], "file string, n_ref int, bam_size long"),
    )


def test_points_over_two_references(spark):
    refs = [
        {"bins": [(0, [(at(1), at(2)), (at(3), at(4)), (at(5), at(6))])]},
        {"bins": [(0, [(at(7), at(8))])]},
    ]
    got = index_ops.stratified_seek_points(*index_tables(spark, refs), 4).orderBy("point_no").collect()
    assert [(p.ref_id, p.compressed) for p in got] == [(0, 1), (1, 7), (0, 5)]
    assert all(p.region for p in got)


@pytest.mark.parametrize("n, points", [(12, 1), (13, 2), (23, 12), (24, 24), (60, 24)])
def test_stopping_early_loses_points_of_small_indexes(spark, n, points):
    refs = [{"bins": [(0, [(at(10 * i + 1), at(10 * i + 9)) for i in range(n)])]}]
    tables = index_tables(spark, refs)
    assert index_ops.stratified_seek_points(*tables, 24, stop_early=True).count() == points
    assert index_ops.stratified_seek_points(*tables, 24).count() == min(n, 24)


def test_linear_index_helps_out(spark):
    refs = [{"bins": [(0, [(at(4), at(5))])], "linear": [0, at(2), at(4), at(9)]}]
    tables = index_tables(spark, refs)
    got = index_ops.stratified_seek_points(*tables, 10).orderBy("compressed").collect()
    assert [(p.compressed, p.region) for p in got] == [(2, "0:linear:1"), (4, "0:linear:2"), (9, "0:linear:3")]
    assert index_ops.global_seek_points(*tables, 10).count() == 3


def test_even_picks_over_a_file(spark):
    offsets = sorted(random.Random(4).sample(range(1, 1 << 28), 700))
    refs = [{"bins": [(0, [(at(v), at(v + 1)) for v in offsets])]}]
    got = index_ops.global_seek_points(*index_tables(spark, refs), 64).collect()
    want = {offsets[int(i * 699 / 63 + 0.5)] for i in range(64)}
    assert {p.compressed for p in got} == want
    assert index_ops.global_seek_points(*index_tables(spark, refs), 1).count() == 1


def test_each_rule_is_reported(spark):
    refs = [
        {"bins": [(0, [(at(50), at(60)), (at(10), at(10)), (at(200), at(90))])], "linear": [at(9), 0, at(5), at(101)]}
    ]
    chunks, linear, files = index_tables(spark, refs, size=100)
    meta = spark.createDataFrame([("f", 0, at(8), at(7), 1, 1)], "file string, ref_id int, ref_beg long, ref_end long, mapped long, placed_unmapped long")
    files = files.withColumn("bam_n_ref", F.lit(3)).withColumn("no_coordinate", F.lit(None).cast("long"))
    errors = index_ops.validation_errors(chunks, linear, meta, files)
    assert {r.rule for r in errors.collect()} == {1, 2, 3, 4, 6, 7, 8, 11}
    status = index_ops.index_status(files, errors).first()
    assert status.status == "failed" and status.error.count(";") == 4
    assert status.error.startswith("BAI validation failed: numbers of references differ (BAM: 3, index: 1)")


# Interpretation


def assay_of(spark, cb, ub, gx, re, program):
    df = spark.createDataFrame(
        [(cb, ub, gx, 0.0, re, 16, 12)],
        "cb_share double, ub_share double, gx_share double, gn_share double, re_share double, barcode_length long, umi_length long",
    )
    return inference.assay(df, F.lit(program)).first()


def test_assay_rules(spark):
    assert assay_of(spark, 0.9, 0.9, 0.9, 0.9, "").assay_confidence == "high"
    assert assay_of(spark, 0.9, 0.9, 0.9, 0.05, "").assay_confidence == "medium"
    only_program = assay_of(spark, 0.0, 0.0, 0.0, 0.0, "CellRanger 7")
    assert (only_program.assay, only_program.assay_confidence) == (K.SC_RNA, "medium")
    barcoded = assay_of(spark, 0.5, 0.1, 0.9, 0.9, "star")
    assert (barcoded.assay, barcoded.assay_confidence) == ("Barcoded sequencing", "medium")
    assert assay_of(spark, 0.1, 0.9, 0.9, 0.9, "").assay == "Generic alignment"


def layout(spark, files):
    df = spark.createDataFrame(
        [("d", n, i, m, r) for i, (n, m, r) in enumerate(files)],
        "dataset_id string, file_name string, position int, median_length int, illumina_read int",
    )
    got = inference.pair_layout(df).collect()
    return (got[0].r1, got[0].r2, got[0].layout[:3], got[0].confidence) if got else None


def test_pair_layout(spark):
    assert layout(spark, [("s_R1.fastq", 28, None), ("s_R2.fastq", 91, None)]) == ("s_R1.fastq", "s_R2.fastq", "10x", "medium")
    assert layout(spark, [("s_R2.fastq", 91, None), ("s_R1.fastq", 26, None)])[2:] == ("10x", "low")
    assert layout(spark, [("s_R1.fastq", 100, None), ("s_R2.fastq", 100, None)])[2:] == ("Pai", "low")
    assert layout(spark, [("s_R1.fastq", 28, None)]) is None
    assert layout(spark, [("b.fastq", 90, 2), ("a.fastq", 28, 1)])[:2] == ("a.fastq", "b.fastq")
    assert layout(spark, [("s_I1.fastq", 8, 1), ("s_R1.fastq", 28, None), ("x.fastq", 91, None)])[:2] == ("s_R1.fastq", "x.fastq")


def agreement(spark, r1, r2, lane2=1, assay=K.SC_RNA):
    bam = spark.createDataFrame([("d", assay, 16, 12, 91)], "dataset_id string, assay string, barcode_length int, umi_length int, read_length_median int")
    rows = [("d", "s_R1.fastq", 0, r1, 1, 1), ("d", "s_R2.fastq", 1, r2, 2, lane2)]
    fq = spark.createDataFrame(rows, "dataset_id string, file_name string, position int, median_length int, illumina_read int, lane int")
    got = inference.consistency(bam, fq).collect()
    return got[0] if got else None


def test_consistency(spark):
    good = agreement(spark, 28, 91)
    assert good.status == "pass" and good.r1_layout and good.r2_length and good.lane_agreement
    assert agreement(spark, 28, 97).status == "warn"
    assert agreement(spark, 26, 91).status == "warn"
    assert agreement(spark, 28, 91, lane2=2).lane_agreement is False
    assert agreement(spark, 28, 91, lane2=None).status == "pass"
    assert agreement(spark, 28, 91, assay="Generic alignment") is None


def test_tolerances(spark):
    seen = spark.createDataFrame([("a", 101.0), ("b", 250.0), ("c", 1.0)], "k string, value double")
    want = spark.createDataFrame([("a", 100.0), ("b", 200.0), ("z", 1.0)], "k string, value double")
    got = {r.k: r.within for r in compare.outside_tolerance(seen, want, "k", 1.0, 0.01).collect()}
    assert got == {"a": True, "b": False}


# Records


def test_dedup_keeps_the_first_and_is_idempotent(spark):
    rows = [(0, 5, "a", 0, 7, 1), (0, 5, "a", 0, 9, 0), (0, 5, "b", 0, 3, 2), (1, 5, "a", 0, 1, 3)]
    df = spark.createDataFrame(rows, "ref_id int, pos int, read_name string, flag int, mapq int, nth int")
    once = alignments.dedup_records(df, ["nth"])
    assert sorted(tuple(r) for r in once.collect()) == sorted(rows[1:])
    assert alignments.dedup_records(once, ["nth"]).count() == once.count()


def points_table(spark, sizes, exonic):
    rows = [
        ("f", p, 30, 90, "E" if i < n * e else "N", f"c{i % 10}")
        for p, (n, e) in enumerate(zip(sizes, exonic, strict=True))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "file string, point_no int, mapq int, l_seq int, re string, cb string")


def test_stop_rule(spark):
    steady = points_table(spark, [100] * 6, [0.5] * 6)
    got = convergence.convergence(convergence.snapshots(steady), 100).orderBy("point_no").collect()
    assert [r.records for r in got] == [100, 200, 300, 400, 500, 600]
    # Four checkpoints exist after the fourth point; 10/300 and 10/400 barcodes per record agree.
    assert [r.stop_here for r in got] == [False, False, False, True, False, False]
    assert [r.past_stop for r in got] == [False] * 4 + [True] * 2
    jump = points_table(spark, [450, 10], [0.5, 0.5])
    got = convergence.convergence(convergence.snapshots(jump), 100).orderBy("point_no").collect()
    assert (got[0].checkpoints, got[0].crossed, got[0].stop_here) == (4, 4, True)


def test_progressive_waves_stop(spark):
    records = points_table(spark, [100] * 20, [0.5] * 20)
    running, out = progressive.start(records, wave_size=2, batch=100, target=10**9, files_per_trigger=5)
    running.awaitTermination()
    got = progressive.result(spark, out)
    last = got.orderBy(F.desc("point_no")).first()
    assert last.stable and last.records < 2000 and last.records % 200 == 0


def test_progressive_waves_in_any_order_of_time(spark, tmp_path):
    """Thirteen waves, whose files are younger the earlier the wave, or in no order, give the same as all records at once."""
    draw = np.random.default_rng(3)
    rows = [
        (f"f{f}", p, int(draw.integers(0, 60)), int(draw.integers(50, 99)), "E" if draw.random() < 0.1 * (p % 7) else "N", f"c{draw.integers(0, 400)}" if draw.random() < 0.9 else None)
        for f in range(3) for p in range(39) if (f + p) % 5 for _ in range(int(draw.integers(1, 30)))
    ]
    records = spark.createDataFrame(rows, "file string, point_no int, mapq int, l_seq int, re string, cb string")
    want = sorted(map(tuple, convergence.convergence(convergence.snapshots(records, ["file"]), 50, ["file"]).select(*names()).collect()))
    for order in ("late first", "shuffled"):
        folder = str(tmp_path / order.replace(" ", "-"))
        progressive.write_waves(records, 3, folder)
        files = sorted(glob.glob(f"{folder}/*/*.parquet"), key=lambda f: int(re.search(r"of_wave=(\d+)", f)[1]))
        assert len({os.path.dirname(f) for f in files}) == 13
        for no, f in enumerate(files[::-1] if order == "late first" else draw.permutation(files)):
            os.utime(f, (1_000_000 + no, 1_000_000 + no))
        running, out = progressive.start(records, batch=50, target=1 << 62, waves=folder, files_per_trigger=4)
        running.awaitTermination()
        got = sorted(map(tuple, progressive.result(spark, out, names()).collect()))
        stops = {f: min((r[1] for r in want if r[0] == f and r[-3]), default=99) for f in ("f0", "f1", "f2")}
        assert got == [r for r in want if r[1] // 3 <= stops[r[0]] // 3] and len(got) > 20


def test_progressive_reads_points_by_need(spark):
    """Points of a file that has enough records are not read any more."""
    points = spark.createDataFrame([(f, p) for f in ("a", "b") for p in range(12)], "file string, point_no int")

    def take(wave):
        many = wave.loc[wave.index.repeat(10)].reset_index(drop=True)
        return many.assign(mapq=30, l_seq=90, re="E", cb="c1")[["point_no", "mapq", "l_seq", "re", "cb"]]

    running, out = progressive.start(points, take, wave_size=2, batch=1000, target=55, files_per_trigger=3)
    running.awaitTermination()
    got = progressive.result(spark, out)
    assert {(r.file, r.n, r.m) for r in got.groupBy("file").agg(F.count("*").alias("n"), F.max("records").alias("m")).collect()} == {("a", 6, 60), ("b", 6, 60)}


def names():
    return [c.split()[0] for c in progressive.SNAPSHOT_SCHEMA.split(", ")]


def test_rules_of_every_direction(spark):
    rules = spark.createDataFrame([("a", 2.0, 0.0, "both", True), ("b", 0.0, 0.1, "least", False), ("c", 0.0, 0.1, "most", False)], compare.RULE_SCHEMA)
    expected = [("a", "x", 10), ("a", "y", 10), ("a", "gone", 10), ("b", "x", 100), ("b", "y", 100), ("b", "z", 100), ("b", "gone", 1), ("c", "x", 100), ("c", "y", 100), ("d", "x", 1)]
    observed = [("a", "x", 12), ("a", "y", 13), ("b", "x", 90), ("b", "y", 89), ("b", "z", 500), ("c", "x", 110), ("c", "y", 111), ("d", "x", 1), ("a", "extra", 5)]
    schema = "kind string, key string, value bigint"
    got = compare.judged(spark.createDataFrame(observed, schema), spark.createDataFrame(expected, schema), rules)
    assert {(r.kind, r.key): r.verdict for r in got.collect()} == {
        ("a", "x"): "within", ("a", "y"): "outside", ("a", "gone"): "missing", ("b", "x"): "within", ("b", "y"): "outside", ("b", "z"): "within",
        ("b", "gone"): "skipped", ("c", "x"): "within", ("c", "y"): "outside", ("d", "x"): "no rule",
    }


def test_a_held_wave_is_taken_in_part_by_part():
    """Each frame of a wave that can't go on yet is written once, however many come."""
    import pandas as pd

    class Map(dict):
        written = 0

        def containsKey(self, key):
            return key in self

        getValue, removeKey = dict.__getitem__, dict.__delitem__

        def updateValue(self, key, value):
            Map.written += sum(len(v) if isinstance(v, bytes) else sum(map(len, v)) if isinstance(v, list) else 8 for v in value)
            self[key] = value

    def written(frames: int) -> int:
        Map.written, state = 0, progressive._State(None, 10, 10)
        state.held, state.waiting = Map(), Map()
        state._hold(iter([pd.DataFrame({"after": 3, "wave": 4, "due": 10**6, "mapq": range(100)})] * frames), 0)
        return Map.written

    assert written(40) < 5 * written(10)
