"""Sums per cycle and quality extremes against plain loops."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from strandcheck.operators import reads as ops


def _expected(rows):
    sums = defaultdict(lambda: dict.fromkeys(ops._SUMS, 0))
    for file, seq, qual in rows:
        for cycle, (base, letter) in enumerate(zip(seq, qual, strict=True), 1):
            entry, quality = sums[file, cycle], max(0, ord(letter) - 33)
            entry[base.lower() if base in "ACGT" else "n"] += 1
            entry["q_sum"] += quality
            entry["q20"] += quality >= 20
            entry["q30"] += quality >= 30
    return dict(sums)


@pytest.mark.parametrize("held", [5, 40, 500_000])
def test_cycle_sums(spark, monkeypatch, held):
    """One row per cycle whatever the qualities, also where long reads are added up in stretches."""
    monkeypatch.setattr(ops, "HELD_CYCLES", held)
    pick = random.Random(3)
    text = lambda letters, n: "".join(pick.choice(letters) for _ in range(n))
    rows = [(f"f{i % 3}", text("ACGTNRé", n), text("!#+5?Iÿ😀 ", n)) for i, n in enumerate([1, 4, 5, 6, 11, 39, 41, 80, 81, 120])]
    extra = [("f0", "ACGT", "III"), ("f0", None, None)]
    df = spark.createDataFrame(rows + extra, "file string, seq string, qual string").repartition(2)
    found = [r.asDict() for r in ops.cycle_sums(df, ["file"]).collect()]
    assert {(r.pop("file"), r.pop("cycle")): r for r in found} == _expected(rows)
    plain = ops.cycle_sums(df.drop("file"))
    totals = ops.base_totals(plain).first()
    assert totals["bases"] == sum(len(s) for _, s, _ in rows) and plain.count() == 120


def test_no_reads(spark):
    none = ops.cycle_sums(spark.createDataFrame([], "seq string, qual string"))
    assert none.count() == 0 and ops.base_totals(none).first()["bases"] == 0


def test_quality_extremes(spark):
    rows = [("@a", "ACG", "+", "I!~"), ("@b", "ACG", "+", "Ié😀"), ("@c", "AC", "+", "\x01"), ("@d", "", "+", ""), (None, None, None, None)]
    found = ops.integrity(spark.createDataFrame(rows, "header string, seq string, plus string, qual string")).first()
    assert (found["reads"], found["quality_min"], found["quality_max"], found["invalid_quality"]) == (2, 33, 0x1F600, 2)
    bad = ops.integrity(spark.createDataFrame(rows[2:], "header string, seq string, plus string, qual string")).first()
    assert bad["quality_min"] is None and bad["quality_max"] is None
