"""Histograms, quantiles, the knee and contig statistics against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandcheck.functions import alignment as A
from strandcheck.operators import contigs, histograms, knee, reads


def brute_knee(counts):
    """Walks every rank of the curve."""
    c = sorted((x for x in counts if x > 0), reverse=True)
    if len(c) < 50:
        return None
    first = max(1, int(len(c) * 0.002))
    last = max(first + 10, int(len(c) * 0.92))
    xs, ys = np.log10(np.arange(1, len(c) + 1)), np.log10(c)
    start, end = np.array([xs[first], ys[first]]), np.array([xs[last], ys[last]])
    chord = end - start
    far = [
        abs(chord[0] * (ys[i] - start[1]) - chord[1] * (xs[i] - start[0])) / (np.hypot(*chord) or 1)
        for i in range(first + 1, last)
    ]
    best = int(np.argmax(np.round(far, 12)))
    return first + 1 + best + 1, c[first + 1 + best], far[best]


def knee_of(spark, counts):
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(counts)], "k int, reads long")
    found = knee.barcode_knee(knee.count_of_counts(df)).collect()
    return found[0] if found else None


def test_knee_of_two_slopes(spark):
    counts = [
        round(900 / i**0.25) if i < 420 else max(1, round(80 / (i - 400) ** 0.7)) for i in range(1, 1201)
    ]
    got = knee_of(spark, counts)
    assert 20 < got.estimated_cells < 1100
    want = brute_knee(counts)
    assert (got.estimated_cells, got.threshold_reads) == want[:2]
    assert got.curvature == pytest.approx(want[2], abs=1e-9)
    assert got.confidence == "medium"


@pytest.mark.parametrize("seed", range(4))
def test_knee_with_many_ties(spark, seed):
    rng = random.Random(seed)
    counts = [rng.choice([1, 1, 1, 2, 3, 5, 40, 41, 300]) for _ in range(rng.randint(50, 700))]
    got, want = knee_of(spark, counts), brute_knee(counts)
    assert got.curvature == pytest.approx(want[2], abs=1e-9)
    assert (got.estimated_cells, got.threshold_reads) == want[:2]


def test_knee_needs_fifty_barcodes(spark):
    assert knee_of(spark, [5] * 49) is None
    assert knee_of(spark, list(range(1, 51))) is not None


def test_flat_curve_has_a_knee_of_no_curvature(spark):
    got = knee_of(spark, [7] * 60)
    assert got.curvature == 0 and got.confidence == "low"


def test_lower_median_and_quantile_of_histogram(spark):
    hist = spark.createDataFrame([(90, 1), (91, 5), (100, 2)], "v int, n long")
    assert histograms.histogram_quantile(hist, "v", "n", 0.5).first().value == 91
    even = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (10, 1)], "v int, n long")
    assert histograms.histogram_quantile(even, "v", "n", 0.5).first().value == 2
    values = spark.createDataFrame([(1,), (2,), (3,), (10,)], "v int")
    assert values.agg(histograms.lower_median("v").alias("m")).first().m == 2


def test_unit_quantiles_match_interpolation(spark):
    rng = random.Random(5)
    values = [rng.choice([0.0, 0.0, rng.random(), 1.0]) for _ in range(997)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    got = histograms.unit_quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.75}).first()
    assert list(got) == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])), abs=1e-12)


def test_running_totals_do_not_need_a_global_sort(spark):
    values = random.Random(3).sample(range(100_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = histograms.bucketed_prefix(
        df, [], F.floor(F.col("v") / 1000), ["v"], {"rank": F.lit(1), "total": F.col("v")}
    )
    ordered = sorted(values)
    want = {v: (i + 1, sum(ordered[: i + 1])) for i, v in enumerate(ordered)}
    assert {r.v: (r["rank"], r.total) for r in got.collect()} == want


def test_dense_histogram_keeps_zeros(spark):
    df = spark.createDataFrame([("a", 3), ("a", 3), ("b", 0)], "g string, v int")
    got = histograms.dense_histogram(df, "v", 0, 4, ["g"]).orderBy("g", "v").collect()
    assert [r.n for r in got] == [0, 0, 0, 2, 0, 1, 0, 0, 0, 0]
    assert [r.n for r in histograms.dense_histogram(df.filter("false"), "v", 0, 2).collect()] == [0, 0, 0]


def test_wilson_margin(spark):
    row = spark.range(1).select(
        A.wilson_margin(F.lit(5), F.lit(20)).alias("m"),
        A.wilson_margin(F.lit(0), F.lit(20)).alias("z"),
        A.wilson_margin(F.lit(0), F.lit(0)).alias("none"),
        A.proportion(F.lit(0), F.lit(0)).alias("p"),
    ).first()

    def half(k, n, z=1.96):
        p = k / n
        return z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)

    assert row.m == pytest.approx(half(5, 20)) and row.z == pytest.approx(half(0, 20))
    assert row.none is None and row.p is None


def brute_n50(lengths):
    ordered, total, sofar = sorted(lengths, reverse=True), sum(lengths), 0
    for i, x in enumerate(ordered, start=1):
        sofar += x
        if sofar * 2 >= total:
            return x, i
    return 0, 0


@pytest.mark.parametrize("lengths", [[100, 80, 20], [5] * 9, [7], [3, 3, 3, 1, 1, 9], list(range(1, 200))])
def test_n50(spark, lengths):
    df = spark.createDataFrame([(x,) for x in lengths], "length long")
    got = contigs.fai_summary(df).first()
    assert (got.n50, got.l50) == brute_n50(lengths)
    assert (got.contigs, got.total_length) == (len(lengths), sum(lengths))
    assert (got.longest, got.shortest) == (max(lengths), min(lengths))


def test_n50_of_nothing(spark):
    got = contigs.fai_summary(spark.createDataFrame([], "length long")).first()
    assert tuple(got) == (0, 0, 0, 0, 0, 0)


def fingerprint(spark, refs):
    df = spark.createDataFrame([("f", i, n, s) for i, (n, s) in enumerate(refs)], "file string, ref_id int, name string, length long")
    return contigs.fingerprint(df).first(), contigs.special_contigs(df).collect()


def test_human_fingerprint(spark):
    refs = [(f"chr{i}", 248956422 if i == 1 else 10_000_000) for i in range(1, 23)]
    refs += [("chrX", 156040895), ("chrY", 57227415), ("chrM", 16569)]
    refs += [("chr1_KI270706v1_random", 175055), ("chrUn_random", 161802)]
    got, special = fingerprint(spark, refs)
    assert (got.build, got.confidence, got.primary_count) == ("GRCh38 / hg38", "high", 24)
    assert (got.mitochondrial, got.alt_decoy_count, got.small_count) == ("chrM", 1, 1)
    assert got.primary_complete and got.sex_chromosomes == 2
    assert {(r.kind, r.name) for r in special} == {
        ("alt_decoy", "chr1_KI270706v1_random"), ("small", "chrUn_random")
    }


def test_bare_and_unknown_names(spark):
    got, _ = fingerprint(spark, [("1", 249250621), ("2", 5_000_000), ("MT", 16569)])
    assert (got.build, got.build_naming, got.naming) == ("GRCh37 / hg19", "non-prefixed", "non-prefixed")
    got, _ = fingerprint(spark, [("contig_a", 10), ("contig_b", 20)])
    assert (got.build, got.confidence, got.build_naming) == ("Unknown reference", "low", "custom")
    assert got.expected_primary is None and not got.primary_complete


def test_numbering_of_a_hot_group(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.7 else f"g{i % 5}", rng.randrange(10**6), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(6)
    got = {(r.g, r.v, r.i): r.nth for r in histograms.numbered(df, ["g"], ["v", "i"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted(r for r in rows if r[0] == g), start=1):
            want[r] = n
    assert got == want


def test_cells_of_large_part_keys(spark, tmp_path):
    """The cube of a part key is rounded once, as SQL's power() gives it."""
    import duckdb

    from strandcheck.plans import views as V

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("supplier", "nation", "lineitem"):
        con.execute(f"create view {t}_0 as select * from read_parquet('{folder}/{t}.parquet')")
        keys = "* replace (case when l_orderkey % 2 = 0 then 1119995 else 1166404 end as l_partkey)" if t == "lineitem" else "*"
        con.execute(f"copy (select {keys} from {t}_0) to '{tmp_path}/{t}.parquet'")
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet')")
    want = sorted(con.execute(f"select distinct cb from ({V.ALIGNMENTS_SQL}) a where cb is not null").fetchall())
    assert sorted(tuple(r) for r in V.alignments(spark, str(tmp_path)).select("cb").filter("cb is not null").distinct().collect()) == want


def test_gc_histogram_computes_each_sequence_once(spark):
    rows = spark.createDataFrame([(t,) for t in ("GGCC", "AT", "GATC", "", None, "C")], "text string")
    found = reads.gc_histogram(rows.select(F.regexp_replace("text", "x", "y").alias("seq")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert {r.gc_bin: r.n for r in found.collect() if r.n} == {0: 2, 10: 1, 20: 3}  # a missing sequence counts as in the SQL
