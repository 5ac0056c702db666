"""A given number of files, written by as many tasks as the rows need."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandcheck.plans import byte_queries, preflight
from strandcheck.plans import derived_files as D
from strandcheck.plans.byte_queries import scanned_records
from strandcheck.sources import bai, bam, fastq

REFS = [("a", 1 << 29), ("b", 1 << 29), ("c", 1 << 29)]


def records(spark, n):
    return spark.range(n).select(
        (F.col("id") % 3).cast("int").alias("ref_id"), (F.col("id") * 700).cast("int").alias("pos"), F.concat(F.lit("n"), F.col("id")).alias("read_name"), F.lit(9).alias("mapq"),
        F.when(F.col("id") % 5 == 0, 4).otherwise(0).alias("flag"), F.lit(50).alias("l_seq"), (F.col("id") % 2 == 0).alias("spliced"), F.lit("C").alias("cb"), F.lit(None).cast("string").alias("ub"),
    )


def test_bams_of_pieces(spark):
    files = D.write_bams(records(spark, 20_000), "@HD\tVN:1.6\n", REFS, parts=2, pieces=9)
    names = sorted(r["name"] for r in files.collect())
    assert len(names) == 4 and sum(n.endswith(".bai") for n in names) == 2
    headers = bam.read_headers(files)
    assert [r["error"] for r in headers.collect()] == [None, None] and all(r["eof"] for r in headers.collect())
    found = bam.decoded(scanned_records(files, headers, ("CB", "UB")))
    assert sorted((x.ref_id, x.pos, x.read_name) for x in found.collect()) == sorted((i % 3, i * 700, f"n{i}") for i in range(20_000))
    result = preflight.analyze_bams(files)
    assert all((r["structural"], r["sampling"], r["error"]) == ("pass", "pass", None) for r in result.status.collect())
    assert result.totals.agg(F.sum("mapped"), F.sum("placed_unmapped")).first()[:] == (16_000, 4_000)
    starts = {r["file"]: r["n"] for r in found.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(starts) == 2 and min(starts.values()) > 6_000


def test_index_of_pieces_finds_each_record(spark):
    rows = records(spark, 3_000)
    one, joined = (D.write_bams(rows, "@HD\tVN:1.6\n", REFS, parts=1, pieces=k) for k in (1, 7))

    def linear(files):
        found = bai.usable(bai.read_indexes(files))
        return {(r["ref_id"], r["interval"]) for r in bai.linear(found).filter("voffset > 0").collect()}, sorted(map(tuple, bai.meta(found).select("ref_id", "mapped", "placed_unmapped").collect()))

    assert linear(one) == linear(joined)


def test_fastq_of_pieces(spark):
    raw = spark.range(500).select(F.concat(F.lit("@r"), F.col("id")).alias("header"), F.lit("ACGT").alias("seq"), F.lit("+").alias("plus"), F.lit("IIII").alias("qual"))
    files = D.write_bgzip(raw.repartition(6, "header"), files=2)
    assert files.count() == 2
    found = fastq.decoded(fastq.read_records(fastq.splits(fastq.detect_gzip(files))))
    assert sorted(r["header"] for r in found.select("header").collect()) == sorted(f"@r{i}" for i in range(500))
    before = raw.withColumn("half", F.pmod(F.hash("header"), F.lit(2))).groupBy("half").count().collect()
    assert sorted(r["count"] for r in found.groupBy("file").count().collect()) == sorted(r["count"] for r in before)
    assert D.write_bgzip(raw.limit(0).repartition(2, "header"), files=2).count() == 2


def test_selection_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """analyze_files has two files of each kind; neither the records nor the reads of one are written by a single task."""
    tables = {
        "lineitem": "select id div 4 l_orderkey, id % 200 l_partkey, id % 25 l_suppkey, cast(id % 4 + 1 as int) l_linenumber, cast(id % 50 + 1 as double) l_quantity, double(id) l_extendedprice, "
        "0.01D l_discount, 0.01D l_tax, if(id % 10 = 0, 'R', 'N') l_returnflag, 'O' l_linestatus, date'1995-01-01' l_shipdate from range(5000)",
        "supplier": "select id s_suppkey, cast(id as int) s_nationkey from range(25)",
        "part": "select id p_partkey, concat('blue green ', id) p_name from range(200)",
        "documents": "select id doc_id, repeat('some text ', 3) text, 'en' lang, 'web' source, 30L n_chars from range(200)",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    given, written = [], D.materialize

    def seen(df, label, *more):
        out = written(df, label, *more)
        if label == "files":
            given.append((out.filter("name like '%.bam'").count(), out.filter("name like '%.fastq.gz'").count()))
        return out

    monkeypatch.setattr(D, "materialize", seen)
    monkeypatch.setattr(D, "PIECE_RECORDS", 1000, raising=False)
    monkeypatch.setattr(D, "PIECE_READS", 20, raising=False)
    rows = {r["kind"]: r.asDict() for r in byte_queries.analyze_files(spark, str(tmp_path)).collect()}
    assert given == [(5, 0), (2, 0), (0, 10), (0, 2)]
    assert {k: (r["status"], r["files"]) for k, r in rows.items()} == {"BAM": ("pass", 2), "BAI": ("used", 2), "FASTQ": ("pass", 2), "FAI": ("pass", 2)}
    unmapped = sum(i % 10 == 0 and i % 50 + 1 < 10 for i in range(5000))
    assert rows["BAM"]["amount"] == 5000 - unmapped and rows["FAI"]["amount"] == 200
