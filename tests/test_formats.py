"""BAM and FASTQ files through ``spark.read``."""

from __future__ import annotations

import gzip
import random

import pytest
from factory import record, write_bam
from pyspark.sql import functions as F
from test_bytes import bgzip, unplaced

from strandcheck.sources import formats


@pytest.fixture(scope="module")
def bams(spark, tmp_path_factory):
    formats.register(spark)
    folder = tmp_path_factory.mktemp("bams")
    records = [record(pos=i, read_name=f"p{i}", cb=f"C{i % 7}", ref_id=i // 1500) for i in range(3000)] + unplaced(3000)
    write_bam(str(folder / "a.bam"), records, refs=[("chr1", 1000000), ("chr2", 1000000)], index=False)
    write_bam(str(folder / "b.bam"), records[:10], refs=[("chr1", 1000000), ("chr2", 1000000)])
    (folder / "broken.bam").write_bytes(b"not a bam at all, but long enough")
    return folder, records


@pytest.mark.parametrize("span", [4000, 1 << 20])
def test_bam_format(spark, bams, span):
    folder, records = bams
    df = spark.read.format("bam").option("span", span).load(str(folder))
    rows = df.select(F.element_at(F.split("file", "/"), -1), "read_name", "ref_id", "pos", "cb", "error").collect()
    errors = [r for r in rows if r["error"]]
    assert len(errors) == 1 and errors[0][0] == "broken.bam"
    want = [(f, r["read_name"], r["ref_id"], r["pos"], r["cb"]) for f, part in (("a.bam", records), ("b.bam", records[:10])) for r in part]
    assert sorted(tuple(r)[:5] for r in rows if not r["error"]) == sorted(want)
    if span == 4000:
        assert df.rdd.getNumPartitions() > 20


def test_bam_format_reads_what_is_asked_for(spark, bams, monkeypatch):
    folder, records = bams
    flags = spark.read.format("bam").schema("flag int").load(str(folder / "a.bam"))
    assert flags.columns == ["flag"] and flags.count() == len(records)
    reader = formats.BamReader({"path": str(folder)}, flags.schema)
    from strandcheck.sources import bam

    monkeypatch.setattr(bam, "walk", None)  # tags can't be decoded now
    parts = reader.partitions()
    assert {p.path.split("/")[-1] for p in parts} == {"a.bam", "b.bam", "broken.bam"}
    assert sum(b.num_rows for p in parts if p.path.endswith("b.bam") for b in reader.read(p)) == 10


def test_bam_format_takes_filters(spark, bams):
    folder, records = bams
    path = str(folder / "a.bam")
    df = spark.read.format("bam").option("span", 4000).load(str(folder))
    assert df.filter(F.col("file") == path).filter("ref_id = 1").count() == 1500
    reader = formats.BamReader({"path": str(folder)}, df.schema)
    from pyspark.sql.datasource import EqualTo, In

    filters = [EqualTo(("file",), path), In(("ref_id",), (1, 5))]
    assert list(reader.pushFilters(filters)) == filters
    assert {p.path for p in reader.partitions()} == {path}
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1500


def test_fastq_format(spark, bams, tmp_path):
    r = random.Random(2)
    text = "".join(f"@r{i}\n{'ACGT' * r.randint(1, 20)}\n+\n{'I' * 40}\n" for i in range(2000)).encode()
    (tmp_path / "plain.fastq").write_bytes(text)
    (tmp_path / "stream.fq.gz").write_bytes(gzip.compress(text))
    (tmp_path / "blocks.fastq.gz").write_bytes(bgzip(text, 1000))
    (tmp_path / "cut.fastq.gz").write_bytes(gzip.compress(text)[:-500])
    df = spark.read.format("fastq").option("span", 3000).load(str(tmp_path))
    name = F.element_at(F.split("file", "/"), -1)
    got = {r["f"]: (r["n"], r["d"], r["e"]) for r in df.groupBy(name.alias("f")).agg(F.count("header").alias("n"), F.count_distinct("header").alias("d"), F.count("error").alias("e")).collect()}
    assert got["plain.fastq"] == got["stream.fq.gz"] == got["blocks.fastq.gz"] == (2000, 2000, 0)
    assert got["cut.fastq.gz"][2] == 1 and got["cut.fastq.gz"][0] < 2000


def test_small_spans_grow_with_the_files(tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "MOST_TASKS", 10)
    (tmp_path / "a.fastq").write_bytes(b"@r\nA\n+\nI\n" * 1000)
    reader = formats.FastqReader({"path": str(tmp_path), "span": "100"}, formats.T.StructType([formats.T.StructField("header", formats.T.StringType())]))
    parts = reader.partitions()
    assert len(parts) == 10 and parts[-1].stop == 9000
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 1000
