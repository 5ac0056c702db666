"""Readers on bytes made in the tests."""

from __future__ import annotations

import gzip
import random

import numpy as np
import pytest
from factory import at, bai, bgzf_block, one_member_bam, record, write_bam
from pyspark.sql import functions as F

from strandcheck.operators import contigs
from strandcheck.operators import index as index_ops
from strandcheck.operators import reads as read_ops
from strandcheck.plans import derived_files as D
from strandcheck.plans import preflight, report
from strandcheck.plans.byte_queries import not_among, scanned_records
from strandcheck.sources import bam, bgzf, fastq, guess
from strandcheck.sources import bai as bai_source
from strandcheck.sources import fai as fai_source
from strandcheck.sources.storage import list_files


# BGZF


def test_block_size_problems():
    good = bgzf.EOF_BLOCK
    assert bgzf.block_size(good) == 28
    for head, text in (
        (good[:10], "Truncated"),
        (b"x" * 20, "Not a BGZF"),
        (good[:10] + b"\xff\x00" + good[12:], "Need more"),
        (good[:14] + b"\x09\x00" + good[16:], "Malformed"),
        (good[:12] + b"XX" + good[14:], "BC field missing"),
    ):
        with pytest.raises(bgzf.BgzfError, match=text):
            bgzf.block_size(head)


def test_truncated_block(tmp_path):
    data, _ = one_member_bam([record()])
    path = tmp_path / "cut.bam"
    path.write_bytes(data[:60])
    with open(path, "rb") as f, pytest.raises(bgzf.BgzfError, match="Truncated BGZF block"):
        list(bgzf.blocks(f, 0, 60))


# BAM


def test_one_record_bam(spark, tmp_path, rows):
    write_bam(str(tmp_path / "one.bam"), [record()])
    files = list_files(spark, str(tmp_path))
    got = preflight.analyze_bams(files)
    header = rows(got.headers)[0]
    assert header["eof"] and header["error"] is None
    assert header["refs"] == [{"name": "chr1", "length": 248956422}]
    facts = rows(got.header_facts)[0]
    assert (facts["sort_order"], facts["samples"]) == ("coordinate", "S1")
    assert rows(got.fingerprint)[0]["build"] == "GRCh38 / hg38"
    assert rows(got.index_status)[0]["status"] == "pass"
    totals = rows(got.totals)[0]
    assert (totals["mapped"], totals["total_unmapped"], totals["mapped_fraction"]) == (1, 0, 1.0)
    status = rows(got.status)[0]
    assert (status["structural"], status["sampling"], status["warnings"]) == ("pass", "pass", [])
    metrics = {(r.section, r.metric): r for r in preflight.bam_metrics(got).collect()}
    assert metrics["sample", "records"].value == 1
    assert metrics["sample", "mapq_median"].value == 255
    assert metrics["sample", "molecules"].value == 1
    assert metrics["region", "E"].value == 1 and metrics["region", "E"].margin >= 0
    assert metrics["barcodes", "reads_median"].value == 1
    assert metrics["assay", "assay"].text == "Single-cell RNA sequencing"
    assert metrics["assay", "chemistry"].text == "Compatible with 3′ v3/v3.1"
    assert metrics["assay", "assay"].confidence == "high"
    assert metrics["index", "mapped"].provenance == "EXACT"
    assert metrics["knee", "estimated_cells"].provenance == "INFERRED" if ("knee", "estimated_cells") in metrics else True
    lines = [r.value for r in report.receipt_text(report.receipt(files, "quick", got)).collect()]
    bam_line = next(x for x in lines if x.startswith("BAM: ") and x.endswith("/one.bam"))
    assert "- structural: pass; sampling: pass" in lines
    assert lines.index("Files:") < lines.index(bam_line) < len(lines) - 1


def test_bams_with_problems_keep_a_status(spark, tmp_path, rows):
    write_bam(str(tmp_path / "noindex.bam"), [record()], index=False)
    write_bam(str(tmp_path / "noeof.bam"), [record()], eof=False)
    write_bam(str(tmp_path / "beyond.bam"), [record()])
    (tmp_path / "beyond.bam.bai").write_bytes(bai([{"bins": [(4681, [(at(999_999), at(1_000_000))])]}]))
    write_bam(str(tmp_path / "junk.bam"), [record()])
    (tmp_path / "junk.bam.bai").write_bytes(b"nonsense")
    (tmp_path / "broken.bam").write_bytes(b"not a bam at all, but long enough")
    got = {r["file"].split("/")[-1]: r for r in rows(preflight.analyze_bams(list_files(spark, str(tmp_path))).status)}
    assert got["noindex.bam"]["sampling"] == "unavailable" and got["noindex.bam"]["structural"] == "pass"
    assert got["noeof.bam"]["structural"] == "review" and got["noeof.bam"]["sampling"] == "pass"
    assert "past the last byte of the BAM" in got["beyond.bam"]["error"] and got["beyond.bam"]["sampling"] == "failed"
    assert "signature of an index" in got["junk.bam"]["error"]
    assert "Not a BGZF" in got["broken.bam"]["error"]


def test_probe_rejects_wrong_offsets(spark, tmp_path):
    data, first = one_member_bam([record(), record(pos=200)])
    path = tmp_path / "p.bam"
    path.write_bytes(data)
    offsets = [at(0, first), at(0, first + 3), at(0, 60_000)]
    points = spark.createDataFrame([(str(path), "p.bam", v, 1) for v in offsets], "path string, file string, voffset long, n_ref int")
    got = {r.voffset: r for r in bam.probe_points(points).collect()}
    assert got[offsets[0]].ok
    assert not got[offsets[1]].ok
    assert "no block at" in got[offsets[2]].error


@pytest.mark.parametrize(
    "change, text",
    [
        (lambda b: b.replace(b"BAM\x01", b"BAD\x01"), "signature"),
        (lambda b: b.replace(b"chr1\x00", b"chr1!"), "closing zero byte: 0"),
    ],
)
def test_header_problems(change, text):
    from strandcheck.plans.derived_files import encode_header

    data = encode_header("@HD\tVN:1\n", [("chr1", 10)])
    with pytest.raises(bam.BamError, match=text):
        bam.parse_header(change(data))
    with pytest.raises(bam.BamError, match="repeat the name of another: 1"):
        bam.parse_header(encode_header("", [("a", 1), ("a", 2)]))
    with pytest.raises(bam.BamError, match="no positive length: 0"):
        bam.parse_header(encode_header("", [("a", 0)]))
    for cut in range(len(data)):
        assert bam.parse_header(data[:cut]) is None
    assert bam.parse_header(data) == {"header_text": "@HD\tVN:1\n", "refs": [{"name": "chr1", "length": 10}], "header_bytes": len(data)}
    assert bam.parse_header(encode_header("", []))["refs"] == []


def test_scan_reads_every_record_once(spark, tmp_path):
    rng = random.Random(1)
    records = sorted(
        (
            record(pos=rng.randrange(5_000_000), read_name=f"read{i}" * rng.randint(1, 3), l_seq=rng.randint(1, 300),
                   spliced=i % 3 == 0, flag=rng.choice([0, 4, 16]), gn=None if i % 4 else "G")
            for i in range(20_000)
        ),
        key=lambda r: r["pos"],
    )
    write_bam(str(tmp_path / "many.bam"), records)
    files = list_files(spark, str(tmp_path))
    rows = bai_source.usable(bai_source.read_indexes(files)).withColumn("file", F.lit("many.bam"))
    path = F.lit(str(tmp_path / "many.bam"))
    for span in (1 << 14, 1 << 30):
        ranges = bam.scan_ranges(bai_source.chunks(rows), span=span).withColumn("path", path)
        found = bam.decoded(bam.read_ranges(ranges, batch=1 << 17)).collect()
        assert len(found) == len(records)
        assert {(r.pos, r.read_name, r.l_seq, r.spliced, r.gn, r.flag) for r in found} == {
            (r["pos"], r["read_name"], r["l_seq"], r["spliced"], r["gn"], r["flag"]) for r in records
        }


def test_aux_types_and_repeats():
    import struct

    import numpy as np

    from strandcheck.sources.tags import walk

    one = (
        b"CBZone\x00" + b"NHC\x02" + b"mmc\x01" + b"XXBs" + struct.pack("<i", 2) + b"\x01\x00\x02\x00"
        + b"CBZtwo\x00" + b"xfi" + struct.pack("<i", 25) + b"REAE" + b"GXB?\x00\x00\x00\x00"
    )
    two = b"NHZ7\x00" + b"GNZ\xc3\xa9\x00" + b"RGHAB\x00" + b"MMs\xff\xff" + b"CBf" + struct.pack("<f", 1.5)
    data = one + two + b"UBZcut"
    begin, end = np.array([0, len(one), len(one) + len(two)]), np.array([len(one), len(one) + len(two), len(data)])
    got = walk(np.frombuffer(data, np.uint8), begin, end)
    text = lambda tag: got.texts(tag).to_pylist()
    assert text("CB") == ["two", "1.5", None] and text("xf") == ["25", None, None] and text("RE") == ["E", None, None]
    assert text("GN") == [None, "é", None] and text("RG") == [None, "AB", None] and text("GX") == text("UB") == [None] * 3
    assert got.integers("mm").to_pylist() == [1, None, None] and got.integers("MM").to_pylist() == [None, -1, None]
    assert got.integers("NH").to_pylist() == [2, None, None]
    assert got.integers("NH", convert=True).to_pylist() == [2, 7, None]
    assert got.present(("CB", "NH", "mm", "RE", "xf", "RG", "GX")).to_pylist() == [
        ["CB", "NH", "mm", "xf", "RE"], ["NH", "RG", "CB"], []
    ]
    assert got.reached.tolist() == [len(one) - 8, int(end[1]), int(begin[2])]
    empty = walk(np.frombuffer(b"", np.uint8), begin[:0], end[:0])
    assert empty.texts("CB").to_pylist() == [] and empty.present(("CB",)).to_pylist() == []


def scan(spark, folder, **options):
    files = list_files(spark, str(folder))
    headers = bam.read_headers(files)
    index = bai_source.chunks(bai_source.usable(bai_source.read_indexes(files)))
    index = index.withColumn("file", F.regexp_replace("file", r"\.bai$", ""))
    return bam.read_ranges(bam.scan_ranges(index, headers, 1 << 14).withColumn("path", F.col("file")), **options)


def by_name(df):
    return {"/".join(r.file.split("/")[-2:]): r for r in df.collect()}


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for run, n in (("runA", 100), ("runB", 200)):
        (tmp_path / run).mkdir()
        write_bam(str(tmp_path / run / "same.bam"), [record(pos=i, read_name=f"{run}{i}") for i in range(n)])
        (tmp_path / run / "same_R1.fastq").write_text(GOOD * (n // 100))
    files = list_files(spark, str(tmp_path))
    got = preflight.analyze_bams(files)
    assert {k: r.records for k, r in by_name(got.record_totals).items()} == {"runA/same.bam": 100, "runB/same.bam": 200}
    assert {k: r.mapped for k, r in by_name(got.totals).items()} == {"runA/same.bam": 100, "runB/same.bam": 200}
    assert {k: (r.sampling, r.bai.split("/")[-2]) for k, r in by_name(got.status).items()} == {
        "runA/same.bam": ("pass", "runA"), "runB/same.bam": ("pass", "runB")
    }
    assert {k: r.reads for k, r in by_name(preflight.analyze_fastqs(files).summary).items()} == {
        "runA/same_R1.fastq": 12, "runB/same_R1.fastq": 24
    }
    sets = {r.dataset_id.split("/")[-2]: r for r in preflight.datasets.resolve_datasets(files).collect()}
    assert set(sets) == {"runA", "runB"} and all(r.summary == "BAM + BAI + R1" and not r.warnings for r in sets.values())
    assert sets["runB"].bam.endswith("runB/same.bam") and sets["runB"].bai.endswith("runB/same.bam.bai")


def test_scan_covers_files_without_index_or_places(spark, tmp_path):
    loose = [record(pos=-1, ref_id=-1, flag=4, read_name=f"u{i}") for i in range(50)]
    write_bam(str(tmp_path / "unplaced.bam"), loose)
    write_bam(str(tmp_path / "noindex.bam"), [record(pos=i) for i in range(70)], index=False)
    write_bam(str(tmp_path / "empty.bam"), [])
    got = scan(spark, tmp_path)
    assert {k.split("/")[1]: (r.records, r.failed_ranges) for k, r in by_name(bam.scan_status(got)).items()} == {
        "unplaced.bam": (50, 0), "noindex.bam": (70, 0)
    }
    few = scan(spark, tmp_path, tags=("CB",)).filter("ref_id = 0").first()
    assert few.cb and few.ub is None and few.tags_present == ["CB"] and few.read_name


def test_damaged_records_end_their_range(spark, tmp_path):
    import struct
    import zlib

    from strandcheck.plans.derived_files import encode_header, encode_record

    good = [encode_record(record(pos=i, read_name=f"r{i}")) for i in range(1000)]
    broken = struct.pack("<i", 40) + b"\xff" * 40
    body = encode_header("", [("chr1", 1000)]) + b"".join(good[:600]) + broken + b"".join(good[600:])

    def block(data):
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = packer.compress(data) + packer.flush()
        head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(packed) + 25)
        return head + packed + struct.pack("<II", zlib.crc32(data), len(data))

    whole = b"".join(block(body[i : i + 5000]) for i in range(0, len(body), 5000)) + bgzf.EOF_BLOCK
    (tmp_path / "bad.bam").write_bytes(whole)
    (tmp_path / "cut.bam").write_bytes(b"".join(block(x) for x in (body[:5000], body[5000:9000])))
    got = {k.split("/")[1]: r for k, r in by_name(bam.scan_status(scan(spark, tmp_path, batch=20_000))).items()}
    assert (got["bad.bam"].records, got["bad.bam"].failed_ranges) == (600, 1) and "damaged" in got["bad.bam"].error
    assert got["cut.bam"].failed_ranges == 1 and 0 < got["cut.bam"].records < 600


def test_record_budget(spark):
    rows = [("f", p, s, 0, 100 * p + s, "r", 0) for p in range(4) for s in range(100)]
    schema = "file string, point_no int, seq_in_point int, ref_id int, pos int, read_name string, flag int"
    df = spark.createDataFrame(rows, schema).withColumn("share", F.lit(40))
    got = bam.within_budget(df, 160, F.col("share")).groupBy("point_no").count().collect()
    # Twice the share from two points meets the target exactly.
    assert {r.point_no: r["count"] for r in got} == {0: 80, 1: 80}


@pytest.mark.parametrize("target", [30, 100, 400, 2000])
def test_record_budget_counts_different_records(spark, target):
    random = np.random.default_rng(target)
    rows = [(f, p, s, 0, int(random.integers(0, 300)), "r", int(random.integers(0, 2))) for f in "ab" for p in range(12) for s in range(int(random.integers(1, 90)))]
    schema = "file string, point_no int, seq_in_point int, ref_id int, pos int, read_name string, flag int"
    share = -(-target // 12)
    want = set()
    for f in "ab":
        seen = set()
        for p in range(12):
            if len(seen) >= target:
                break
            read = [r for r in rows if r[:2] == (f, p)][: min(2 * share, target - len(seen) + share)]
            seen |= {r[3:] for r in read}
            want |= {r[:3] for r in read}
    got = bam.within_budget(spark.createDataFrame(rows, schema).repartition(3), target, F.lit(share))
    assert {tuple(r)[:3] for r in got.select("file", "point_no", "seq_in_point").collect()} == want


# Starting without an index


def unplaced(n, seed=0, longest=400):
    r = random.Random(seed)
    return [
        record(ref_id=-1, pos=-1, flag=4, mapq=0, read_name="".join(r.choices("ACGT:0123456789", k=r.randint(1, 60))), l_seq=r.randint(1, longest + 1), gn="".join(r.choices("GENE;", k=r.randint(0, 90))))
        for _ in range(n)
    ]


def test_blocks_are_found_from_any_byte(tmp_path):
    write_bam(str(tmp_path / "x.bam"), unplaced(3000))
    data = (tmp_path / "x.bam").read_bytes()
    with open(tmp_path / "x.bam", "rb") as source:
        starts = [b.offset for b in bgzf.blocks(source, 0, len(data))]
        assert len(starts) > 5
        for at_byte in [*range(0, 300), *range(0, len(data), 997), *starts, *(x + 1 for x in starts), len(data) - 1]:
            want = next((x for x in starts if x >= at_byte), None)
            assert guess.first_block(source, at_byte, len(data), len(data)) == want
            assert want is None or guess.first_block(source, at_byte, want, len(data)) is None
    # bytes that look like a header, in a stored block, are none
    fake = bgzf.EOF_BLOCK[:16] + b"\xff\x00" + b"x" * 300
    (tmp_path / "y").write_bytes(b"??" + fake + data)
    with open(tmp_path / "y", "rb") as source:
        assert guess.first_block(source, 0, len(data), len(data) + 2 + len(fake)) == 2 + len(fake)


@pytest.mark.parametrize("longest", [0, 5, 400, 150_000])
def test_records_are_found_in_every_block(tmp_path, longest):
    rows = unplaced(2000 if longest < 1000 else 40, longest, longest)
    write_bam(str(tmp_path / "x.bam"), rows)
    size = (tmp_path / "x.bam").stat().st_size
    with open(tmp_path / "x.bam", "rb") as source:
        header = bam._read_header({"path": str(tmp_path / "x.bam")})
        blocks = list(bgzf.blocks(source, 0, size))
        joined, places = b"".join(b.data for b in blocks), []
        ends = np.cumsum([len(b.data) for b in blocks])
        at_byte = header["header_bytes"]
        while at_byte < len(joined):
            k = int(np.searchsorted(ends, at_byte, "right"))
            places.append(blocks[k].offset << 16 | at_byte - int(ends[k]) + len(blocks[k].data))
            at_byte = bam.next_record(joined, at_byte, 1 << 28)
        assert len(places) == len(rows)
        for b in blocks[1:]:
            want = next((p for p in places if p >= b.offset << 16), None)
            assert guess.first_record(source, b.offset, size, size, 1, 1 << 28) == want


@pytest.mark.parametrize("index", [True, False])
@pytest.mark.parametrize("span", [3000, 20_000, 1 << 30])
def test_scan_cuts_what_no_index_covers(spark, tmp_path, span, index):
    placed = [record(pos=i, read_name=f"p{i}") for i in range(500)]
    write_bam(str(tmp_path / "x.bam"), placed + unplaced(4000), index=index)
    write_bam(str(tmp_path / "none.bam"), unplaced(3000, 7), index=index)
    write_bam(str(tmp_path / "long.bam"), unplaced(30, 8, 100_000), index=index)
    write_bam(str(tmp_path / "empty.bam"), [], index=index)
    files = list_files(spark, str(tmp_path))
    headers = bam.read_headers(files)
    chunks = bai_source.chunks(bai_source.usable(bai_source.read_indexes(files)).withColumn("file", F.regexp_replace("file", r"\.bai$", "")))
    ranges = bam.scan_ranges(chunks, headers, span)
    found = bam.read_ranges(ranges.withColumn("path", F.col("file")), tags=())
    rows = found.select(F.regexp_extract("file", r"(\w+)\.bam", 1).alias("f"), "read_name", "pos", "l_seq", "error").collect()
    assert not [r.error for r in rows if r.error]
    want = [("x", r) for r in placed + unplaced(4000)] + [("none", r) for r in unplaced(3000, 7)] + [("long", r) for r in unplaced(30, 8, 100_000)]
    assert sorted(tuple(r)[:4] for r in rows) == sorted((f, r["read_name"], r["pos"], r["l_seq"]) for f, r in want)
    per_file = {r.f: r.n for r in ranges.groupBy(F.regexp_extract("file", r"(\w+)\.bam", 1).alias("f")).agg(F.count("*").alias("n")).collect()}
    if span == 3000:
        assert per_file["x"] > 20 and per_file["none"] > 20


def test_damage_in_an_unindexed_stretch_costs_its_range(spark, tmp_path):
    write_bam(str(tmp_path / "x.bam"), unplaced(4000), index=False)
    data = bytearray((tmp_path / "x.bam").read_bytes())
    middle = len(data) // 2
    data[middle : middle + 100] = bytes(100)
    (tmp_path / "x.bam").write_bytes(data)
    files = list_files(spark, str(tmp_path))
    ranges = bam.scan_ranges(spark.createDataFrame([], "file string, beg bigint"), bam.read_headers(files), 20_000)
    found = bam.read_ranges(ranges.withColumn("path", F.col("file")), tags=())
    (status,) = bam.scan_status(found).collect()
    assert status.failed_ranges == 1 and 3000 < status.records < 4000
    names = {r["read_name"] for r in unplaced(4000)[-200:]}
    assert names <= {r.read_name for r in found.select("read_name").collect()}


def bgzip(text: bytes, size: int) -> bytes:
    return b"".join(bgzf_block(text[k : k + size]) for k in range(0, len(text), size)) + bgzf.EOF_BLOCK


@pytest.mark.parametrize("damaged", [True, False])
@pytest.mark.parametrize("span", [200, 5000, 1 << 30])
def test_bgzip_in_ranges_gives_the_rows_of_the_stream(spark, tmp_path, span, damaged):
    r = random.Random(4)
    lines = []
    for i in range(1500):
        n = r.randint(1, 120)
        lines += [f"@r{i} {r.choice('12')}", "".join(r.choices("ACGTN", k=n)), "+", "".join(r.choices("+I#5" if damaged else "@+I#5", k=n))]
    for _ in range(40 if damaged else 0):  # stray, missing and broken lines
        k = r.randrange(len(lines))
        lines[k : k + r.choice([0, 1, 2])] = r.choice([[], ["stray"], ["@x"], [""], ["+"]])
    text = ("\n".join(lines) + r.choice(["", "\n", "\n@cut\nAC"][: 3 if damaged else 2])).encode()
    for name, data in (("a", bgzip(text, 700)), ("b", bgzip(text, 61)), ("c", bgzip(text.replace(b"\n", b"\r\n"), 5000)), ("d", bgzip(b"", 10)), ("e", bgzip(text, 65280))):
        (tmp_path / f"{name}.fastq.gz").write_bytes(data)
    files = fastq.detect_gzip(list_files(spark, str(tmp_path)))
    assert [r.bgzip for r in files.collect()] == [True] * 5
    columns = ["f", "header", "seq", "plus", "qual", "tail", "error"]
    rows = lambda raw: sorted(map(str, raw.withColumn("f", F.regexp_extract("file", r"(\w)\.fastq", 1)).select(columns).collect()))
    cut = fastq.splits(files, span)
    want = rows(fastq.read_records(fastq.splits(files.withColumn("bgzip", F.lit(False)))))
    assert len(want) > 5000 and rows(fastq.read_records(cut)) == want
    if span == 200:
        assert cut.filter("path like '%/a.%'").count() > 100


def test_a_damaged_block_of_a_bgzip_file_is_an_error_of_its_range(spark, tmp_path):
    data = bytearray(bgzip(b"".join(b"@r%d\nACGT\n+\nIIII\n" % i for i in range(20_000)), 5000))
    data[len(data) // 2] ^= 0xFF
    (tmp_path / "x.fastq.gz").write_bytes(data)
    files = fastq.detect_gzip(list_files(spark, str(tmp_path)))
    raw = fastq.read_records(fastq.splits(files, 5000))
    assert raw.filter("error is not null").count() == 1
    found = {r.header for r in fastq.decoded(raw).select("header").collect()}
    assert 17_000 < len(found) < 20_000 and {"@r0", "@r19999"} <= found


# BAI


def load_index(spark, tmp_path, data, name="x.bai"):
    (tmp_path / name).write_bytes(data)
    return bai_source.read_indexes(list_files(spark, str(tmp_path)))


def test_metadata_bins_and_trailer(spark, tmp_path):
    one = {
        "bins": [(0, [(at(1000, 10), at(1100, 20))]), (37450, [(at(1000), at(2000)), (123456, 789)])],
        "linear": [at(1000, 10)],
    }
    rows = load_index(spark, tmp_path, bai([one], trailer=42))
    files = bai_source.index_files(rows).withColumn("bam_size", F.lit(10_000)).withColumn("bam_n_ref", F.lit(1))
    totals = index_ops.index_totals(bai_source.meta(rows), files).first()
    assert (totals.mapped, totals.placed_unmapped, totals.total_unmapped) == (123456, 789, 831)
    points = index_ops.global_seek_points(bai_source.chunks(rows), bai_source.linear(rows), files, 8).collect()
    assert [(p.compressed, p.uncompressed) for p in points] == [(1000, 10)]


@pytest.mark.parametrize(
    "data, text",
    [
        (bai([{}], junk=b"\x01"), "1 bytes are left over"),
        (b"BAI", "3 bytes are no index"),
        (bai([{"bins": [(40000, [])]}]), "bin 40000 of reference 0"),
        (bai([{"bins": [(0, [(at(5), at(4))])]}]), "ends before it begins"),
        (bai([{"bins": [(37450, [(1, 2)])]}]), "has 1 parts, not 2"),
        (bai([{"linear": [1, 2]}])[:-4], "the index ends where 2 offsets should be"),
    ],
)
def test_index_problems(spark, tmp_path, data, text):
    assert text in bai_source.errors(load_index(spark, tmp_path, data)).first().error


def test_counts_without_metadata_are_unavailable(spark, tmp_path):
    rows = load_index(spark, tmp_path, bai([{"bins": [(0, [(at(1), at(2))])]}], trailer=5))
    totals = index_ops.index_totals(bai_source.meta(rows), bai_source.index_files(rows)).first()
    assert totals.mapped is None and totals.mapped_fraction is None and totals.total_unmapped == 5


# FASTQ

GOOD = "".join(
    f"@instrument:1:flow:1:1101:1:{i} {2 if i % 2 else 1}:N:0:ACGT\nACGTACGT\n+\nIIIIIIII\n" for i in range(12)
)


def fastq_file(spark, tmp_path, name, data):
    (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return fastq.detect_gzip(list_files(spark, str(tmp_path)))


def test_small_fastq_sample(spark, tmp_path, rows):
    files = fastq_file(spark, tmp_path, "reads.fastq", GOOD)
    sample = fastq.sample_records(files, 8)
    facts = rows(read_ops.integrity(sample))[0]
    assert facts["reads"] == 8 and facts["invalid_quality"] == 0 and facts["malformed"] == 0
    assert facts["quality_encoding"].startswith("Phred+33") and not facts["read_number_consistent"]
    whole = preflight.analyze_fastqs(list_files(spark, str(tmp_path)))
    summary = rows(whole.summary)[0]
    assert summary["reads"] == 12 and summary["strategy"] == "uncompressed full file"
    assert summary["illumina"]["instrument"] == "instrument" and summary["illumina"]["lane"] == 1


def test_malformed_and_cut_records(spark, tmp_path, rows):
    text = "@ok\nACGT\n+\nIIII\n@bad\nACGT\n+\nIII\n@tail\nAC"
    files = fastq_file(spark, tmp_path, "m.fastq", text)
    facts = rows(read_ops.integrity(fastq.sample_records(files, 10)))[0]
    assert (facts["reads"], facts["malformed"], facts["incomplete_tail"]) == (1, 1, True)


def test_no_valid_record_is_an_error(spark, tmp_path, rows):
    fastq_file(spark, tmp_path, "none.fastq", "hello\nthere\n")
    got = rows(preflight.analyze_fastqs(list_files(spark, str(tmp_path))).summary)[0]
    assert got["error"] == preflight.NO_READS


def many_reads(n=3000):
    rng = random.Random(2)
    out = []
    for i in range(n):
        length = rng.randint(1, 120)
        seq = "".join(rng.choice("ACGTN") for _ in range(length))
        # Qualities may start with @ or +, as headers and separators do.
        qual = rng.choice("@+I") + "".join(chr(rng.randint(33, 126)) for _ in range(length - 1))
        out.append((f"@read{i}", seq, "+", qual))
    return out


@pytest.mark.parametrize("span", [997, 50_000, 1 << 26])
def test_every_span_gives_the_same_records(spark, tmp_path, span, monkeypatch):
    reads = many_reads()
    files = fastq_file(spark, tmp_path, "s.fq", "".join("\n".join(r) + "\n" for r in reads))
    found = fastq.read_records(fastq.splits(files, span)).collect()
    assert sorted((r.header, r.seq, r.plus, r.qual) for r in found) == sorted(reads)


def test_gzip_members_and_missing_newline(spark, tmp_path):
    reads = many_reads(900)
    texts = ["".join("\n".join(r) + "\r\n" for r in part) for part in (reads[:400], reads[400:])]
    data = gzip.compress(texts[0].encode()) + gzip.compress(texts[1].rstrip().encode())
    files = fastq_file(spark, tmp_path, "unnamed.fastq", data)
    assert files.first().gzip
    found = fastq.read_records(fastq.splits(files)).orderBy("rec_no").collect()
    assert [(r.header, r.seq, r.plus, r.qual) for r in found] == reads
    few = fastq.sample_records(files, 25).collect()
    assert len(few) == 25 and max(r.rec_no for r in few) == 24


@pytest.mark.parametrize("span", [701, 20_000, 1 << 30])
def test_damage_costs_one_record_for_every_span(spark, tmp_path, rows, span):
    reads = many_reads(2000)
    lines = [list(r) for r in reads]
    lines[500] = lines[500][:2] + ["x"] + lines[500][3:]
    lines[900] = lines[900][1:]
    lines[1300].insert(0, "stray")
    text = "".join("\n".join(r) + "\n" for r in lines)
    files = fastq_file(spark, tmp_path, "d.fq", text)
    got = rows(read_ops.integrity(fastq.decoded(fastq.read_records(fastq.splits(files, span)))))[0]
    assert (got["reads"], got["malformed"], got["incomplete_tail"]) == (1998, 3, False)


def test_cut_or_damaged_gzip_is_an_error_of_its_file(spark, tmp_path, rows):
    data = gzip.compress("".join("\n".join(r) + "\n" for r in many_reads(5000)).encode())
    (tmp_path / "good.fastq.gz").write_bytes(data + bytes(100))
    (tmp_path / "cut.fastq.gz").write_bytes(data[: len(data) // 2])
    (tmp_path / "bad.fastq.gz").write_bytes(data[:5000] + bytes(300) + data[5300:])
    raw = fastq.read_records(fastq.splits(fastq.detect_gzip(list_files(spark, str(tmp_path)))))
    counts = {r.file.split("/")[-1]: r["count"] for r in fastq.decoded(raw).groupBy("file").count().collect()}
    assert counts["good.fastq.gz"] == 5000 and 0 < counts["cut.fastq.gz"] < 5000
    failed = {r.file.split("/")[-1]: r.error for r in fastq.failures(raw).collect()}
    assert set(failed) == {"cut.fastq.gz", "bad.fastq.gz"} and "ends before" in failed["cut.fastq.gz"]
    summary = {r["name"]: r for r in rows(preflight.analyze_fastqs(list_files(spark, str(tmp_path))).summary)}
    assert summary["good.fastq.gz"]["error"] is None and "ends before" in summary["cut.fastq.gz"]["error"]


def test_windows_do_not_overlap(spark):
    files = spark.createDataFrame([("p", "a.fastq", 5 << 20, False), ("q", "b.fastq", 1 << 30, False)], fastq.GZIP_SCHEMA)
    got = fastq.sample_windows(files).orderBy("file", "window").collect()
    small = [(r.start, r.end) for r in got if r.file == "p"]
    assert small == [(0, 1 << 20), (1 << 20, 5 << 20)]
    large = [(r.start, r.end) for r in got if r.file == "q"]
    assert len(large) == 16 and large[-1][1] == 1 << 30
    assert all(b - a == 4 << 20 for a, b in large)
    overlapping = fastq.sample_windows(files, overlap=True).filter("file = 'p'").orderBy("window").collect()
    assert [(r.start, r.end) for r in overlapping] == [(0, 4 << 20), (1 << 20, 5 << 20)]


# FAI


def test_fai_rows(spark, tmp_path, rows):
    path = tmp_path / "g.fai"
    path.write_text("a\t100\t0\t50\t51\n\nb\t80\t102\t50\t51\r\nc\t20\t184\t20\t21\textra\n")
    df = fai_source.read_fai(spark, str(path))
    got = rows(contigs.fai_summary(df))[0]
    assert (got["contigs"], got["total_length"], got["n50"], got["l50"]) == (3, 200, 100, 1)
    assert [r.line_no for r in df.orderBy("line_no").collect()] == [1, 3, 4]
    assert [r.name for r in fai_source.first_rows(df, 2).orderBy("rank").collect()] == ["a", "b"]


@pytest.mark.parametrize("line, text", [("x\t1\t2", "3 of 5 columns"), ("x\t1\t2\t\t5", "no whole number")])
def test_bad_fai_lines(spark, tmp_path, line, text):
    path = tmp_path / "bad.fai"
    path.write_text(f"a\t100\t0\t50\t51\n{line}\n")
    lenient = fai_source.read_fai(spark, str(path), fail_fast=False)
    bad = lenient.filter("error is not null").first()
    assert text in bad.error and "line 2" in bad.error
    with pytest.raises(Exception, match=text):
        fai_source.read_fai(spark, str(path)).select("name").collect()


def test_fai_files_of_one_name_stay_apart(spark, tmp_path):
    for folder, length in (("a", 100), ("b", 300)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "genome.fa.fai").write_text(f"c\t{length}\t0\t50\t51\n")
    df = fai_source.read_fai(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    got = {r.file.split("/")[-2]: (r.contigs, r.total_length) for r in contigs.fai_summary(df, ["file"]).collect()}
    assert got == {"a": (1, 100), "b": (1, 300)}
    listed = {r.path for r in list_files(spark, str(tmp_path)).collect()}
    assert {r.file for r in df.collect()} == listed


def test_a_mixed_selection_keeps_a_status_for_each_file(spark, tmp_path):
    write_bam(str(tmp_path / "s1.bam"), [record(pos=i, read_name=f"r{i}") for i in range(50)])
    (tmp_path / "bad.bam").write_bytes(b"not a bam at all, but long enough")
    (tmp_path / "other.bai").write_bytes(bai([{}]))
    (tmp_path / "s1_R1.fastq").write_text("@r 1\nACGT\n+\nIIII\n" * 5)
    (tmp_path / "cut.fastq.gz").write_bytes(gzip.compress(b"@r 1\nACGT\n+\nIIII\n" * 500)[:-20])
    (tmp_path / "none.fastq").write_text("x\n")
    (tmp_path / "g.fa.fai").write_text("a\t100\t0\t50\t51\n")
    (tmp_path / "bad.fai").write_text("a\t100\t0\t50\t51\nb\t1\n")
    (tmp_path / "notes.txt").write_text("x")
    gone = spark.createDataFrame([(f"file:{tmp_path}/gone.{k}", f"gone.{k}", 10, 0) for k in ("bam", "fastq", "fai")], "path string, name string, size bigint, position bigint")
    listed = list_files(spark, str(tmp_path)).select(gone.columns).unionByName(gone.filter("name <> 'gone.fai'"))
    result = preflight.analyze_files(listed)
    got = {r.file.split("/")[-1]: r for r in result.status.collect()}
    assert {k: r.status for k, r in got.items()} == {
        "s1.bam": "pass", "s1.bam.bai": "used", "bad.bam": "failed", "other.bai": "unassigned", "s1_R1.fastq": "pass", "cut.fastq.gz": "failed", "none.fastq": "failed",
        "g.fa.fai": "pass", "bad.fai": "failed", "notes.txt": "not analysed", "gone.bam": "failed", "gone.fastq": "failed",
    }
    assert "index line 2" in got["bad.fai"].error and got["s1.bam"].dataset == "s1"
    assert [r.contigs for r in result.contig_summary.filter("file like '%g.fa.fai'").collect()] == [1]
    assert result.bams.record_totals.first().records == 50 and result.consistency.count() == 1


def test_sinks(spark, tmp_path):
    import json

    (tmp_path / "in").mkdir()
    write_bam(str(tmp_path / "in" / "one.bam"), [record(), record(pos=300, read_name="s")])
    got = preflight.analyze_bams(list_files(spark, str(tmp_path / "in")))
    metrics = preflight.bam_metrics(got)
    report.write_json(metrics, str(tmp_path / "json"))
    text = "".join(p.read_text() for p in (tmp_path / "json").glob("part-*"))
    document = json.loads(text)
    mapped = [m for m in document["metrics"] if (m["section"], m["metric"]) == ("index", "mapped")]
    assert document["file"].endswith("/one.bam") and mapped[0]["text"] == "2" and mapped[0]["provenance"] == "EXACT"
    report.write_metrics(metrics, str(tmp_path / "metrics"))
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == metrics.count()


def test_shared_folder_comes_from_the_session(spark):
    from types import SimpleNamespace

    from strandcheck import session

    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": "s3://x/y"}.get(key, default)))
    assert session.shared_dir(named) == "s3://x/y"
    assert session.fresh_dir(named, "a").startswith("s3://x/y/a-")
    assert session.shared_dir(spark) == session.shared_dir(spark)


def test_deep_mode_ends_at_the_stop(spark, tmp_path, monkeypatch):
    from strandcheck.functions import constants as K

    records = [record(pos=i * 20_000, read_name=f"r{i}", cb=f"C{i % 3}-1") for i in range(6000)]
    write_bam(str(tmp_path / "deep.bam"), records)
    files = list_files(spark, str(tmp_path))
    monkeypatch.setattr(preflight.convergence.convergence, "__defaults__", (200, ()))
    monkeypatch.setitem(K.RECORD_TARGET, "deep", 4000)
    deep = preflight.analyze_bams(files, "deep")
    kept = {r.point_no for r in deep.records.select("point_no").distinct().collect()}
    marks = deep.convergence.orderBy("point_no").collect()
    assert kept == {r.point_no for r in marks if not r.past_stop}
    assert any(r.past_stop for r in marks)


def test_small_ranges_read_little(tmp_path):
    """What a range costs depends on its own bytes, not on a fixed piece of the file."""
    import io

    dice = random.Random(5)
    text = b"".join(b"@r%d\n%s\n+\n%s\n" % (i, bytes(dice.choices(b"ACGT", k=200)), b"I" * 200) for i in range(10_000))
    packed = bgzip(text, 65280)

    class Counted(io.BytesIO):
        asked = 0

        def read(self, n=-1):
            got = super().read(n)
            self.asked += len(got)
            return got

    for data, most, read in (
        (text, 8, lambda s, a, b: fastq._records_of_range(s, a, b, len(text))),
        (packed, 24, lambda s, a, b: fastq._records_of_blocks(s, a, b, len(packed))),
    ):
        span, asked, found = 8 << 10, 0, 0
        for start in range(0, len(data), span):
            source = Counted(data)
            found += sum(len(group) for group in read(source, start, min(len(data), start + span)))
            asked += source.asked
        assert found == 10_000
        assert asked < most * len(data)


def test_small_ranges_share_tasks(spark):
    from strandcheck.sources.storage import spread_bytes

    ranges = spark.range(100_000).select((F.col("id") * 8192).alias("start"), ((F.col("id") + 1) * 8192).alias("end"))
    assert spread_bytes(ranges, F.col("end") - F.col("start")).rdd.getNumPartitions() == 25


@pytest.mark.parametrize("rows_at_once", [13, 700, 2000])
def test_batches_are_written_as_records_one_by_one(rows_at_once):
    import io

    import pyarrow as pa
    from strandcheck.plans.derived_files import BamFile, encode_header

    dice = random.Random(rows_at_once)
    some = lambda *values: dice.choice([None, *values])
    rows = [
        record(ref_id=dice.randrange(-1, 3), pos=dice.randrange(200_000), read_name=f"r{i}" * dice.randrange(1, 4), mapq=dice.randrange(256), flag=dice.randrange(4096),
               l_seq=dice.randrange(1, 300), spliced=dice.random() < 0.3, cb=some("AC-1", ""), ub=some("ACGT"), gx=some("G\u00e9"), gn=some("a;b"), re=some("E", "N"), nh=some(1, 70_000))
        for i in range(2000)
    ]
    rows.sort(key=lambda r: (r["ref_id"] < 0, r["ref_id"], r["pos"]))
    refs = [("chr1", 1 << 20), ("chr2", 1 << 20), ("chr3", 1 << 20)]
    sinks = io.BytesIO(), io.BytesIO()
    one, many = (BamFile(s, encode_header("", refs), 3) for s in sinks)
    for r in rows:
        one.add(r)
    schema = pa.RecordBatch.from_pylist(rows).schema
    for k in range(0, len(rows), rows_at_once):
        many.add_all(pa.RecordBatch.from_pylist(rows[k : k + rows_at_once], schema=schema))
    assert one.close() == many.close() and sinks[0].getvalue() == sinks[1].getvalue()
    assert one.index() == many.index()


def test_sampled_files_stay_within_their_windows(spark, monkeypatch):
    """More reads make more files, so a sample above their number has every read."""
    from strandcheck.plans.registry import all_queries

    monkeypatch.setattr(fastq, "WINDOW_BYTES", 100_000)
    folder = "/root/testdata/sf0.01"
    (row,) = all_queries()["fastq_sample"].build(spark, folder).collect()
    assert row["reads"] == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_places_of_records_come_in_order_and_whole():
    """Stretch by stretch the same places are found as in all bytes at once, also where the last fields reach over the edge of a stretch."""
    data = b"".join(D.encode_record(record(pos=i, read_name="n" * (i % 200 + 1))) for i in range(400))
    for cut in (0, 7, 100):
        part = data[cut:]
        assert list(guess.places_in_order(part, 3, 1 << 28)) == guess.likely_records(part, 3, 1 << 28).tolist()
    places, lots = guess.places_in_order(data, 3, 1 << 28), []
    search = guess.likely_records
    try:
        guess.likely_records = lambda some, *rest: lots.append(len(some)) or search(some, *rest)
        assert next(places) == 0 and max(lots) < len(data) // 10  # the first place costs a stretch, not all bytes
    finally:
        guess.likely_records = search


def test_a_run_of_records_is_probed_at_once():
    rows = [D.encode_record(record(pos=i, read_name=f"r{i}")) for i in range(8)]
    data = b"".join(rows)
    assert bam.probe_record(data, 0, 3, 1 << 28, 6) == 6 and bam.probe_record(data[:-1], 0, 3, 1 << 28, 8) == 7
    broken = b"".join([*rows[:3], rows[3][:-3] + b"?" * 3, *rows[4:]])
    assert bam.probe_record(broken, 0, 3, 1 << 28, 3) == 3
    with pytest.raises(bam.BamError, match=str(len(rows[0]) * 3)):
        bam.probe_record(broken, 0, 3, 1 << 28, 6)


def test_costly_columns_are_made_once_the_rows_lie_in_their_files(spark, tmp_path):
    """The rows are gone over twice, for the ranges and to be written; records are made of them once."""
    made = spark.sparkContext.accumulator(0)

    def named(names):
        made.add(1)
        return names

    rows = spark.range(500).select((F.col("id") * 10).cast("int").alias("at"), (F.col("id") % 3).cast("int").alias("r"))

    def as_records(lines):
        name = F.udf(lambda at: named(f"n{at}"), "string").asNondeterministic()
        return lines.select(
            F.col("r").alias("ref_id"), F.col("at").alias("pos"), name("at").alias("read_name"), F.lit(9).alias("mapq"), F.lit(0).alias("flag"),
            F.lit(50).alias("l_seq"), F.lit(False).alias("spliced"), F.lit("C").alias("cb"), F.lit(None).cast("string").alias("ub"),
        )

    files = D.write_bams(rows, "@HD\tVN:1.6\n", [("a", 1 << 29), ("b", 1 << 29), ("c", 1 << 29)], parts=4, by=("r", "at"), as_records=as_records)
    assert made.value == 500
    headers = bam.read_headers(files)
    found = bam.decoded(scanned_records(files, headers, ("CB", "UB")))
    assert sorted((x.ref_id, x.pos, x.read_name, x.cb, x.ub) for x in found.collect()) == sorted((i % 3, i * 10, f"n{i * 10}", "C", None) for i in range(500))


def test_few_rows_are_looked_up_without_sorting_all_known_ones(spark):
    known = spark.range(3_000_000).select((F.col("id") * 2).alias("pos"), F.lit(1).alias("flag"))
    few = spark.sql("select * from values (4L, 1), (5L, 1), (4L, 2), (5L, 1), (6L, 1) as t(pos, flag)")
    found = not_among(few, known, ["pos", "flag"])
    assert sorted(map(tuple, found.collect())) == [(4, 2), (5, 1), (5, 1)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "LeftSemi, BuildRight" in plan  # only what is found among the known rows goes to the join by a shuffle
