"""Queries that read bytes: files are derived from the tables, then decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import alignments as aln_ops
from ..operators import barcodes, contigs
from ..operators import index as index_ops
from ..operators import reads as read_ops
from ..operators.histograms import numbered
from ..session import materialize
from ..sources import bai, bam, fai, fastq, formats
from ..sources.storage import list_files
from ..streaming import progressive
from . import derived_files as D
from . import preflight, report
from . import views as V
from .alignment_queries import convergence_sql
from .registry import query

HEADER_TEXT = "@HD\tVN:1.6\tSO:coordinate\n@RG\tID:rg1\tSM:lines\tLB:lib1\n@PG\tID:cellranger\tPN:cellranger\n"


def _round(df: DataFrame, *names: str, digits: int = 8) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _placed_records(lines: DataFrame) -> DataFrame:
    return V.as_alignments(lines, genes=True).select(
        "ref_id", (F.col("pos") % 536870000).cast("int").alias("pos"), "read_name", "mapq", "flag", "l_seq",
        "spliced", "cb", "ub", "gx", "gn", "re", "nh",
    )


def bam_files(spark: SparkSession, folder: str, parts: int | None = None) -> DataFrame:
    """The alignments as sorted, indexed BAM files, ``parts`` of them if given."""
    lines = V.alignment_lines(spark, folder, genes=True)
    place = ("s_nationkey", F.col("l_orderkey") % 536870000, "l_linenumber")
    pieces = -(-V.table(spark, folder, "lineitem").count() // D.PIECE_RECORDS) if parts else 0
    return D.write_bams(lines, HEADER_TEXT, D.nation_references(), parts, place, _placed_records, pieces)


def _index(files: DataFrame) -> DataFrame:
    """Index rows under the name of their BAM."""
    rows = bai.usable(materialize(bai.read_indexes(files), "index"))
    return rows.withColumn("file", F.regexp_replace("file", r"(?i)\.bai$", ""))


def _with_path(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files.select(F.col("path").alias("file"), "path"), "file")


def scanned_records(files: DataFrame, headers: DataFrame, tags: tuple[str, ...] = K.WANTED_TAGS) -> DataFrame:
    """Every record of the files; ranges that end early keep a row with their error."""
    ranges = bam.scan_ranges(bai.chunks(_index(files)), headers, span=1 << 20)
    return bam.read_ranges(_with_path(ranges, files), tags=tags)


_BAM_SQL = f"(select *, pos % 536870000 p from ({V.GENE_ALIGNMENTS_SQL}) a)"


@query(
    "bam_scan",
    f"""select ref_id, ref_name, count(*) records, cast(sum(p) as bigint) pos_sum, cast(sum(mapq) as bigint) mapq_sum, cast(sum(flag) as bigint) flag_sum, cast(sum(l_seq) as bigint) length_sum,
 count(*) filter (where spliced) spliced, count(distinct cb) barcodes, count(distinct ub) umis, count(gx) gx, count(distinct gn) gene_names, count(*) filter (where re = 'E') exonic, cast(sum(nh) as bigint) nh_sum, count(distinct read_name) names from {_BAM_SQL} a group by all""",
)
def bam_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every record, written to BAM and decoded again, per reference."""
    files = bam_files(spark, folder)
    headers = materialize(bam.read_headers(files), "headers")
    refs = bam.references(headers).select("file", "ref_id", F.col("name").alias("ref_name"))
    found = bam.decoded(scanned_records(files, headers, ("CB", "UB", "GX", "GN", "RE", "NH")))
    records = found.join(refs, ["file", "ref_id"], "left")
    total = lambda c, name: F.sum(c).cast("bigint").alias(name)
    return records.groupBy("ref_id", "ref_name").agg(
        F.count(F.lit(1)).alias("records"),
        total("pos", "pos_sum"),
        total("mapq", "mapq_sum"),
        total("flag", "flag_sum"),
        total("l_seq", "length_sum"),
        F.count_if("spliced").alias("spliced"),
        F.count_distinct("cb").alias("barcodes"),
        F.count_distinct("ub").alias("umis"),
        F.count("gx").alias("gx"),
        F.count_distinct("gn").alias("gene_names"),
        F.count_if(F.col("re") == "E").alias("exonic"),
        total("nh", "nh_sum"),
        F.count_distinct("read_name").alias("names"),
    )


@query(
    "bam_unplaced_scan",
    f"""select count(*) records, count(*) records_of_names, count(distinct read_name) names, cast(sum(mapq) as bigint) mapq_sum, cast(sum(flag | 4) as bigint) flag_sum, cast(sum(l_seq) as bigint) length_sum, cast(0 as bigint) failed_ranges, true as many_ranges from ({V.ALIGNMENTS_SQL}) a""",
)
def bam_unplaced_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of files in which no record has a place, cut into ranges of 16 KiB that no index knows."""
    records = lambda lines: V.as_alignments(lines).select(
        F.lit(-1).alias("ref_id"), F.lit(-1).alias("pos"), "read_name", "mapq", F.col("flag").bitwiseOR(4).alias("flag"), "l_seq",
        F.lit(False).alias("spliced"), "cb", "ub", "gx", F.lit(None).cast("string").alias("gn"), "re", "nh",
    )
    lines = V.alignment_lines(spark, folder)
    files = D.write_bams(lines, HEADER_TEXT, D.nation_references(), by=("l_orderkey", "l_linenumber"), as_records=records)
    headers = materialize(bam.read_headers(files), "headers")
    ranges = materialize(bam.scan_ranges(bai.chunks(_index(files)), headers, span=16 << 10), "ranges")
    found = materialize(bam.read_ranges(_with_path(ranges, files), tags=()), "records")
    status = bam.scan_status(found).agg(F.coalesce(F.sum("failed_ranges"), F.lit(0)).alias("n")).scalar()
    fewest = ranges.join(headers.select("file", "size"), "file").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    cut = fewest.agg(F.bool_and(F.col("n") >= F.floor(F.col("size") / (32 << 10)))).scalar()
    good = bam.decoded(found)
    per_name = good.groupBy("read_name").agg(F.count(F.lit(1)).alias("n"))
    names = per_name.agg(F.count(F.lit(1)).alias("names"), F.sum("n").alias("records_of_names"))
    return good.agg(
        F.count(F.lit(1)).alias("records"), F.sum("mapq").cast("bigint").alias("mapq_sum"), F.sum("flag").cast("bigint").alias("flag_sum"),
        F.sum("l_seq").cast("bigint").alias("length_sum"),
    ).select(
        "records", names.select("records_of_names").scalar().alias("records_of_names"), names.select("names").scalar().alias("names"),
        "mapq_sum", "flag_sum", "length_sum", status.alias("failed_ranges"), cut.alias("many_ranges"),
    )


@query(
    "bam_format",
    f"""select ref_id, count(*) records, cast(sum(p) as bigint) pos_sum, cast(sum(flag) as bigint) flag_sum, count(cb) with_barcode from {_BAM_SQL} a where ref_id in (3, 7, 24) group by ref_id""",
)
def bam_format(spark: SparkSession, folder: str) -> DataFrame:
    """Records of three references through ``spark.read.format("bam")``, cut into spans of 64 KiB at least; one tag is decoded."""
    files = bam_files(spark, folder)
    formats.register(spark)
    (place,) = files.select(F.min(F.regexp_extract("path", "^(.*)/", 1))).first()
    rows = spark.read.format("bam").schema("ref_id int, pos int, flag int, cb string").option("span", 64 << 10).load(place)
    return rows.filter(F.col("ref_id").isin(3, 7, 24)).groupBy("ref_id").agg(
        F.count(F.lit(1)).alias("records"), F.sum("pos").cast("bigint").alias("pos_sum"), F.sum("flag").cast("bigint").alias("flag_sum"), F.count("cb").alias("with_barcode")
    )


@query(
    "fastq_format",
    f"""select split_part(header, ':', 3) lang, count(*) reads, cast(sum(length(seq)) as bigint) bases from ({V.READS_SQL}) x group by 1""",
)
def fastq_format(spark: SparkSession, folder: str) -> DataFrame:
    """Reads through ``spark.read.format("fastq")``, from files of BGZF blocks in spans of 64 KiB at least."""
    files = D.write_bgzip(V.reads(spark, folder).withColumn("plus", F.lit("+")))
    formats.register(spark)
    (place,) = files.select(F.min(F.regexp_extract("path", "^(.*)/", 1))).first()
    rows = spark.read.format("fastq").schema("header string, seq string").option("span", 64 << 10).load(place)
    return rows.groupBy(F.element_at(F.split("header", ":"), 3).alias("lang")).agg(F.count(F.lit(1)).alias("reads"), F.sum(F.length("seq")).cast("bigint").alias("bases"))


@query(
    "bam_header_scan",
    f"""select cast(n_nationkey as int) ref_id, case when n_nationkey = 24 then 'chrM' else concat('chr', cast(n_nationkey + 1 as varchar)) end as name, cast(536870912 as bigint) length, true as in_all_files, true as all_have_eof from nation""",
)
def bam_header_scan(spark: SparkSession, folder: str) -> DataFrame:
    headers = materialize(bam.read_headers(bam_files(spark, folder)), "headers")
    files = headers.agg(F.count(F.lit(1))).scalar()
    missing = headers.agg(F.count_if(~F.col("eof") | F.col("error").isNotNull())).scalar()
    return (
        bam.references(headers)
        .groupBy("ref_id", "name", "length")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("ref_id", "name", "length", (F.col("n") == files).alias("in_all_files"), (missing == 0).alias("all_have_eof"))
    )


@query(
    "bai_scan",
    f"""select ref_id, count(*) filter (where (flag & 4) = 0) mapped, count(*) filter (where (flag & 4) <> 0) placed_unmapped, cast(0 as bigint) unplaced from {_BAM_SQL} a group by ref_id""",
)
def bai_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the index metadata bins, against counting the records."""
    rows = _index(bam_files(spark, folder))
    unplaced = bai.index_files(rows).agg(F.sum("no_coordinate")).scalar()
    return (
        bai.meta(rows)
        .groupBy("ref_id")
        .agg(F.sum("mapped").alias("mapped"), F.sum("placed_unmapped").alias("placed_unmapped"))
        .withColumn("unplaced", unplaced)
    )


def _index_tables(files: DataFrame) -> tuple[DataFrame, ...]:
    rows = _index(files)
    headers = materialize(bam.read_headers(files), "headers")
    sizes = headers.select("file", F.col("size").alias("bam_size"), F.size("refs").alias("bam_n_ref"))
    return (
        bai.chunks(rows),
        bai.linear(rows),
        bai.meta(rows),
        bai.index_files(rows).join(sizes, "file"),
    )


@query("index_probe", "select true ok, cast(null as varchar) as error, true as every_file")
def index_probe(spark: SparkSession, folder: str) -> DataFrame:
    """Rules and strict record probes of every index; all of them must hold."""
    files = bam_files(spark, folder)
    chunks, linear, meta, index_files = _index_tables(files)
    points = index_ops.global_seek_points(chunks, linear, index_files, K.PROBE_POINTS)
    probed = bam.probe_points(_with_path(points.join(index_files.select("file", F.col("bam_n_ref").alias("n_ref")), "file"), files))
    broken = index_ops.validation_errors(chunks, linear, meta, index_files).select(
        "file", F.lit(False).alias("ok"), F.col("message").alias("error")
    )
    every = probed.select("file", "ok", "error").unionByName(broken)
    number = index_files.agg(F.count(F.lit(1))).scalar()
    return (
        every.groupBy("ok", "error")
        .agg(F.count_distinct("file").alias("n"))
        .select("ok", "error", (F.col("n") == number).alias("every_file"))
    )


def sampled_records(files: DataFrame, mode: str = "quick", target: int | None = None) -> DataFrame:
    """The bounded, stratified sample of every file, deduplicated."""
    chunks, linear, _, index_files = _index_tables(files)
    points = materialize(
        index_ops.stratified_seek_points(chunks, linear, index_files, K.SEEK_POINTS[mode]), "points"
    )
    return sample_points(_with_path(points, files), target or K.RECORD_TARGET[mode])


def sample_points(points: DataFrame, target: int) -> DataFrame:
    sizes = points.groupBy("file").agg(F.count(F.lit(1)).alias("points"))
    shared = points.join(sizes, "file").withColumn("share", F.ceil(F.lit(target) / F.col("points")))
    raw = materialize(bam.read_points(shared, F.col("share") * 2), "sample")
    kept = bam.within_budget(
        bam.decoded(raw).join(shared.select("file", "point_no", "share"), ["file", "point_no"]), target, F.col("share")
    ).drop("share")
    return aln_ops.dedup_records(kept, ["point_no", "seq_in_point"], by=["file"])


def not_among(few: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``few`` whose keys no row of ``known`` has; the keys are looked up in ``known`` first, so that Spark can leave its rows where they are."""
    return few.join(known.select(keys).join(few.select(keys), keys, "left_semi"), keys, "left_anti")


@query(
    "bam_sample",
    "select true as has_records, true as within_target, true as all_known, cast(25 as bigint) as references_known",
)
def bam_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A sample of 300 records per file and at most as many more from its last point, made of records of the tables only."""
    files = bam_files(spark, folder)
    sample = materialize(sampled_records(files, target=300), "records")
    known = V.alignments(spark, folder).select(
        "ref_id", (F.col("pos") % 536870000).cast("int").alias("pos"), "read_name", "flag"
    )
    strangers = not_among(sample, known, ["ref_id", "pos", "read_name", "flag"]).agg(F.count(F.lit(1))).scalar()
    references = bam.references(bam.read_headers(files)).agg(F.count_distinct("ref_id")).scalar()
    per_file = sample.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(
        (F.min("n") > 0).alias("has_records"),
        (F.max("n") <= 600).alias("within_target"),
    ).select("has_records", "within_target", (strangers == 0).alias("all_known"), references.alias("references_known"))


# Windows of so many records, evenly spread over each sample, stand for what is read at seek points; records of one reference and length count as repeats.
_POINTS, _WINDOW, _TARGET = 18, 250, 600
_SHARE = -(-_TARGET // _POINTS)


@query(
    "record_budget",
    f"""with recursive a as (select *, row_number() over (partition by file order by record_no, mapq, ref_id, l_seq) - 1 n, count(*) over (partition by file) size from ({V.ALIGNMENTS_SQL}) x),
v as (select *, n - greatest(0, size - {_WINDOW}) * i // {_POINTS - 1} seq from a, range({_POINTS}) r(i) where n - greatest(0, size - {_WINDOW}) * i // {_POINTS - 1} between 0 and {_WINDOW - 1}),
p as (select file, i, list(ref_id * 1000 + l_seq order by seq) k from v group by file, i),
w as (select distinct file, cast(-1 as bigint) i, cast([] as integer[]) seen, cast(0 as bigint) budget from p
 union all select b.file, b.i + 1, list_distinct(list_concat(seen, coalesce(k[1:room], []))), room from
 (select file, i, seen, cast(case when len(seen) >= {_TARGET} then 0 else least({2 * _SHARE}, {_TARGET} - len(seen) + {_SHARE}) end as bigint) room from w where i < {_POINTS - 1}) b join p on p.file = b.file and p.i = b.i + 1)
select w.file, cast(w.i as int) point_no, budget, count(*) records, cast(sum(pos) as bigint) pos_sum, cast(sum(mapq) as bigint) mapq_sum from w join v on v.file = w.file and v.i = w.i and seq < budget group by all""",
)
def record_budget(spark: SparkSession, folder: str) -> DataFrame:
    """What a reader takes from its windows that counts different records only, so that repeats don't use up its target."""
    rows = V.alignments(spark, folder).select("file", "ref_id", "pos", "mapq", "l_seq", "record_no")
    placed = materialize(numbered(rows, ["file"], ["record_no", "mapq", "ref_id", "l_seq"]), "numbered")
    sizes = placed.groupBy("file").agg(F.count(F.lit(1)).alias("size"))
    room = F.greatest(F.lit(0), F.col("size") - _WINDOW)
    starts = sizes.select("file", F.explode(F.sequence(F.lit(0), F.lit(_POINTS - 1))).alias("point_no"), room.alias("room")).select(
        "file", "point_no", F.floor(F.col("room") * F.col("point_no") / (_POINTS - 1)).alias("start")
    )
    seq = (F.col("nth") - 1 - F.col("start")).alias("seq_in_point")
    windows = placed.join(starts, "file").select(*placed.columns, "point_no", seq).filter(F.col("seq_in_point").between(0, _WINDOW - 1))
    kept = bam.within_budget(windows, _TARGET, F.lit(_SHARE), ("ref_id", "l_seq"), keep_budget=True)
    return kept.groupBy("file", "point_no", "budget").agg(
        F.count(F.lit(1)).alias("records"), F.sum("pos").cast("bigint").alias("pos_sum"), F.sum("mapq").cast("bigint").alias("mapq_sum")
    )


@query(
    "bam_tag_presence",
    f"""with a as {_BAM_SQL}, t as ({' union all '.join(f"select '{t.upper()}' tag, count({t}) n, count(*) r from a" for t in ('cb', 'ub', 'gx', 'gn', 're', 'nh'))}) select tag, n, round(n/r, 8) fraction from t where n > 0""",
)
def bam_tag_presence(spark: SparkSession, folder: str) -> DataFrame:
    """Tag shares from decoded aux fields."""
    files = bam_files(spark, folder)
    found = scanned_records(files, materialize(bam.read_headers(files), "headers"))
    return _round(aln_ops.tag_presence(bam.decoded(found)), "fraction")


_FASTQ_RAW = f"""(select header, upper(trim(seq)) seq, trim(qual) qual, header like '@%' and plus like '+%' and length(trim(seq)) = length(trim(qual)) and length(trim(seq)) > 0 ok from ({V.RAW_READS_SQL}) r)"""


@query(
    "fastq_gzip_scan",
    f"""select count(*) filter (where ok) reads, count(*) filter (where not ok) malformed, false incomplete_tail, cast(sum(length(translate(seq, 'ACGTNRYKMSWBDHV.-', ''))) filter (where ok) as bigint) invalid_bases,
 cast(sum(length(regexp_replace(qual, '[!-~]', '', 'g'))) filter (where ok) as bigint) invalid_quality, cast(count(distinct seq) filter (where ok) as bigint) unique_sequences from {_FASTQ_RAW} r""",
)
def fastq_gzip_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Records with defects through gzip FASTQ files, one stream per file."""
    files = D.write_fastq(V.raw_reads(spark, folder), gzip=True)
    raw = materialize(fastq.decoded(fastq.read_records(fastq.splits(fastq.detect_gzip(files)))), "reads")
    valid = read_ops.checked(raw).filter("valid")
    unique = read_ops.read_totals(valid).select("unique_sequences").scalar()
    return (
        read_ops.integrity(raw)
        .select("reads", "malformed", "incomplete_tail", "invalid_bases", "invalid_quality")
        .withColumn("unique_sequences", unique)
    )


@query(
    "fastq_bgzip_scan",
    f"""select count(*) filter (where ok) reads, count(*) filter (where not ok) malformed, cast(sum(length(seq)) filter (where ok) as bigint) bases, cast(count(distinct seq) filter (where ok) as bigint) unique_sequences,
 cast(sum(ascii(qual)) filter (where ok) as bigint) quality_sum from {_FASTQ_RAW} r""",
)
def fastq_bgzip_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Records with defects through FASTQ files of BGZF blocks, cut into ranges of 32 KiB of compressed bytes."""
    files = fastq.detect_gzip(D.write_bgzip(V.raw_reads(spark, folder)))
    raw = fastq.decoded(fastq.read_records(fastq.splits(files, span=32 << 10)))
    rows = materialize(read_ops.checked(raw), "reads")
    unique = rows.filter("valid").select("seq").distinct().agg(F.count(F.lit(1))).scalar()
    ok = F.col("valid")
    return rows.agg(
        F.count_if(ok).alias("reads"), F.count_if(~ok).alias("malformed"), F.sum(F.when(ok, F.length("seq"))).cast("bigint").alias("bases"),
        F.sum(F.when(ok, F.ascii("qual"))).cast("bigint").alias("quality_sum"),
    ).select("*", unique.alias("unique_sequences"))


@query(
    "fastq_scan",
    f"""select lang, count(*) reads, cast(sum(length(seq)) as bigint) bases, count(distinct seq) unique_sequences, cast(sum(ascii(qual)) as bigint) quality_sum from (select split_part(header, ':', 3) lang, seq, qual from ({V.READS_SQL}) x) r group by lang""",
)
def fastq_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Reads through plain FASTQ files cut into byte ranges of 8 KiB."""
    rows = V.reads(spark, folder).withColumn("plus", F.lit("+"))
    files = fastq.detect_gzip(D.write_fastq(rows))
    raw = fastq.decoded(fastq.read_records(fastq.splits(files, span=8 << 10)))
    return raw.groupBy(F.element_at(F.split("header", ":"), 3).alias("lang")).agg(
        F.count(F.lit(1)).alias("reads"),
        F.sum(F.length("seq")).cast("bigint").alias("bases"),
        F.count_distinct("seq").alias("unique_sequences"),
        F.sum(F.ascii("qual")).cast("bigint").alias("quality_sum"),
    )


@query(
    "fastq_sample",
    f"""select count(*) reads, count(distinct seq) unique_sequences from ({V.READS_SQL}) r""",
)
def fastq_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The bounded window sample, with a target above the size of each file and files that the windows cover."""
    rows = V.reads(spark, folder).withColumn("plus", F.lit("+"))
    size = F.octet_length("header") + F.octet_length("seq") + F.octet_length("qual") + len("\n\n+\n\n")
    number, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    covered = fastq.MAX_WINDOWS * fastq.WINDOW_BYTES
    if total > covered // 2:
        rows = rows.repartition(-(-total // (covered // 2)))  # files of half of what the windows cover, about
    sample = fastq.decoded(fastq.sample_records(fastq.detect_gzip(D.write_fastq(rows)), number * fastq.MAX_WINDOWS))
    return read_ops.read_totals(read_ops.checked(sample).filter("valid")).select("reads", "unique_sequences")


@query(
    "fai_scan",
    """with a as (select n_chars len, sum(n_chars) over (order by n_chars desc, doc_id rows unbounded preceding) cum,
  row_number() over (order by n_chars desc, doc_id) rk, sum(n_chars) over () total from documents)
select count(*) contigs, cast(sum(len) as bigint) total_length, arg_min(len, rk) filter (where cum >= total/2) n50, min(rk) filter (where cum >= total/2) l50,
  max(len) longest, min(len) shortest from a""",
)
def fai_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = V.table(spark, folder, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"),
        F.col("n_chars").alias("length"),
        (F.col("doc_id") * 100000).alias("offset"),
        F.lit(60).alias("line_bases"),
        F.lit(61).alias("line_bytes"),
    )
    return contigs.fai_summary(fai.read_fai(spark, D.write_fai(docs)))


@query(
    "fai_folders",
    """with a as (select doc_id % 2 half, doc_id // 500 part, concat('doc', cast(doc_id as varchar)) as name, n_chars len, row_number() over (partition by doc_id % 2, doc_id // 500 order by doc_id) line_no from documents),
c as (select *, sum(len) over (partition by half, part order by len desc, line_no rows unbounded preceding) cum, sum(len) over (partition by half, part) total, row_number() over (partition by half, part order by len desc, line_no) rk from a)
select cast(half as int) half, cast(part as int) part, count(*) contigs, cast(sum(len) as bigint) total_length, arg_min(len, rk) filter (where cum >= total / 2) n50, min(rk) filter (where cum >= total / 2) l50,
 cast(max(line_no) as bigint) lines, string_agg(name, ',' order by line_no) filter (where line_no <= 5) first_names from c group by half, part""",
)
def fai_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Indexes of the same names in two folders: they stay apart, and their first rows come in file order."""
    docs = V.table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.col("n_chars").alias("length"),
        (F.col("doc_id") % 7 * 100000).alias("offset"), F.lit(60).alias("line_bases"), F.lit(61).alias("line_bytes"),
        (F.col("doc_id") % 2).alias("half"), F.floor(F.col("doc_id") / 500).alias("part"),
    )
    rows = fai.read_fai(spark, D.write_fai(docs.repartition("part").sortWithinPartitions("half", "part", "doc_id"), ["half", "part"]))
    rows = materialize(rows, "contigs")
    first = fai.first_rows(rows, 5).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("rank", "name"))).alias("names"))
    lines = rows.groupBy("file").agg(F.max("line_no").alias("lines"))
    place = lambda key: F.regexp_extract("file", f"/{key}=(\\d+)/", 1).cast("int").alias(key)
    return contigs.fai_summary(rows, ["file"]).join(first, "file").join(lines, "file").select(
        place("half"), place("part"), "contigs", "total_length", "n50", "l50", "lines", F.array_join(F.transform("names", lambda n: n["name"]), ",").alias("first_names")
    )


@query(
    "barcodes_from_bam",
    f"""select cb, reads, umis, genes, mito_fraction from (select cb, count(*) reads, count(distinct ub) umis, count(distinct split_part(coalesce(gx, gn), ';', 1)) genes, round(sum(case when ref_name = 'chrM' then 1 else 0 end) / count(*), 8) mito_fraction from {_BAM_SQL} a where cb is not null group by cb) t""",
)
def barcodes_from_bam(spark: SparkSession, folder: str) -> DataFrame:
    """Per-barcode metrics from decoded records, named by the BAM header."""
    files = bam_files(spark, folder)
    headers = materialize(bam.read_headers(files), "headers")
    refs = bam.references(headers).select("file", "ref_id", F.col("name").alias("ref_name"))
    found = bam.decoded(scanned_records(files, headers, ("CB", "UB", "GX", "GN")))
    records = found.join(refs, ["file", "ref_id"], "left")
    found = barcodes.barcode_metrics(barcodes.molecules(records))
    return _round(materialize(found, "barcodes", V.table(spark, folder, "lineitem").count()), "mito_fraction")




@query(
    "analyze_files",
    f"""select 'BAM' kind, 'pass' status, cast(2 as bigint) files, count(*) filter (where (flag & 4) = 0) amount from {_BAM_SQL} a
union all select 'BAI', 'used', 2, null union all select 'FASTQ', 'pass', 2, count(*) filter (where ok) from {_FASTQ_RAW} r
union all select 'FAI', 'pass', count(distinct doc_id % 2), count(*) from documents""",
)
def analyze_files(spark: SparkSession, folder: str) -> DataFrame:
    """One analysis of a mixed selection: two BAMs with indexes, two FASTQ files, which are read whole, and two FASTA indexes."""
    bams = bam_files(spark, folder, parts=2)
    docs = V.table(spark, folder, "documents")
    pieces = 2 * max(1, -(-docs.count() // (2 * D.PIECE_READS)))
    reads = D.write_bgzip(V.raw_reads(spark, folder).repartition(pieces, "read_id"), files=2)
    lines = docs.select(
        F.col("doc_id").cast("string").alias("name"), F.col("n_chars").alias("length"), F.lit(0).alias("offset"), F.lit(60).alias("line_bases"), F.lit(61).alias("line_bytes"), (F.col("doc_id") % 2).alias("half")
    )
    written = list_files(spark, D.write_fai(lines.repartition("half"), ["half"])).filter(F.col("name").endswith(".txt"))
    indexes = written.withColumn("name", F.concat("name", F.lit(".fai")))
    columns = ["path", "name", "size", "position"]
    selection = bams.select(columns).unionByName(reads.select(columns)).unionByName(indexes.select(columns))
    result = preflight.analyze_files(selection, fastq_mode="whole")
    amounts = (
        result.bams.totals.select("file", F.col("mapped").alias("amount"))
        .unionByName(result.fastqs.summary.select("file", F.col("reads").alias("amount")))
        .unionByName(result.contig_summary.select("file", F.col("contigs").alias("amount")))
    )
    rows = result.status.join(amounts, "file", "left")
    return rows.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("files"), F.sum("amount").cast("bigint").alias("amount"))


@query("bam_preflight")
def bam_preflight(spark: SparkSession, folder: str) -> DataFrame:
    """Every metric of the complete BAM analysis, summed over its files."""
    result = preflight.analyze_bams(bam_files(spark, folder))
    metrics = preflight.bam_metrics(result)
    return metrics.groupBy("section", "metric", "provenance").agg(
        F.count_distinct("file").alias("files"),
        F.round(F.sum("value"), 6).alias("value"),
        F.min("text").alias("text"),
    )


@query("fastq_preflight")
def fastq_preflight(spark: SparkSession, folder: str) -> DataFrame:
    """Every metric of the complete FASTQ analysis, summed over its files."""
    files = D.write_fastq(V.raw_reads(spark, folder))
    metrics = preflight.fastq_metrics(preflight.analyze_fastqs(files))
    return metrics.groupBy("section", "metric", "provenance").agg(
        F.count_distinct("file").alias("files"), F.round(F.sum("value"), 6).alias("value")
    )


@query("receipt_lines")
def receipt_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The receipt of a run over BAM and FASTQ files, lines per part."""
    files = bam_files(spark, folder)
    reads = D.write_fastq(V.reads(spark, folder).withColumn("plus", F.lit("+")))
    rows = report.receipt(
        files.unionByName(reads.select(*files.columns)),
        "quick",
        preflight.analyze_bams(files),
        preflight.analyze_fastqs(reads),
    )
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("file").alias("files"))


_WAVES_SQL = convergence_sql(f"(select file, ref_id point_no, mapq, l_seq, re, cb from ({V.ALIGNMENTS_SQL}) a)", 500, "file")


@query(
    "progressive_sample",
    f"""with v as ({_WAVES_SQL}), e as (select file, min(point_no) filter (where stable) // 2 last_wave from v group by file)
select v.* from v join e on e.file = v.file where last_wave is null or point_no // 2 <= last_wave""",
)
def progressive_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Thirteen waves of two references each as a stream, stopped per sample once stable."""
    records = V.alignments(spark, folder).select("file", F.col("ref_id").alias("point_no"), "mapq", "l_seq", "re", "cb")
    running, out = progressive.start(records, wave_size=2, batch=500, target=1 << 62, files_per_trigger=8)
    running.awaitTermination()
    return _round(progressive.result(spark, out), "exonic_fraction", "barcode_rate")
