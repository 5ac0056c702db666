"""The whole analysis of a set of files, as tables.

Every step takes and gives DataFrames keyed by file or dataset, so one run
covers any number of files. Decoded bytes are written once to the shared
folder and reused by all metrics.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import alignments as aln
from ..operators import barcodes, contigs, convergence, datasets, headers, inference, knee
from ..operators import index as index_ops
from ..operators import reads as read_ops
from ..session import materialize
from ..sources import bai, bam, fai, fastq

NO_INDEX = "No index goes with this BAM, so it was neither counted exactly nor sampled across its references."
NO_COUNTS = "The index has no count bins; mapped and unmapped records per reference are unknown."
NO_READS = "Not one of the records looked at is a valid FASTQ record"
FILE = ["file"]


@dataclass
class BamResult:
    """Tables of all BAM files, each with a ``file`` column: the path."""

    headers: DataFrame
    header_facts: DataFrame
    fingerprint: DataFrame
    index_status: DataFrame
    totals: DataFrame
    per_reference: DataFrame
    records: DataFrame
    record_totals: DataFrame
    barcode_metrics: DataFrame
    knees: DataFrame
    shape: DataFrame
    assay: DataFrame
    qc: DataFrame
    convergence: DataFrame
    status: DataFrame


@dataclass
class FastqResult:
    """Tables of all FASTQ files, each with a ``file`` column: the path."""

    files: DataFrame
    records: DataFrame
    summary: DataFrame
    per_cycle: DataFrame
    lengths: DataFrame
    gc: DataFrame
    top_sequences: DataFrame
    pairs: DataFrame
    #: All records were read, not a sample of them.
    whole: bool = False


def index_tables(files: DataFrame, bam_headers: DataFrame) -> tuple[DataFrame, ...]:
    """Index rows under the path of the BAM they belong to, and load errors."""
    pairs = materialize(datasets.matched_bai(files).select("bam", "bai"), "pairs")
    used = files.join(pairs.select(F.col("bai").alias("path")), "path", "left_semi")
    rows = materialize(bai.read_indexes(used), "index")
    named = lambda df: (
        df.withColumnRenamed("file", "bai").join(pairs, "bai").withColumnRenamed("bam", "file").drop("bai")
    )
    good = materialize(named(bai.usable(rows)), "index-of-bam")
    sizes = bam_headers.filter(F.col("error").isNull()).select(
        "file", F.col("size").alias("bam_size"), F.size("refs").alias("bam_n_ref")
    )
    index_files = materialize(bai.index_files(good).join(sizes, "file"), "index-files")
    return (
        bai.chunks(good),
        bai.linear(good),
        bai.meta(good),
        index_files,
        named(bai.errors(rows)),
        pairs,
    )


def analyze_bams(files: DataFrame, mode: str = "quick") -> BamResult:
    """Headers, index counts, a stratified sample and all metrics on it.

    ``files`` has path, name, size and position. A file whose header cannot be
    read, or whose index breaks a rule, keeps a row in ``status`` with the
    reason; its other tables have no rows for it.
    """
    bam_headers = materialize(bam.read_headers(files), "headers")
    refs = bam.references(bam_headers)
    lines = headers.header_lines(bam_headers.filter(F.col("error").isNull()))
    header_facts = materialize(headers.header_summary(lines), "header-facts")
    fingerprint = materialize(contigs.fingerprint(refs), "fingerprint")
    chunks, linear, meta, index_files, load_errors, pairs = index_tables(files, bam_headers)

    broken = index_ops.validation_errors(chunks, linear, meta, index_files)
    ruled = materialize(index_ops.index_status(index_files, broken), "rules")
    sound = index_files.join(ruled.filter("status = 'pass'").select("file"), "file", "left_semi")
    paths = files.select(F.col("path").alias("file"), "path")
    probes = bam.probe_points(
        index_ops.global_seek_points(chunks, linear, sound, K.PROBE_POINTS)
        .join(sound.select("file", F.col("bam_n_ref").alias("n_ref")), "file")
        .join(paths, "file")
    )
    probe_errors = probes.filter(~F.col("ok")).groupBy("file").agg(F.min_by("error", "voffset").alias("error"))
    rejected = (
        load_errors.unionByName(ruled.filter("status = 'failed'").select("file", "error"))
        .unionByName(probe_errors)
    )
    index_status = materialize(
        pairs.select(F.col("bam").alias("file"), "bai").join(rejected, "file", "left").select(
            "file", "bai", F.when(F.col("error").isNull(), "pass").otherwise("failed").alias("status"), "error"
        ),
        "index-status",
    )
    passed = index_status.filter("status = 'pass'").select("file")
    usable = index_files.join(passed, "file", "left_semi")
    totals = index_ops.index_totals(meta.join(passed, "file", "left_semi"), usable)
    per_reference = contigs.reference_dictionary(refs, meta.join(passed, "file", "left_semi"), FILE)

    points = materialize(
        index_ops.stratified_seek_points(chunks, linear, usable, K.SEEK_POINTS[mode]).join(paths, "file"), "points"
    )
    target = K.RECORD_TARGET[mode]
    shares = points.groupBy("file").agg(F.count(F.lit(1)).alias("points"))
    shared = points.join(shares, "file").withColumn("share", F.ceil(F.lit(target) / F.col("points")))
    raw = materialize(bam.read_points(shared, F.col("share") * 2), "sample")
    counted = bam.decoded(raw).join(shared.select("file", "point_no", "share"), ["file", "point_no"])
    kept = bam.within_budget(counted, target, F.col("share")).drop("share")
    once = aln.dedup_records(kept, ["point_no", "seq_in_point"], by=FILE)
    named = once.join(refs.select("file", "ref_id", F.col("name").alias("ref_name")), ["file", "ref_id"], "left")
    order = (F.col("point_no").cast("bigint") * (1 << 32) + F.col("seq_in_point")).alias("record_no")
    records = materialize(named.select("*", order), "records")
    snapshots = materialize(convergence.convergence(convergence.snapshots(records, FILE), by=FILE), "snapshots")
    if mode == "deep":
        # All points are read at once; what lies after the stop is left out again.
        within = snapshots.filter(~F.col("past_stop")).select("file", "point_no")
        records = records.join(within, ["file", "point_no"], "left_semi")

    record_totals = materialize(aln.record_totals(records, FILE), "record-totals")
    metrics = materialize(barcodes.barcode_metrics(barcodes.molecules(records, by=FILE), FILE), "barcodes")
    knees = materialize(knee.barcode_knee(knee.count_of_counts(metrics, by=FILE), FILE), "knees")
    shape = materialize(barcodes.barcode_shape(metrics, FILE), "shape")
    profile = inference.tag_profile(records, FILE).join(header_facts.select("file", "program_text"), "file", "left")
    assay = inference.assay(profile, F.col("program_text"))
    special = fingerprint.select("file", (F.col("small_count") + F.col("alt_decoy_count")).alias("special_contigs"))
    qc_row = (
        record_totals.join(profile.select("file", "gx_share", "gn_share"), "file")
        .join(knees.select("file", "estimated_cells", F.col("confidence").alias("knee_confidence")), "file", "left")
        .join(shape.select("file", "mito_median"), "file", "left")
        .join(special, "file", "left")
    )
    qc = inference.qc_flags(qc_row, FILE)
    status = bam_status(bam_headers, index_status, index_files, record_totals)
    return BamResult(
        bam_headers, header_facts, fingerprint, index_status, totals, per_reference, records, record_totals,
        metrics, knees, shape, assay, qc, snapshots, status,
    )


def bam_status(bam_headers: DataFrame, index: DataFrame, index_files: DataFrame, sampled: DataFrame) -> DataFrame:
    """Structural and sampling status with warnings, one row per BAM.

    Structure passes only with a readable header, an EOF block and, where an
    index is given, a valid one.
    """
    joined = (
        bam_headers.select("file", "path", "size", "eof", F.col("error").alias("header_error"))
        .join(index.select("file", "bai", F.col("status").alias("index"), F.col("error").alias("index_error")), "file", "left")
        .join(index_files.select("file", "has_metadata"), "file", "left")
        .join(sampled.select("file", F.col("records").alias("sampled")), "file", "left")
    )
    failed = F.col("header_error").isNotNull() | (F.col("index") == "failed")
    sampling = (
        F.when(F.col("header_error").isNotNull(), "failed")
        .when(F.col("bai").isNull(), "unavailable")
        .when(F.col("index") == "failed", "failed")
        .when(F.col("sampled").isNull(), "failed")
        .otherwise("pass")
    )
    structural = F.when(F.col("eof") & ~F.coalesce(failed, F.lit(False)), "pass").otherwise("review")
    error = F.coalesce(
        "header_error",
        "index_error",
        F.when(F.col("bai").isNotNull() & F.col("sampled").isNull(), "No record could be decoded at the places the index names"),
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("bai").isNull() & F.col("header_error").isNull(), NO_INDEX),
            F.when(F.col("index_error").isNotNull(), F.concat(
                F.lit("The index was not used: "), "index_error")),
            F.when((F.col("index") == "pass") & ~F.col("has_metadata"), NO_COUNTS),
        )
    )
    return joined.select(
        "file", "size", "eof", "bai", structural.alias("structural"), sampling.alias("sampling"),
        error.alias("error"), warnings.alias("warnings"),
    )


def analyze_fastqs(files: DataFrame, mode: str = "quick") -> FastqResult:
    """A bounded sample of every FASTQ file, or with the mode ``whole`` all of its records, and all metrics on it.

    ``files`` has path, name, size and position. A file without any valid
    record keeps a row in ``summary`` with an ``error``.
    """
    marked = materialize(fastq.detect_gzip(files), "fastq-files")
    target = K.READ_TARGET[mode]
    found = fastq.read_records(fastq.splits(marked)) if target is None else fastq.sample_records(marked, target)
    sampled = materialize(found, "reads")
    raw = fastq.decoded(sampled)
    valid = read_ops.checked(raw).filter("valid")
    sums = materialize(read_ops.cycle_sums(valid.select("file", "seq", "qual"), FILE), "bases")
    cycles = read_ops.per_cycle(sums, FILE)
    order = F.col("window").cast("bigint") * (1 << 40) + F.col("rec_no")
    listed = files.select(F.col("path").alias("file"), "name", "size", "position")
    strategy = (
        F.when(F.col("gzip"), "gzip prefix stream")
        .when(F.col("size") > fastq.WINDOW_BYTES, "distributed uncompressed byte ranges")
        .otherwise("uncompressed full file")
    ) if target is not None else F.when(F.col("gzip"), "gzip full file").otherwise("uncompressed full file")
    summary = (
        listed.join(marked.select(F.col("path").alias("file"), "gzip"), "file")
        .withColumn("strategy", strategy)
        .join(read_ops.read_totals(valid, FILE), "file", "left")
        .join(read_ops.base_totals(sums, FILE), "file", "left")
        .join(read_ops.cycle_entropy(cycles, FILE), "file", "left")
        .join(read_ops.integrity(raw, FILE).drop("reads"), "file", "left")
        .join(read_ops.first_header(raw, order, FILE), "file", "left")
        .join(fastq.failures(sampled), "file", "left")
        .withColumn("error", F.coalesce("error", F.when(F.col("reads").isNull(), NO_READS)))
    )
    summary = materialize(summary, "fastq-summary")
    keyed = datasets.labelled_files(files).select(F.col("path").alias("file"), F.col("dataset_key").alias("dataset_id"))
    pairs = inference.pair_layout(
        summary.join(keyed, "file").select(
            "dataset_id", F.col("name").alias("file_name"), "position", "median_length",
            F.col("illumina.read").alias("illumina_read"), "error",
        )
    )
    return FastqResult(
        marked, raw, summary, cycles, read_ops.length_histogram(valid, FILE), read_ops.gc_histogram(valid, FILE),
        read_ops.top_sequences(valid, by=FILE), pairs, target is None,
    )


def consistency(files: DataFrame, bams: BamResult, fastqs: FastqResult) -> DataFrame:
    """FASTQ layout against the BAM of the same dataset."""
    keys = datasets.resolve_datasets(files).filter(F.col("bam").isNotNull()).select(
        "dataset_id", F.col("bam").alias("file")
    )
    medians = aln.medians(bams.records, FILE)
    bam_side = (
        bams.assay.select("file", "assay", "barcode_length", "umi_length")
        .join(medians.select("file", "read_length_median"), "file")
        .join(keys, "file")
    )
    fastq_keys = datasets.labelled_files(files).select(
        F.col("path").alias("file"), F.col("dataset_key").alias("dataset_id")
    )
    fastq_side = fastqs.summary.join(fastq_keys, "file").select(
        "dataset_id", F.col("name").alias("file_name"), "position", "median_length",
        F.col("illumina.read").alias("illumina_read"), F.col("illumina.lane").alias("lane"), "error",
    )
    return inference.consistency(bam_side, fastq_side)


@dataclass
class SelectionResult:
    """Everything about a mixed selection. ``status`` has one row per file: ``file, kind, dataset, status, error, warnings``."""

    bams: BamResult
    fastqs: FastqResult
    contigs: DataFrame
    contig_summary: DataFrame
    datasets: DataFrame
    consistency: DataFrame
    status: DataFrame


def analyze_files(files: DataFrame, mode: str = "quick", fastq_mode: str | None = None) -> SelectionResult:
    """All files of a selection (path, name, size, position), each by its kind; a file that cannot be read costs only itself.

    FASTQ files may have a mode of their own, see :func:`analyze_fastqs`. ``status`` is ``pass`` or ``failed`` for what was read, ``used`` or ``unassigned`` for an index of a BAM, and ``not analysed`` for any other file.
    """
    files = materialize(files.select("path", "name", "size", "position"), "selection")
    spark = files.sparkSession
    bams, fastqs = analyze_bams(files, mode), analyze_fastqs(files, fastq_mode or mode)
    labelled = datasets.labelled_files(files).select(F.col("path").alias("file"), F.col("type").alias("kind"), F.col("dataset_key").alias("dataset"))
    listed = [r["path"] for r in files.filter(F.col("name").rlike(r"(?i)\.fai$")).select("path").collect()]  # paths alone, as the user gave them
    rows = fai.read_fai(spark, *listed, fail_fast=False) if listed else fai.no_contigs(spark)
    rows = materialize(rows, "contigs")
    lines = rows.groupBy("file").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("line_no"))).alias("error"))
    none = F.array().cast("array<string>")
    unassigned = datasets.unassigned_bai(files).select(F.col("path").alias("file"), "reason")
    parts = (
        bams.status.select("file", "error", "warnings"),
        fastqs.summary.select("file", "error", none.alias("warnings")),
        lines.select("file", "error", none.alias("warnings")),
    )
    known = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("read", F.lit(True))
    status = (
        F.when((F.col("kind") == "BAI") & F.col("reason").isNotNull(), "unassigned")
        .when(F.col("kind") == "BAI", "used")
        .when(F.col("error").isNotNull(), "failed")
        .when(F.coalesce("read", F.lit(False)) | (F.col("kind") == "FAI"), "pass")
        .otherwise("not analysed")
    )
    joined = labelled.join(known, "file", "left").join(unassigned, "file", "left")
    table = joined.select("file", "kind", "dataset", status.alias("status"), F.coalesce("error", "reason").alias("error"), F.coalesce("warnings", none).alias("warnings"))
    good = rows.filter(F.col("error").isNull())
    return SelectionResult(
        bams, fastqs, rows, materialize(contigs.fai_summary(good, FILE), "contig-summary"), datasets.resolve_datasets(files),
        consistency(files, bams, fastqs), materialize(table, "status"),
    )


# The long table of metrics

EXACT, SAMPLED, INFERRED = "EXACT", "SAMPLED", "INFERRED"


def _long(
    wide: DataFrame, section: str, provenance: str, numbers: tuple[str, ...] = (), texts: tuple[str, ...] = (),
    n: Column | None = None, confidence: Column | None = None, margins: Column | None = None,
) -> DataFrame:
    null = F.lit(None)
    entries = [
        F.struct(
            F.lit(c).alias("metric"),
            (F.col(c).cast("double") if c in numbers else null.cast("double")).alias("value"),
            (F.col(c).cast("string") if c in texts else null.cast("string")).alias("text"),
        )
        for c in (*numbers, *texts)
    ]
    given = lambda c, t: (F.lit(None) if c is None else c).cast(t)
    return wide.select(
        "file",
        F.lit(section).alias("section"),
        F.array(*entries).alias("e"),
        F.lit(provenance).alias("provenance"),
        given(confidence, "string").alias("confidence"),
        given(n, "bigint").alias("n"),
        given(margins, "double").alias("margin"),
    ).select("file", "section", F.inline("e"), "provenance", "confidence", "n", "margin")


def bam_metrics(r: BamResult) -> DataFrame:
    """All scalar metrics of the BAM files as rows with their provenance."""
    mito = index_ops.mito_fraction(r.per_reference)
    counts = ("records", "mapped", "unmapped", "paired", "proper_pair", "duplicate", "secondary", "supplementary")
    margins = aln.with_margins(r.record_totals, counts[1:], FILE)
    regions = aln.region_counts(r.records, FILE)
    tags = aln.tag_presence(r.records, FILE)
    sampled = F.col("n")

    def entry(df: DataFrame, section: str, name: Column, value: str, margin: Column) -> DataFrame:
        return df.select(
            "file",
            F.lit(section).alias("section"),
            name.alias("metric"),
            F.col(value).cast("double").alias("value"),
            F.lit(None).cast("string").alias("text"),
            F.lit(SAMPLED).alias("provenance"),
            F.lit(None).cast("string").alias("confidence"),
            sampled.cast("bigint").alias("n"),
            margin.cast("double").alias("margin"),
        )

    parts = [
        _long(r.totals, "index", EXACT, ("mapped", "placed_unmapped", "unplaced_unmapped", "total_unmapped", "mapped_fraction")),
        _long(mito, "index", EXACT, ("mito_fraction",), ("mito_name",)),
        _long(
            r.fingerprint, "reference", EXACT,
            ("reference_count", "primary_count", "alt_decoy_count", "small_count"), ("naming", "mitochondrial"),
        ),
        _long(r.fingerprint, "reference", INFERRED, (), ("build",), confidence=F.col("confidence")),
        _long(r.header_facts, "header", EXACT, (), ("sort_order", "samples", "libraries", "programs")),
        _long(r.record_totals, "sample", SAMPLED, (*counts, "spliced", "multimapped"), n=F.col("records")),
        _long(aln.medians(r.records, FILE), "sample", SAMPLED, ("mapq_median", "read_length_median")),
        _long(aln.coverage(r.records, FILE), "sample", SAMPLED, ("regions", "references")),
        _long(aln.unique_genes(r.records, by=FILE), "sample", SAMPLED, ("genes",)),
        _long(
            barcodes.unique_molecules(barcodes.molecules(r.records, by=FILE), FILE), "sample", SAMPLED, ("molecules",)
        ),
        entry(margins, "flag", F.col("name"), "estimate", F.col("margin")),
        entry(regions, "region", F.col("region"), "estimate", F.col("margin")),
        entry(tags, "tag", F.col("tag"), "fraction", F.lit(None)),
        _long(
            r.shape, "barcodes", SAMPLED,
            ("barcodes", "reads_median", "umis_median", "genes_median", "cell_reads_median", "cell_umis_median",
             "cell_genes_median", "mito_p25", "mito_median", "mito_p75", "ambient_tail_fraction"),
        ),
        _long(
            r.knees, "knee", INFERRED, ("estimated_cells", "threshold_reads", "curvature"), confidence=F.col("confidence")
        ),
        _long(r.assay, "assay", INFERRED, ("barcode_length", "umi_length"), ("assay", "chemistry", "evidence"), confidence=F.col("assay_confidence")),
        r.qc.select(
            "file", F.lit("qc").alias("section"), F.col("check").alias("metric"), "value", F.col("level").alias("text"),
            F.lit(INFERRED).alias("provenance"), F.lit(None).cast("string").alias("confidence"),
            F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("double").alias("margin"),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fastq_metrics(r: FastqResult) -> DataFrame:
    numbers = (
        "reads", "median_length", "bases", "q20", "q30", "n_fraction", "duplication", "unique_sequences",
        "adapter_fraction", "poly_a_fraction", "poly_g_fraction", "mean_cycle_entropy", "malformed",
        "invalid_bases", "invalid_quality", "quality_min", "quality_max", "read_number_1", "read_number_2",
    )
    texts = ("strategy", "quality_encoding", "read_number_consistent", "incomplete_tail", "first_header", "error")
    return _long(r.summary, "fastq", EXACT if r.whole else SAMPLED, numbers, texts, n=F.col("reads")).unionByName(
        _long(
            r.summary.select(
                "file", F.col("illumina.read").alias("illumina_read"), F.col("illumina.lane").alias("illumina_lane")
            ),
            "fastq", INFERRED, ("illumina_read", "illumina_lane"),
        )
    )


def top_tables(r: BamResult) -> dict[str, DataFrame]:
    """The bounded lists of a report."""
    return {
        "top_genes": aln.top_genes(r.records, by=FILE),
        "read_groups": aln.read_groups(r.records, by=FILE),
        "top_references": index_ops.top_references(r.per_reference),
        "barcode_rank": barcodes.ranked_barcodes(r.barcode_metrics, by=FILE),
        "special_contigs": contigs.special_contigs(bam.references(r.headers)),
        "mapq_histogram": aln.mapq_histogram(r.records, FILE),
        "read_length_histogram": aln.read_length_histogram(r.records, FILE),
        "alignment_classes": aln.alignment_classes(r.records, FILE),
        "sampled_references": aln.records_per_reference(r.records, bam.references(r.headers), FILE),
    }

