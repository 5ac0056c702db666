"""Rule-based interpretation of metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import names as N


def first_seen_length(order: Column, length: Column) -> Column:
    """Length of the value with the smallest ``order``, however long it is."""
    return F.min_by(length.cast("bigint"), F.when(length > 0, order))


def profile_columns(order: str = "record_no") -> list[Column]:
    """Tag shares and first-seen barcode and UMI lengths as aggregates."""
    cb, ub = F.col("cb"), F.col("ub")
    share = lambda c: F.count(c) / F.greatest(F.lit(1), F.count(F.lit(1)))
    return [
        share(cb).alias("cb_share"),
        share(ub).alias("ub_share"),
        share(F.col("gx")).alias("gx_share"),
        share(F.col("gn")).alias("gn_share"),
        share(F.col("re")).alias("re_share"),
        first_seen_length(F.col(order), F.length(F.substring_index(cb, "-", 1))).alias("barcode_length"),
        first_seen_length(
            F.col(order), F.when(F.coalesce(cb, F.lit("")) != "", F.length(ub))
        ).alias("umi_length"),
    ]


def tag_profile(records: DataFrame, by: Sequence[str] = (), order: str = "record_no") -> DataFrame:
    """Tag shares and first-seen lengths, one row per group."""
    return records.groupBy(*by).agg(*profile_columns(order))


def assay(profile: DataFrame, program_text: Column) -> DataFrame:
    """Assay label, confidence, chemistry and the evidence for them."""
    cell = F.col("cb_share") > K.TAG_PRESENT
    umi = F.col("ub_share") > K.TAG_PRESENT
    gene = (F.col("gx_share") > K.TAG_PRESENT) | (F.col("gn_share") > K.TAG_PRESENT)
    region = F.col("re_share") > K.REGION_TAG_PRESENT
    cellranger = F.coalesce(F.lower(program_text).contains("cellranger"), F.lit(False))
    single = (cell & umi & gene) | cellranger
    v3 = F.coalesce(
        (F.col("barcode_length") == K.BARCODE_V3) & (F.col("umi_length") == K.UMI_V3), F.lit(False)
    )
    evidence = F.array_compact(
        F.array(
            F.when(F.col("barcode_length").isNotNull(), F.format_string("CB %d nt", "barcode_length")),
            F.when(F.col("umi_length").isNotNull(), F.format_string("UB %d nt", "umi_length")),
            F.when(gene, "GX/GN present"),
            F.when(region, "RE present"),
            F.when(cellranger, "Cell Ranger @PG"),
        )
    )
    return profile.select(
        "*",
        F.when(single, K.SC_RNA)
        .when(cell & ~umi, "Barcoded sequencing")
        .otherwise("Generic alignment")
        .alias("assay"),
        F.when(single, F.when(cell & umi & gene & region, "high").otherwise("medium"))
        .when(cell & ~umi, "medium")
        .otherwise("low")
        .alias("assay_confidence"),
        F.when(
            single,
            F.when(v3, "Compatible with 3′ v3/v3.1").otherwise(
                "10x-like chemistry; read structure not fully resolved"
            ),
        ).alias("chemistry"),
        F.when(single, F.array_join(evidence, ", ")).alias("evidence"),
    )


def qc_flags(row: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Six QC checks as rows ``(check, level, label, value, note)``.

    ``row`` has per group: records, mapped, duplicate, gx_share, gn_share,
    mito_median, knee_confidence, special_contigs, and
    ``estimated_cells`` for the note on the knee.
    """
    mapped = F.try_divide(F.col("mapped").cast("double"), F.col("records").cast("double"))
    duplicate = F.try_divide(F.col("duplicate").cast("double"), F.col("records").cast("double"))
    gene = F.greatest("gx_share", "gn_share")
    mito = F.col("mito_median")
    special = F.coalesce(F.col("special_contigs"), F.lit(0))
    cells = F.col("estimated_cells") if "estimated_cells" in row.columns else F.lit(None).cast("bigint")
    level = lambda good: F.when(F.coalesce(good, F.lit(False)), "good").otherwise("warn")
    percent = lambda value, text, missing: F.when(value.isNull(), missing).otherwise(
        F.concat(N.format_percent(value), F.lit(text))
    )
    checks = (
        (
            "alignment", level(mapped >= K.MAPPED_GOOD), "Alignment fraction", mapped,
            percent(mapped, " of the records read have a place on the reference.", "No record was read."),
        ),
        (
            "duplication", level(duplicate <= K.DUPLICATE_GOOD), "Duplicate reads", duplicate,
            percent(duplicate, " of the records read are flagged as duplicates.", "No record was read."),
        ),
        (
            "gene-assignment", level(gene >= K.GENE_GOOD), "Gene assignment tags", gene,
            F.when(gene >= K.GENE_GOOD, "At least half of the records read name a gene.").otherwise(
                "Fewer than half of the records read name a gene; treat gene counts with care."
            ),
        ),
        (
            "mitochondrial", level(mito.isNull() | (mito <= K.MITO_GOOD)), "Mitochondrial signal", mito,
            percent(
                mito, " is the median mitochondrial share of a barcode.",
                "No barcode to take a mitochondrial share from.",
            ),
        ),
        (
            "barcode-knee", level(F.col("knee_confidence") == "medium"), "Barcode knee", F.lit(None),
            F.coalesce(
                F.concat(F.lit("The curve bends at about "), F.format_number(cells, 0), F.lit(" barcodes.")),
                F.lit("The curve of barcodes has no clear bend."),
            ),
        ),
        (
            "reference-contigs", level(special == 0), "Reference contigs", special,
            F.when(special == 0, "All contigs are primary ones of usual size.").otherwise(
                F.concat(special.cast("string"), F.lit(" contigs are alternative, decoy or very short."))
            ),
        ),
    )
    flags = F.array(
        *[
            F.struct(
                F.lit(i).alias("check_no"),
                F.lit(name).alias("check"),
                lvl.alias("level"),
                F.lit(label).alias("label"),
                value.cast("double").alias("value"),
                note.alias("note"),
            )
            for i, (name, lvl, label, value, note) in enumerate(checks, start=1)
        ]
    )
    return row.select(*by, F.inline(flags))


def pair_layout(results: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Layout of the first R1 and R2 file of each dataset.

    ``results`` has per FASTQ file: file_name, position, median_length and
    optionally illumina_read and error. Files with an error do not take part.
    Without an R1 (or R2) by name, files that look like read 1 by header or
    name come first; index reads never stand in for a mate.
    """
    stem = N.fastq_stem(F.col("file_name"))
    usable = results
    if "error" in results.columns:
        usable = usable.filter(F.col("error").isNull())
    looks_first = F.when(F.col("file_name").rlike(r"(?i)[_.-]R?1(?:[_.-]|$)"), 1).otherwise(9)
    read = F.col("illumina_read") if "illumina_read" in results.columns else F.lit(None).cast("int")
    rows = usable.select(
        *by,
        F.struct("file_name", "median_length", "position").alias("f"),
        N.fastq_role(stem).alias("role"),
        F.coalesce(read.cast("int"), looks_first).alias("guess"),
    )
    order = F.struct("f.position", "f.file_name")
    pick = lambda cond: F.min_by("f", F.when(cond, order))
    named = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"),
        pick(F.col("role") == "r1").alias("named1"),
        pick(F.col("role") == "r2").alias("named2"),
    )
    # Two fallback files are enough: the second serves when the first is R1.
    # The rank filter keeps two rows per group and task before the shuffle.
    likely = Window.partitionBy(*by).orderBy("guess", "f.position", "f.file_name")
    guesses = (
        rows.filter(~F.col("role").isin("i1", "i2"))
        .withColumn("nth", F.row_number().over(likely))
        .filter(F.col("nth") <= 2)
        .groupBy(*by)
        .agg(
            F.max(F.when(F.col("nth") == 1, F.col("f"))).alias("guess1"),
            F.max(F.when(F.col("nth") == 2, F.col("f"))).alias("guess2"),
        )
    )
    chosen = named.join(guesses, list(by), "left")
    first = F.coalesce("named1", "guess1")
    second = F.coalesce(
        F.col("named2"),
        F.when(~F.col("guess1").eqNullSafe(first), F.col("guess1")),
        F.col("guess2"),
    )
    pairs = (
        chosen.filter(F.col("files") >= 2)
        .select(*by, first.alias("a"), second.alias("b"))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    )
    compact = F.col("a.median_length").between(*K.R1_RANGE) & (F.col("b.median_length") >= K.R2_MIN)
    return pairs.select(
        *by,
        F.col("a.file_name").alias("r1"),
        F.col("b.file_name").alias("r2"),
        F.when(compact, "10x-like barcode/UMI + cDNA layout")
        .otherwise("Paired sequencing reads")
        .alias("layout"),
        F.when(compact & (F.col("a.median_length") == K.R1_EXACT), "medium").otherwise("low").alias("confidence"),
    )


def consistency(bam: DataFrame, fastq: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Compares the FASTQ layout of a dataset with what its BAM implies.

    ``bam``: key, assay, barcode_length, umi_length, read_length_median.
    ``fastq``: key, file_name, position, median_length, illumina_read, lane.
    Only single-cell RNA datasets with an R1 or R2 file have a row.
    """
    by_name = N.fastq_role(N.fastq_stem(F.col("file_name")))
    usable = fastq.filter(F.col("error").isNull()) if "error" in fastq.columns else fastq
    role = (
        F.when((F.col("illumina_read") == 1) | (by_name == "r1"), "r1")
        .when((F.col("illumina_read") == 2) | (by_name == "r2"), "r2")
    )
    rows = usable.withColumn("side", role)
    order = F.struct("position", "file_name")
    pick = lambda side: F.min_by(
        F.struct("median_length", "lane"), F.when(F.col("side") == side, order)
    )
    sides = (
        rows.filter(F.col("side").isNotNull())
        .groupBy(key)
        .agg(pick("r1").alias("r1"), pick("r2").alias("r2"))
    )
    joined = bam.filter(F.col("assay") == K.SC_RNA).join(sides, key)
    implied = F.nullif(F.col("barcode_length"), F.lit(0)) + F.nullif(F.col("umi_length"), F.lit(0))
    gap = F.abs(F.col("r2.median_length") - F.nullif(F.col("read_length_median"), F.lit(0)))
    lanes_differ = F.coalesce(
        F.nullif(F.col("r1.lane"), F.lit(0)) != F.nullif(F.col("r2.lane"), F.lit(0)), F.lit(False)
    )
    checked = joined.select(
        key,
        (F.col("r1.median_length") == implied).alias("r1_layout"),
        (gap <= K.R2_TOLERANCE).alias("r2_length"),
        (~lanes_differ).alias("lane_agreement"),
    )
    checks = [F.col(c) for c in ("r1_layout", "r2_length", "lane_agreement")]
    any_false, any_true = F.lit(False), F.lit(False)
    for c in checks:
        any_false = any_false | F.coalesce(~c, F.lit(False))
        any_true = any_true | F.coalesce(c, F.lit(False))
    return checked.select(
        "*", F.when(any_false, "warn").when(any_true, "pass").otherwise("limited").alias("status")
    )
