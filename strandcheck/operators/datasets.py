"""Grouping a table of files into datasets.

``files`` has ``name``, ``size`` and ``modified``; ``position`` gives the order
of selection. With a ``path`` a file is known by it, since pipelines give the
files of every run the same names; without one, by its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from .histograms import numbered

ROLES = ("r1", "r2", "i1", "i2")
UNMATCHED_REASON = "No uniquely matching BAM"
MULTIPLE_INDEXES = "Multiple BAI candidates matched; using "
UNKNOWN_ROLES = "Some FASTQ files have no recognizable R1/R2/I1/I2 suffix."


def file_id(files: DataFrame) -> Column:
    """What tells files apart: the path where there is one, else the name."""
    return F.col("path") if "path" in files.columns else F.col("name")


def folder_of(files: DataFrame) -> Column:
    """The folder a file lies in; empty for files without a path."""
    return F.regexp_replace("path", "[^/]*$", "") if "path" in files.columns else F.lit("")


def selected_files(files: DataFrame) -> DataFrame:
    """Supported files, each identity (path, if any, name, size, modified) once."""
    kept = files.filter(N.is_supported(F.col("name")))
    identity = ["name", "size", "modified", *(["path"] if "path" in files.columns else [])]
    if "position" not in files.columns:
        return kept.dropDuplicates(identity)
    others = [c for c in files.columns if c not in (*identity, "position")]
    return kept.groupBy(*identity).agg(F.min("position").alias("position"), *[F.min(c).alias(c) for c in others])


def labelled_files(files: DataFrame) -> DataFrame:
    """File type, and for FASTQ names role, lane, stem and sample key.

    Where a name comes up in several folders, its sample key is that of a run:
    the key then starts with the folder, for all files of the sample.
    """
    kind, stem, role = F.col("type"), F.col("stem"), F.col("role")
    typed = files.withColumn("type", N.file_type(F.col("name")))
    stemmed = typed.withColumn("stem", F.when(kind == "FASTQ", N.fastq_stem(F.col("name"))))
    labelled = stemmed.withColumn("role", F.when(kind == "FASTQ", N.fastq_role(stem))).select(
        *files.columns,
        "type",
        "role",
        F.when(kind == "FASTQ", N.fastq_lane(stem, role)).alias("lane"),
        F.when(kind == "FASTQ", N.fastq_key(stem, role))
        .when(kind == "BAM", N.bam_key(F.col("name")))
        .alias("dataset_key"),
        "stem",
    )
    if "path" not in files.columns:
        return labelled
    seen = labelled.filter(F.col("dataset_key").isNotNull()).groupBy("dataset_key", "name").agg(
        F.min(folder_of(files)).alias("low"), F.max(folder_of(files)).alias("high")
    )
    repeated = seen.groupBy("dataset_key").agg(F.bool_or(F.col("low") != F.col("high")).alias("repeated"))
    key = F.when(F.col("repeated"), F.concat(folder_of(files), "dataset_key")).otherwise(F.col("dataset_key"))
    return labelled.join(repeated, "dataset_key", "left").withColumn("dataset_key", key).select(*labelled.columns)


def bai_candidates(files: DataFrame) -> DataFrame:
    """BAM and BAI pairs by name: ``x.bam`` with ``x.bam.bai`` or ``x.bai``.

    Each BAM is written under both names it may be indexed by, so the match is
    one equi-join instead of a disjunction. Both lie in one folder; a BAM
    without an index there takes one from elsewhere only if no other BAM of
    the selection has its name.
    """
    lower = F.lower("name")
    where, known = folder_of(files).alias("folder"), file_id(files)
    keyed = files.filter(N.file_type(F.col("name")) == "BAM").select(
        where,
        lower.alias("bam_name"),
        known.alias("bam"),
        F.col("position").alias("bam_position"),
        F.explode(
            F.array(F.concat(lower, F.lit(".bai")), F.concat(N.bam_stem(lower), F.lit(".bai")))
        ).alias("wanted"),
    )
    found = files.filter(N.file_type(F.col("name")) == "BAI").select(
        where,
        F.lower("name").alias("wanted"),
        known.alias("bai"),
        F.col("name").alias("bai_name"),
        F.col("position").alias("bai_position"),
    )
    columns = ["bam", "bam_position", "bai", "bai_name", "bai_position"]
    near = keyed.join(found, ["folder", "wanted"]).select(*columns)
    if "path" not in files.columns:
        return near
    single = keyed.groupBy("bam_name").agg(F.count_distinct("bam").alias("n")).filter("n = 1").select("bam_name")
    alone = keyed.join(near.select("bam"), "bam", "left_anti").join(single, "bam_name", "left_semi").drop("folder")
    unused = found.join(near.select("bai"), "bai", "left_anti")
    return near.unionByName(alone.join(unused, "wanted").select(*columns))


def matched_bai(files: DataFrame) -> DataFrame:
    """For each BAM the first matching index, and how many there are."""
    chosen = F.min_by(F.struct("bai", "bai_name"), F.struct("bai_position", "bai")).alias("chosen")
    return (
        bai_candidates(files)
        .groupBy("bam", "bam_position")
        .agg(chosen, F.count(F.lit(1)).alias("candidates"))
        .select(
            "bam",
            "bam_position",
            F.col("chosen.bai").alias("bai"),
            "candidates",
            F.when(
                F.col("candidates") > 1, F.concat(F.lit(MULTIPLE_INDEXES), F.col("chosen.bai_name"), F.lit("."))
            ).alias("warning"),
        )
    )


def unassigned_bai(files: DataFrame) -> DataFrame:
    """Indexes no BAM uses."""
    bais = files.filter(N.file_type(F.col("name")) == "BAI")
    named = ["name", *(["path"] if "path" in files.columns else [])]
    used = matched_bai(files).select(F.col("bai").alias(named[-1]))
    return bais.join(used, named[-1], "left_anti").select(*named, "size", F.lit(UNMATCHED_REASON).alias("reason"))


def resolve_datasets(files: DataFrame) -> DataFrame:
    """One row per dataset: its BAM, index, FASTQ counts per role and summary.

    BAM and FASTQ rows meet in one aggregation on the sample key. BAMs that
    normalise to the same key stay apart: every BAM after the first forms its
    own dataset, named by its file, with a warning. ``bam`` and ``bai`` are
    paths if the files have them, else names.
    """
    marked = labelled_files(files)
    bams = marked.filter(F.col("type") == "BAM").select(
        "dataset_key", "name", file_id(files).alias("bam"), "position"
    )
    firsts = bams.groupBy("dataset_key").agg(F.min(F.struct("position", "bam")).alias("first"))
    shared = F.col("first") != F.struct("position", "bam")
    pairs = matched_bai(files).select("bam", F.col("bam_position").alias("position"), "bai", "candidates", "warning")
    bam_rows = bams.join(firsts, "dataset_key").join(pairs, ["bam", "position"], "left").select(
        F.when(shared, F.concat("dataset_key", F.lit("#"), "name")).otherwise(F.col("dataset_key")).alias("dataset_id"),
        N.bam_stem(F.col("name")).alias("label"),
        "bam",
        "bai",
        F.col("warning").alias("many_bai"),
        shared.alias("shared_key"),
    )
    fastq = marked.filter(F.col("type") == "FASTQ")
    known = F.col("role").isin(*ROLES)
    fastq_rows = fastq.groupBy(F.col("dataset_key").alias("dataset_id")).agg(
        *[F.count_if(F.col("role") == r).alias(r) for r in ROLES],
        F.count_if(~known).alias("unknown"),
        F.count_distinct(F.when(known, F.col("lane"))).alias("lanes"),
    )
    joined = bam_rows.join(fastq_rows, "dataset_id", "full_outer")
    counted = joined.select(
        "dataset_id",
        F.coalesce("label", N.display_name(F.col("dataset_id"))).alias("label"),
        "bam",
        "bai",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in (*ROLES, "unknown", "lanes")],
        "many_bai",
        F.coalesce("shared_key", F.lit(False)).alias("shared_key"),
    )

    def role_text(role: str):
        count = F.col(role)
        return F.when(count > 1, F.concat(F.lit(f"{role.upper()} ×"), count.cast("string"))).when(
            count == 1, F.lit(role.upper())
        )

    reads = F.concat_ws("/", *[role_text(r) for r in ROLES])
    lanes = F.when(
        F.col("lanes") > 1, F.concat(F.lit(" across "), F.col("lanes").cast("string"), F.lit(" lanes"))
    ).otherwise("")
    parts = F.concat_ws(
        " + ",
        F.when(F.col("bam").isNotNull(), "BAM"),
        F.when(F.col("bai").isNotNull(), "BAI"),
        F.when(reads != "", F.concat(reads, lanes)),
    )
    warnings = F.array_compact(
        F.array(
            F.col("many_bai"),
            F.when(F.col("unknown") > 0, F.lit(UNKNOWN_ROLES)),
            F.when(F.col("shared_key"), F.lit("Another BAM has the same sample key; kept apart.")),
        )
    )
    return counted.select(
        "dataset_id",
        "label",
        "bam",
        "bai",
        *ROLES,
        "unknown",
        "lanes",
        F.when(parts == "", "No recognized genomic files").otherwise(parts).alias("summary"),
        F.array_join(warnings, " ").alias("warnings"),
    )


def dataset_files(files: DataFrame) -> DataFrame:
    """Long form ``(dataset_id, role, nth, name)``: BAM, BAI, then FASTQ by role.

    ``name`` is the path if the files have one.

    R1 and R2 files are numbered by name, the others by selection order.
    """
    marked = labelled_files(files)
    fastq = marked.filter(F.col("type") == "FASTQ").select(
        F.col("dataset_key").alias("dataset_id"), "role", file_id(files).alias("name"), "position"
    )
    by_name = F.when(F.col("role").isin("r1", "r2"), F.col("name"))
    reads = numbered(fastq, ["dataset_id", "role"], [by_name, "position", "name"]).drop("position")
    pairs = resolve_datasets(files).select(
        "dataset_id", F.expr("stack(2, 'bam', bam, 'bai', bai) as (role, name)")
    ).filter(F.col("name").isNotNull())
    return reads.unionByName(pairs.withColumn("nth", F.lit(1).cast("bigint")))


def selection_totals(files: DataFrame) -> DataFrame:
    """Files and bytes per type."""
    kind = N.file_type(F.col("name")).alias("type")
    return files.groupBy(kind).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").cast("bigint").alias("bytes")
    )
