"""FAI summaries and what the reference dictionary says about the assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import constants as K
from .alignments import count_where


def fai_summary(contigs: DataFrame, by: Sequence[str] = (), length: str = "length") -> DataFrame:
    """Contig count, total, N50, L50, longest and shortest.

    Contigs are collapsed to ``(length, count)`` first; a total of ``T`` bases
    has at most ``sqrt(2 T)`` distinct lengths. Inside a run of equal lengths
    the L50 position follows by division.
    """
    hist = contigs.groupBy(*by, F.col(length).alias("len")).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by)
    before = group.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, -1)
    runs = hist.select(
        *by,
        "len",
        "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum(F.col("len") * F.col("n")).over(before), F.lit(0)).alias("len_before"),
        F.sum(F.col("len") * F.col("n")).over(group).alias("total"),
    )
    missing = F.col("total") / 2 - F.col("len_before")
    steps = F.greatest(F.lit(1), F.ceil(F.try_divide(missing, F.col("len"))))
    reached = F.col("len_before") + F.col("len") * F.col("n") >= F.col("total") / 2
    return runs.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("contigs"),
        F.coalesce(F.sum(F.col("len") * F.col("n")), F.lit(0)).cast("bigint").alias("total_length"),
        F.coalesce(F.max(F.when(reached, F.col("len"))), F.lit(0)).cast("bigint").alias("n50"),
        F.coalesce(
            F.min(F.when(reached, F.col("n_before") + F.coalesce(steps, F.lit(1)))), F.lit(0)
        ).cast("bigint").alias("l50"),
        F.coalesce(F.max("len"), F.lit(0)).cast("bigint").alias("longest"),
        F.coalesce(F.min("len"), F.lit(0)).cast("bigint").alias("shortest"),
    )


def _first_build(style: Column) -> Column:
    """Number of the first known assembly whose chromosome 1 has this name and length."""
    number = None
    for i, (_, size) in enumerate(K.BUILDS):
        hit = style & (F.col("length") == size)
        number = F.when(hit, i) if number is None else number.when(hit, i)
    return F.min(number)


def fingerprint(refs: DataFrame, by: Sequence[str] = ("file",), order: str = "ref_id") -> DataFrame:
    """Assembly, naming and completeness of each reference dictionary.

    One aggregation over the references; the lists of special contigs hold the
    first twenty in header order. ``refs`` has ``name``, ``length`` and the
    position ``order`` in the dictionary.
    """
    name, length = F.col("name"), F.col("length")
    mito = name.rlike(K.MITO_PATTERN)
    alt = name.rlike(K.ALT_DECOY_PATTERN)
    small = (length < K.SMALL_CONTIG) & ~mito & ~alt
    chr_like = name.rlike("(?i)^chr")
    marked = refs.select(
        *by, order, name, length, mito.alias("mito"), alt.alias("alt"), small.alias("small")
    )
    counts = marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("reference_count"),
        count_where(chr_like).alias("chr_names"),
        count_where(name.rlike(K.CHR_NAME_PATTERN)).alias("chr_primary_like"),
        count_where(name.rlike(K.BARE_NAME_PATTERN)).alias("bare_primary_like"),
        count_where(name.rlike(K.PRIMARY_CHR_PATTERN)).alias("primary_chr"),
        count_where(name.rlike(K.PRIMARY_BARE_PATTERN)).alias("primary_bare"),
        _first_build(name == "chr1").alias("build_chr"),
        _first_build(name == "1").alias("build_bare"),
        F.min_by("name", F.when(F.col("mito"), F.col(order))).alias("mitochondrial"),
        count_where(name.rlike(K.SEX_PATTERN)).alias("sex_chromosomes"),
        count_where(F.col("alt")).alias("alt_decoy_count"),
        count_where(F.col("small")).alias("small_count"),
    )
    build = F.least("build_chr", "build_bare")
    label = F.get(F.array(*[F.lit(b) for b, _ in K.BUILDS]), build)
    chr_naming = F.col("chr_names") >= F.col("reference_count") - F.col("chr_names")
    unknown_naming = (
        F.when(F.col("chr_primary_like") > F.col("bare_primary_like"), "chr-prefixed")
        .when(F.col("bare_primary_like") > 0, "non-prefixed")
        .otherwise("custom")
    )
    primary = F.when(chr_naming, F.col("primary_chr")).otherwise(F.col("primary_bare"))
    base = counts.select(
        *by,
        F.coalesce(label, F.lit("Unknown reference")).alias("build"),
        F.when(build.isNotNull(), "high").otherwise("low").alias("confidence"),
        F.when(F.col("build_chr") <= F.coalesce("build_bare", F.lit(99)), "chr-prefixed")
        .when(build.isNotNull(), "non-prefixed")
        .otherwise(unknown_naming)
        .alias("build_naming"),
        F.when(chr_naming, "chr-prefixed").otherwise("non-prefixed").alias("naming"),
        primary.alias("primary_count"),
        F.when(primary >= K.MIN_PRIMARY, K.FULL_PRIMARY).cast("bigint").alias("expected_primary"),
        ((primary >= K.MIN_PRIMARY) & (primary >= K.FULL_PRIMARY)).alias("primary_complete"),
        "mitochondrial",
        "sex_chromosomes",
        "alt_decoy_count",
        "small_count",
        F.least(F.lit(K.SPECIAL_CONTIGS_SHOWN).cast("bigint"), "small_count").alias("small_shown"),
        "reference_count",
    )
    return base


def special_contigs(refs: DataFrame, by: Sequence[str] = ("file",), order: str = "ref_id") -> DataFrame:
    """First twenty ALT/decoy and first twenty other small contigs per file."""
    name = F.col("name")
    mito, alt = name.rlike(K.MITO_PATTERN), name.rlike(K.ALT_DECOY_PATTERN)
    kind = F.when(alt, "alt_decoy").when((F.col("length") < K.SMALL_CONTIG) & ~mito, "small")
    marked = refs.select(*by, order, "name", kind.alias("kind")).filter(F.col("kind").isNotNull())
    position = Window.partitionBy(*by, "kind").orderBy(order)
    ranked = marked.withColumn("position", F.row_number().over(position))
    return ranked.filter(F.col("position") <= K.SPECIAL_CONTIGS_SHOWN).select(
        *by, "kind", "position", "name"
    )


def reference_dictionary(refs: DataFrame, counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Index counts with names from the dictionary, ``ref_<id>`` where unnamed."""
    keys = [*[c for c in by if c in refs.columns], "ref_id"]
    joined = counts.join(refs.select(*keys, "name", "length"), keys, "left")
    others = [c for c in counts.columns if c not in keys]
    return joined.select(
        *by,
        "ref_id",
        A.reference_label(F.col("name"), F.col("ref_id")).alias("name"),
        "length",
        *[c for c in others if c not in by],
    )
