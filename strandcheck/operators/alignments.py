"""Metrics over alignment records.

``records`` is one row per alignment with the columns of the decoded BAM
schema (``ref_id pos read_name mapq flag l_seq spliced cb ub gx gn re ...``).
``by`` names columns, such as ``file``, to keep apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import constants as K
from .histograms import dense_histogram, lower_median, top_k, top_k_by, value_counts

RECORD_KEY = ("ref_id", "pos", "read_name", "flag")


def dedup_records(
    records: DataFrame,
    order: Sequence[str] = (),
    by: Sequence[str] = (),
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """One row per record identity: the first in ``order``.

    Without other columns to keep this is a distinct on the key. With them the
    survivor is chosen by rank 1, which Spark already applies inside each
    partition before the shuffle, so a key with many copies does not travel.
    ``order`` must be total; by default it is all remaining columns.
    """
    key = [*by, *RECORD_KEY]
    columns = list(keep) if keep is not None else records.columns
    rest = [c for c in columns if c not in key]
    if not rest and not order:
        return records.select(*key).distinct()
    first = Window.partitionBy(*key).orderBy(*(order or rest))
    needed = list(dict.fromkeys([*key, *columns, *order]))
    ranked = records.select(*needed).withColumn("__rank", F.row_number().over(first))
    return ranked.filter(F.col("__rank") == 1).select(*columns)


def count_where(predicate: Column) -> Column:
    return F.count_if(predicate).cast("bigint")


def total_columns(columns: Sequence[str]) -> list[Column]:
    """Record, FLAG, class, splice and multi-mapping counts as aggregates."""
    flags = [count_where(p).alias(n) for n, p in A.flag_predicates(F.col("flag")).items()]
    label = A.alignment_class(F.col("flag"))
    classes = [count_where(label == c).alias(f"class_{c}") for c in A.ALIGNMENT_CLASSES]
    extra = []
    if "spliced" in columns:
        extra.append(count_where(F.col("spliced")).alias("spliced"))
    if "nh" in columns:
        tag = lambda c: F.col(c) if c in columns else F.lit(None).cast("bigint")
        many = A.is_multimapped(tag("mm_upper"), tag("mm_lower"), F.col("nh"))
        extra.append(count_where(many).alias("multimapped"))
    return [F.count(F.lit(1)).alias("records"), *flags, *classes, *extra]


def record_totals(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All counts of :func:`total_columns` in one pass."""
    return records.groupBy(*by).agg(*total_columns(records.columns))


def with_margins(totals: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Unfold count columns into ``(name, n, estimate, margin)`` rows."""
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    keep = [f"`{c}`" for c in by] + ["records"]
    long = totals.selectExpr(*keep, f"stack({len(names)}, {pairs}) as (name, n)")
    return long.select(
        *by,
        "name",
        F.col("n").cast("bigint").alias("n"),
        A.proportion(F.col("n"), F.col("records")).alias("estimate"),
        A.wilson_margin(F.col("n"), F.col("records")).alias("margin"),
    )


def flag_counts(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    names = list(A.flag_predicates(F.lit(0)))
    return with_margins(record_totals(records.select(*by, "flag"), by), names, by)


def alignment_classes(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Class counts with margins; classes without records stay, with 0."""
    names = [f"class_{c}" for c in A.ALIGNMENT_CLASSES]
    rows = with_margins(record_totals(records.select(*by, "flag"), by), names, by)
    return rows.withColumn("name", F.substring_index("name", "_", -1))


def region_counts(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per region code with margins over all records."""
    counted = records.groupBy(*by, "re").agg(F.count(F.lit(1)).alias("n"))
    everything = F.sum("n").over(Window.partitionBy(*by))
    return (
        counted.select("*", everything.alias("records"))
        .filter(F.col("re").isNotNull())
        .select(
            *by,
            F.col("re").alias("region"),
            A.region_label(F.col("re")).alias("label"),
            "n",
            A.proportion(F.col("n"), F.col("records")).alias("estimate"),
            A.wilson_margin(F.col("n"), F.col("records")).alias("margin"),
        )
    )


def mapq_histogram(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return dense_histogram(records, "mapq", 0, 255, by)


def read_length_histogram(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return value_counts(records, "l_seq", by)


def medians(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return records.groupBy(*by).agg(
        lower_median("mapq").alias("mapq_median"),
        lower_median("l_seq").alias("read_length_median"),
    )


def tag_presence(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of records carrying each tag, from ``tags_present`` arrays.

    One pass with a counter per wanted tag, so no record is unfolded. A tag
    that no record carries has no row.
    """
    counts = records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"),
        *[
            count_where(F.coalesce(F.array_contains("tags_present", t), F.lit(False))).alias(f"tag_{i}")
            for i, t in enumerate(K.WANTED_TAGS)
        ],
    )
    pairs = [F.struct(F.lit(t).alias("tag"), F.col(f"tag_{i}").alias("n")) for i, t in enumerate(K.WANTED_TAGS)]
    rows = counts.select(*by, "records", F.inline(F.array(*pairs))).filter(F.col("n") > 0)
    return rows.select(*by, "tag", "n", A.share(F.col("n"), F.col("records")).alias("fraction"))


def read_groups(records: DataFrame, k: int = K.TOP_READ_GROUPS, by: Sequence[str] = ()) -> DataFrame:
    counted = value_counts(records.filter(A.present(F.col("rg"))), "rg", by)
    return top_k_by(counted, by, "n", k, "rg").drop("rank") if by else top_k(counted, "n", k, "rg")


def records_per_reference(records: DataFrame, refs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sampled records per reference, named from the dictionary ``refs``.

    Records are counted before the join, so the join carries one row per
    reference and not one per record.
    """
    counted = value_counts(records.filter(F.col("ref_id") >= 0), "ref_id", by)
    keys = [*[c for c in by if c in refs.columns], "ref_id"]
    named = counted.join(refs.select(*keys, "name"), keys, "left")
    return named.select(
        *by, "ref_id", A.reference_label(F.col("name"), F.col("ref_id"), "").alias("name"), "n"
    )


def coverage(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct sampled regions and references."""
    return records.groupBy(*by).agg(
        F.count_distinct("region").alias("regions"),
        F.count_distinct(F.when(F.col("ref_id") >= 0, F.col("ref_id"))).alias("references"),
    )


def gene_counts(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    tokens = A.gene_tokens(F.col("gx"), F.col("gn"))
    return value_counts(records.select(*by, F.explode(tokens).alias("gene")), "gene", by)


def top_genes(records: DataFrame, k: int = K.TOP_GENES, by: Sequence[str] = ()) -> DataFrame:
    counted = gene_counts(records, by)
    return top_k_by(counted, by, "n", k, "gene").drop("rank") if by else top_k(counted, "n", k, "gene")


def unique_genes(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counted = gene_counts(records, by)
    return counted.groupBy(*by).agg(F.count(F.lit(1)).alias("genes"))


def per_reference_qc(records: DataFrame, name: str = "ref_name") -> DataFrame:
    """Deduplicated records per reference with mapping, duplicates, barcodes.

    Copies of a record count once; their MAPQ and barcode are the largest.
    """
    key = (name, "pos", "read_name", "flag")
    once = records.groupBy(*key).agg(F.max("mapq").alias("mapq"), F.max("cb").alias("cb"))
    flag = F.col("flag")
    grouped = once.groupBy(name).agg(
        F.count(F.lit(1)).alias("records"),
        count_where(A.is_mapped(flag)).alias("mapped"),
        count_where(A.has_flag(flag, K.DUPLICATE)).alias("duplicates"),
        F.count_distinct("cb").alias("barcodes"),
        lower_median("mapq").alias("mapq_median"),
    )
    return grouped.select(
        "*",
        F.round(A.proportion(F.col("mapped"), F.col("records")), 6).alias("mapped_fraction"),
        F.round(A.wilson_margin(F.col("mapped"), F.col("records")), 6).alias("mapped_margin"),
    )
