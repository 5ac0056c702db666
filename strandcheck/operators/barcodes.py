"""Cell-barcode metrics.

Records are first collapsed to molecules ``(cb, ub, gene)``. The shuffle of
that step is keyed on all three, so one barcode with a third of all reads is
spread over tasks, and later steps see one row per molecule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import constants as K
from .histograms import keyed_join, numbered, top_k, top_k_by, unit_quantiles
from .knee import barcode_knee, count_of_counts


def molecules(records: DataFrame, ref_name: str = "ref_name", by: Sequence[str] = ()) -> DataFrame:
    """Reads and mitochondrial reads per barcode, UMI and gene text."""
    return (
        records.filter(A.present(F.col("cb")))
        .select(
            *by,
            "cb",
            A.non_empty(F.col("ub")).alias("ub"),
            A.molecule_gene(F.col("gx"), F.col("gn")).alias("gene"),
            A.is_mitochondrial(F.col(ref_name)).cast("bigint").alias("mito"),
        )
        .groupBy(*by, "cb", "ub", "gene")
        .agg(F.count(F.lit(1)).alias("reads"), F.sum("mito").alias("mito"))
    )


def barcode_counts(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return (
        records.filter(A.present(F.col("cb")))
        .groupBy(*by, "cb")
        .agg(F.count(F.lit(1)).alias("reads"))
    )


def barcode_metrics(mols: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Reads, distinct UMIs, distinct genes and mitochondrial share per barcode."""
    return (
        mols.groupBy(*by, "cb")
        .agg(
            F.sum("reads").alias("reads"),
            F.count_distinct("ub").alias("umis"),
            F.count_distinct(A.first_token(F.col("gene"))).alias("genes"),
            F.sum("mito").alias("mito"),
        )
        .select(
            *by,
            "cb",
            "reads",
            "umis",
            "genes",
            (F.col("mito") / F.col("reads")).alias("mito_fraction"),
        )
    )


def ranked_barcodes(
    counts: DataFrame, k: int | None = None, by: Sequence[str] = (), count: str = "reads"
) -> DataFrame:
    """All barcodes numbered from 1 by their reads, or the ``k`` with most."""
    if k is None:
        return numbered(counts, by, [F.desc(count), F.col("cb")], "rank").withColumn("rank", F.col("rank").cast("int"))
    if by:
        return top_k_by(counts, by, count, k, "cb")
    best = top_k(counts, count, k, "cb")
    order = Window.orderBy(F.desc(count), "cb")  # at most k rows are left here
    return best.withColumn("rank", F.row_number().over(order))


def unique_molecules(mols: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Molecules with a UMI; a missing gene counts as a value of its own."""
    return (
        mols.filter(F.col("ub").isNotNull())
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("molecules"))
    )


def _cell_barcodes(metrics: DataFrame, knees: DataFrame, by: Sequence[str]) -> DataFrame:
    """Barcodes with the cell count of their group and their tie position.

    Barcodes above the threshold are cells. Of those at the threshold, cells
    are taken by UMIs, then genes, descending: equal triples are interchangeable
    for every median, so only their number per triple is needed.
    """
    triples = metrics.groupBy(*by, "reads", "umis", "genes").agg(F.count(F.lit(1)).alias("barcodes"))
    if by:
        joined = keyed_join(triples, knees.select(*by, "estimated_cells", "threshold_reads"), by, "left")
    else:
        at_knee = knees.select(F.struct("estimated_cells", "threshold_reads")).scalar()
        joined = triples.withColumn("knee", at_knee).select("*", "knee.estimated_cells", "knee.threshold_reads")
    above = joined.groupBy(*by).agg(
        F.coalesce(
            F.sum(F.when(F.col("reads") > F.col("threshold_reads"), F.col("barcodes"))),
            F.lit(0).cast("bigint"),
        ).alias("above")
    )
    with_above = keyed_join(joined, above, by) if by else joined.withColumn("above", above.scalar())
    at = F.col("reads") == F.col("threshold_reads")
    ties = Window.partitionBy(*by, "reads").orderBy(F.desc("umis"), F.desc("genes"))
    before = F.sum("barcodes").over(ties.rowsBetween(Window.unboundedPreceding, -1))
    left = F.col("estimated_cells") - F.col("above") - F.coalesce(before, F.lit(0))
    cells = (
        F.when(F.col("reads") > F.col("threshold_reads"), F.col("barcodes"))
        .when(at, F.greatest(F.lit(0), F.least(F.col("barcodes"), left)))
        .otherwise(0)
    )
    return with_above.select(
        *by, "reads", "umis", "genes", "barcodes", F.coalesce(cells, F.lit(0)).cast("bigint").alias("cells")
    )


def barcode_shape(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Medians over all barcodes and over cells, mito quartiles, ambient tail.

    Reads, UMIs and genes per barcode take at most ``sqrt(2 R)`` values, which
    bounds the state of each percentile; the mitochondrial share does not, so
    it goes through :func:`unit_quantiles`.
    """
    knees = barcode_knee(count_of_counts(metrics, "reads", by), by)
    triples = _cell_barcodes(metrics, knees, by)
    every, cells = F.col("barcodes"), F.col("cells")
    reads = F.sum(F.col("reads") * every)
    cell_reads = F.sum(F.col("reads") * cells)
    shape = triples.groupBy(*by).agg(
        F.sum("barcodes").alias("barcodes"),
        F.percentile("reads", 0.5, every).alias("reads_median"),
        F.percentile("umis", 0.5, every).alias("umis_median"),
        F.percentile("genes", 0.5, every).alias("genes_median"),
        F.percentile("reads", 0.5, cells).alias("cell_reads_median"),
        F.percentile("umis", 0.5, cells).alias("cell_umis_median"),
        F.percentile("genes", 0.5, cells).alias("cell_genes_median"),
        F.try_divide((reads - cell_reads).cast("double"), reads.cast("double")).alias("ambient_tail_fraction"),
    )
    quartiles = unit_quantiles(
        metrics, "mito_fraction", {"mito_p25": 0.25, "mito_median": 0.5, "mito_p75": 0.75}, by
    )
    if by:
        return keyed_join(shape, quartiles, by, "left")
    names = ("mito_p25", "mito_median", "mito_p75")
    mito = shape.withColumn("mito", quartiles.select(F.struct(*names)).scalar())
    return mito.select(*shape.columns, *[F.col("mito")[name].alias(name) for name in names])
