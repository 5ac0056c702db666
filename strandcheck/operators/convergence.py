"""Progress snapshots over seek points and the early-stop rule.

Records are reduced to counts per seek point first. A sample has a few dozen
points per file, so every window here runs over a few dozen rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import constants as K
from ..session import materialize
from .histograms import keyed_join

FIELDS = ("exonic_fraction", "barcode_rate", "mapq_median", "read_length_median")
TOLERANCES = (K.STABLE_FRACTION, K.STABLE_FRACTION, K.STABLE_MEDIAN, K.STABLE_MEDIAN)


def _cumulative_median(cells: DataFrame, value: str, alias: str, by: Sequence[str]) -> DataFrame:
    """Lower median of all records up to each point, from cells of ``n`` equal records.

    Works on counts per (point, value): the values are MAPQ (256 of them) or
    read lengths, so nothing after the first step grows with the records.
    """
    counts = cells.groupBy(*by, "point_no", value).agg(F.sum("n").alias("n"))
    points = counts.groupBy(*by).agg(F.collect_set("point_no").alias("points"))
    started = counts.withColumnRenamed("point_no", "from_point")
    listed = keyed_join(started, points, by) if by else started.withColumn("points", points.scalar())
    from_point = F.col("from_point")
    merged = (
        listed.select(*by, F.explode(F.filter("points", lambda p: p >= from_point)).alias("point_no"), value, "n")
        .groupBy(*by, "point_no", value)
        .agg(F.sum("n").alias("n"))
    )
    group = Window.partitionBy(*by, "point_no")
    running = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = merged.select(
        *by, "point_no", value, F.sum("n").over(running).alias("cum"), F.sum("n").over(group).alias("all")
    )
    return (
        ranked.filter(F.col("cum") > (F.col("all") - 1) / 2)
        .groupBy(*by, "point_no")
        .agg(F.min(value).cast("bigint").alias(alias))
    )


def snapshots(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Running totals after each seek point.

    ``records`` has ``point_no mapq l_seq re cb``. A barcode counts from the
    first point it is seen at. All else comes from counts of equal records,
    written once: at most points x 256 MAPQ x read lengths x 2 rows.
    """
    keys = [*by, "point_no"]
    exonic = F.coalesce(F.col("re") == "E", F.lit(False)).alias("exonic")
    cells = materialize(
        records.groupBy(*keys, "mapq", "l_seq", exonic).agg(F.count(F.lit(1)).alias("n")), "cells"
    )
    per_point = cells.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("exonic"), F.col("n")).otherwise(0)).alias("exonic")
    )
    new_barcodes = (
        records.filter(A.present(F.col("cb")))
        .groupBy(*by, "cb")
        .agg(F.min("point_no").alias("point_no"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("new_cb"))
    )
    upto = (
        Window.partitionBy(*by).orderBy("point_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = per_point.join(new_barcodes, keys, "left").select(
        *keys,
        F.sum("n").over(upto).alias("records"),
        F.sum("exonic").over(upto).alias("exonic"),
        F.sum(F.coalesce("new_cb", F.lit(0))).over(upto).alias("barcodes"),
    )
    return (
        totals.join(_cumulative_median(cells, "mapq", "mapq_median", by), keys)
        .join(_cumulative_median(cells, "l_seq", "read_length_median", by), keys)
        .select(
            *keys,
            "records",
            "mapq_median",
            "read_length_median",
            (F.col("exonic") / F.col("records")).alias("exonic_fraction"),
            (F.col("barcodes") / F.col("records")).alias("barcode_rate"),
        )
    )


def _within(a: Column, b: Column, tolerance: float) -> Column:
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(True))


def convergence(points: DataFrame, batch: int = K.CHECKPOINT_RECORDS, by: Sequence[str] = ()) -> DataFrame:
    """Marks checkpoints and the first point at which sampling may stop.

    A point that passes several multiples of ``batch`` counts as that many
    equal checkpoints (``crossed``). Sampling may stop once four checkpoints
    exist and the last two agree within the tolerances.
    """
    order = Window.partitionBy(*by).orderBy("point_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.floor(F.col("records") / batch)
    marked = points.withColumn("checkpoints", reached).withColumn(
        "crossed", reached - F.coalesce(F.lag(reached).over(order), F.lit(0))
    )
    snapshot = F.when(F.col("crossed") > 0, F.struct(*FIELDS))
    compared = marked.withColumn("prev", F.last(snapshot, ignorenulls=True).over(before))
    near = F.lit(True)
    for name, tolerance in zip(FIELDS, TOLERANCES, strict=True):
        near = near & _within(F.col(name), F.col(f"prev.{name}"), tolerance)
    last_two = F.when(F.col("crossed") > 1, F.lit(True)).otherwise(near & F.col("prev").isNotNull())
    agree = F.when(F.col("crossed") > 0, last_two)
    held = F.last(agree, ignorenulls=True).over(upto)
    stable = (F.col("checkpoints") >= K.CHECKPOINTS_NEEDED) & F.coalesce(held, F.lit(False))
    flagged = compared.withColumn("stable", stable)
    earlier = F.coalesce(F.max(F.col("stable").cast("int")).over(before), F.lit(0))
    return flagged.select(
        *by,
        "point_no",
        "records",
        *FIELDS,
        "checkpoints",
        "crossed",
        "stable",
        (F.col("stable") & (earlier == 0)).alias("stop_here"),
        (earlier == 1).alias("past_stop"),
    )
