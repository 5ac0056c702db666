"""Knee of the barcode-rank curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K


def count_of_counts(barcodes: DataFrame, count: str = "reads", by: Sequence[str] = ()) -> DataFrame:
    """How many barcodes have each count: ``(by, n, barcodes)``.

    Counts that add up to ``R`` reads take at most ``sqrt(2 R)`` distinct
    values, so this table is small however many barcodes there are.
    """
    return (
        barcodes.filter(F.col(count) > 0)
        .groupBy(*by, F.col(count).alias("n"))
        .agg(F.count(F.lit(1)).alias("barcodes"))
    )


def barcode_knee(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Point of the log-log rank curve farthest from the chord of its ends.

    Barcodes with equal counts occupy a run of ranks on which the distance is
    monotonic, so its maximum over the run lies at one of the run's ends:
    evaluating both ends of each run gives the same point as walking all ranks.
    """
    group = Window.partitionBy(*by)
    down = group.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = hist.select(
        *by,
        "n",
        F.sum("barcodes").over(group).alias("total"),
        (F.sum("barcodes").over(down) - F.col("barcodes")).alias("lo"),
        (F.sum("barcodes").over(down) - 1).alias("hi"),
    ).filter(F.col("total") >= K.KNEE_MIN_BARCODES)

    start = F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(K.KNEE_START)))
    runs = runs.withColumn("s", start)
    runs = runs.withColumn(
        "e",
        F.greatest(F.col("s") + K.KNEE_MIN_SPAN, F.floor(F.col("total") * F.lit(K.KNEE_END))),
    )
    holds = lambda at: F.when(
        (F.col("lo") <= F.col(at)) & (F.col(at) <= F.col("hi")), F.col("n")
    )
    chord = runs.select(
        "*",
        F.log10(F.col("s") + 1).alias("x1"),
        F.log10(F.col("e") + 1).alias("x2"),
        F.log10(F.max(holds("s")).over(group).cast("double")).alias("y1"),
        F.log10(F.max(holds("e")).over(group).cast("double")).alias("y2"),
    )
    ends = chord.select(
        "*",
        F.explode(
            F.array_distinct(
                F.array(
                    F.greatest(F.col("lo"), F.col("s") + 1), F.least(F.col("hi"), F.col("e") - 1)
                )
            )
        ).alias("i"),
    ).filter((F.col("i") > F.col("s")) & (F.col("i") < F.col("e")) & F.col("i").between(F.col("lo"), F.col("hi")))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    span = F.sqrt(dx * dx + dy * dy)
    offset = F.abs(
        dy * F.log10(F.col("i") + 1)
        - dx * F.log10(F.col("n").cast("double"))
        + F.col("x2") * F.col("y1")
        - F.col("y2") * F.col("x1")
    )
    points = ends.select(
        *by,
        "total",
        "n",
        "i",
        (offset / F.when(span == 0, F.lit(1.0)).otherwise(span)).alias("distance"),
    )
    best = points.groupBy(*by).agg(
        F.max_by(F.struct("i", "n", "total", "distance"), F.struct("distance", -F.col("i"))).alias("k")
    )
    medium = (F.col("k.total") >= K.KNEE_MEDIUM_BARCODES) & (F.col("k.distance") > K.KNEE_MEDIUM_CURVATURE)
    return best.filter(F.col("k").isNotNull()).select(
        *by,
        (F.col("k.i") + 1).cast("bigint").alias("estimated_cells"),
        F.col("k.n").cast("bigint").alias("threshold_reads"),
        F.when(medium, "medium").otherwise("low").alias("confidence"),
        F.col("k.distance").alias("curvature"),
    )
