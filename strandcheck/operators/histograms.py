"""Histograms, order statistics and running totals.

Two ideas keep these away from single-task sorts of the data:

* Positive integers are first collapsed to ``(value, count)``. If the values of
  ``n`` rows add up to ``S``, at most ``sqrt(2 S)`` of them are distinct, so the
  collapsed table stays small (1.4 million rows for a trillion reads).
* Where values are not bounded like that, rows are put into ordered buckets.
  A window runs inside each bucket and a second one over the bucket totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def keyed_join(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on ``by``."""
    names = list(by)
    renamed = right.select(
        *[F.col(c).alias(f"__{c}") if c in names else F.col(c) for c in right.columns]
    )
    condition = F.lit(True)
    for c in names:
        condition = condition & left[c].eqNullSafe(renamed[f"__{c}"])
    return left.join(renamed, condition, how).drop(*[f"__{c}" for c in names])


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), count: str = "n") -> DataFrame:
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias(count))


def dense_histogram(
    df: DataFrame, value: str, low: int, high: int, by: Sequence[str] = (), count: str = "n"
) -> DataFrame:
    """Counts for every integer of ``low..high``, zeros included.

    One aggregation pass: each group carries a map of its counts (never more
    than ``high - low + 1`` entries) that is unfolded over the full range.
    """
    counted = value_counts(df.filter(F.col(value).between(low, high)), value, by, count)
    maps = counted.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(value).cast("int"), F.col(count)))).alias("m")
    )
    wide = maps.select(
        *by, "m", F.explode(F.sequence(F.lit(low), F.lit(high))).alias(value)
    )
    found = F.try_element_at(F.col("m"), F.col(value))
    return wide.select(*by, value, F.coalesce(found, F.lit(0).cast("bigint")).alias(count))


def lower_median(value: str) -> Column:
    """Median of integers with few distinct values; the lower one for even counts."""
    return F.expr(f"percentile_disc(0.5) within group (order by {value})").cast("bigint")


def histogram_quantile(
    hist: DataFrame, value: str, count: str, p: float, by: Sequence[str] = (), alias: str = "value"
) -> DataFrame:
    """Nearest-lower quantile of ``(value, count)`` rows: index floor(p (n-1))."""
    total = Window.partitionBy(*by)
    up_to = total.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = hist.filter(F.col(count) > 0).select(
        *by,
        value,
        F.sum(count).over(up_to).alias("cum"),
        F.sum(count).over(total).alias("all"),
    )
    target = F.floor(F.lit(p) * (F.col("all") - 1))
    return running.filter(F.col("cum") > target).groupBy(*by).agg(F.min(value).alias(alias))


def top_k(df: DataFrame, count: str, k: int, *ties: str) -> DataFrame:
    """The ``k`` largest counts of the whole frame, ties by ``ties`` ascending."""
    return df.orderBy(F.desc(count), *[F.asc(t) for t in ties]).limit(k)


def top_k_by(df: DataFrame, by: Sequence[str], count: str, k: int, *ties: str) -> DataFrame:
    """The ``k`` largest counts of each group.

    The rank filter lets Spark cut each partition to ``k`` rows per group
    before the shuffle, so a hot group costs ``k`` rows per task.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(count), *[F.asc(t) for t in ties])
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bucketed_prefix(
    df: DataFrame,
    by: Sequence[str],
    bucket: Column,
    order: Sequence[Column | str],
    sums: dict[str, Column],
) -> DataFrame:
    """Running totals in a global order, without a global sort.

    ``bucket`` must not decrease along ``order``. Adds, for each name in
    ``sums``, the total of all rows up to and including the row. Only the
    bucket totals are windowed per group, all rows only inside their bucket.
    """
    rows = df.withColumn("__b", bucket)
    totals = rows.groupBy(*by, "__b").agg(*[F.sum(e).alias(f"__t_{n}") for n, e in sums.items()])
    before = (
        Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *by,
        "__b",
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums],
    )
    inside = (
        Window.partitionBy(*by, "__b")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = rows.select("*", *[F.sum(e).over(inside).alias(n) for n, e in sums.items()])
    joined = keyed_join(local, offsets, [*by, "__b"])
    return joined.select(
        *df.columns, *[(F.col(n) + F.col(f"__o_{n}")).alias(n) for n in sums]
    )


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], alias: str = "nth") -> DataFrame:
    """Position of every row in its group, from 1, in ``order``.

    Unlike a window per group this also holds when one group has most rows:
    rows are range-partitioned on group and order, so a large group spans many
    tasks. Rows are counted inside each range and shifted by the counts of
    the group's earlier ranges. The ranged rows are written once, because the
    ranges must be the same for both steps.
    """
    keys = [F.col(c) for c in by] + [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(ranged.withColumn("__id", F.monotonically_increasing_id()), "ranged")
    piece = F.shiftright("__id", 33).alias("__piece")
    pieces = placed.groupBy(*by, piece).agg(
        F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    # One row per group and range that holds some of it.
    earlier = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    shifted = pieces.select(
        *by, "__piece", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")
    )
    joined = keyed_join(placed.withColumn("__piece", piece), shifted, [*by, "__piece"])
    position = F.col("__before") + F.col("__id") - F.col("__first") + 1
    return joined.select(*df.columns, position.alias(alias))


def unit_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), buckets: int = 4096
) -> DataFrame:
    """Exact interpolated quantiles of values of any cardinality, in buckets of ``1 / buckets``.

    Equal values are collapsed first, so a value shared by most rows is one
    row; running counts then come from :func:`bucketed_prefix`.
    """
    hist = value_counts(df.filter(F.col(value).isNotNull()), value, by, "__n")
    bucket = F.floor(F.col(value) * buckets)
    running = bucketed_prefix(hist, by, bucket, [value], {"__cum": F.col("__n")})
    totals = hist.groupBy(*by).agg(F.sum("__n").alias("__all"))
    if by:
        ranked = keyed_join(running, totals, by)
    else:
        ranked = running.withColumn("__all", totals.scalar())
    first = F.col("__cum") - F.col("__n")

    def at(index: Column) -> Column:
        return F.max(F.when((first <= index) & (index < F.col("__cum")), F.col(value)))

    out = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("__all") - 1)
        low, high = at(F.floor(position)), at(F.ceil(position))
        fraction = F.max(position - F.floor(position))
        out.append((low + (high - low) * fraction).alias(name))
    return ranked.groupBy(*by).agg(*out)
