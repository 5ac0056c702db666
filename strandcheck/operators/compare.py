"""Comparing metric tables with expectations and samples with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outside_tolerance(
    observed: DataFrame, expected: DataFrame, key: str, absolute: float = 0.0, relative: float = 0.0
) -> DataFrame:
    """Rows of both tables with the tolerance and whether it is kept.

    The tolerance of a row is the larger of ``absolute`` and ``relative``
    times the expectation. Keys missing on one side are not compared.
    """
    both = observed.select(key, F.col("value").alias("observed")).join(
        expected.select(key, F.col("value").alias("expected")), key
    )
    tolerance = F.greatest(F.lit(float(absolute)), F.abs("expected") * relative)
    gap = F.abs(F.col("observed") - F.col("expected"))
    return both.select(
        key,
        F.col("observed").cast("double").alias("observed"),
        F.col("expected").cast("double").alias("expected"),
        tolerance.alias("tolerance"),
        F.coalesce(gap <= tolerance, F.lit(False)).alias("within"),
    )


# What a run is held against, by kind: absolute and relative tolerance, which side counts, and whether a missing value fails.
GOLDEN_RULES = (
    ("r1_length", 0.0, 0.0, "both", True),
    ("r2_length", 0.0, 0.0, "both", True),
    ("file_length", 0.0, 0.0, "both", False),
    ("mapped", 1.0, 0.01, "both", False),
    ("cells", 0.0, 0.25, "both", False),
    ("region_coverage", 0.05, 0.0, "least", False),
)
RULE_SCHEMA = "kind string, absolute double, relative double, direction string, required boolean"


def judged(observed: DataFrame, expected: DataFrame, rules: DataFrame) -> DataFrame:
    """Every expectation (``kind, key, value``) that a rule is for, with what was observed of it and a verdict.

    The tolerance is the larger of the rule's absolute one and its relative one times the expectation. ``direction`` tells whether the
    observed value may leave it on neither side (``both``), or must not fall below (``least``) or rise above it (``most``).
    ``verdict`` is ``within`` or ``outside``; where nothing was observed ``missing``, or ``skipped`` unless the rule requires it. Values without
    expectation are not looked at; expectations of an unknown kind are ``no rule``.
    """
    found = observed.select("kind", "key", F.col("value").cast("double").alias("observed"))
    asked = expected.select("kind", "key", F.col("value").cast("double").alias("expected"))
    rows = asked.join(found, ["kind", "key"], "left").join(rules, "kind", "left")
    tolerance = F.greatest(F.col("absolute"), F.abs("expected") * F.col("relative"))
    below = (F.col("direction") != "most") & (F.col("observed") < F.col("expected") - tolerance)
    above = (F.col("direction") != "least") & (F.col("observed") > F.col("expected") + tolerance)
    verdict = (
        F.when(F.col("direction").isNull(), "no rule")
        .when(F.col("observed").isNull(), F.when(F.col("required"), "missing").otherwise("skipped"))
        .when(below | above, "outside")
        .otherwise("within")
    )
    return rows.select("kind", "key", "observed", "expected", tolerance.alias("tolerance"), verdict.alias("verdict"))


def represented_share(records: DataFrame, strata: DataFrame, by: str = "file", stratum: str = "region") -> DataFrame:
    """Share of the chosen ``strata`` (``by``, ``stratum``) that have given records, as ``key`` and ``value`` of kind ``region_coverage``."""
    seen = records.select(by, stratum).distinct().withColumn("__seen", F.lit(1))
    shares = strata.select(by, stratum).distinct().join(seen, [by, stratum], "left").groupBy(by)
    return shares.agg((F.count("__seen") / F.count(F.lit(1))).alias("value")).select(F.lit("region_coverage").alias("kind"), F.col(by).alias("key"), "value")


def region_coverage(represented: Column, strata: Column, missing: float = 0.05) -> Column:
    """Whether enough of the chosen seek points produced records."""
    return F.try_divide(represented.cast("double"), strata.cast("double")) >= 1 - missing


def sample_comparison(totals: DataFrame, sampled: DataFrame, knees: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row per file: mapped share, sampled records, knee and warnings.

    All inputs have one row per ``file``; datasets of a single file have no
    comparison, so there are no rows unless two or more files are given.
    """
    several = totals.agg(F.count(F.lit(1)).alias("c")).scalar()
    return (
        totals.filter(several > 1)
        .join(sampled, "file", "left")
        .join(knees, "file", "left")
        .join(warnings, "file", "left")
        .select(
            "file",
            "mapped_fraction",
            "records",
            "estimated_cells",
            F.coalesce("warnings", F.lit(0)).cast("bigint").alias("warnings"),
        )
    )
