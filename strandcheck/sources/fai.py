"""FASTA indexes as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators.histograms import bucketed_prefix, top_k_by


def read_fai(spark: SparkSession, *paths: str, fail_fast: bool = True) -> DataFrame:
    """Contigs of ``.fai`` files, each known by its path, with their line from 1; blank lines count as lines but are left out.

    A line with fewer than five columns or with a column that is not a number
    raises, or has its ``error`` set when ``fail_fast`` is off. Further
    columns are ignored.
    """
    # a file that is gone since it was listed has no rows
    lines = spark.read.option("ignoreMissingFiles", "true").text(list(paths)).select(
        F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )
    lines = bucketed_prefix(lines, ["file"], F.col("block"), ["nth"], {"line_no": F.lit(1)})
    number = lambda i: F.expr(f"try_cast(trim(get(parts, {i})) as bigint)")
    rows = (
        lines.filter(F.trim("line") != "")
        .withColumn("parts", F.split("line", "\t"))
        .select(
            "file",
            "line_no",
            "line",
            F.size("parts").alias("columns"),
            F.get("parts", F.lit(0)).alias("name"),
            number(1).alias("length"),
            number(2).alias("offset"),
            number(3).alias("line_bases"),
            number(4).alias("line_bytes"),
        )
    )
    missing = F.lit(False)
    for column in ("length", "offset", "line_bases", "line_bytes"):
        missing = missing | F.col(column).isNull()
    place = F.concat(F.lit("index line "), F.col("line_no").cast("string"), F.lit(": "))
    few = F.concat(place, F.col("columns").cast("string"), F.lit(" of 5 columns are there"))
    problem = F.when(F.col("columns") < 5, few).when(missing, F.concat(place, F.lit("a column after the name is no whole number")))
    guard = lambda c, t: (
        F.when(problem.isNotNull(), F.raise_error(problem).cast(t)).otherwise(F.col(c)).alias(c)
        if fail_fast
        else F.col(c)
    )
    return rows.select(
        "file",
        "line_no",
        guard("name", "string"),
        guard("length", "bigint"),
        "offset",
        "line_bases",
        "line_bytes",
        problem.alias("error"),
    )


def no_contigs(spark: SparkSession) -> DataFrame:
    """The table of :func:`read_fai` without rows."""
    return spark.createDataFrame([], "file string, line_no bigint, name string, length bigint, offset bigint, line_bases bigint, line_bytes bigint, error string")


def first_rows(contigs: DataFrame, k: int = K.FAI_ROWS_SHOWN) -> DataFrame:
    """The first ``k`` contigs of each file in file order, with their ``rank``."""
    order = contigs.withColumn("__o", -F.col("line_no"))
    return top_k_by(order, ["file"], "__o", k, "name").drop("__o")
