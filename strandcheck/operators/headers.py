"""SAM header text as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _field_entries(fields: Column) -> Column:
    """``KEY:VALUE`` fields split at the first colon; others are left out."""
    usable = F.filter(fields, lambda f: F.instr(f, ":") > 1)
    return F.transform(
        usable,
        lambda f: F.struct(
            F.substring_index(f, ":", 1).alias("key"),
            f.substr(F.instr(f, ":") + 1, F.length(f)).alias("value"),
        ),
    )


def header_lines(headers: DataFrame, by: Sequence[str] = ("file",), text: str = "header_text") -> DataFrame:
    """One row per ``@`` line: line number, type, fields and comment text.

    A key given twice in a line keeps its last value.
    """
    lines = headers.select(*by, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    clean = F.regexp_replace("line", "\r$", "")
    split = lines.filter(F.col("line").startswith("@")).select(
        *by, "line_no", F.split(clean, "\t").alias("parts")
    )
    kind = F.substring(F.col("parts")[0], 2, 1_000_000)
    rest = F.slice("parts", 2, F.greatest(F.lit(0), F.size("parts") - 1))
    entries = split.select(*by, "line_no", kind.alias("type"), rest.alias("rest")).select(
        *by, "line_no", "type", "rest", _field_entries(F.col("rest")).alias("e")
    )
    last = F.filter(
        F.transform("e", lambda x, i: F.struct(x["key"].alias("key"), x["value"].alias("value"), i.alias("i"))),
        lambda x: ~F.exists(
            F.slice("e", x["i"] + 2, F.greatest(F.lit(0), F.size("e") - x["i"] - 1)),
            lambda y: y["key"] == x["key"],
        ),
    )
    fields = F.map_from_entries(
        F.transform(last, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    )
    return entries.select(
        *by,
        "line_no",
        "type",
        F.when(F.col("type").isin("HD", "SQ", "RG", "PG"), fields).alias("fields"),
        F.when(F.col("type") == "CO", F.array_join("rest", "\t")).alias("comment"),
    ).filter(F.col("type").isin("HD", "SQ", "RG", "PG", "CO"))


def _distinct_in_order(value: Column) -> Column:
    pairs = F.sort_array(F.collect_list(F.when(value.isNotNull() & (value != ""), F.struct(F.col("line_no"), value.alias("v")))))
    return F.array_distinct(F.transform(pairs, lambda p: p["v"]))


def header_summary(lines: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """Sort order, samples, libraries, programs and program text per file.

    Only HD, RG and PG lines are gathered: a header is limited to 64 MiB.
    """
    field = lambda t, k: F.when(F.col("type") == t, F.try_element_at(F.col("fields"), F.lit(k)))
    text = lambda k: F.coalesce(F.try_element_at(F.col("fields"), F.lit(k)), F.lit(""))
    program = F.coalesce(F.nullif(field("PG", "PN"), F.lit("")), field("PG", "ID"))
    words = F.when(F.col("type") == "PG", F.concat_ws(" ", text("ID"), text("PN"), text("CL")))
    programs = F.sort_array(
        F.collect_list(F.when(program.isNotNull() & (program != ""), F.struct("line_no", program.alias("v"))))
    )
    word_rows = F.sort_array(F.collect_list(F.when(words.isNotNull(), F.struct("line_no", words.alias("v")))))
    needed = lines.filter(F.col("type").isin("HD", "RG", "PG", "SQ"))
    return needed.groupBy(*by).agg(
        F.max_by(
            F.try_element_at(F.col("fields"), F.lit("SO")), F.when(F.col("type") == "HD", F.col("line_no"))
        ).alias("sort_order"),
        F.array_join(_distinct_in_order(field("RG", "SM")), ", ").alias("samples"),
        F.array_join(_distinct_in_order(field("RG", "LB")), ", ").alias("libraries"),
        F.array_join(F.transform(programs, lambda p: p["v"]), " → ").alias("programs"),
        F.lower(F.array_join(F.transform(word_rows, lambda p: p["v"]), " ")).alias("program_text"),
    )
