"""Conversations as training examples: every assistant turn with all that precedes it, only the reply trainable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Strings that mark turns in the template.
OPEN, BODY, CLOSE = "<s>", "[INST]", "[/INST]</s>"
#: A marking string, with any number of backslashes after its first character.
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
ESCAPED = r"([<\[])\\(\\*/?(?:s>|INST\]))"

_TURNS = "array<struct<role:string,text:string>>"


def escaped(text: Column) -> Column:
    """Text without any marking string: one more backslash after the first character of each that looks like one."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def conversations_as_rows(rows: DataFrame) -> DataFrame:
    """One row per ``conv_id`` with its ``turns`` in order of turn, then role, then text; null role and text are empty.

    A null ``conv_id`` is a conversation of its own, null turns come first, repeated rows are repeated turns.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    gathered = rows.select(F.col("conv_id").cast("bigint"), F.struct(F.col("turn").cast("bigint"), role, text).alias("t")).groupBy("conv_id").agg(F.collect_list("t").alias("t"))
    return gathered.select("conv_id", F.transform(F.sort_array("t"), lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).cast(_TURNS).alias("turns"))


def formatted_examples(rows: DataFrame) -> DataFrame:
    """Examples of ``rows`` (``conv_id, turn, role, text``): ``conv_id, turn_no, formatted, loss_start, loss_end``.

    Every assistant turn gives an example with the turns up to it; ``formatted[loss_start:loss_end]`` (code points) is
    its escaped text, the only trainable part. Turns after the last assistant turn give one more example with an
    empty trainable part, so each conversation can be read back from its longest example. Each turn is written
    as ``<s>role[INST]text[/INST]</s>``; a marking string inside a role or text is escaped and can be restored exactly.
    Empty tables give no rows; other columns are ignored.
    """
    turns = conversations_as_rows(rows).select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(
            (t.role == "assistant").alias("reply"),
            F.concat(F.lit(OPEN), escaped(t.role), F.lit(BODY)).alias("head"),
            escaped(t.text).alias("body"),
        )).alias("turns"),
    )
    targets = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i).reply | (i == F.size("turns")))
    one = turns.select("conv_id", "turns", F.explode(targets).alias("turn_no"))
    target = F.element_at("turns", F.col("turn_no"))
    before = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("turn_no") - 1), lambda t: F.concat(t.head, t.body, F.lit(CLOSE))), "")
    parts = one.select("conv_id", "turn_no", F.concat(before, target.head).alias("context"), target.body.alias("body"), target.reply.alias("reply"))
    start = F.length("context").cast("bigint")
    return parts.select(
        "conv_id",
        "turn_no",
        F.concat("context", "body", F.lit(CLOSE)).alias("formatted"),
        start.alias("loss_start"),
        F.when(F.col("reply"), start + F.length("body")).otherwise(start).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example as an array of ``(role, text)``."""
    pieces = F.filter(F.split(formatted, r"\[/INST\]</s>", -1), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring(F.substring_index(p, BODY, 1), F.lit(len(OPEN) + 1), F.length(p))).alias("role"),
        unescaped(F.substring(p, F.length(F.substring_index(p, BODY, 1)) + F.lit(len(BODY) + 1), F.length(p))).alias("text"),
    ))


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, as it was before formatting."""
    return unescaped(F.substring(formatted, (start + 1).cast("int"), (end - start).cast("int")))
