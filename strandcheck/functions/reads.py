"""Column expressions over FASTQ records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

_SPACE = " \t\n\r\u000b\u000c ﻿"


def trimmed(col: Column) -> Column:
    return F.trim(col, F.lit(_SPACE))


def clean_sequence(seq: Column) -> Column:
    return F.upper(trimmed(seq))


def is_valid_record(header: Column, seq: Column, plus: Column, qual: Column) -> Column:
    """Four-line shape holds and sequence and quality agree in length."""
    bases, quality = trimmed(seq), trimmed(qual)
    ok = (
        header.startswith("@")
        & plus.startswith("+")
        & (F.length(bases) == F.length(quality))
        & (F.length(bases) > 0)
    )
    return F.coalesce(ok, F.lit(False))


def invalid_bases(seq: Column) -> Column:
    return F.length(F.translate(seq, K.BASE_ALPHABET, ""))


def invalid_quality(qual: Column) -> Column:
    """Quality characters outside the printable range 33-126."""
    return F.length(F.regexp_replace(qual, "[!-~]+", ""))


def gc_bases(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, "GC", ""))


def gc_bin(seq: Column) -> Column:
    ratio = gc_bases(seq) / F.greatest(F.lit(1), F.length(seq)) * (K.GC_BINS - 1)
    return F.least(F.lit(K.GC_BINS - 1), F.floor(ratio).cast("int"))


def has_adapter(seq: Column) -> Column:
    return seq.contains(K.ADAPTER)


def has_poly_a(seq: Column) -> Column:
    return seq.rlike(K.POLY_A_PATTERN)


def has_poly_g(seq: Column) -> Column:
    return seq.rlike(K.POLY_G_PATTERN)


def read_number(header: Column) -> Column:
    """``1`` or ``2`` named in a header, NULL where there is none."""
    return F.nullif(F.regexp_extract(header, K.READ_NUMBER_PATTERN, 1), F.lit(""))


def illumina_fields(header: Column) -> Column:
    """Parts of an Illumina header as a struct; NULL where it has no such form."""
    part = lambda i: F.regexp_extract(header, K.ILLUMINA_PATTERN, i)
    number = lambda i: F.try_to_number(part(i), F.lit("9" * 18)).cast("bigint")
    return F.when(
        header.rlike(K.ILLUMINA_PATTERN),
        F.struct(
            part(1).alias("instrument"),
            part(2).alias("run"),
            part(3).alias("flowcell"),
            number(4).alias("lane"),
            number(5).alias("tile"),
            number(8).alias("read"),
            (part(9) == "Y").alias("filtered"),
            number(10).alias("control"),
            part(11).alias("index"),
        ),
    )


def short_sequence(seq: Column, limit: int = 80) -> Column:
    """Display form: more than ``limit`` characters end in an ellipsis."""
    return F.when(
        F.length(seq) > limit, F.concat(F.substring(seq, 1, limit - 3), F.lit("…"))
    ).otherwise(seq)
