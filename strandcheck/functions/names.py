"""Column expressions over file names, sizes and display values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def is_supported(name: Column) -> Column:
    return name.rlike(K.SUPPORTED_PATTERN)


def file_type(name: Column) -> Column:
    return (
        F.when(name.rlike(r"(?i)\.bam$"), "BAM")
        .when(name.rlike(r"(?i)\.bai$"), "BAI")
        .when(name.rlike(K.FASTQ_PATTERN), "FASTQ")
        .when(name.rlike(r"(?i)\.fai$"), "FAI")
        .otherwise("FILE")
    )


def clean_key(text: Column) -> Column:
    """Normalised sample key of a file stem."""
    slashed = F.translate(text, "\\", "/")
    joined = F.regexp_replace(slashed, r"\s+", "_")
    no_sample = F.regexp_replace(joined, r"(?i)_S\d+$", "")
    return F.lower(F.regexp_replace(no_sample, "_+$", ""))


def fastq_stem(name: Column) -> Column:
    return F.regexp_replace(name, K.FASTQ_PATTERN, "")


def bam_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.bam$", "")


def fastq_role(stem: Column) -> Column:
    letter = F.regexp_extract(stem, K.FASTQ_ROLE_PATTERN, 1)
    digit = F.regexp_extract(stem, K.FASTQ_ROLE_PATTERN, 2)
    return F.when(letter == "", "unknown").otherwise(F.lower(F.concat(letter, digit)))


def fastq_lane(stem: Column, role: Column) -> Column:
    lane = F.nullif(F.regexp_extract(stem, K.LANE_PATTERN, 1), F.lit(""))
    return F.when(role != "unknown", lane)


def fastq_key(stem: Column, role: Column) -> Column:
    prefix = F.regexp_replace(
        F.regexp_replace(stem, K.FASTQ_ROLE_PATTERN, ""), r"(?i)[_-]L\d{3}$", ""
    )
    return clean_key(F.when(role == "unknown", stem).otherwise(prefix))


def bam_key(name: Column) -> Column:
    return clean_key(bam_stem(name))


def display_name(key: Column) -> Column:
    last = F.element_at(F.split(key, r"[\\/]"), -1)
    return F.coalesce(F.nullif(last, F.lit("")), F.nullif(key, F.lit("")), F.lit("Unnamed dataset"))


def format_bytes(size: Column) -> Column:
    """Size in 1024-based units with 0, 1 or 2 decimals; of two equally near numbers the larger is shown.

    ``format_string`` is enough here: a whole number over a power of 1024 that reads as a tie is one.
    """
    units = ("B", "KB", "MB", "GB", "TB")
    text = None
    for power, unit in enumerate(units):
        value = size.cast("double") / float(1024**power)
        if power == 0:
            shown = F.format_string("%.0f B", value)
        else:
            shown = (
                F.when(value >= 100, F.format_string(f"%.0f {unit}", value))
                .when(value >= 10, F.format_string(f"%.1f {unit}", value))
                .otherwise(F.format_string(f"%.2f {unit}", value))
            )
        last = power == len(units) - 1
        below = F.lit(True) if last else size < 1024 ** (power + 1)
        text = F.when(below, shown) if text is None else text.when(below, shown)
    return F.when(size.isNull(), "—").otherwise(text)


def format_count(value: Column) -> Column:
    """Grouped digits, compact from a million on; a dash for NULL."""
    v = value.cast("double")
    one = lambda div, unit: F.concat(
        F.regexp_replace(F.format_string("%,.1f", v / div), r"\.0$", ""), F.lit(unit)
    )
    return (
        F.when(value.isNull(), "—")
        .when(v >= 1e12, one(1e12, "T"))
        .when(v >= 1e9, one(1e9, "B"))
        .when(v >= 1e6, one(1e6, "M"))
        .otherwise(one(1.0, ""))
    )


def _fixed(value: Column, digits: int) -> Column:
    """Digits of a double as ``toFixed`` gives them: its exact value is rounded, ties away from zero.

    ``format_string`` alone rounds the shortest decimal that reads as the same double: 0.15, a little less than 3/20,
    becomes 0.2. Here twice the scaled fraction is counted in integers, its first 30 bits and the rest apart. Values from
    10^12 on, infinite ones and NaN are left to ``format_string``.
    """
    scale = 10**digits
    size = F.abs(value)
    whole = F.floor(size)
    bits = (size - whole) * float(2**30)
    twice = F.floor(bits) * (2 * scale) + F.floor((bits - F.floor(bits)) * float(2 * scale)) + 2**30
    rounded = (whole * scale + F.shiftright(twice, 31)).cast("double") / float(scale)
    shown = F.when(size < 1e12, F.when(value < 0, -rounded).otherwise(rounded)).otherwise(value)
    return F.format_string(f"%.{digits}f", shown)


def format_percent(value: Column, digits: int = 1) -> Column:
    """Share as a percentage; a dash for NULL, NaN and infinite values."""
    share = value.cast("double")
    finite = F.abs(share) < float("inf")
    return F.when(finite, F.concat(_fixed(share * 100, digits), F.lit("%"))).otherwise("—")
