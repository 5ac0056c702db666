"""Column expressions over alignment records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def has_flag(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(bit) != 0


def is_mapped(flag: Column) -> Column:
    return ~has_flag(flag, K.UNMAPPED)


def flag_predicates(flag: Column) -> dict[str, Column]:
    """The seven FLAG questions the reports ask."""
    return {
        "mapped": is_mapped(flag),
        "unmapped": has_flag(flag, K.UNMAPPED),
        "paired": has_flag(flag, K.PAIRED),
        "proper_pair": has_flag(flag, K.PROPER_PAIR),
        "duplicate": has_flag(flag, K.DUPLICATE),
        "secondary": has_flag(flag, K.SECONDARY),
        "supplementary": has_flag(flag, K.SUPPLEMENTARY),
    }


ALIGNMENT_CLASSES = ("primary", "secondary", "supplementary", "unmapped")


def alignment_class(flag: Column) -> Column:
    return (
        F.when(has_flag(flag, K.UNMAPPED), "unmapped")
        .when(has_flag(flag, K.SECONDARY), "secondary")
        .when(has_flag(flag, K.SUPPLEMENTARY), "supplementary")
        .otherwise("primary")
    )


def present(col: Column) -> Column:
    """A tag value that is neither missing nor the empty string."""
    return col.isNotNull() & (col != "")


def non_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def molecule_gene(gx: Column, gn: Column) -> Column:
    """Gene of a molecule: the id first, then the name."""
    return F.coalesce(non_empty(gx), non_empty(gn))


def counted_gene(gx: Column, gn: Column) -> Column:
    """Gene text for gene counting: the name first, then the id."""
    return F.coalesce(non_empty(gn), non_empty(gx))


def gene_tokens(gx: Column, gn: Column) -> Column:
    return F.filter(F.split(counted_gene(gx, gn), ";"), lambda t: t != "")


def first_token(text: Column) -> Column:
    return F.substring_index(text, ";", 1)


def is_multimapped(mm_upper: Column, mm_lower: Column, nh: Column) -> Column:
    """Numeric ``MM``/``mm`` equal to 1, or ``NH`` above 1."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return yes(mm_upper == 1) | yes(mm_lower == 1) | yes(nh > 1)


def is_mitochondrial(name: Column) -> Column:
    return F.coalesce(name.rlike(K.MITO_PATTERN), F.lit(False))


def is_spliced(cigar: Column) -> Column:
    """Any reference skip (operation 3) in an array of ``(len, op)``."""
    return F.exists(cigar, lambda c: c["op"] == 3)


def region_label(code: Column) -> Column:
    return (
        F.when(code == "E", "Exonic")
        .when(code == "N", "Intronic")
        .when(code == "I", "Intergenic")
        .otherwise(code)
    )


def offset_block(voffset: Column) -> Column:
    """Compressed file position of a virtual offset."""
    return F.shiftrightunsigned(voffset, 16)


def offset_within(voffset: Column) -> Column:
    """Position inside the inflated block of a virtual offset."""
    return voffset.bitwiseAND(F.lit(65535).cast("bigint"))


def region_id(ref_id: Column, bin_no: Column, index: Column) -> Column:
    """``ref:bin:chunk``, or ``ref:linear:interval`` where no bin is known."""
    return F.concat_ws(
        ":",
        ref_id.cast("string"),
        F.coalesce(bin_no.cast("string"), F.lit("linear")),
        index.cast("string"),
    )


def reference_label(name: Column, ref_id: Column, prefix: str = "ref_") -> Column:
    return F.coalesce(name, F.concat(F.lit(prefix), ref_id.cast("string")))


def wilson_margin(count: Column, n: Column) -> Column:
    """Half-width of the 95 % Wilson interval; NULL when ``n`` is 0."""
    z2 = F.lit(K.WILSON_Z * K.WILSON_Z)
    total = F.nullif(n.cast("double"), F.lit(0.0))
    p = count.cast("double") / total
    root = F.sqrt(p * (1 - p) / total + z2 / (4 * total * total))
    return F.lit(K.WILSON_Z) * root / (1 + z2 / total)


def proportion(count: Column, n: Column) -> Column:
    """``count / n``; NULL when ``n`` is 0."""
    return F.try_divide(count.cast("double"), n.cast("double"))


def share(count: Column, n: Column) -> Column:
    """``count / max(1, n)``: 0 rather than NULL for an empty denominator."""
    return count.cast("double") / F.greatest(F.lit(1).cast("bigint"), n).cast("double")
