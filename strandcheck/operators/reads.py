"""Metrics over FASTQ records (``header seq plus qual``).

:func:`checked` splits raw four-line records into valid ones, cleaned, and the
rest; the metric functions take cleaned records with ``seq`` and ``qual``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import constants as K
from ..functions import reads as R
from ..session import ship_package
from .alignments import count_where
from .histograms import dense_histogram, top_k, top_k_by, value_counts


def checked(raw: DataFrame) -> DataFrame:
    """Adds ``valid``; sequence trimmed and upper-cased, quality trimmed."""
    return raw.withColumn(
        "valid", R.is_valid_record(*[F.col(c) for c in ("header", "seq", "plus", "qual")])
    ).withColumns({"seq": R.clean_sequence(F.col("seq")), "qual": R.trimmed(F.col("qual"))})


def _code_range():
    """Function that gives the least and the greatest code point of a text; NULL if it has none."""

    def work(texts: pa.Array) -> pa.Array:
        found = []
        for text in texts.to_pylist():
            codes = _code_points([text]) if text else None
            found.append(None if codes is None else {"low": int(codes.min()), "high": int(codes.max())})
        return pa.array(found, pa.struct([("low", pa.int64()), ("high", pa.int64())]))

    return F.arrow_udf(work, "low bigint, high bigint")


def integrity(raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Malformed records, invalid characters, quality range and read numbers."""
    ship_package(raw.sparkSession)
    rows = checked(raw)
    ok = F.col("valid")
    tail = F.coalesce(F.col("tail"), F.lit(False)) if "tail" in raw.columns else F.lit(False)
    number = F.when(ok, R.read_number(F.col("header")))
    rows = rows.withColumn("codes", _code_range()(F.when(ok, F.col("qual"))))
    totals = rows.groupBy(*by).agg(
        count_where(ok).alias("reads"),
        count_where(~ok & ~tail).alias("malformed"),
        F.coalesce(F.bool_or(tail), F.lit(False)).alias("incomplete_tail"),
        F.sum(F.when(ok, R.invalid_bases(F.col("seq")))).cast("bigint").alias("invalid_bases"),
        F.sum(F.when(ok, R.invalid_quality(F.col("qual")))).cast("bigint").alias("invalid_quality"),
        F.min("codes.low").alias("quality_min"),
        F.max("codes.high").alias("quality_max"),
        count_where(F.coalesce(number == "1", F.lit(False))).alias("read_number_1"),
        count_where(F.coalesce(number == "2", F.lit(False))).alias("read_number_2"),
    )
    both = (F.col("read_number_1") > 0) & (F.col("read_number_2") > 0)
    return totals.select(
        "*",
        (~both).alias("read_number_consistent"),
        F.when(F.col("invalid_quality") > 0, "invalid quality bytes")
        .otherwise("Phred+33 printable range (encoding remains ambiguous for high-quality-only reads)")
        .alias("quality_encoding"),
    )


#: Bases that a task works on at once, and cycles of its sums after which it hands them on.
PART_BASES, HELD_CYCLES = 1_000_000, 500_000
_BASES = "ACGTN"
#: Columns of the sums, per cycle: each base, the qualities, and the bases of quality 20 and 30 at least.
_SUMS = ("a", "c", "g", "t", "n", "q_sum", "q20", "q30")
#: Place in ``_BASES`` of each code point up to 255; those beyond count as the last of them.
_PLACE = np.full(256, 4, np.int64)
_PLACE[[ord(b) for b in _BASES]] = range(len(_BASES))


def _code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _cycle_sums(seqs: list[str], quals: list[str]) -> np.ndarray:
    """The sums of some reads, a row for each column and as many cycles as the longest read has."""
    sizes = np.array([len(s) for s in seqs], np.int64)
    longest, ends = int(sizes.max()), np.cumsum(sizes)
    cycle = np.arange(ends[-1], dtype=np.int64) - np.repeat(ends - sizes, sizes)
    base = _PLACE[np.minimum(_code_points(seqs), 255)]
    quality = np.maximum(0, _code_points(quals) - K.PHRED_OFFSET)
    bases = np.bincount(base * longest + cycle, minlength=len(_BASES) * longest).reshape(len(_BASES), longest)
    rest = (
        np.bincount(cycle, quality, longest),  # whole numbers far below 2**53, so exact
        np.bincount(cycle[quality >= 20], minlength=longest),
        np.bincount(cycle[quality >= 30], minlength=longest),
    )
    return np.concatenate([bases, np.stack(rest).astype(np.int64)])


def _some_reads(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most :data:`PART_BASES` bases, one read at least."""
    start, total = 0, 0
    for i, size in enumerate(pc.utf8_length(batch.column("seq")).to_pylist()):
        if i > start and total + size > PART_BASES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if batch.num_rows:
        yield batch.slice(start)


def cycle_sums(reads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sums per cycle, see :data:`_SUMS`: the source of all per-base metrics.

    Each task adds its reads up in arrays over the cycles and hands on one row per cycle; no base is ever a row. Characters other
    than A, C, G, T and N count as N, qualities below 0 as 0. Reads whose quality is not as long as their sequence, and nulls, are
    left out; :func:`checked` tells them. A very long read is added up in stretches, which are handed on at once.
    """
    ship_package(reads.sparkSession)
    keys = F.struct(*by) if by else F.lit(0)
    rows = reads.filter(F.length("seq") == F.length("qual")).select(keys.alias("keys"), "seq", "qual")
    keys_type = to_arrow_schema(rows.select("keys").schema).field("keys").type

    def handed_on(key, sums: np.ndarray, first: int = 0) -> Iterator[pa.RecordBatch]:
        for at in range(0, sums.shape[1], 100_000):
            part = sums[:, at : at + 100_000]
            size = part.shape[1]
            cycle = np.arange(first + at + 1, first + at + 1 + size, dtype=np.int32)
            repeated = pa.array([dict(key) if by else key], keys_type).take(pa.array(np.zeros(size, np.int64)))
            yield pa.RecordBatch.from_arrays([repeated, pa.array(cycle), *(pa.array(x) for x in part)], names=["keys", "cycle", *_SUMS])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for part in (p for b in batches for p in _some_reads(b)):
            groups: dict = {}
            for key, seq, qual in zip(*(part.column(c).to_pylist() for c in ("keys", "seq", "qual")), strict=True):
                groups.setdefault(tuple(key.items()) if by else key, []).append((seq, qual))
            for key, pairs in groups.items():
                seqs, quals = [s for s, _ in pairs], [q for _, q in pairs]
                longest = max(map(len, seqs))
                if longest > HELD_CYCLES:
                    for at in range(0, longest, HELD_CYCLES):
                        there = [k for k, s in enumerate(seqs) if len(s) > at]
                        end = at + HELD_CYCLES
                        yield from handed_on(key, _cycle_sums([seqs[k][at:end] for k in there], [quals[k][at:end] for k in there]), at)
                elif longest:
                    fresh = _cycle_sums(seqs, quals)
                    known = held.get(key, fresh[:, :0])
                    small, large = sorted((known, fresh), key=lambda x: x.shape[1])
                    large[:, : small.shape[1]] += small
                    held[key] = large
            if sum(x.shape[1] for x in held.values()) > HELD_CYCLES:
                for key, sums in held.items():
                    yield from handed_on(key, sums)
                held = {}
        for key, sums in held.items():
            yield from handed_on(key, sums)

    schema = f"keys {rows.schema['keys'].dataType.simpleString()}, cycle int, {', '.join(f'{c} bigint' for c in _SUMS)}"
    counted = rows.mapInArrow(add_up, schema).select(*(F.col(f"keys.{c}").alias(c) for c in by), "cycle", *_SUMS)
    return counted.groupBy(*by, "cycle").agg(*(F.sum(c).alias(c) for c in _SUMS))


def _sum_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0).cast("bigint"))


def _reads_at() -> Column:
    """Reads that reach a cycle."""
    return F.col("a") + F.col("c") + F.col("g") + F.col("t") + F.col("n")


def base_totals(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bases, and shares of good and unknown ones, from :func:`cycle_sums`."""
    total = F.greatest(F.lit(1).cast("bigint"), F.col("bases")).cast("double")
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    totals = sums.groupBy(*by).agg(
        whole(_reads_at()).alias("bases"),
        whole("n").alias("n_bases"),
        whole("q20").alias("q20_bases"),
        whole("q30").alias("q30_bases"),
    )
    return totals.select(
        *by,
        "bases",
        (F.col("q20_bases") / total).alias("q20"),
        (F.col("q30_bases") / total).alias("q30"),
        (F.col("n_bases") / total).alias("n_fraction"),
    )


def per_cycle(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean quality and base shares over the reads reaching each cycle, from :func:`cycle_sums`."""
    return sums.select(
        *by,
        "cycle",
        _reads_at().alias("reads"),
        (F.col("q_sum") / _reads_at()).alias("mean_q"),
        *[(F.col(b) / _reads_at()).alias(f"frac_{b}") for b in ("a", "c", "g", "t", "n")],
    )


def cycle_entropy(cycles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over cycles of the A/C/G/T entropy in bits."""
    entropy = F.lit(0.0)
    for b in ("a", "c", "g", "t"):
        p = F.col(f"frac_{b}")
        entropy = entropy - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return cycles.groupBy(*by).agg(F.avg(entropy).alias("mean_cycle_entropy"))


def length_histogram(reads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return value_counts(reads.select(*by, F.length("seq").alias("length")), "length", by)


def gc_histogram(reads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    # What a generator gives is computed once: else the optimizer puts the expression behind ``seq`` into each place that needs the bin.
    sequences = reads.select(*by, F.explode(F.array("seq")).alias("seq"))
    bins = sequences.select(*by, F.explode(F.array(R.gc_bin(F.col("seq")))).alias("gc_bin"))
    return dense_histogram(bins, "gc_bin", 0, K.GC_BINS - 1, by)


def sequence_counts(reads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return value_counts(reads, "seq", by)


def top_sequences(reads: DataFrame, k: int = K.TOP_SEQUENCES, by: Sequence[str] = ()) -> DataFrame:
    counted = sequence_counts(reads, by)
    best = top_k_by(counted, by, "n", k, "seq").drop("rank") if by else top_k(counted, "n", k, "seq")
    return best.withColumn("shown", R.short_sequence(F.col("seq")))


def read_totals(reads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Read counts, duplication, adapter and homopolymer tails, median length.

    All of them depend on the sequence only, so they are taken from distinct
    sequences with their counts: heavily repeated reads are one row.
    """
    seq = F.col("seq")
    lengths = (
        sequence_counts(reads, by)
        .groupBy(*by, F.length(seq).alias("length"))
        .agg(
            F.sum("n").alias("reads"),
            F.count(F.lit(1)).alias("unique"),
            _sum_if(R.has_adapter(seq)).alias("adapter"),
            _sum_if(R.has_poly_a(seq)).alias("poly_a"),
            _sum_if(R.has_poly_g(seq)).alias("poly_g"),
        )
    )
    # One row per read length is left: B bases have at most sqrt(2 B) of them.
    group = Window.partitionBy(*by)
    up_to = group.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = lengths.select(
        "*", F.sum("reads").over(up_to).alias("cum"), F.sum("reads").over(group).alias("all")
    )
    reads_n = F.coalesce(F.sum("reads"), F.lit(0).cast("bigint"))
    total = F.greatest(F.lit(1).cast("bigint"), reads_n).cast("double")
    unique = F.coalesce(F.sum("unique"), F.lit(0).cast("bigint"))
    past_half = F.col("cum") > (F.col("all") - 1) / 2
    return ranked.groupBy(*by).agg(
        reads_n.alias("reads"),
        unique.alias("unique_sequences"),
        F.min(F.when(past_half, F.col("length"))).cast("bigint").alias("median_length"),
        ((reads_n - unique) / total).alias("duplication"),
        (F.sum("adapter") / total).alias("adapter_fraction"),
        (F.sum("poly_a") / total).alias("poly_a_fraction"),
        (F.sum("poly_g") / total).alias("poly_g_fraction"),
    )


def first_header(raw: DataFrame, order: Column, by: Sequence[str] = ()) -> DataFrame:
    """Header of the first valid record and its Illumina parts."""
    valid = checked(raw).filter("valid")
    first = valid.groupBy(*by).agg(F.min(F.struct(order.alias("o"), "header")).alias("f"))
    return first.select(
        *by,
        F.col("f.header").alias("first_header"),
        R.illumina_fields(F.col("f.header")).alias("illumina"),
    )
