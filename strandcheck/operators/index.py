"""Index counts, index validation and seek-point selection.

Input tables (one row each, ``file`` first):
``chunks``  file, ref_id, bin, chunk_index, beg, end
``linear``  file, ref_id, interval, voffset
``meta``    file, ref_id, ref_beg, ref_end, mapped, placed_unmapped
``files``   file, n_ref, no_coordinate, bam_size, bam_n_ref
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import constants as K
from ..session import materialize
from .histograms import bucketed_prefix, top_k_by

PICK_BUCKETS = 1024


def index_totals(meta: DataFrame, files: DataFrame) -> DataFrame:
    """Exact counts per file; NULL where the index has no counts.

    The total of unmapped records needs the index trailer, the mapped total
    needs at least one reference with counts.
    """
    sums = meta.groupBy("file").agg(
        F.sum("mapped").alias("mapped"), F.sum("placed_unmapped").alias("placed_unmapped")
    )
    joined = files.select("file", "no_coordinate").join(sums, "file", "left")
    unmapped = F.coalesce("placed_unmapped", F.lit(0)) + F.col("no_coordinate")
    whole = F.col("mapped") + unmapped
    return joined.select(
        "file",
        "mapped",
        "placed_unmapped",
        F.col("no_coordinate").alias("unplaced_unmapped"),
        unmapped.alias("total_unmapped"),
        F.try_divide(F.col("mapped").cast("double"), whole.cast("double")).alias("mapped_fraction"),
    )


def mito_fraction(named: DataFrame) -> DataFrame:
    """Mapped share of the first mitochondrial contig of each file."""
    mito = A.is_mitochondrial(F.col("name"))
    return (
        named.groupBy("file")
        .agg(
            F.sum("mapped").alias("mapped"),
            F.min_by("name", F.when(mito, F.col("ref_id"))).alias("mito_name"),
            F.min_by("mapped", F.when(mito, F.col("ref_id"))).alias("mito_mapped"),
        )
        .select(
            "file",
            "mito_name",
            "mito_mapped",
            F.try_divide(F.col("mito_mapped").cast("double"), F.col("mapped").cast("double")).alias(
                "mito_fraction"
            ),
        )
    )


def top_references(named: DataFrame, k: int = K.TOP_REFERENCES) -> DataFrame:
    """The ``k`` references of each file with most mapped records."""
    counted = named.withColumn("__m", F.coalesce("mapped", F.lit(0)))
    return top_k_by(counted, ["file"], "__m", k, "ref_id").drop("__m")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _violations(rows: DataFrame, bin_no: Column, item: Column, rules: dict[int, tuple[Column, Column]]) -> DataFrame:
    """Unfolds the rules each row breaks, all of them checked in one pass."""
    broken = [
        F.when(
            condition,
            F.struct(F.lit(rule).alias("rule"), item.cast("bigint").alias("item"), message.alias("message")),
        )
        for rule, (condition, message) in rules.items()
    ]
    return rows.select("file", "ref_id", bin_no.alias("bin"), F.inline(F.array_compact(F.array(*broken))))


def _beyond(offset: str, label: Column) -> tuple[Column, Column]:
    block = A.offset_block(F.col(offset))
    message = _text(label, " lies past the last byte of the BAM (", block, " >= ", F.col("bam_size"), ")")
    return block >= F.col("bam_size"), message


def validation_errors(chunks: DataFrame, linear: DataFrame, meta: DataFrame, files: DataFrame) -> DataFrame:
    """Every violated rule of every index, one row each.

    Windows run inside one reference of one file for the linear index (an
    index has at most 32,768 intervals there) and inside one bin for chunks;
    no window spans a whole file. Each table is read once for all its rules.
    """
    size = files.select("file", "bam_size")
    ref = _text("index of reference ", F.col("ref_id"))
    none = F.lit(-1)

    counts = _violations(
        files.withColumn("ref_id", none),
        none,
        F.lit(0),
        {
            1: (
                F.col("n_ref") != F.col("bam_n_ref"),
                _text("numbers of references differ (BAM: ", F.col("bam_n_ref"), ", index: ", F.col("n_ref"), ")"),
            )
        },
    )

    earlier = (
        Window.partitionBy("file", "ref_id").orderBy("interval").rowsBetween(Window.unboundedPreceding, -1)
    )
    used = F.when(F.col("voffset") != 0, F.col("voffset"))
    followed = linear.withColumn("previous", F.last(used, ignorenulls=True).over(earlier)).join(size, "file")
    of_linear = _violations(
        followed,
        none,
        F.col("interval"),
        {
            2: _beyond("voffset", _text(ref, " linear interval ", F.col("interval"))),
            3: (
                (F.col("voffset") != 0) & (F.col("voffset") < F.col("previous")),
                _text(ref, " has linear offsets that go back"),
            ),
        },
    )

    label = _text(ref, " bin ", F.col("bin"))
    beg, end = A.offset_block(F.col("beg")), A.offset_block(F.col("end"))
    in_bin = Window.partitionBy("file", "ref_id", "bin").orderBy("chunk_index")
    ordered = chunks.withColumn("previous", F.lag(beg).over(in_bin)).join(size, "file")
    of_chunks = _violations(
        ordered,
        F.col("bin"),
        F.col("chunk_index"),
        {
            4: _beyond("beg", _text(label, " chunk start")),
            5: _beyond("end", _text(label, " chunk end")),
            6: (F.col("end") <= F.col("beg"), _text(label, " has a chunk that holds nothing")),
            7: ((F.col("previous") > 0) & (beg < F.col("previous")), _text(label, " has chunks out of order")),
            8: (end < beg, _text(label, " has a chunk that ends in an earlier block")),
        },
    )
    of_meta = _violations(
        meta.join(size, "file"),
        F.lit(K.META_BIN),
        F.lit(0),
        {
            9: _beyond("ref_beg", _text(ref, " metadata start")),
            10: _beyond("ref_end", _text(ref, " metadata end")),
            11: (F.col("ref_end") < F.col("ref_beg"), _text(ref, " has metadata that end before they begin")),
        },
    )
    return counts.unionByName(of_linear).unionByName(of_chunks).unionByName(of_meta)


def first_errors(errors: DataFrame, k: int = K.ERRORS_SHOWN) -> DataFrame:
    """The first ``k`` errors of each file: by reference, linear index, bins, counts."""
    linear_first = F.when(F.col("rule") <= 3, 0).when(F.col("rule") <= 8, 1).otherwise(2)
    rows = errors.withColumn("part", linear_first)
    order = Window.partitionBy("file").orderBy("ref_id", "part", "bin", "item", "rule")
    return (
        rows.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= k)
        .select("file", "position", "message")
    )


def index_status(files: DataFrame, errors: DataFrame) -> DataFrame:
    """``pass``, or ``failed`` with the first errors, for each index."""
    shown = (
        first_errors(errors)
        .groupBy("file")
        .agg(F.sort_array(F.collect_list(F.struct("position", "message"))).alias("e"))
    )
    joined = files.select("file").join(shown, "file", "left")
    text = F.array_join(F.transform("e", lambda r: r["message"]), "; ")
    return joined.select(
        "file",
        F.when(F.col("e").isNull(), "pass").otherwise("failed").alias("status"),
        F.when(F.col("e").isNotNull(), F.concat(F.lit("BAI validation failed: "), text)).alias("error"),
    )


def _candidates(chunks: DataFrame, linear: DataFrame) -> DataFrame:
    of_chunks = chunks.filter(F.col("beg") != 0).select(
        "file", "ref_id", "bin", F.col("chunk_index").alias("index"), F.col("beg").alias("voffset"),
        F.lit(0).alias("source"),
    )
    of_linear = linear.filter(F.col("voffset") != 0).select(
        "file", "ref_id", F.lit(None).cast("int").alias("bin"), F.col("interval").alias("index"),
        "voffset", F.lit(1).alias("source"),
    )
    return of_chunks.unionByName(of_linear)


def _offset_bucket(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds a coarse position in the BAM that does not decrease with the offset."""
    sized = rows.join(files.select("file", "bam_size"), "file")
    place = A.offset_block(F.col("voffset")) * F.lit(float(PICK_BUCKETS)) / F.col("bam_size")
    return sized.withColumn("bucket", F.floor(place)).drop("bam_size")


def _half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def global_seek_points(chunks: DataFrame, linear: DataFrame, files: DataFrame, k: int) -> DataFrame:
    """At most ``k`` offsets per file, evenly spaced over its distinct offsets.

    Linear-index offsets join in only for files with fewer than ``min(8, k)``
    distinct chunk starts. Of entries with the same offset the first in index
    order stands. Positions come from counts per bucket of file offsets plus
    the rank inside the bucket, so no file is sorted as a whole.
    """
    entries = _candidates(chunks, linear)
    starts = entries.filter("source = 0").groupBy("file").agg(F.count_distinct("voffset").alias("starts"))
    pool = (
        entries.join(starts, "file", "left")
        .filter((F.col("source") == 0) | (F.coalesce("starts", F.lit(0)) < min(8, k)))
        .groupBy("file", "voffset")
        .agg(F.min(F.struct("source", "ref_id")).alias("first"))
        .select("file", "voffset", F.col("first.ref_id").alias("ref_id"))
    )
    pool = materialize(pool, "seek-candidates")
    placed = _offset_bucket(files, pool)
    ranked = bucketed_prefix(placed, ["file"], F.col("bucket"), ["voffset"], {"position": F.lit(1)})
    sizes = pool.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    wanted = sizes.select(
        "file", "n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i")
    ).select(
        "file",
        F.when(F.col("n") <= k, F.col("i") + 1)
        .otherwise(_half_up(F.col("i") * (F.col("n") - 1) / F.lit(max(1, k - 1))) + 1)
        .alias("position"),
    )
    picked = ranked.join(wanted.distinct(), ["file", "position"])
    return picked.select(
        "file",
        "ref_id",
        "voffset",
        A.offset_block(F.col("voffset")).alias("compressed"),
        A.offset_within(F.col("voffset")).alias("uncompressed"),
    )


def stratified_seek_points(
    chunks: DataFrame, linear: DataFrame, files: DataFrame, k: int, stop_early: bool = False
) -> DataFrame:
    """At most ``k`` offsets per file, spread evenly over its references.

    Every reference with candidates gets ``max(1, k // references)`` evenly
    spaced positions, taken in rounds over the references until ``k`` are
    found. ``stop_early`` ends at the first round that adds nothing. Of
    entries with the same offset the last in index order stands.
    """
    entries = _candidates(chunks, linear)
    starts = (
        entries.filter("source = 0").groupBy("file", "ref_id").agg(F.count(F.lit(1)).alias("starts"))
    )
    pool = (
        entries.join(starts, ["file", "ref_id"], "left")
        .filter((F.col("source") == 0) | (F.coalesce("starts", F.lit(0)) < 2))
        .groupBy("file", "ref_id", "voffset")
        .agg(F.max(F.struct("source", F.coalesce("bin", F.lit(-1)).alias("b"), "index", "bin")).alias("last"))
        .select("file", "ref_id", "voffset", F.col("last.bin").alias("bin"), F.col("last.index").alias("index"))
    )
    # Bins per reference are bounded by the format, so a window per reference is.
    inside = Window.partitionBy("file", "ref_id")
    ranked = materialize(
        pool.withColumn("position", F.row_number().over(inside.orderBy("voffset"))).withColumn(
            "n", F.count(F.lit(1)).over(inside)
        ),
        "seek-candidates",
    )
    sizes = ranked.filter("position = 1").select("file", "ref_id", "n")
    per_file = sizes.groupBy("file").agg(F.count(F.lit(1)).alias("refs"))
    quota = F.greatest(F.lit(1), F.floor(F.lit(k) / F.col("refs")))
    rounds = (
        sizes.join(per_file, "file")
        .withColumn("quota", quota)
        .select("file", "ref_id", "n", "quota", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("quota") - 1)).alias("round"))
    )
    index = _half_up(F.col("round") * (F.col("n") - 1) / F.greatest(F.lit(1), F.col("quota") - 1))
    # A position asked for in several rounds belongs to the first of them.
    firsts = (
        rounds.withColumn("position", F.least(F.col("n") - 1, index) + 1)
        .groupBy("file", "ref_id", "position")
        .agg(F.min("round").alias("round"))
    )
    if stop_early:
        per_round = firsts.groupBy("file", "round").agg(F.count(F.lit(1)).alias("added"))
        order = Window.partitionBy("file").orderBy("round")  # at most k rounds
        kept = per_round.withColumn("seq", F.row_number().over(order) - 1).filter(
            F.col("seq") == F.col("round")
        )
        firsts = firsts.join(kept.select("file", "round"), ["file", "round"])
    picked = ranked.drop("n").join(firsts, ["file", "ref_id", "position"])
    order = Window.partitionBy("file").orderBy("round", "ref_id")
    return (
        picked.withColumn("point_no", F.row_number().over(order) - 1)
        .filter(F.col("point_no") < k)
        .select(
            "file",
            "point_no",
            "ref_id",
            "voffset",
            A.offset_block(F.col("voffset")).alias("compressed"),
            A.offset_within(F.col("voffset")).alias("uncompressed"),
            A.region_id(F.col("ref_id"), F.col("bin"), F.col("index")).alias("region"),
        )
    )
