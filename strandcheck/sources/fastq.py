"""FASTQ records as a DataFrame, from byte ranges or gzip streams."""

from __future__ import annotations

import codecs
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import reads as R
from . import bgzf
from .guess import first_block
from .storage import open_range, per_row, spread, spread_bytes

# Byte windows of a sample.
WINDOW_BYTES = 4 << 20
MAX_WINDOWS = 16
READ_BYTES = 4 << 20
#: Least bytes fetched at once by a range, and the first that are fetched beyond its end.
LEAST_BYTES = 16 << 10

RECORD_SCHEMA = (
    "file string, window int, rec_no bigint, header string, seq string, plus string, qual string, tail boolean, "
    "error string"
)
GZIP_SCHEMA = "path string, name string, size bigint, gzip boolean"


def detect_gzip(files: DataFrame) -> DataFrame:
    """Adds ``gzip``: by suffix, else by the first two bytes; and ``bgzip``: whether a gzip file is made of BGZF blocks."""

    def work(row: dict) -> Iterator[list[dict]]:
        try:
            with open_range(row["path"]) as source:
                head = source.read(12 + 65535)
        except OSError:
            head = b""  # reading the records tells what is wrong
        packed = row["name"].lower().endswith(".gz") or head[:2] == b"\x1f\x8b"
        try:
            blocked = packed and bgzf.block_size(head) > 0
        except bgzf.BgzfError:
            blocked = False
        yield [row | {"gzip": packed, "bgzip": blocked}]

    fastq = files.filter(F.col("name").rlike(K.FASTQ_PATTERN)).select("path", "name", "size")
    return per_row(spread(fastq), work, f"{GZIP_SCHEMA}, bgzip boolean")


def splits(files: DataFrame, span: int = 64 << 20) -> DataFrame:
    """Ranges that cover every file once; a gzip file is one range, unless it is made of BGZF blocks."""
    blocked = F.col("bgzip") if "bgzip" in files.columns else F.lit(False)
    stream = F.col("gzip") & ~blocked
    count = F.when(stream, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("size") / span)))
    rows = files.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1)).alias("w"))
    return rows.select(
        "path",
        F.col("path").alias("file"),
        "gzip",
        blocked.alias("bgzip"),
        F.col("w").cast("int").alias("window"),
        (F.col("w") * span).alias("start"),
        F.when(stream, F.col("size")).otherwise(F.least(F.col("size"), (F.col("w") + 1) * span)).alias("end"),
    )


def sample_windows(files: DataFrame, overlap: bool = False) -> DataFrame:
    """At most sixteen 4 MiB windows per file, spread evenly over it.

    The even spacing makes windows of a small file overlap. By default a
    window then ends where the next one starts, so that no read counts twice.
    """
    size = F.col("size")
    count = F.when(F.col("gzip"), 1).otherwise(
        F.least(F.lit(MAX_WINDOWS), F.greatest(F.lit(1), F.ceil(size / WINDOW_BYTES)))
    )
    rows = files.withColumn("windows", count.cast("bigint")).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("windows") - 1)).alias("w")
    )
    room = F.greatest(F.lit(0), size - WINDOW_BYTES)
    gaps = F.greatest(F.lit(1), F.col("windows") - 1)
    start = F.floor(F.col("w") * room / gaps)
    following = F.when(F.col("w") + 1 < F.col("windows"), F.floor((F.col("w") + 1) * room / gaps)).otherwise(size)
    end = F.least(size, start + WINDOW_BYTES)
    if not overlap:
        end = F.least(end, following)
    return rows.select(
        "path",
        F.col("path").alias("file"),
        "gzip",
        "windows",
        F.col("w").cast("int").alias("window"),
        F.when(F.col("gzip"), 0).otherwise(start).alias("start"),
        F.when(F.col("gzip"), size).otherwise(end).alias("end"),
    )


class FastqError(ValueError):
    """A compressed stream that is damaged or cut off."""


def _lines_of_gzip(source) -> Iterator[list[str]]:
    """Lines of all gzip members, a batch per piece read; they must end whole."""
    inflater, decode, rest = zlib.decompressobj(31), codecs.getincrementaldecoder("utf-8")("replace"), ""
    begun = False
    while piece := source.read(READ_BYTES):
        while piece:
            if not begun and not piece.strip(b"\x00"):
                # Padding after the last member.
                break
            begun = True
            try:
                text = decode.decode(inflater.decompress(piece, READ_BYTES))
            except zlib.error as problem:
                raise FastqError(f"damaged gzip stream: {problem}") from problem
            lines = (rest + text).split("\n")
            rest = lines.pop()
            yield lines
            piece = inflater.unconsumed_tail
            if inflater.eof:
                piece, begun = inflater.unused_data, False
                inflater = zlib.decompressobj(31)
    if rest:
        yield [rest]
    if begun:
        raise FastqError("gzip stream ends before its last block")


def _lines_of_range(source, start: int, size: int, end: int | None = None) -> Iterator[tuple[int, list[bytes]]]:
    """Whole lines starting at or after ``start`` with the offset of the first.

    No more is fetched than up to ``end``, if given; what is asked for beyond comes in pieces that double.
    """
    at = max(0, start - 1)
    source.seek(at)
    rest = b""
    skipped = start == 0
    beyond = LEAST_BYTES
    while at + len(rest) < size:
        left = size if end is None else end - at - len(rest)
        if left <= 0:
            left, beyond = beyond, 2 * beyond
        piece = source.read(min(READ_BYTES, max(LEAST_BYTES, left)))
        if not piece:
            break
        data = rest + piece
        if not skipped:
            cut = data.find(b"\n")
            if cut < 0:
                at, rest = at + len(data), b""
                continue
            at, data, skipped = at + cut + 1, data[cut + 1 :], True
        lines = data.split(b"\n")
        rest = lines.pop()
        yield at, lines
        at += len(data) - len(rest)
    if rest and skipped:
        yield at, [rest]


def _is_start(lines: list, i: int) -> bool:
    """A line with ``@`` and one with ``+`` two lines on: in whole records only headers are such lines."""
    return lines[i].startswith("@") and lines[i + 2].startswith("+")


def _groups(batches: Iterator[tuple[int, list[str], list[int]]], start: int, end: int | None | Callable[[], int | None]) -> Iterator[list[list[str]]]:
    """Records whose first line starts in ``[start, end)``, as lists of lines. An end that is found on the way is asked for with each batch.

    A valid record is followed by the next line. A damaged one is followed by
    the next line that starts a record, so that one stray or missing line costs
    one record, wherever a file is cut: a range begins at its first such line
    (the start of the file counts as one) and ends at the first of the next.
    The lines in between make one damaged record for every four begun, filled
    with empty lines; only what the end of the file cuts off has fewer than four.
    """
    lines: list[str] = []
    sizes: list[int] = []
    at = None
    # Lines of a damaged record, while the start of the next is looked for.
    damaged: list[str] | None = None if start == 0 else []
    owned = start == 0
    find_end = end if callable(end) else None
    for first, more, lengths in batches:
        end = find_end() if find_end else end
        at = first if at is None else at
        lines += more
        sizes += lengths
        found, i = [], 0
        while True:
            if damaged is not None:
                while i + 2 < len(lines) and not _is_start(lines, i):
                    if owned:
                        damaged.append(lines[i])
                        if len(damaged) == 4:
                            found.append(damaged)
                            damaged = []
                    at += sizes[i]
                    i += 1
                if i + 2 >= len(lines):
                    break
                if damaged:
                    found.append(damaged + [""] * (4 - len(damaged)))
                damaged, owned = None, True
            if i + 4 > len(lines):
                break
            if end is not None and at >= end and _is_start(lines, i):
                if found:
                    yield found
                return
            if _is_valid(lines[i : i + 4]):
                found.append(lines[i : i + 4])
                at += sum(sizes[i : i + 4])
                i += 4
            else:
                damaged = [lines[i]]
                at += sizes[i]
                i += 1
        if found:
            yield found
        lines, sizes = lines[i:], sizes[i:]
    if not owned:
        return
    if damaged is None:
        # A cut record after the range is its own if no later range can start there.
        beyond = end is not None and at is not None and at >= end
        if any(lines) and not (beyond and len(lines) > 2 and _is_start(lines, 0)):
            yield [lines]
        return
    room = 4 - len(damaged)
    cut = next((k for k in range(room, len(lines)) if lines[k].startswith("@")), len(lines))
    body = damaged + lines[:cut]
    left = [body[k : k + 4] for k in range(0, len(body), 4)]
    if cut < len(lines):
        left = [x + [""] * (4 - len(x)) for x in left] + [lines[cut:]]
    if any(map(any, left)):
        yield left


def _records_of_range(source, start: int, end: int, size: int) -> Iterator[list[list[str]]]:
    def batches() -> Iterator[tuple[int, list[str], list[int]]]:
        for at, raw in _lines_of_range(source, start, size, end):
            yield at, *_plain(raw)

    return _groups(batches(), start, end)


def _records_of_blocks(source, start: int, end: int, size: int) -> Iterator[list[list[str]]]:
    """Records of the BGZF blocks that begin in ``[start, end)``.

    Lines are placed by their distance in the inflated bytes from the first of these blocks. The line that reaches into that block, or begins
    with it, belongs to the range before; the range ends with the last record that begins no later than the first block of the next one.
    """
    first = 0 if start == 0 else first_block(source, start, min(end, size), size)
    if first is None:
        return
    boundary: int | None = None

    def batches() -> Iterator[tuple[int, list[str], list[int]]]:
        nonlocal boundary
        rest, at, inflated, skipped = b"", 0, 0, start == 0
        held: list[bytes] = []
        problem = None
        blocks = bgzf.blocks(source, first, size, min(bgzf.READ_AHEAD, max(0, end - first)))
        while True:
            try:
                block = next(blocks, None)
            except bgzf.BgzfError as damage:
                block, problem = None, FastqError(str(damage))
            if block is not None:
                if block.offset >= end and boundary is None:
                    boundary = inflated + 1
                held.append(block.data)
                inflated += len(block.data)
                if sum(map(len, held)) < READ_BYTES and boundary is None:
                    continue
            data = rest + b"".join(held)
            held = []
            if not skipped:
                cut = data.find(b"\n")
                if cut < 0 and block is not None:
                    at, rest = at + len(data), b""
                    continue
                at, data, skipped = at + cut + 1, data[cut + 1 :] if cut >= 0 else b"", True
            lines = data.split(b"\n")
            rest = lines.pop()
            yield at, *_plain(lines)
            at += len(data) - len(rest)
            if block is None:
                if problem:
                    raise problem
                if rest:
                    yield at, *_plain([rest])
                return

    yield from _groups(batches(), start, lambda: boundary)


def _plain(raw: list[bytes]) -> tuple[list[str], list[int]]:
    """Lines as text, and their bytes with the line end."""
    return [x.replace(b"\r", b"").decode("utf-8", "replace") for x in raw], [len(x) + 1 for x in raw]


def _records_of_gzip(source) -> Iterator[list[list[str]]]:
    batches = ((0, [x.replace("\r", "") for x in more], [0] * len(more)) for more in _lines_of_gzip(source))
    return _groups(batches, 0, None)


def _is_valid(four: list[str]) -> bool:
    header, seq, plus, qual = four
    seq, qual = seq.strip(), qual.strip()
    return header.startswith("@") and plus.startswith("+") and 0 < len(seq) == len(qual)


def records_of(row: dict, source) -> Iterator[list[list[str]]]:
    """Records of one range, see :func:`splits`, as lists of lines."""
    if row["bgzip"]:
        return _records_of_blocks(source, row["start"], row["end"], source.size())
    if row["gzip"]:
        return _records_of_gzip(source)
    return _records_of_range(source, row["start"], row["end"], source.size())


def columns_of(group: list[list[str]]) -> dict[str, list]:
    """Records as columns; what a cut record lacks is NULL, and ``tail`` tells of it."""
    full = [lines + [None] * (4 - len(lines)) for lines in group]
    header, seq, plus, qual = (list(column) for column in zip(*full, strict=True))
    return {"header": header, "seq": seq, "plus": plus, "qual": qual, "tail": [len(lines) < 4 for lines in group]}


def read_records(ranges: DataFrame, target: int | None = None) -> DataFrame:
    """Raw records of ranges, numbered per range.

    With a ``target``, a range stops after that many valid records. A file
    that ends inside a record gives a row with ``tail`` set, one that cannot be
    read on a row with ``error`` and no record, see :func:`decoded`, :func:`failures`.
    """

    def work(row: dict) -> Iterator[list[dict] | dict]:
        number = valid = 0
        base = {"file": row["file"], "window": row["window"]}
        try:
            with open_range(row["path"]) as source:
                for group in records_of(row, source):
                    if row["limit"] is not None:
                        taken = 0
                        for lines in group:
                            if valid >= row["limit"]:
                                break
                            valid += len(lines) == 4 and _is_valid(lines)
                            taken += 1
                        group = group[:taken]
                    if group:
                        yield base | {"rec_no": list(range(number, number + len(group)))} | columns_of(group)
                        number += len(group)
                    if row["limit"] is not None and valid >= row["limit"]:
                        return
        except (FastqError, OSError) as problem:
            yield [base | {"rec_no": number, "error": str(problem)}]

    limit = F.lit(None).cast("bigint") if target is None else F.ceil(F.lit(target) / F.coalesce("windows", F.lit(1)))
    blocked = F.col("bgzip") if "bgzip" in ranges.columns else F.lit(False)
    rows = ranges.select("path", "file", "gzip", blocked.alias("bgzip"), "window", "start", "end", limit.cast("bigint").alias("limit"))
    dealt = spread_bytes(rows, F.col("end") - F.col("start")) if target is None else spread(rows)
    return per_row(dealt, work, RECORD_SCHEMA)


def decoded(raw: DataFrame) -> DataFrame:
    """The records without the rows that tell of files that could not be read on."""
    return raw.filter(F.col("error").isNull()).drop("error")


def failures(raw: DataFrame) -> DataFrame:
    """The first problem of each file that could not be read to its end."""
    failed = raw.filter(F.col("error").isNotNull())
    return failed.groupBy("file").agg(F.min_by("error", F.struct("window", "rec_no")).alias("error"))


def sample_records(files: DataFrame, target: int, overlap: bool = False) -> DataFrame:
    """A bounded sample: the first ``target`` valid records in window order.

    Every window gives its share at most, so only a few windows of a file can
    pass the target; records after it are left out by a running count per
    window. Rows with an ``error`` are kept.
    """
    raw = read_records(sample_windows(files, overlap), target)
    marked = raw.withColumn(
        "ok", R.is_valid_record(F.col("header"), F.col("seq"), F.col("plus"), F.col("qual")).cast("bigint")
    )
    per_window = marked.groupBy("file", "window").agg(F.sum("ok").alias("n"))
    earlier = Window.partitionBy("file").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_window.select(
        "file", "window", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    inside = (
        Window.partitionBy("file", "window").orderBy("rec_no").rowsBetween(Window.unboundedPreceding, -1)
    )
    counted = marked.withColumn("seen", F.coalesce(F.sum("ok").over(inside), F.lit(0)))
    return (
        counted.join(offsets, ["file", "window"])
        .filter(F.col("error").isNotNull() | (F.col("before") + F.col("seen") < target))
        .drop("ok", "seen", "before")
    )
