"""BAM headers and records as DataFrames.

Files are never read as a whole by one task: work arrives as rows (a file, a
seek point, a range between two index offsets) and is dealt out by Spark.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import constants as K
from ..session import materialize
from . import bgzf
from .guess import record_cuts
from .storage import open_range, per_row, spread, spread_bytes
from .tags import slices, walk

# Limits of headers and records.
HEADER_BYTES = 64 << 20
MAX_REFERENCES = 1_000_000
MAX_NAME = 1_000_000
RECORD_BYTES = (32, 16 << 20)
MAX_SEQUENCE = 1_000_000
# Window limits (compressed bytes, blocks, inflated bytes).
SAMPLE_WINDOW = (1536 << 10, 48, 3 << 20)
PROBE_WINDOW = (512 << 10, 16, 1 << 20)
# Most bytes of a record in a whole-file scan; a longer one is reported as an error.
LARGEST_RECORD = 256 << 20

HEADER_SCHEMA = (
    "file string, path string, size bigint, eof boolean, header_text string, "
    "refs array<struct<name:string,length:bigint>>, header_bytes bigint, compressed_bytes bigint, "
    "blocks int, first_record bigint, error string"
)
RECORD_SCHEMA = (
    "file string, point_no int, region string, seq_in_point int, ref_id int, pos int, read_name string, "
    "mapq int, flag int, l_seq int, spliced boolean, cb string, cr string, ub string, ur string, gx string, "
    "gn string, re string, rg string, mm_upper bigint, mm_lower bigint, nh bigint, xf string, "
    "tags_present array<string>, error string"
)
PROBE_SCHEMA = "file string, voffset bigint, ok boolean, error string"


# Which operations of a CIGAR take up bases.
_COVERS = np.isin(np.arange(16), (0, 1, 4, 7, 8))


class BamError(ValueError):
    """Bytes that do not follow the BAM layout."""


# Headers


_INT = struct.Struct("<i")


def _int(data: bytes, at: int, low: int, high: int, what: str) -> int:
    (value,) = _INT.unpack_from(data, at)
    if not low <= value <= high:
        raise BamError(f"{what} is {value}, which is not within {low} and {high}")
    return value


def _entry_bounds(data: bytes, at: int, count: int) -> np.ndarray | None:
    """Begin and end of the name in each dictionary entry; None if the bytes end before the last entry does."""
    bounds = np.zeros((count, 2), np.int64)
    for k in range(count):
        if at + 4 > len(data):
            return None
        size = _int(data, at, 1, MAX_NAME, f"name size of dictionary entry {k}")
        bounds[k] = at + 4, at + 4 + size
        at += 8 + size
    return None if at > len(data) else bounds


def _listed(entries: np.ndarray) -> str:
    return ", ".join(map(str, entries[:5].tolist())) + (" and more" if len(entries) > 5 else "")


def parse_header(data: bytes) -> dict | None:
    """Header text and references, or None while more bytes are needed.

    The entries of the dictionary are found first; their names, lengths and repeats are then looked at all together.
    """
    if not b"BAM\x01".startswith(data[:4]):
        raise BamError("the first bytes are not the signature of a BAM")
    if len(data) < 12:
        return None
    text_end = 8 + _int(data, 4, 0, HEADER_BYTES, "size of the header text")
    if len(data) < text_end + 4:
        return None
    bounds = _entry_bounds(data, text_end + 4, _int(data, text_end, 0, MAX_REFERENCES, "number of references"))
    if bounds is None:
        return None
    raw, (begins, ends) = np.frombuffer(data, np.uint8), bounds.T
    lengths = np.ascontiguousarray(raw[ends[:, None] + np.arange(4)]).view("<i4").ravel()
    names = [data[a : b - 1].decode("utf-8", "replace") for a, b in bounds.tolist()]
    first = {name: k for k, name in reversed(list(enumerate(names)))}
    for wrong, what in (
        (raw[ends - 1] != 0, "have a name without its closing zero byte"),
        (ends - begins == 1, "have an empty name"),
        (lengths <= 0, "have no positive length"),
        (np.array([first[n] < k for k, n in enumerate(names)], bool), "repeat the name of another"),
    ):
        if wrong.any():
            raise BamError(f"dictionary entries that {what}: {_listed(np.flatnonzero(wrong))}")
    return {
        "header_text": data[8:text_end].decode("utf-8", "replace"),
        "refs": [{"name": n, "length": size} for n, size in zip(names, lengths.tolist(), strict=True)],
        "header_bytes": int(ends[-1]) + 4 if len(bounds) else text_end + 4,
    }


def _read_header(row: dict) -> dict:
    with open_range(row["path"]) as source:
        size = source.size()
        out = {"eof": bgzf.ends_with_eof_block(source, size), "size": size}
        data, need, parsed = bytearray(), 0, None
        # Where each block lies in the file, by its place in the inflated bytes.
        places: list[tuple[int, int]] = []
        for block in bgzf.blocks(source, 0, size):
            places.append((len(data), block.offset))
            data += block.data
            if len(data) > HEADER_BYTES + (MAX_REFERENCES << 6):
                raise BamError("header and dictionary together are larger than any that is accepted")
            # Parsing again after every block would be quadratic in the header.
            if len(data) >= need or not block.data:
                if parsed := parse_header(bytes(data)):
                    break
                need = len(data) + len(data) // 4
        parsed = parsed or parse_header(bytes(data))
        if not parsed:
            raise BamError("the file ends inside its header")
        after = block.offset + block.size
        places.append((len(data), after))
        inflated, offset = max(p for p in places if p[0] <= parsed["header_bytes"])
        first = offset << 16 | parsed["header_bytes"] - inflated
        return out | parsed | {"compressed_bytes": after, "blocks": len(places) - 1, "first_record": first}


def read_headers(files: DataFrame, fail_fast: bool = False) -> DataFrame:
    """One row per BAM of ``files``, known by its path; a problem is its ``error``, or raised."""

    def work(row: dict) -> Iterator[list[dict]]:
        base = {"file": row["path"], "path": row["path"], "size": row["size"]}
        try:
            yield [base | _read_header(row)]
        except (BamError, bgzf.BgzfError, OSError) as problem:
            if fail_fast:
                raise
            yield [base | {"error": str(problem)}]

    bams = files.filter(F.col("name").rlike(r"(?i)\.bam$")).select("path", "name", "size")
    return per_row(spread(bams), work, HEADER_SCHEMA)


def references(headers: DataFrame) -> DataFrame:
    return headers.select("file", F.posexplode("refs").alias("ref_id", "r")).select(
        "file", "ref_id", F.col("r.name").alias("name"), F.col("r.length").alias("length")
    )


# Records


def record_table(
    data: bytes, start: int, stop: int, limit: int, largest: int = RECORD_BYTES[1], longest: int = MAX_SEQUENCE
) -> tuple[dict[str, np.ndarray], int]:
    """Fixed fields of the records starting in ``[start, stop)`` as columns.

    Also gives the position after the last of them. Ends early at a record
    that is cut off, has impossible lengths, more than ``largest`` bytes or
    more than ``longest`` bases.
    """
    at, starts, size = start, [], len(data)
    unpack = struct.Struct("<i").unpack_from
    while at + 4 <= size and at < stop and len(starts) < limit:
        (length,) = unpack(data, at)
        if not RECORD_BYTES[0] <= length <= largest or at + 4 + length > size:
            break
        starts.append(at)
        at += 4 + length
    begin = np.array(starts, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    fixed = np.ascontiguousarray(raw[begin[:, None] + np.arange(36)]).view("<i4")
    words = fixed.view("<u4")
    t = {
        "begin": begin,
        "bytes": fixed[:, 0].astype(np.int64),
        "ref_id": fixed[:, 1],
        "pos": fixed[:, 2],
        "name_bytes": (words[:, 3] & 0xFF).astype(np.int64),
        "mapq": (words[:, 3] >> 8) & 0xFF,
        "cigars": (words[:, 4] & 0xFFFF).astype(np.int64),
        "flag": words[:, 4] >> 16,
        "l_seq": fixed[:, 5].astype(np.int64),
    }
    t["end"] = begin + 4 + t["bytes"]
    t["cigar_at"] = begin + 36 + t["name_bytes"]
    t["aux_at"] = t["cigar_at"] + 4 * t["cigars"] + (t["l_seq"] + 1) // 2 + t["l_seq"]
    sane = (
        (t["name_bytes"] >= 1)
        & (t["name_bytes"] <= t["bytes"])
        & (t["l_seq"] >= 0)
        & (t["l_seq"] <= longest)
        & (t["aux_at"] <= t["end"])
    )
    if not sane.all():
        first = int(np.argmin(sane))
        at = int(begin[first])
        t = {k: v[:first] for k, v in t.items()}
    total = int(t["cigars"].sum())
    owner = np.repeat(np.arange(len(t["begin"])), t["cigars"])
    within = np.arange(total) - np.repeat(np.cumsum(t["cigars"]) - t["cigars"], t["cigars"])
    ops = raw[t["cigar_at"][owner] + 4 * within] & 0xF if total else np.empty(0, np.uint8)
    t["spliced"] = np.bincount(owner[ops == 3], minlength=len(t["begin"])) > 0
    return t, at


def _columns(data: bytes, t: dict[str, np.ndarray], base: dict, first: int, tags: tuple[str, ...]) -> dict:
    """Records of a table as output columns, with names and the wanted tags decoded."""
    n = len(t["begin"])
    raw = np.frombuffer(data, dtype=np.uint8)
    names = t["begin"] + 36
    out = base | {
        "seq_in_point": np.arange(first, first + n, dtype=np.int32),
        **{k: t[k].astype(np.int32) for k in ("ref_id", "pos", "mapq", "flag", "l_seq")},
        "spliced": t["spliced"],
        "read_name": slices(raw, names, names + t["name_bytes"] - 1),
    }
    if not tags:
        return out
    fields = walk(raw, t["aux_at"], t["end"])
    for tag in tags:
        if tag in ("MM", "mm"):
            out["mm_upper" if tag == "MM" else "mm_lower"] = fields.integers(tag)
        elif tag == "NH":
            out["nh"] = fields.integers(tag, convert=True)
        else:
            out[tag.lower()] = fields.texts(tag)
    return out | {"tags_present": fields.present(tags)}


def read_points(points: DataFrame, per_point: int | Column, tags: tuple[str, ...] = K.WANTED_TAGS) -> DataFrame:
    """Records of bounded windows at seek points.

    ``points``: path, file, point_no, voffset, region. A point whose bytes
    cannot be read gives one row with ``error`` and no record.
    """

    def work(row: dict) -> Iterator[list[dict]]:
        base = {"file": row["file"], "point_no": row["point_no"], "region": row["region"]}
        try:
            with open_range(row["path"]) as source:
                found = bgzf.window(source, row["voffset"] >> 16, source.size(), *SAMPLE_WINDOW)
            data = b"".join(b.data for b in found)
            table, _ = record_table(data, row["voffset"] & 0xFFFF, len(data), row["limit"])
            yield _columns(data, table, base, 0, tags)
        except (bgzf.BgzfError, OSError) as problem:
            yield [base | {"error": str(problem)}]

    limit = per_point if isinstance(per_point, Column) else F.lit(per_point)
    work_rows = points.select(
        "path", "file", F.col("point_no").cast("int").alias("point_no"), "voffset", "region",
        limit.cast("int").alias("limit"),
    )
    return per_row(spread(work_rows), work, RECORD_SCHEMA)


def scan_ranges(
    chunks: DataFrame, headers: DataFrame | None = None, span: int = 32 << 20, largest: int = LARGEST_RECORD
) -> DataFrame:
    """Record-aligned ranges that cover every file once.

    A range starts at the lowest chunk offset in each ``span`` of compressed
    bytes; it ends where the next one starts, the last at the end of the file.
    With ``headers`` the first range starts right after the header, and in each
    span where no chunk starts the first record is looked for in the bytes, so
    a file without index and the reads without a place at the end of one are
    many ranges as well.
    """
    starts = chunks.filter("beg <> 0").select("file", "beg")
    if headers is not None:
        after = headers.filter(F.col("first_record").isNotNull())
        starts = starts.unionByName(after.select("file", F.col("first_record").alias("beg")))
    piece = F.floor(A.offset_block(F.col("beg")) / span)
    starts = starts.groupBy("file", piece.alias("piece")).agg(F.min("beg").alias("voffset"))
    if headers is not None:
        begun = F.floor(A.offset_block(F.col("first_record")) / span)
        pieces = after.select(
            "path", "file", "size", F.size("refs").alias("n_ref"),
            F.explode(F.sequence(begun, F.floor((F.col("size") - 1) / span))).alias("piece"),
        )
        starts = materialize(starts, "indexed-starts")
        gaps = pieces.join(starts, ["file", "piece"], "left_anti").select(
            "path", "file", "n_ref", (F.col("piece") * span).alias("start"), F.least("size", (F.col("piece") + 1) * span).alias("stop")
        )
        found = record_cuts(gaps, largest).select("file", F.floor(A.offset_block(F.col("beg")) / span).alias("piece"), F.col("beg").alias("voffset"))
        starts = starts.unionByName(materialize(found, "found-starts"))
    order = Window.partitionBy("file").orderBy("voffset")
    return starts.select(
        "file",
        (F.row_number().over(order) - 1).alias("point_no"),
        "voffset",
        F.lead("voffset").over(order).alias("end"),
    )


def _missing(data: bytes, at: int, largest: int) -> int:
    """Bytes still needed for the record at ``at``; 0 if it can never be read."""
    have = len(data) - at
    if have < 4:
        return 4 - have
    (length,) = struct.unpack_from("<i", data, at)
    if not RECORD_BYTES[0] <= length <= largest:
        return 0
    return max(0, 4 + length - have)


def records_of_range(
    row: dict, batch: int, tags: tuple[str, ...], largest: int, references: Sequence[int] | None = None
) -> Iterator[list[dict] | dict]:
    """Records of one range (path, file, point_no, voffset, end), see :func:`read_ranges`; of ``references`` only, if given."""
    base = {"file": row["file"], "point_no": row["point_no"], "region": None}
    data, at, stop, done, wanted = b"", row["voffset"] & 0xFFFF, None, 0, batch
    parts: list[bytes] = []
    held = 0

    def parse() -> dict:
        """Records of the joined bytes; keeps what lies after them."""
        nonlocal data, at, stop, done, parts, held
        data, parts, held = data + b"".join(parts), [], 0
        table, after = record_table(data, at, len(data) if stop is None else stop, 1 << 62, largest, 1 << 31)
        wanted_rows = slice(None) if references is None else np.isin(table["ref_id"], references)
        found = _columns(data, {k: v[wanted_rows] for k, v in table.items()}, base, done, tags)
        done += len(table["begin"])
        stop = None if stop is None else stop - after
        data, at = data[after:], max(0, at - len(data)) if after > len(data) else 0
        return found

    try:
        with open_range(row["path"]) as source:
            begin = row["voffset"] >> 16
            ahead = bgzf.READ_AHEAD if row["end"] is None else min(bgzf.READ_AHEAD, (row["end"] >> 16) - begin)
            for block in bgzf.blocks(source, begin, source.size(), ahead):
                if row["end"] is not None and stop is None and block.offset >= row["end"] >> 16:
                    inside = row["end"] & 0xFFFF if block.offset == row["end"] >> 16 else 0
                    stop, wanted = len(data) + held + inside, 1
                parts.append(block.data)
                held += len(block.data)
                if held < wanted:
                    continue
                yield parse()
                if stop is not None and stop <= 0:
                    return
                missing = _missing(data, 0, largest)
                if not missing:
                    break
                wanted = max(missing, batch if stop is None else 1)
            else:
                yield parse()
        if data and (stop is None or stop > 0):
            yield [base | {"error": f"range ends at a damaged or cut record, after {done} whole ones"}]
    except (bgzf.BgzfError, OSError) as problem:
        if parts:
            yield parse()
        yield [base | {"error": str(problem)}]


def read_ranges(
    ranges: DataFrame, batch: int = 4 << 20, tags: tuple[str, ...] = K.WANTED_TAGS, largest: int = LARGEST_RECORD
) -> DataFrame:
    """All records of ranges (path, file, point_no, voffset, end).

    Only ``tags`` are decoded; without any, auxiliary fields are not looked
    at. A range ends at the first record that breaks the layout, with a row
    that carries the ``error``, see :func:`scan_status`. A task holds
    ``batch`` inflated bytes and one record.
    """

    def work(row: dict) -> Iterator[list[dict] | dict]:
        return records_of_range(row, batch, tags, largest)

    pieces = ranges.select("path", "file", "point_no", "voffset", "end")
    size = F.coalesce(A.offset_block(F.col("end")) - A.offset_block(F.col("voffset")), F.lit(bgzf.READ_AHEAD))  # the last range of a file has no end
    return per_row(spread_bytes(pieces, size), work, RECORD_SCHEMA)


def scan_status(records: DataFrame) -> DataFrame:
    """Per file: records read, ranges that ended early and the first problem."""
    failed = F.col("error").isNotNull()
    return records.groupBy("file").agg(
        F.count_if(~failed).alias("records"),
        F.count_if(failed).alias("failed_ranges"),
        F.min_by("error", F.when(failed, F.col("point_no"))).alias("error"),
    )


def next_record(data: bytes, at: int, largest: int) -> int | None:
    """Where the record after the one at ``at`` begins, which may be beyond ``data``; None if no record begins at ``at``."""
    if len(data) - at < 4:
        return len(data) + 1
    (length,) = struct.unpack_from("<i", data, at)
    return at + 4 + length if RECORD_BYTES[0] <= length <= largest else None


def probe_record(data: bytes, at: int, reference_count: int, largest: int = RECORD_BYTES[1], limit: int = 1) -> int:
    """How many records, ``limit`` at most, stand whole in a row from ``at`` on; raises unless there is one and all are well-formed."""
    table, _ = record_table(data, at, len(data), limit, largest, MAX_SEQUENCE if largest == RECORD_BYTES[1] else 1 << 31)
    number = len(table["begin"])
    if not number:
        raise BamError(f"no whole record at byte {at}")
    start, stop = int(table["begin"][0]), int(table["end"][-1])
    fields = walk(np.frombuffer(data, np.uint8, stop - start, start), table["aux_at"] - start, table["end"] - start)
    for k in range(number):
        one = {c: int(v[k]) for c, v in table.items()}
        ops = np.frombuffer(data, "<u4", one["cigars"], one["cigar_at"])
        lengths, kinds = ops >> 4, ops & 0xF
        bases = int(lengths[_COVERS[kinds]].sum())
        tags, reached = fields.tag[fields.row == k], start + int(fields.reached[k])
        for wrong, what in (
            (data[one["begin"] + 35 + one["name_bytes"]] != 0, "its name has no closing zero byte"),
            ((lengths == 0).any() or (kinds > 8).any(), "its CIGAR has an operation of no length or of no known kind"),
            (len(ops) and bases != one["l_seq"], f"its CIGAR covers {bases} bases of {one['l_seq']}"),
            (not -1 <= one["ref_id"] < min(reference_count, MAX_REFERENCES), "its reference is not in the dictionary"),
            (one["pos"] < -1, "its position is negative"),
            (reached != one["end"], f"its auxiliary field at byte {reached} is cut off or of no known type"),
            (len(tags) and ((tags >> 8 < 33) | (tags & 0xFF < 33)).any(), "it has an auxiliary field without a printable tag"),
        ):
            if wrong:
                raise BamError(f"the record at byte {one['begin']} is no good: {what}")
    return number


def probe_points(points: DataFrame) -> DataFrame:
    """Whether a well-formed record starts at each offset.

    ``points``: path, file, voffset, n_ref (references in the BAM header).
    """

    def work(row: dict) -> Iterator[list[dict]]:
        base = {"file": row["file"], "voffset": row["voffset"]}
        place = f"{row['voffset'] >> 16}:{row['voffset'] & 0xFFFF}"
        try:
            with open_range(row["path"]) as source:
                found = bgzf.window(source, row["voffset"] >> 16, source.size(), *PROBE_WINDOW)
            if not found or row["voffset"] & 0xFFFF >= len(found[0].data):
                raise BamError(f"no block at {place} is long enough for this offset")
            probe_record(b"".join(b.data for b in found), row["voffset"] & 0xFFFF, row["n_ref"])
            yield [base | {"ok": True}]
        except (BamError, bgzf.BgzfError, OSError) as problem:
            yield [base | {"ok": False, "error": str(problem)}]

    return per_row(spread(points.select("path", "file", "voffset", "n_ref")), work, PROBE_SCHEMA)


def decoded(records: DataFrame) -> DataFrame:
    return records.filter(F.col("error").isNull()).drop("error")


def failed_points(records: DataFrame) -> DataFrame:
    return records.filter(F.col("error").isNotNull()).select("file", "point_no", "error")


def within_budget(
    records: DataFrame,
    target: int,
    per_point: Column,
    key: Sequence[str] = ("ref_id", "pos", "read_name", "flag"),
    keep_budget: bool = False,
) -> DataFrame:
    """Keeps what a reader would have read that counts different records only.

    Points are read in order, up to twice their share while the target is far, and only what is missing plus one share near it;
    a record that an earlier point or row has given already uses up room at its point, but does not count. No point is read once
    the target is met. A file's sample is bounded by twice the target, so its keys are walked through in one task.
    """
    columns = {c: records.schema[c].dataType.simpleString() for c in ("file", "point_no", "seq_in_point")}
    schema = f"file {columns['file']}, point_no {columns['point_no']}, budget bigint"
    marks = [F.xxhash64(*key).alias("mark"), F.xxhash64(F.lit(1), *key).alias("other")]
    keys = records.select("file", "point_no", "seq_in_point", per_point.cast("bigint").alias("share"), *marks)

    def budgets(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["point_no", "seq_in_point"])
        ids = pd.factorize(pd.MultiIndex.from_frame(rows[["mark", "other"]]))[0]
        seen = np.zeros(len(rows), bool)  # of each different record
        done, out = 0, []
        for point, at in rows.groupby("point_no").indices.items():
            share = int(rows["share"].iat[at[0]])
            budget = 0 if done >= target else min(2 * share, target - done + share)
            read = ids[at[:budget]]
            done += len(np.unique(read[~seen[read]]))
            seen[read] = True
            out.append((name[0], point, budget))
        return pd.DataFrame(out, columns=["file", "point_no", "budget"])

    allowed = keys.groupBy("file").applyInPandas(budgets, schema)
    kept = records.join(allowed, ["file", "point_no"]).filter(F.col("seq_in_point") < F.col("budget"))
    return kept if keep_budget else kept.drop("budget")
