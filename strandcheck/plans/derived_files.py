"""BAM, BAI, FASTQ and FAI files written from the given tables by Spark.

The byte readers need bytes to read. Each task encodes its own partition into
one file with a fresh name; the table of finished files is written by Spark,
so files of failed or repeated attempts are never listed.
"""

from __future__ import annotations

import pickle
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import discard, fresh_dir, materialize, ship_package
from ..sources.bgzf import EOF_BLOCK
from ..sources.storage import filesystem, list_files, open_range, per_row, spread

BLOCK_DATA = 65280
#: Records of a BAM file, about; more make more files, so that no task holds more.
FILE_RECORDS = 1_000_000
#: Records of a BAM file, and reads of a FASTQ file, that a task writes as a piece where the number of files is given, about.
PIECE_RECORDS, PIECE_READS = 250_000, 20_000
#: Bytes of a piece that are held while it is copied.
COPIED = 8 << 20
#: Columns that the records of a file are sorted by.
ORDER = ("ref_id", "pos", "read_name")
FILE_SCHEMA = "path string, name string, size bigint, position bigint"
_FILE = pa.schema([("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("position", pa.int64())])


def bgzf_block(data: bytes) -> bytes:
    """One BGZF block with ``data``."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = struct.pack("<4BI2BHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def bin_of(begin: int, end: int) -> int:
    """Smallest index bin that holds ``[begin, end)``."""
    last = end - 1
    for shift, offset in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == last >> shift:
            return offset + (begin >> shift)
    return 0


def encode_header(text: str, refs: list[tuple[str, int]]) -> bytes:
    raw = text.encode()
    out = b"BAM\x01" + struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(refs))
    for name, length in refs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\x00" + struct.pack("<i", length)
    return out


def encode_record(r: dict) -> bytes:
    """A record with a plain or spliced CIGAR and string, char and integer tags."""
    length = r["l_seq"]
    cigar = [length << 4]
    if r["spliced"]:
        half = length // 2
        cigar = [half << 4, 100 << 4 | 3, (length - half) << 4]
    name = r["read_name"].encode() + b"\x00"
    body = struct.pack(
        "<iiIIiiii", r["ref_id"], r["pos"], len(name) | r["mapq"] << 8, len(cigar) | r["flag"] << 16, length, -1, -1, 0
    )
    body += name + struct.pack(f"<{len(cigar)}I", *cigar) + b"\x11" * ((length + 1) // 2) + b"\x23" * length
    for tag in ("cb", "ub", "gx", "gn", "rg"):
        if r.get(tag) is not None:
            body += tag.upper().encode() + b"Z" + r[tag].encode() + b"\x00"
    if r.get("re") is not None:
        body += b"REA" + r["re"].encode()
    if r.get("nh") is not None:
        body += b"NHi" + struct.pack("<i", r["nh"])
    return struct.pack("<i", len(body)) + body


def _places(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Every place in the stretches that begin ``at`` and have these sizes."""
    return np.repeat(at - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes that hold all texts, where each begins, its size, and whether there is one."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    _, offsets, data = (text := column.cast(pa.binary())).buffers()
    raw = np.frombuffer(data or b"", np.uint8)
    begins = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text)] if len(text) else sizes
    return raw, begins.astype(np.int64), sizes, there


def encode_records(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of :func:`encode_record` for all rows in a row, and where each record ends."""
    n, names = batch.num_rows, set(batch.schema.names)
    number = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
    length, spliced = number("l_seq"), number("spliced").astype(bool)
    name = _texts(batch.column("read_name"))
    cigars = np.where(spliced, 3, 1)
    letters = (length + 1) // 2
    tags = [(t, _texts(batch.column(t))) for t in ("cb", "ub", "gx", "gn", "rg", "re") if t in names]
    counted = batch.column("nh").is_valid().to_numpy(zero_copy_only=False) if "nh" in names else np.zeros(n, bool)
    sizes = 37 + name[2] + 4 * cigars + letters + length + 7 * counted
    for tag, (_, _, size, there) in tags:
        sizes = sizes + np.where(there, size + (3 if tag == "re" else 4), 0)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    begins = ends - sizes

    def put(at: np.ndarray, values: np.ndarray) -> None:
        """Rows of bytes of equal length."""
        out[at[:, None] + np.arange(values.shape[1])] = values

    none = np.full(n, -1)
    fixed = (sizes - 4, number("ref_id"), number("pos"), name[2] + 1 | number("mapq") << 8, cigars | number("flag") << 16, length, none, none, 0 * none)
    put(begins, np.stack(fixed, 1).astype("<u4").view(np.uint8))
    at = begins + 36

    def write(text: tuple[np.ndarray, ...], at: np.ndarray) -> None:
        raw, start, size, _ = text
        out[_places(at, size)] = raw[_places(start, size)]

    write(name, at)
    at = at + name[2] + 1
    half = length // 2
    put(at[~spliced], (length[~spliced] << 4)[:, None].astype("<u4").view(np.uint8))
    put(at[spliced], np.stack((half << 4, 0 * half + (100 << 4 | 3), length - half << 4), 1)[spliced].astype("<u4").view(np.uint8))
    at = at + 4 * cigars
    out[_places(at, letters)] = 0x11
    out[_places(at + letters, length)] = 0x23
    at = at + letters + length
    for tag, text in tags:
        _, _, size, there = text
        head = np.frombuffer(tag.upper().encode() + (b"A" if tag == "re" else b"Z"), np.uint8)
        put(at[there], np.broadcast_to(head, (int(there.sum()), 3)))
        write(text, at + 3)
        at = at + np.where(there, size + (3 if tag == "re" else 4), 0)
    put(at[counted], np.broadcast_to(np.frombuffer(b"NHi", np.uint8), (int(counted.sum()), 3)))
    if counted.any():
        values = pc.fill_null(batch.column("nh"), 0).to_numpy(zero_copy_only=False)[counted]
        put(at[counted] + 3, values[:, None].astype("<i4").view(np.uint8))
    return out, ends


def bins_of(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """:func:`bin_of` for many stretches."""
    last, out = end - 1, np.zeros(len(begin), np.int64)
    for shift, offset in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = np.where(begin >> shift == last >> shift, offset + (begin >> shift), out)
    return out


class BamFile:
    """Writes records in order and keeps what the index needs."""

    def __init__(self, sink, header: bytes, references: int):
        self.sink, self.references, self.at, self.held = sink, references, 0, bytearray()
        self.chunks: dict[int, dict[int, list[list[int]]]] = defaultdict(lambda: defaultdict(list))
        self.linear: dict[int, dict[int, int]] = defaultdict(dict)
        self.counts: dict[int, list[int]] = defaultdict(lambda: [0, 0])
        self.spans: dict[int, list[int]] = {}
        self._append(header)
        self._flush()

    def _flush(self) -> None:
        if self.held:
            block = bgzf_block(bytes(self.held[:BLOCK_DATA]))
            self.sink.write(block)
            self.at += len(block)
            del self.held[:BLOCK_DATA]

    def _append(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= BLOCK_DATA:
            self._flush()

    def _offset(self) -> int:
        return self.at << 16 | len(self.held)

    def add(self, r: dict) -> None:
        begin = self._offset()
        self._append(encode_record(r))
        end, ref, pos = self._offset(), r["ref_id"], r["pos"]
        if ref < 0:
            return
        stop = pos + r["l_seq"] + (100 if r["spliced"] else 0)
        chunks = self.chunks[ref][bin_of(pos, stop)]
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = end
        else:
            chunks.append([begin, end])
        for interval in range(pos >> 14, ((stop - 1) >> 14) + 1):
            self.linear[ref].setdefault(interval, begin)
        self.counts[ref][1 if r["flag"] & 4 else 0] += 1
        self.spans.setdefault(ref, [begin, end])[1] = end

    def add_all(self, batch: pa.RecordBatch) -> None:
        """The rows of a batch, as :meth:`add` takes them one by one."""
        data, ends = encode_records(batch)
        offsets, blocks = len(self.held) + np.concatenate([[0], ends]), [self.at]
        self.held += data.tobytes()
        while len(self.held) >= BLOCK_DATA:
            self._flush()
            blocks.append(self.at)
        virtual = np.array(blocks)[offsets // BLOCK_DATA] << 16 | offsets % BLOCK_DATA
        ref, pos, length, flag, spliced = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ref_id", "pos", "l_seq", "flag", "spliced"))
        placed = np.flatnonzero(ref >= 0)
        if not len(placed):
            return
        begin, end, ref, pos, flag = virtual[:-1][placed], virtual[1:][placed], ref[placed], pos[placed], flag[placed]
        stop = pos + length[placed] + 100 * spliced[placed]
        number, low, high = bins_of(pos, stop), pos >> 14, stop - 1 >> 14

        def runs(*same: np.ndarray) -> list[tuple[int, int]]:
            """First and last row of each run of equal values in rows that follow one another."""
            new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in same], 0) | (begin[1:] != end[:-1])])
            first = np.flatnonzero(new)
            return list(zip(first.tolist(), [*(first[1:] - 1).tolist(), len(ref) - 1], strict=True))

        for i, j in runs(ref, number):
            chunks, b, e = self.chunks[int(ref[i])][int(number[i])], int(begin[i]), int(end[j])
            if chunks and chunks[-1][1] == b:
                chunks[-1][1] = e
            else:
                chunks.append([b, e])
        for i, _ in runs(ref, low, high):
            for interval in range(int(low[i]), int(high[i]) + 1):
                self.linear[int(ref[i])].setdefault(interval, int(begin[i]))
        for i, j in runs(ref):
            unmapped = int(np.count_nonzero(flag[i : j + 1] & 4))
            counts = self.counts[int(ref[i])]
            counts[0] += j + 1 - i - unmapped
            counts[1] += unmapped
            self.spans.setdefault(int(ref[i]), [int(begin[i]), int(end[j])])[1] = int(end[j])

    def places(self) -> bytes:
        """What the index needs, for :meth:`add_piece` of another file."""
        chunks = {ref: dict(bins) for ref, bins in self.chunks.items()}
        return pickle.dumps((chunks, dict(self.linear), dict(self.counts), self.spans))

    def add_piece(self, source, places: bytes) -> None:
        """Blocks that were written without a header and an end, with their :meth:`places`."""
        shift = self.at << 16
        self.at += _copy(source, self.sink)
        chunks, linear, counts, spans = pickle.loads(places)
        for ref, bins in chunks.items():
            for number, found in bins.items():
                self.chunks[ref][number] += [[begin + shift, end + shift] for begin, end in found]
        for ref, intervals in linear.items():
            for interval, begin in intervals.items():
                self.linear[ref].setdefault(interval, begin + shift)
        for ref, (mapped, unmapped) in counts.items():
            self.counts[ref][0] += mapped
            self.counts[ref][1] += unmapped
        for ref, (begin, end) in spans.items():
            self.spans.setdefault(ref, [begin + shift, end + shift])[1] = end + shift

    def close(self, ended: bool = True) -> int:
        while self.held:
            self._flush()
        if not ended:
            return self.at
        self.sink.write(EOF_BLOCK)
        return self.at + len(EOF_BLOCK)

    def index(self, unplaced: int | None = 0) -> bytes:
        out = [b"BAI\x01", struct.pack("<I", self.references)]
        for ref in range(self.references):
            bins, linear = self.chunks.get(ref, {}), self.linear.get(ref, {})
            out.append(struct.pack("<I", len(bins) + (1 if ref in self.spans else 0)))
            for number in sorted(bins):
                out.append(struct.pack("<II", number, len(bins[number])))
                out += [struct.pack("<QQ", *chunk) for chunk in bins[number]]
            if ref in self.spans:
                out.append(struct.pack("<IIQQQQ", K.META_BIN, 2, *self.spans[ref], *self.counts[ref]))
            size = max(linear, default=-1) + 1
            out.append(struct.pack(f"<I{size}Q", size, *[linear.get(i, 0) for i in range(size)]))
        if unplaced is not None:
            out.append(struct.pack("<Q", unplaced))
        return b"".join(out)


def _copy(source, sink) -> int:
    """Writes the rest of ``source`` to ``sink``; gives its size."""
    size = 0
    while data := source.read(COPIED):
        sink.write(data)
        size += len(data)
    return size


def _join_pieces(pieces: DataFrame, group: Callable[[list[str]], list[list[str]]], join: Callable[[list[str]], list[dict]]) -> DataFrame:
    """Has each group of the paths of ``pieces``, in the order of their position, joined by a task; then they go. Gives the table of files."""
    spark = pieces.sparkSession
    every = [r["path"] for r in pieces.orderBy("position").select("path").collect()]
    paths = [p for p in every if not p.endswith(".bai")]
    groups = spark.createDataFrame([(g,) for g in group(paths)], "pieces array<string>")
    files = materialize(per_row(spread(groups), lambda row: iter([join(row["pieces"])]), FILE_SCHEMA), "files")
    for path in every:
        store, inner = filesystem(path)
        store.delete_file(inner)
    discard(pieces)
    return files


def write_bams(
    rows: DataFrame, header_text: str, refs: list[tuple[str, int]], parts: int | None = None,
    by: Sequence[str | Column] = ORDER, as_records: Callable[[DataFrame], DataFrame] | None = None, pieces: int = 0,
) -> DataFrame:
    """Sorted BAM files with their indexes; gives the table of files.

    ``refs`` is a reference dictionary of fixed size. Positions are split into
    ranges by Spark, each range being one file: ``parts`` of them, or as many as tasks of
    a shuffle, and more for more than :data:`FILE_RECORDS` records each.

    ``rows`` are the records. Spark goes over them once to find the ranges and once to deal them out; where their columns
    are costly, ``rows`` are what ``as_records`` makes records of once they lie in the ranges of ``by``, columns or
    expressions in the order of ``ref_id`` and ``pos``.

    With more ``pieces`` than ``parts`` that many tasks write, and their blocks, in a row, are copied into the files.
    """
    spark = rows.sparkSession
    folder = fresh_dir(spark, "bam")
    fs, inner = filesystem(folder)
    fs.create_dir(inner, recursive=True)
    whole = not parts or pieces <= parts
    wanted = (parts if whole else pieces) or max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")), -(-rows.count() // FILE_RECORDS))
    placed = rows.repartitionByRange(wanted, *by)
    placed = (as_records(placed) if as_records else placed).sortWithinPartitions(*ORDER)
    header = encode_header(header_text, refs)

    def listed(name: str, size: int, index: bytes, position: int = 0) -> list[dict]:
        """Writes the index; gives both files."""
        store, base = filesystem(folder)
        with store.open_output_stream(f"{base}/{name}.bai") as sink:
            sink.write(index)
        return [
            {"path": f"{folder}/{name}", "name": name, "size": size, "position": position},
            {"path": f"{folder}/{name}.bai", "name": f"{name}.bai", "size": len(index), "position": position},
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name = f"part_{uuid.uuid4().hex}.bam"
        store, base = filesystem(folder)
        with store.open_output_stream(f"{base}/{name}") as sink:
            bam = BamFile(sink, header if whole else b"", len(refs))
            for batch in chain([first], batches):
                bam.add_all(batch)
            size = bam.close(whole)
        rows = listed(name, size, bam.index()) if whole else listed(name, size, bam.places(), TaskContext.get().partitionId())
        yield pa.RecordBatch.from_pylist(rows, schema=_FILE)

    def join(paths: list[str]) -> list[dict]:
        name = f"part_{uuid.uuid4().hex}.bam"
        store, base = filesystem(folder)
        with store.open_output_stream(f"{base}/{name}") as sink:
            bam = BamFile(sink, header, len(refs))
            for path in paths:
                with open_range(path) as source, open_range(f"{path}.bai") as places:
                    bam.add_piece(source, places.read())
            size = bam.close()
        return listed(name, size, bam.index())

    ship_package(spark)
    written = materialize(placed.mapInArrow(run, FILE_SCHEMA), "files")
    if whole:
        return written
    return _join_pieces(written, lambda paths: [g.tolist() for g in np.array_split(np.array(paths, object), parts) if len(g)], join)


def write_fastq(raw: DataFrame, gzip: bool = False) -> DataFrame:
    """Four-line text of ``header seq plus qual`` rows; gives the table of files."""
    spark = raw.sparkSession
    folder = fresh_dir(spark, "fastq")
    text = raw.select(F.concat_ws("\n", "header", "seq", "plus", "qual").alias("value"))
    text.write.option("compression", "gzip" if gzip else "none").text(folder)
    named = F.regexp_replace("name", r"\.txt", ".fastq")
    return list_files(spark, folder).withColumn("name", named)


def write_bgzip(raw: DataFrame, files: int | None = None) -> DataFrame:
    """Four-line text of ``header seq plus qual`` rows in BGZF blocks, a file per partition; gives the table of files.

    With a number of ``files``, the blocks of each so manieth partition are copied into one.
    """
    spark = raw.sparkSession
    folder = fresh_dir(spark, "bgzip")
    fs, inner = filesystem(folder)
    fs.create_dir(inner, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size, held = f"part_{uuid.uuid4().hex}.fastq.gz", 0, b""
        store, base = filesystem(folder)
        with store.open_output_stream(f"{base}/{name}", compression=None) as sink:  # else the name has it packed again
            for batch in batches:
                held += "".join(f"{line}\n" for line in batch.column(0).to_pylist()).encode()
                whole = len(held) // BLOCK_DATA * BLOCK_DATA
                for at in range(0, whole, BLOCK_DATA):
                    size += sink.write(bgzf_block(held[at : at + BLOCK_DATA]))
                held = held[whole:]
            for rest in (bgzf_block(held) if held else b"", b"" if files else EOF_BLOCK):
                size += sink.write(rest)
        position = TaskContext.get().partitionId() if files else 0
        yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "name": name, "size": size, "position": position}], schema=_FILE)

    def join(paths: list[str]) -> list[dict]:
        name, size = f"part_{uuid.uuid4().hex}.fastq.gz", len(EOF_BLOCK)
        store, base = filesystem(folder)
        with store.open_output_stream(f"{base}/{name}", compression=None) as sink:
            for path in paths:
                with open_range(path) as source:
                    size += _copy(source, sink)
            sink.write(EOF_BLOCK)
        return [{"path": f"{folder}/{name}", "name": name, "size": size, "position": 0}]

    ship_package(spark)
    text = raw.select(F.concat_ws("\n", "header", "seq", "plus", "qual").alias("value"))
    written = materialize(text.mapInArrow(run, FILE_SCHEMA), "files")
    return _join_pieces(written, lambda paths: [paths[k::files] for k in range(files)], join) if files else written


def write_fai(contigs: DataFrame, by: Sequence[str] = ()) -> str:
    """``name length offset line_bases line_bytes`` rows as text, in folders for each value of ``by``; gives the folder."""
    folder = fresh_dir(contigs.sparkSession, "fai")
    columns = [F.col(c).cast("string") for c in ("name", "length", "offset", "line_bases", "line_bytes")]
    contigs.select(F.concat_ws("\t", *columns).alias("value"), *by).write.partitionBy(*by).text(folder)
    return folder


def nation_references() -> list[tuple[str, int]]:
    """The dictionary of the alignment view: chr1 to chr24 and chrM."""
    return [(f"chr{i + 1}", 536870912) for i in range(24)] + [("chrM", 536870912)]
