"""Token ids as length-delimited binary records, with an index of offsets beside each file.

A record is: length of the payload (unsigned 64-bit), masked checksum of that
length (unsigned 32-bit), payload, masked checksum of the payload. All numbers
are little-endian. The payload holds a flag (1: the document has an id), the
id (signed 64-bit), the width of a token id in bytes (2 or 4), and the ids.
A checksum is the CRC-32 turned right by 15 bits plus a constant, so that a
checksum of data that itself holds checksums stays strong. The index is one unsigned
64-bit offset per record and one for the end of the file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_dir, materialize, ship_package
from ..sources.storage import filesystem, spread
from .common import given_back, in_small_parts, text_bytes, text_chunks
from .tokens import encoder

# Fixed value: what is added to a turned checksum.
MASK_DELTA = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_META = struct.Struct("<BqB")
#: Bytes of records that a reader fetches at once. A longer record is fetched alone.
READ_BYTES = 4_000_000


class BadRecord(ValueError):
    """A record whose length or content does not agree with its checksum."""


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked_crc(length)) + payload + struct.pack("<I", masked_crc(payload))


def unframed(data: memoryview | bytes) -> bytes:
    """The payload of one framed record; raises :class:`BadRecord`."""
    if len(data) < 16:
        raise BadRecord("record is cut short")
    length, check = _HEAD.unpack_from(data)
    if masked_crc(bytes(data[:8])) != check or length != len(data) - 16:
        raise BadRecord("length does not agree with its checksum")
    payload = bytes(data[12:-4])
    if masked_crc(payload) != struct.unpack("<I", data[-4:])[0]:
        raise BadRecord("content does not agree with its checksum")
    return payload


def packed_ids(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return _META.pack(doc_id is not None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()


def unpacked_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    known, doc_id, width = _META.unpack_from(payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=_META.size)


def read_offsets(path: str) -> np.ndarray:
    fs, inner = filesystem(path + ".idx")
    with fs.open_input_file(inner) as f:
        return np.frombuffer(f.read(), "<u8").astype(np.int64)


def read_file(path: str, order: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of a file in file order, or those that ``order`` names, found by the offset index."""
    offsets = read_offsets(path)
    fs, inner = filesystem(path)
    with fs.open_input_file(inner) as f:
        if order is not None:
            for k in order:
                f.seek(int(offsets[k]))
                yield unpacked_ids(unframed(f.read(int(offsets[k + 1] - offsets[k]))))
            return
        at = 0
        while at < len(offsets) - 1:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + READ_BYTES, "right")) - 1)
            f.seek(int(offsets[at]))
            block = memoryview(f.read(int(offsets[to] - offsets[at])))
            for a, b in zip(offsets[at:to] - offsets[at], offsets[at + 1 : to + 1] - offsets[at], strict=True):
                yield unpacked_ids(unframed(block[a:b]))
            at = to


_FILES = "part bigint, path string, records bigint, tokens bigint"


def write_records(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes the ids of all texts in ascending ``doc_id`` order and returns the list of files.

    Rows are dealt out by ranges of ``doc_id``; each task writes one file and its
    index under a name of its own. Only files of tasks that succeeded are in the list
    (``part, path, records, tokens, start``), so a repeated task leaves no trace in it.
    ``start`` counts the ids in all earlier files. Null ids come first, equal ids in
    the order of a hash of their text; null texts are empty; no rows give no files.
    """
    spark = docs.sparkSession
    in_small_parts(spark)
    ship_package(spark)
    folder = folder or fresh_dir(spark, "records")
    ordered = (
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(tokenizer)
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.records"
        fs, inner = filesystem(path)
        fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        offsets, tokens, at = [0], 0, 0
        with fs.open_output_stream(inner) as out:
            for batch in given_back(_chain(first, batches)):
                for some in text_chunks(batch):
                    ids, counts = encode(text_bytes(some.column("text")))
                    begin, lot = 0, []
                    for doc_id, n in zip(some.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                        lot.append(framed(packed_ids(doc_id, np.append(ids[begin : begin + n], np.uint32(end_id)))))
                        begin, tokens, at = begin + n, tokens + n + 1, at + len(lot[-1])
                        offsets.append(at)
                    out.write(b"".join(lot))
        fs, inner = filesystem(path + ".idx")
        with fs.open_output_stream(inner) as out:
            out.write(np.array(offsets, "<u8").tobytes())
        yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "records": len(offsets) - 1, "tokens": tokens}])

    files = materialize(ordered.mapInArrow(write, _FILES), "record-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def read_records(files: DataFrame, at_once: int = 500_000) -> DataFrame:
    """Reads the listed files: ``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit), each file by one task.

    A record that fails its checksum fails the job.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                start, rows, held = row["start"], [], 0
                for doc_id, ids in read_file(row["path"]):
                    rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes()))
                    start, held = start + len(ids), held + len(ids)
                    if held >= at_once:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ship_package(files.sparkSession)
    return spread(files.select("path", "start")).mapInArrow(lambda batches: given_back(read(batches)), "doc_id bigint, start bigint, n_tokens bigint, ids binary")
