"""BAI indexes as flat tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .storage import open_range, per_row, spread

# Limits of an index.
MAX_REFERENCES = 1_000_000
MAX_BINS = 1_000_000
MAX_CHUNKS = 1_000_000
MAX_INTERVALS = 100_000_000

ROW_SCHEMA = (
    "file string, kind string, ref_id int, bin int, item int, a bigint, b bigint, c bigint, d bigint, error string"
)
_ROWS_PER_BATCH = 50_000


class BaiError(ValueError):
    """Bytes that do not follow the BAI layout."""


class _Bytes:
    """Reads numbers off the content, checking that they are there."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def need(self, n: int, what: str) -> None:
        if self.at + n > len(self.data):
            raise BaiError(f"the index ends where {what} should be")

    def count(self, most: int, what: str) -> int:
        self.need(4, "a number of 4 bytes")
        (value,) = struct.unpack_from("<I", self.data, self.at)
        self.at += 4
        if value > most:
            raise BaiError(f"{what} is {value}, more than {most}")
        return value

    def longs(self, n: int) -> np.ndarray:
        self.need(8 * n, f"{n} offsets")
        out = np.frombuffer(self.data, "<u8", n, self.at).astype(np.int64)
        self.at += 8 * n
        return out


def parse(data: bytes) -> Iterator[dict]:
    """Rows of one index: chunks, linear offsets, counts, then the file row."""
    if len(data) < 8:
        raise BaiError(f"{len(data)} bytes are no index")
    if data[:4] != b"BAI\x01":
        raise BaiError("the first bytes are not the signature of an index")
    source = _Bytes(data)
    source.at = 4
    references = source.count(MAX_REFERENCES, "number of references")
    with_counts = 0
    for ref in range(references):
        for _ in range(source.count(MAX_BINS, "number of bins")):
            number = source.count(2**32 - 1, "bin number")
            chunks = source.count(2**32 - 1, "number of chunks")
            if number > K.META_BIN:
                raise BaiError(f"bin {number} of reference {ref} is none of the format")
            if chunks > MAX_CHUNKS:
                raise BaiError(f"bin {number} of reference {ref} claims {chunks} chunks")
            pairs = source.longs(2 * chunks).reshape(-1, 2)
            if number == K.META_BIN:
                if chunks != 2:
                    raise BaiError(
                        f"the bin with counts of reference {ref} has {chunks} parts, not 2"
                    )
                with_counts += 1
                (a, b), (c, d) = pairs.tolist()
                yield {"kind": "meta", "ref_id": ref, "a": a, "b": b, "c": c, "d": d}
                continue
            if (pairs[:, 1] < pairs[:, 0]).any():
                raise BaiError(f"a chunk of bin {number} of reference {ref} ends before it begins")
            for i, (beg, end) in enumerate(pairs.tolist()):
                yield {"kind": "chunk", "ref_id": ref, "bin": number, "item": i, "a": beg, "b": end}
        offsets = source.longs(source.count(MAX_INTERVALS, "number of linear offsets"))
        for i, offset in enumerate(offsets.tolist()):
            yield {"kind": "linear", "ref_id": ref, "item": i, "a": offset}
    left = len(data) - source.at
    if left not in (0, 8):
        raise BaiError(
            f"{left} bytes are left over, where nothing or the count of unplaced records (8) may stand"
        )
    trailer = int(source.longs(1)[0]) if left else None
    yield {"kind": "file", "item": references, "a": trailer, "b": with_counts}


def read_indexes(files: DataFrame) -> DataFrame:
    """Rows of all indexes in ``files`` (path, name), known by their path; one task per index.

    An index that breaks a rule gives one row of kind ``error`` and its other
    rows are to be ignored, see :func:`usable`.
    """

    def work(row: dict) -> Iterator[list[dict]]:
        held: list[dict] = []
        try:
            with open_range(row["path"]) as source:
                data = source.read()
            for item in parse(data):
                held.append(item | {"file": row["path"]})
                if len(held) >= _ROWS_PER_BATCH:
                    yield held
                    held = []
        except (BaiError, OSError) as problem:
            held = [{"file": row["path"], "kind": "error", "error": str(problem)}]
        yield held

    bais = files.filter(F.col("name").rlike(r"(?i)\.bai$")).select("path", "name")
    return per_row(spread(bais), work, ROW_SCHEMA)


def errors(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'error'").select("file", "error")


def usable(rows: DataFrame) -> DataFrame:
    """Rows of the indexes without an error."""
    return rows.filter("kind <> 'error'").join(errors(rows).select("file"), "file", "left_anti")


def chunks(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'chunk'").select(
        "file", "ref_id", "bin", F.col("item").alias("chunk_index"), F.col("a").alias("beg"), F.col("b").alias("end")
    )


def linear(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'linear'").select(
        "file", "ref_id", F.col("item").alias("interval"), F.col("a").alias("voffset")
    )


def meta(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'meta'").select(
        "file",
        "ref_id",
        F.col("a").alias("ref_beg"),
        F.col("b").alias("ref_end"),
        F.col("c").alias("mapped"),
        F.col("d").alias("placed_unmapped"),
    )


def index_files(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'file'").select(
        "file",
        F.col("item").alias("n_ref"),
        F.col("a").alias("no_coordinate"),
        (F.col("b") > 0).alias("has_metadata"),
    )
