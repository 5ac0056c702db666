"""Helpers shared by the operators: tables, bounded chunks of text, and hashed words computed on whole byte arrays."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes, and rows, that a task works on at once. A longer text is a chunk of its own.
CHUNK_BYTES, CHUNK_ROWS = 1_000_000, 2_000
#: Settings of the session that keep few rows in memory at once, set where the session has nothing of its own: bytes of an Arrow batch
#: on its way to Python, rows that a scan holds in columns, and bytes of a row group of a written table.
SMALL_PARTS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "512",
    "parquet.block.size": str(16 << 20),
}
#: Ids that may be sent to all tasks, 8 bytes each.
BROADCAST_IDS = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D
_ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def in_small_parts(spark: SparkSession) -> None:
    """Sets :data:`SMALL_PARTS`, for whole texts take much memory in default sizes."""
    given = {key for key, _ in spark.sparkContext.getConf().getAll()}
    for key, value in SMALL_PARTS.items():
        if key not in given and f"spark.hadoop.{key}" not in given:
            spark.conf.set(key, value)


def given_back(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hands ``parts`` on; memory freed by then goes back to the machine with every tenth and after the last, for workers live on between tasks."""
    count = 0
    for part in parts:
        yield part
        count += 1
        if count % 10 == 0:
            _give_back()
    _give_back()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can do it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def held_out(doc_id: str = "doc_id"):
    """True for documents that no model may learn from: crc32 of the id as text leaves 0 when divided by 5."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` joined ``left_semi`` or ``left_anti`` with ``ids`` on the column of ``ids``.

    A list that is counted and found short is sent to all tasks, so that the texts stay where they are; a longer one meets them by a shuffle.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, ids.columns[0], how).select(docs.columns)


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most ``limit`` bytes together, one row at least and at most ``rows``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and (total + size > limit or i - start >= rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null gives none."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


class Words:
    """Words of many texts as arrays: hash of each word, and the index of its text.

    ``word_byte`` tells for each byte value whether it belongs to words. ASCII
    capitals are lowered first. A word's hash is a polynomial over its bytes
    modulo 2**64, mixed afterwards; all words are hashed with array operations.
    """

    def __init__(self, word_byte: np.ndarray):
        self._is_word = word_byte
        self._powers = np.ones(1, np.uint64)
        self._inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self._powers):
            for name, base in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 2**64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = np.frombuffer((b"\n".join(texts) + b"\n").translate(_ASCII_LOWER), np.uint8)
        inside = self._is_word[joined]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        owner = np.repeat(
            np.arange(len(texts)), np.diff(np.searchsorted(starts, np.cumsum(lengths)), prepend=0)
        ) if len(starts) else np.zeros(0, np.int64)
        self._grow(len(joined) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(joined) + 1, np.uint64)
            np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * self._powers[: len(joined)], out=sums[1:])
            hashes = (sums[ends] - sums[starts]) * self._inverses[starts]
        return mixed(hashes), owner


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values, one to one."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _MIX_1
        h = (h ^ (h >> np.uint64(27))) * _MIX_2
        return h ^ (h >> np.uint64(31))


def combined(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words."""
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = mixed(h * _ODD + words[k : k + n])
    return h


def white_space_words() -> Words:
    r"""Words ``[^\x20\x09-\x0D]+``."""
    flags = np.ones(256, bool)
    flags[[0x20, *range(0x09, 0x0E)]] = False
    return Words(flags)


def letter_digit_words() -> Words:
    r"""Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: ASCII digits, lower-case letters and everything beyond ASCII."""
    flags = np.zeros(256, bool)
    flags[0x30:0x3A] = flags[0x61:0x7B] = flags[0x80:] = True
    return Words(flags)
