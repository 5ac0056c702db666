"""Where to start reading inside a compressed file without an index.

A block chain is found from any byte on: a place that looks like a block header
counts only if its block inflates with the right checksum and a further block,
or the end of the file, follows. A record start is found inside inflated bytes:
lengths that fit together narrow the places down with array operations, and a
run of well-formed records, up to the end of what the file has, decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bgzf
from .storage import open_range, per_row, spread

#: Well-formed records in a row that show a true start; fewer only at the end of a file.
CHAIN = 6
SEARCH_BYTES = 1 << 20
CUTS_PER_TASK = 512
#: Inflated bytes in which records are looked for first.
FIRST_STRETCH = 4096
# Fixed fields and the longest name of a record.
_FIXED_AND_NAME = 36 + 255
CUT_SCHEMA = "file string, beg bigint"

_MAGIC = np.array([31, 139, 8], np.uint8)


def _magic_places(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < 4:
        return np.zeros(0, np.int64)
    return np.flatnonzero((raw[:-3] == _MAGIC[0]) & (raw[1:-2] == _MAGIC[1]) & (raw[2:-1] == _MAGIC[2]) & (raw[3:] & 4 > 0))


def _is_block(source, at: int, file_size: int) -> bool:
    """A whole block at ``at`` with its checksum, followed by another header or the end."""
    try:
        block = next(bgzf.blocks(source, at, file_size, bgzf.MAX_BLOCK))
        after = at + block.size
        if after == file_size:
            return True
        source.seek(after)
        bgzf.block_size(source.read(min(12 + 65535, file_size - after)))
        return True
    except (bgzf.BgzfError, StopIteration):
        return False


def first_block(source, start: int, stop: int, file_size: int) -> int | None:
    """Offset of the first block that begins in ``[start, stop)``; places that only look like one are passed over."""
    at = start
    while at < stop:
        source.seek(at)
        data = source.read(min(SEARCH_BYTES, file_size - at, stop - at + 3))
        for place in (at + _magic_places(data)).tolist():
            if place >= stop:
                return None
            if _is_block(source, place, file_size):
                return place
        if at + len(data) >= file_size:
            return None
        at += max(1, len(data) - 3)
    return None


def likely_records(data: bytes, references: int, largest: int) -> np.ndarray:
    """Places whose fixed fields could be those of a record, however its bytes go on."""
    n = len(data) - 36
    if n <= 0:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    word = np.empty(len(data) - 3, np.int32)
    for shift in range(4):
        part = raw[shift : shift + (len(raw) - shift) // 4 * 4].view("<i4")
        word[shift::4][: len(part)] = part
    size, ref, pos, name, flags, bases, mate, mate_pos = (word[k : k + n] for k in range(0, 32, 4))
    fits = (size >= 32) & (size <= largest) & (ref >= -1) & (ref < references) & (pos >= -1)
    fits &= (bases >= 0) & (mate >= -1) & (mate < references) & (mate_pos >= -1) & (name & 0xFF > 0)
    at = np.flatnonzero(fits)
    names, ops, letters = (name[at] & 0xFF).astype(np.int64), (flags[at] & 0xFFFF).astype(np.int64), bases[at].astype(np.int64)
    at = at[32 + names + 4 * ops + (letters + 1) // 2 + letters <= size[at]]
    ends = at + 36 + (name[at] & 0xFF) - 1
    inside = ends < len(raw)
    return at[~inside | (raw[np.minimum(ends, len(raw) - 1)] == 0)]


def places_in_order(data: bytes, references: int, largest: int) -> Iterator[int]:
    """The places of :func:`likely_records` one by one, found in ever larger stretches, as one of the first is nearly always right."""
    start, step = 0, FIRST_STRETCH
    while start < len(data):
        for at in likely_records(data[start : start + step + _FIXED_AND_NAME], references, largest).tolist():
            if at >= step:
                break
            yield start + at
        start, step = start + step, 2 * step


def _run_of_records(data: bytes, at: int, whole: bool, references: int, largest: int) -> bool | None:
    """Whether a run of records starts at ``at``; None if more bytes are needed to tell."""
    from .bam import BamError, next_record, probe_record

    try:
        if probe_record(data, at, references, largest, CHAIN) == CHAIN:
            return True
    except BamError:
        pass  # told apart below, record by record
    for _ in range(CHAIN):
        if at == len(data):
            return True if whole else None
        after = next_record(data, at, largest)
        if after is None:
            return False
        if after > len(data):
            return False if whole else None
        try:
            probe_record(data, at, references, largest)
        except BamError:
            return False
        at = after
    return True


def first_record(source, start: int, stop: int, file_size: int, references: int, largest: int) -> int | None:
    """Virtual offset of the first record that begins in a block of ``[start, stop)``; None if there is none, or no telling."""
    block_at = first_block(source, start, stop, file_size)
    if block_at is None:
        return None
    data, places = b"", []
    rejected: set[int] = set()
    blocks: Iterator[bgzf.Block] = bgzf.blocks(source, block_at, file_size, 2 * bgzf.MAX_BLOCK)
    held: list[bytes] = []
    wanted = 2 * bgzf.MAX_BLOCK
    size, whole = 0, False
    while True:
        try:
            block = next(blocks, None)
        except bgzf.BgzfError:
            block = None  # what lies before the damage is all there is
            stop = min(stop, block_at)
        if block is not None:
            places.append((size, block.offset))
            held.append(block.data)
            size += len(block.data)
            block_at = block.offset + block.size
            if size < wanted:
                continue
        whole = block is None
        data, held = data + b"".join(held), []
        for at in places_in_order(data, references, largest):
            if at in rejected:
                continue
            inside, offset = max(p for p in places if p[0] <= at)
            if offset >= stop:
                break
            found = _run_of_records(data, at, whole, references, largest)
            if found:
                return offset << 16 | at - inside
            if found is False:
                rejected.add(at)
        if whole or (places and places[-1][1] >= stop and size > wanted + largest):
            return None
        wanted = 2 * size  # a long record may begin here, or reach beyond the next cut


def record_cuts(gaps: DataFrame, largest: int) -> DataFrame:
    """``file, beg`` of the first record in each stretch of ``gaps``: path, file, start, stop, n_ref."""

    def work(row: dict) -> Iterator[list[dict]]:
        try:
            with open_range(row["path"]) as source:
                found = first_record(source, row["start"], row["stop"], source.size(), row["n_ref"], largest)
        except OSError:
            found = None  # reading the range before reports it
        if found is not None:
            yield [{"file": row["file"], "beg": found}]

    return per_row(spread(gaps.select("path", "file", "start", "stop", F.col("n_ref").cast("int").alias("n_ref")), CUTS_PER_TASK), work, CUT_SCHEMA)
