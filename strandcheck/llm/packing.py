"""Packing of token sequences into windows of fixed length, online and in bounded space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .common import text_bytes, text_chunks
from .tokens import encoder

WINDOW = 2048
#: Windows that a packer keeps open.
OPEN_WINDOWS = 16
#: Packers whose open windows one task merges.
MERGED_AT_ONCE = 64

_COLUMNS = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, sequence_id bigint, offset bigint"
_SCHEMA = f"{_COLUMNS}, packer int, left_over boolean"

#: doc_id, start in the document, ids, tokens of the document.
Piece = tuple[int | None, int, np.ndarray, int]


class Packer:
    """Places pieces best-fit into a fixed number of open windows.

    A piece goes to the open window with the least room that still holds it.
    When none holds it, the fullest window takes as much of the piece as fits
    and is emitted full; the rest of the piece is placed in turn.
    """

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window = window
        self.rooms = [window] * open_windows
        self.held: list[list[Piece]] = [[] for _ in range(open_windows)]

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Takes a piece; yields the windows that became full."""
        doc_id, start, ids, total = piece
        while len(ids) >= self.window:
            yield [(doc_id, start, ids[: self.window], total)]
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            fitting = [r for r in self.rooms if r >= len(ids)]
            at = self.rooms.index(min(fitting or self.rooms))
            head = ids[: self.rooms[at]]
            self.held[at].append((doc_id, start, head, total))
            self.rooms[at] -= len(head)
            start, ids = start + len(head), ids[len(head) :]
            if not self.rooms[at]:
                yield self.held[at]
                self.rooms[at], self.held[at] = self.window, []

    def rest(self) -> Iterator[list[Piece]]:
        """The windows that are still open and hold something."""
        yield from (h for h in self.held if h)

    def last(self) -> Iterator[list[Piece]]:
        """The open windows filled up from one another: all full but the last."""
        final = Packer(self.window, 1)
        for held in self.rest():
            for piece in held:
                yield from final.add(piece)
        yield from final.rest()


def _rows(windows: Iterator[tuple[list[Piece], bool]], packer: int, level: int) -> Iterator[dict]:
    for number, (pieces, left_over) in enumerate(windows):
        sequence, offset = ((level << 26 | packer) << 32) | number, 0
        for doc_id, start, ids, total in pieces:
            yield {"doc_id": doc_id, "start": start, "length": len(ids), "doc_tokens": total, "ids": ids.astype("<u4").tobytes(),
                   "sequence_id": sequence, "offset": offset, "packer": packer, "left_over": left_over}
            offset += len(ids)


def _arrow(rows: Iterator[dict], at_once: int = 4000) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()),
                        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("packer", pa.int32()), ("left_over", pa.bool_())])
    lot: list[dict] = []
    for row in rows:
        lot.append(row)
        if len(lot) == at_once:
            yield pa.RecordBatch.from_pylist(lot, schema=schema)
            lot = []
    if lot:
        yield pa.RecordBatch.from_pylist(lot, schema=schema)


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Packs the texts of ``docs`` into sequences of at most ``window`` tokens.

    Each partition tokenizes its texts, ends each with ``end_id`` and packs
    them with ``open_windows`` open windows. The windows still open at the end
    are merged, up to 64 packers in a task, round by round until one is left;
    only the very last sequence can be shorter than ``window``.

    Returns one row per piece: ``doc_id, start, length, doc_tokens, ids``
    (little-endian unsigned 32-bit), ``sequence_id`` and ``offset``. A null text
    counts as empty, an empty text has only its end id, repeated rows are packed
    each on its own, an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encode = Packer(window, open_windows), encoder(tokenizer)

        def windows() -> Iterator[tuple[list[Piece], bool]]:
            for batch in batches:
                for part in text_chunks(batch):
                    ids, counts = encode(text_bytes(part.column("text")))
                    at = 0
                    for doc_id, n in zip(part.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                        piece = np.append(ids[at : at + n], np.uint32(end_id))
                        at += n
                        for full in packer.add((doc_id, 0, piece, n + 1)):
                            yield full, False
            for held in packer.rest():
                yield held, True

        yield from _arrow(_rows(windows(), TaskContext.get().partitionId(), 0))

    first = materialize(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(pack, _SCHEMA), "packed")
    done, open_rows = first.filter(~F.col("left_over")), first.filter("left_over")
    packers = (first.agg(F.max("packer")).first()[0] or 0) + 1
    level = 0
    while True:
        level += 1
        groups = -(-packers // MERGED_AT_ONCE)
        merged = open_rows.groupBy(F.floor(F.col("packer") / MERGED_AT_ONCE).cast("int").alias("group")).applyInPandas(
            _merger(level, groups == 1, window, open_windows), _SCHEMA
        )
        if groups == 1:
            return done.unionByName(merged).select("doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset")
        merged = materialize(merged, "merged")
        done, open_rows, packers = done.unionByName(merged.filter(~F.col("left_over"))), merged.filter("left_over"), groups


def _merger(level: int, final: bool, window: int, open_windows: int):
    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(window, open_windows)
        frame = frame.sort_values(["sequence_id", "offset"])

        def windows() -> Iterator[tuple[list[Piece], bool]]:
            for row in frame.itertuples():
                doc_id = None if pd.isna(row.doc_id) else int(row.doc_id)
                for full in packer.add((doc_id, int(row.start), np.frombuffer(row.ids, "<u4"), int(row.doc_tokens))):
                    yield full, False
            for held in packer.last() if final else packer.rest():
                yield held, not final

        rows = pd.DataFrame(list(_rows(windows(), int(key[0]), level)), columns=[c.split()[0] for c in _SCHEMA.split(", ")])
        return rows.astype({"doc_id": "Int64"})

    return merge
