"""Auxiliary fields of BAM records, taken from many records at once.

A step looks at the next field of every record that still has one, so the
number of steps is that of the fields in the longest record and not that of
the records.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes of a value by type letter, and how numbers are stored.
WIDTHS = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4, "d": 8}
NUMBERS = {"c": "<i1", "C": "<u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4", "f": "<f4", "d": "<f8"}

_TEXT, _ARRAY = [ord(c) for c in "ZH"], ord("B")
_NEVER = np.int64(1) << 60


def _by_letter(sizes: dict[str, int]) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[[ord(c) for c in sizes]] = list(sizes.values())
    return out


_WIDTH = _by_letter(WIDTHS)
_IS_TEXT = np.isin(np.arange(256), _TEXT)
_ITEM = _by_letter({c: w for c, w in WIDTHS.items() if c not in "Ad"})


def _code(tag: str) -> int:
    return ord(tag[0]) << 8 | ord(tag[1])


@dataclass
class Fields:
    """Fields of ``n`` records: row, tag, type letter and place of the value.

    A record has its fields in file order. ``reached`` is where the walk over
    each record ended: its end, or a field that is cut off or of no known type.
    """

    raw: np.ndarray
    n: int
    row: np.ndarray
    tag: np.ndarray
    kind: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    reached: np.ndarray

    def _last(self, tag: str) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have the tag and, for each, its last field."""
        at = np.flatnonzero(self.tag == _code(tag))
        slot = np.full(self.n, -1, dtype=np.int64)
        slot[self.row[at]] = at
        rows = np.flatnonzero(slot >= 0)
        return rows, slot[rows]

    def _numbers(self, at: np.ndarray, letters: str) -> tuple[np.ndarray, list]:
        """Places among ``at`` with a number of these types, and the numbers."""
        places, values = [], []
        for letter in letters:
            hit = np.flatnonzero(self.kind[at] == ord(letter))
            if len(hit):
                kind = np.dtype(NUMBERS[letter])
                cells = self.raw[self.begin[at[hit]][:, None] + np.arange(kind.itemsize)]
                places.append(hit)
                values += np.ascontiguousarray(cells).view(kind)[:, 0].tolist()
        return (np.concatenate(places) if places else np.empty(0, np.int64)), values

    def texts(self, tag: str) -> pa.Array:
        """Values as text, NULL without the tag and for arrays."""
        rows, at = self._last(tag)
        begin, end = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        plain = np.isin(self.kind[at], [*_TEXT, ord("A")])
        begin[rows[plain]] = self.begin[at[plain]]
        # The value of a text ends before its zero byte.
        end[rows[plain]] = self.end[at[plain]] - np.isin(self.kind[at[plain]], _TEXT)
        known = np.zeros(self.n, dtype=bool)
        known[rows[plain]] = True
        out = slices(self.raw, begin, end, known)
        places, values = self._numbers(at, "".join(NUMBERS))
        if not values:
            return out
        mixed = out.to_pylist()
        for row, value in zip(rows[places].tolist(), values, strict=True):
            mixed[row] = str(value)
        return pa.array(mixed, pa.string())

    def integers(self, tag: str, convert: bool = False) -> pa.Array:
        """Integer values; with ``convert`` also numbers given as text or float."""
        rows, at = self._last(tag)
        out, known = np.zeros(self.n, np.int64), np.zeros(self.n, dtype=bool)
        places, values = self._numbers(at, "cCsSiI")
        out[rows[places]] = values
        known[rows[places]] = True
        if convert and len(places) < len(at):
            shown = self.texts(tag)
            for row in rows[~known[rows]].tolist():
                try:
                    out[row], known[row] = int(float(shown[row].as_py())), True
                except (TypeError, ValueError, OverflowError):
                    continue
        return pa.array(out, pa.int64(), mask=~known)

    def present(self, tags: tuple[str, ...]) -> pa.Array:
        """Which of the tags each record has, in the order of its fields."""
        codes = np.array([_code(t) for t in tags])
        at = np.flatnonzero(np.isin(self.tag, codes))
        _, first = np.unique(self.row[at] << 16 | self.tag[at], return_index=True)
        at = at[np.sort(first)]
        at = at[np.argsort(self.row[at], kind="stable")]
        order = np.argsort(codes)
        which = order[np.searchsorted(codes[order], self.tag[at])]
        offsets = np.zeros(self.n + 1, np.int32)
        np.cumsum(np.bincount(self.row[at], minlength=self.n), out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(tags, pa.string()).take(pa.array(which)))


def slices(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    """Texts at ``[begin, end)`` of the bytes, NULL where not ``known``."""
    size = end - begin
    offsets = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    body = raw[np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])]
    if len(body) and body.max() >= 128:
        # What is not UTF-8 has to be replaced, text by text.
        there = [True] * len(begin) if known is None else known.tolist()
        cut = zip(begin.tolist(), end.tolist(), there, strict=True)
        return pa.array([raw[i:j].tobytes().decode("utf-8", "replace") if k else None for i, j, k in cut], pa.string())
    mask = None if known is None else pa.py_buffer(np.packbits(known, bitorder="little"))
    return pa.Array.from_buffers(pa.string(), len(begin), [mask, pa.py_buffer(offsets), pa.py_buffer(body)])


def walk(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Fields:
    """Fields of the records whose field bytes are ``[begin, end)``."""
    reached = begin.astype(np.int64)
    zeros = np.append(np.flatnonzero(raw == 0), _NEVER)
    found: list[tuple[np.ndarray, ...]] = []
    rows = np.flatnonzero(reached + 3 <= end)
    while len(rows):
        head, last = reached[rows], end[rows]
        kind, value = raw[head + 2], head + 3
        width = _WIDTH[kind]
        after = np.where(width > 0, value + width, _NEVER)
        text = _IS_TEXT[kind]
        after[text] = zeros[np.searchsorted(zeros, value[text])] + 1
        arrays = np.flatnonzero((kind == _ARRAY) & (value + 5 <= last))
        if len(arrays):
            at = value[arrays]
            count = np.ascontiguousarray(raw[at[:, None] + np.arange(1, 5)]).view("<i4")[:, 0].astype(np.int64)
            item = _ITEM[raw[at]]
            after[arrays] = np.where((item > 0) & (count >= 0), at + 5 + count * item, _NEVER)
        whole = after <= last
        rows, head, after = rows[whole], head[whole], after[whole]
        name = raw[head].astype(np.int64) << 8 | raw[head + 1]
        found.append((rows, name, kind[whole], value[whole], after))
        reached[rows] = after
        rows = rows[after + 3 <= end[rows]]
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 5
    return Fields(raw, len(begin), *columns, reached)
