"""Benchmark decontamination with a positional inverted index over training texts.

The index is dealt out by documents: each row is a shard of a few megabytes of
text with the postings (positions) of all its words, so a phrase is found
inside one row, no list of a frequent word is ever gathered, and a lost task
is repeated alone. Its size grows with the text; test phrases are looked up in
blocks of bounded size, so any number of them can be searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .common import by_ids, given_back, in_small_parts, letter_digit_words, text_bytes, text_chunks

WINDOW = 13
#: Words of test items that are sent to the tasks at once.
BLOCK_WORDS = 500_000
#: Words that the words of a proximity match may span.
PROXIMITY = 2 * WINDOW

_INDEX = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.binary()), ("terms", pa.binary()), ("list_ends", pa.binary()), ("postings", pa.binary())])
_INDEX_SQL = "shard bigint, doc_ids array<bigint>, n_words binary, terms binary, list_ends binary, postings binary"
_FOUND = pa.schema([("shard", pa.int64()), ("ordinal", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])
_FOUND_SQL = "shard bigint, ordinal int, doc_id bigint, n_words bigint, hits array<array<bigint>>, items array<string>, near array<string>"


def build_index(docs: DataFrame) -> DataFrame:
    """Positional postings of all words of ``docs`` (``doc_id, text``).

    One row per shard: ``doc_ids`` and ``n_words`` of its texts, sorted hashes of its ``terms``, where each term's
    list ends, and the lists of positions, counted over the shard. Null texts and texts without words have 0 words.
    """
    ship_package(docs.sparkSession)
    in_small_parts(docs.sparkSession)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = letter_digit_words(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in text_chunks(batch):
                hashes, owner = words(text_bytes(part.column("text")))
                order = np.argsort(hashes, kind="stable")
                ordered = hashes[order]
                last = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True)) if len(ordered) else np.zeros(0, np.int64)
                counts = np.bincount(owner, minlength=part.num_rows)
                yield pa.RecordBatch.from_pylist([{
                    "shard": number, "doc_ids": part.column("doc_id").to_pylist(), "n_words": counts.astype("<i8").tobytes(),
                    "terms": ordered[last].astype("<u8").tobytes(), "list_ends": (last + 1).astype("<u4").tobytes(), "postings": order.astype("<u4").tobytes(),
                }], schema=_INDEX)
                number += 1

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(lambda batches: given_back(index(batches)), _INDEX_SQL)


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Test items with their word hashes, in blocks of about ``limit`` words; one item at a time comes to the driver."""
    words, block, held = letter_digit_words(), [], 0
    for row in items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        hashes, _ = words([(row["text"] or "").encode()])
        if len(hashes):
            block.append((row["item_id"], hashes))
            held += len(hashes)
        if held >= limit:
            yield block
            block, held = [], 0
    if block:
        yield block


class _Windows:
    """All windows of a block of items: hashes of their terms and the item of each, by window length."""

    def __init__(self, block: list[tuple[str, np.ndarray]], window: int):
        self.items = [item for item, _ in block]
        by_length: dict[int, list] = {}
        for k, (_, hashes) in enumerate(block):
            size = min(window, len(hashes))
            views = np.lib.stride_tricks.sliding_window_view(hashes, size)
            by_length.setdefault(size, []).append((views, np.full(len(views), k)))
        self.groups = []
        for parts in by_length.values():
            terms, owners = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            pairs = np.unique(np.column_stack([terms, owners.astype(np.uint64)]), axis=0)
            self.groups.append((pairs[:, :-1], pairs[:, -1].astype(np.int64)))
        self.terms = np.unique(np.concatenate([g[0].ravel() for g in self.groups]))
        self.groups = [(np.searchsorted(self.terms, t), o) for t, o in self.groups]


def _lookup(windows: _Windows, terms: np.ndarray, list_ends: np.ndarray, postings: np.ndarray, doc_starts: np.ndarray, proximity: int):
    """Exact windows as (start, length, item), and (position, item) of proximity matches, in one shard.

    The lists of a window's terms are shifted by the term's offset and
    intersected, from the rarest term on; a window with a term that the shard
    does not have is never looked at.
    """
    at = np.searchsorted(terms, windows.terms)
    present = at < len(terms)
    present[present] = terms[at[present]] == windows.terms[present]
    at = np.where(present, at, 0)
    begins = np.where(at > 0, list_ends[at - 1], 0)
    ends = list_ends[at]
    sizes = np.where(present, ends - begins, 0)
    exact: list[tuple[np.ndarray, int, int]] = []
    near: list[tuple[np.ndarray, int]] = []
    for term_at, owner in windows.groups:
        length = term_at.shape[1]
        for w in np.flatnonzero((sizes[term_at] > 0).all(axis=1)):
            own = term_at[w]
            rising = np.argsort(sizes[own], kind="stable")
            lists = [postings[begins[own[k]] : ends[own[k]]] for k in rising]
            starts = lists[0] - rising[0]
            starts = starts[starts >= 0]
            for k, found in zip(rising[1:], lists[1:], strict=True):
                if not len(starts):
                    break
                place = np.searchsorted(found, starts + k)
                inside = place < len(found)
                inside[inside] = found[place[inside]] == starts[inside] + k
                starts = starts[inside]
            if len(starts):  # a window must not run over the end of its document
                doc = np.searchsorted(doc_starts, starts, "right")
                starts = starts[np.searchsorted(doc_starts, starts + length - 1, "right") == doc]
            if len(starts):
                exact.append((starts, length, int(owner[w])))
            if proximity and length > 1:
                anchors = lists[0]
                doc = np.searchsorted(doc_starts, anchors, "right")
                for found in lists[1:]:
                    if not len(anchors):
                        break
                    lowest = np.maximum(anchors - proximity // 2, doc_starts[doc - 1])
                    place = np.searchsorted(found, lowest)
                    inside = place < len(found)
                    reach = found[place[inside]]
                    inside[inside] = (reach <= anchors[inside] + proximity // 2) & (np.searchsorted(doc_starts, reach, "right") == doc[inside])
                    anchors, doc = anchors[inside], doc[inside]
                if len(anchors):
                    near.append((anchors, int(owner[w])))
    return exact, near


def search_index(index: DataFrame, items: DataFrame, window: int = WINDOW, proximity: int = PROXIMITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Finds the windows of ``items`` (``item_id, text``) in a stored index of :func:`build_index`.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window. Returns one row
    per indexed row: ``doc_id, n_words, hits`` (disjoint ``[start, end)`` ranges of words inside exact
    matches), ``n_hit``, ``items`` (sorted distinct ids with exact matches) and ``near_items`` (items
    of which some window has all its words within ``proximity`` words of one document). Items without words
    match nothing; items are compared by their text, so repeated items all count; without items nothing is hit.
    """
    spark = index.sparkSession
    parts = [index.mapInArrow(_searcher(_Windows(block, window), proximity), _FOUND_SQL) for block in _blocks(items, block_words)]
    if not parts:
        parts = [index.mapInArrow(_searcher(None, proximity), _FOUND_SQL)]
    ship_package(spark)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if len(parts) > 1:
        found = found.groupBy("shard", "ordinal", "doc_id", "n_words").agg(
            *(F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "items", "near"))
        )
    nothing = F.array().cast("array<array<bigint>>")
    joined = F.aggregate(
        F.array_sort("hits"), nothing,
        lambda done, span: F.when(
            (F.size(done) > 0) & (F.element_at(F.element_at(done, -1), 2) >= span[0]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(F.array(F.element_at(F.element_at(done, -1), 1), F.greatest(F.element_at(F.element_at(done, -1), 2), span[1]))),
            ),
        ).otherwise(F.concat(done, F.array(span))),
    )
    found = found.withColumn("hits", F.when(F.size("hits") > 0, joined).otherwise(nothing))
    return found.select(
        "doc_id",
        "n_words",
        "hits",
        F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, s: a + s[1] - s[0]).alias("n_hit"),
        F.array_sort(F.array_distinct("items")).alias("items"),
        F.array_sort(F.array_distinct("near")).alias("near_items"),
    )


def _searcher(windows: _Windows | None, proximity: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from given_back(_search(batches))

    def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                terms, ends, postings, counts = (
                    np.frombuffer(row.column(c)[0].as_buffer(), t).astype(np.int64 if t != "<u8" else np.uint64)
                    for c, t in (("terms", "<u8"), ("list_ends", "<u4"), ("postings", "<u4"), ("n_words", "<i8"))
                )
                doc_ids = row.column("doc_ids")[0].as_py()
                n = len(doc_ids)
                hits, items, near = ([[] for _ in range(n)] for _ in range(3))
                if windows is not None and len(terms):
                    doc_ends = np.cumsum(counts)
                    doc_starts = doc_ends - counts
                    exact, close = _lookup(windows, terms, ends, postings, doc_starts, proximity)
                    marks = np.zeros(int(doc_ends[-1]) + 1, np.int32)
                    for starts, length, item in exact:
                        np.add.at(marks, starts, 1)
                        np.add.at(marks, starts + length, -1)
                        for d in np.unique(np.searchsorted(doc_starts, starts, "right") - 1).tolist():
                            items[d].append(windows.items[item])
                    for anchors, item in close:
                        for d in np.unique(np.searchsorted(doc_starts, anchors, "right") - 1).tolist():
                            near[d].append(windows.items[item])
                    if exact:
                        covered = np.cumsum(marks)[:-1] > 0
                        opens = np.flatnonzero(np.diff(covered, prepend=False) & covered)
                        opens = np.union1d(opens, doc_starts[(counts > 0) & covered[np.minimum(doc_starts, len(covered) - 1)]])
                        docs = np.searchsorted(doc_starts, opens, "right") - 1
                        free = np.append(np.flatnonzero(~covered), len(covered))
                        closes = np.minimum(free[np.searchsorted(free, opens)], doc_ends[docs])
                        for d, a, b in zip(docs.tolist(), opens.tolist(), closes.tolist(), strict=True):
                            hits[d].append([a - int(doc_starts[d]), b - int(doc_starts[d])])
                yield pa.RecordBatch.from_arrays([
                    pa.array([row.column("shard")[0].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(doc_ids, pa.int64()),
                    pa.array(counts, pa.int64()), pa.array(hits, _FOUND.field("hits").type), pa.array([sorted(set(x)) for x in items], _FOUND.field("items").type),
                    pa.array([sorted(set(x)) for x in near], _FOUND.field("near").type),
                ], schema=_FOUND)

    return search


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, proximity: int = PROXIMITY) -> DataFrame:
    """Builds the index of ``docs``, stores it and searches ``items`` in it; see :func:`search_index`.

    ``contaminated`` is true if at least a twentieth of a document's words lie inside exact matches. Repeated
    rows give a row each; empty tables give no rows; other columns of ``docs`` and ``items`` are ignored.
    """
    found = search_index(materialize(build_index(docs), "positions"), items, window, proximity)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with all their columns. Rows with the same id go together; rows without an id stay."""
    bad = decontaminated(docs, items, proximity=0).filter("contaminated and doc_id is not null").select("doc_id").distinct()
    return by_ids(docs, materialize(bad, "contaminated"), "left_anti")
