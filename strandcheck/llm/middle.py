"""Fill in the middle: a text is cut into lines, and prefix, middle and suffix change places between sentinels.

All texts of a batch are taken through pyarrow kernels together: split into lists of lines, flattened with the index of their text,
numbered, filtered by role, put together as lists again and joined. Where a text is cut and which form it takes follows from a hash of
its id alone, so the same document is cut alike in every run. Nothing is shuffled; a text is worked on as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import in_small_parts, text_chunks

#: Marks set before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are cut, and of these, percent with the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT, SEED = 100, 50, 7


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2**32 from the hash of ``seed:doc_id``; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def _modulo(a: pa.Array, b: pa.Array | int) -> pa.Array:
    return pc.subtract(a, pc.multiply(b, pc.divide(a, b)))


def _offsets(counts: pa.Array) -> pa.Array:
    zero = pa.array([0], pa.int64())
    return pa.concat_arrays([zero, pc.cumulative_sum(counts)]).cast(pa.int32())


def _lines(texts: pa.StringArray) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """All lines with their ends, the index of the text of each, its place there from 0, and how many lines each text has."""
    lists = pc.split_pattern(texts, "\n")
    pieces, parents, sizes = pc.list_flatten(lists), pc.list_parent_indices(lists), pc.list_value_length(lists).cast(pa.int64())
    starts = pc.subtract(pc.cumulative_sum(sizes), sizes)
    places = pc.subtract(pa.array(range(len(pieces)), pa.int64()), pc.take(starts, parents))
    last = pc.equal(places, pc.subtract(pc.take(sizes, parents), 1))
    kept = pc.invert(pc.and_(last, pc.equal(pc.binary_length(pieces), 0)))  # what follows the last line end is no line if empty
    lines = pc.binary_join_element_wise(pieces, pc.if_else(last, "", "\n"), "")
    ends_empty = pc.ends_with(texts, "\n")
    counts = pc.if_else(pc.equal(pc.binary_length(texts), 0), 0, pc.subtract(sizes, ends_empty.cast(pa.int64())))
    return pc.filter(lines, kept), pc.filter(parents, kept), pc.filter(places, kept), counts


def _arranged(part: pa.RecordBatch, cut_percent: int, suffix_first_percent: int) -> list[pa.Array]:
    texts = pc.fill_null(part.column("text").cast(pa.string()), "")
    h1, h2, h3, h4 = (part.column(f"h{k}") for k in range(1, 5))
    lines, parents, places, n = _lines(texts)
    cuts = [_modulo(h, pc.add(n, 1)) for h in (h1, h2)]
    low, high = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    before, behind = pc.less(places, pc.take(low, parents)), pc.greater_equal(places, pc.take(high, parents))
    roles = ((before, low), (pc.invert(pc.or_(before, behind)), pc.subtract(high, low)), (behind, pc.subtract(n, high)))
    prefix, middle, suffix = (pc.binary_join(pa.ListArray.from_arrays(_offsets(size), pc.filter(lines, mask)), "") for mask, size in roles)
    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(_modulo(h3, 100), cut_percent))
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(texts, sentinel))
    suffix_first = pc.less(_modulo(h4, 100), suffix_first_percent)
    head = pc.if_else(suffix_first, pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, ""), pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, ""))
    output = pc.if_else(plain, texts, pc.binary_join_element_wise(head, MIDDLE, middle, ""))
    form = pc.if_else(plain, "plain", pc.if_else(suffix_first, "spm", "psm"))
    none = pa.scalar(None, pa.int64())
    lengths = [pc.if_else(plain, none, pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return [part.column("doc_id"), n, form, *lengths, output]


def filled_in_middle(docs: DataFrame, seed: int = SEED, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for each row of ``docs`` (``doc_id, text``).

    ``n`` counts the lines. ``form`` is ``psm`` or ``spm`` by the order of prefix, suffix and middle, or ``plain``: the text as it is, where it is null or
    empty, holds a sentinel, or is not drawn; then the lengths (code points) are null. Rows without an id share one draw, as do repeated rows, which come
    out repeatedly. Other columns are ignored; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    in_small_parts(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", "text", *(h.alias(f"h{k + 1}") for k, h in enumerate(draws(F.col("doc_id"), seed))))

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
                yield pa.RecordBatch.from_arrays(_arranged(part, cut_percent, suffix_first_percent), names=names)

    return given.mapInArrow(arrange, f"doc_id {key}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`filled_in_middle` made ``output`` of; a text with sentinels of its own stays plain, so they tell the parts apart."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    order = [F.when(form == "psm", k).otherwise(s) for k, s in ((1, 2), (3, 3), (2, 1))]
    return F.when(form == "plain", output).otherwise(F.concat(*(F.get(parts, k) for k in order)))
