"""Secrets in texts: fixed patterns, and strings whose sliding-window entropy is that of random characters."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns (Java and RE2 syntax).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

# Character classes of candidates, each with its alphabet and the least entropy of a window in bits.
CLASSES = (
    ("hexrun", r"^[0-9A-Fa-f]+$", "0123456789abcdefABCDEF", 2.9),
    ("b64run", r"^[A-Za-z0-9+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.7),
)
ENTROPY_WINDOW = 20
# The allow-list. Candidates that are UUIDs, numbers and dates, or without any digit are no secrets; placeholders and runs of
# the alphabet are none either, but what stands before and after them is looked at like any other text.
ALLOWED = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$|^[0-9+/_=-]+$|^[^0-9]+$"
PLACEHOLDERS = ("example", "placeholder", "changeme", "xxxx", "0123456789", "abcdefghij")
KINDS = ("assign", "access", "hex", *(c[0] for c in CLASSES))


def scaled(n: int) -> int:
    """A count's part n * log2(n) of the entropy sum, in thousandths, so that sums are exact."""
    return round(1000 * n * math.log2(n)) if n else 0


def sum_limit(bits: float, window: int = ENTROPY_WINDOW) -> int:
    """A window has at least ``bits`` of entropy if the scaled parts of its counts add up to at most this."""
    return math.floor(1000 * window * (math.log2(window) - bits))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of ``values`` (integers, none below 0) what those before it come to, 0 for the first.

    Appending to an array copies it, so values are taken in blocks of the cube root of their number, 64 at least: first inside
    each block, then over the blocks.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("done"))

    def steps(items: Column, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(items, start, lambda s, x: F.struct(combine(s["at"], of(x)).alias("at"), F.concat(s["done"], F.array(s["at"])).alias("done")))

    def blocks(v: Column) -> Column:
        size = F.greatest(F.lit(64), F.ceil(F.cbrt(F.size(v))).cast("int"))
        return _let(size, lambda b: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / b).cast("int")), lambda k: F.slice(v, k * b + 1, b)))

    def joined(parts: Column) -> Column:
        before = steps(parts, lambda p: p["at"])["done"]
        return _let(before, lambda b: F.flatten(F.transform(parts, lambda p, k: F.transform(p["done"], lambda x: combine(F.get(b, k), x)))))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(F.transform(blocks(v), lambda block: steps(block, lambda x: x)), joined)).otherwise(F.array().cast("array<int>")))


def _found(text: Column, pattern: str) -> Column:
    """Matches as ``(start, found)``: starts are the lengths of all that stands between and in earlier matches."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("found")), lambda x: x["found"].isNotNull())
    pairs = F.transform(pairs, lambda x: F.struct(F.length(x["gap"]).alias("gap"), x["found"].alias("found")))

    def placed(p: Column) -> Column:
        before = _running(F.transform(p, lambda x: x["gap"] + F.length(x["found"])), lambda a, b: a + b)
        return F.zip_with(p, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), x["found"].alias("found")))

    return F.when(text.rlike(pattern), _let(pairs, placed)).otherwise(F.array().cast("array<struct<start:int,found:string>>"))


def _as_spans(found: Column, kind: str) -> Column:
    no = KINDS.index(kind)
    return F.transform(found, lambda x: F.struct(x.start.alias("start"), F.lit(no).alias("kind"), (x.start + F.length(x.found)).alias("end")))


def entropy_range(text: str, alphabet: str, bits: float, window: int = ENTROPY_WINDOW) -> str:
    """SQL for the range ``(first, last)`` of a candidate that windows of enough entropy cover, null without any.

    The window slides by one character; the counts of the two characters that change and
    the entropy sum are adjusted, nothing is counted anew.
    """
    parts = "array(" + ",".join(str(scaled(n)) for n in range(window + 1)) + ")"
    come, go = "element_at(c, least(i, size(c)))", f"element_at(c, greatest(i - {window}, 1))"
    more = f"element_at({parts}, element_at(s.n, {come}) + 2) - element_at({parts}, element_at(s.n, {come}) + 1)"
    less = f"if(i > {window}, element_at({parts}, element_at(s.n, {go})) - element_at({parts}, element_at(s.n, {go}) + 1), 0)"
    keep = f"i > size(c) or (i > {window} and {come} = {go})"
    hit = f"i > {window} and s.sum <= {sum_limit(bits, window)}"  # of the window that ends before character i
    step = f"""named_struct(
        'n', if({keep}, s.n, transform(s.n, (v, j) -> v + if(j + 1 = {come}, 1, 0) - if(i > {window} and j + 1 = {go}, 1, 0))),
        'sum', if({keep}, s.sum, s.sum + {more} + {less}),
        'first', if({hit}, coalesce(s.first, i - 1 - {window}), s.first),
        'last', if({hit}, i - 1, s.last))"""
    start = f"named_struct('n', array_repeat(0, {len(alphabet)}), 'sum', 0, 'first', cast(null as int), 'last', cast(null as int))"
    codes = f"transform(slice(split({text}, '', -1), 1, length({text})), x -> instr('{alphabet}', x))"
    return f"element_at(transform(array({codes}), c -> aggregate(sequence(1, size(c) + 1), {start}, (s, i) -> {step}, s -> struct(s.first, s.last))), 1)"


def _blanked(text: Column) -> Column:
    """``text`` with spaces in place of placeholders, so that no candidate reaches over one."""
    for word in PLACEHOLDERS:
        text = F.regexp_replace(text, f"(?i){word}", " " * len(word))
    return text


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``docs`` has not got."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def found_secrets(docs: DataFrame, spans: str = "spans") -> DataFrame:
    """Spans of secrets in each text of ``docs``: all columns, and ``spans`` (in place of a column of that name) as ``(start, kind, end)`` by start, then kind.

    ``kind`` counts in ``KINDS``; positions are code points, the end is exclusive. Base kinds are the leftmost
    non-overlapping matches of the fixed patterns. A candidate string that the allow-list does not suppress adds the range
    that windows of high entropy for its character class cover. Null and empty texts have no spans; each row is on its own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    assign = F.filter(_found(text, ASSIGN), lambda x: F.length(F.regexp_extract(x.found, ASSIGN, 2)) >= 8)
    candidates = F.filter(_found(_blanked(text), CANDIDATE), lambda x: ~x.found.rlike(ALLOWED))
    base, runs, ranges = (_free(docs, f"__{n}") for n in ("base", "candidates", "ranges"))
    found = docs.withColumn(base, F.concat(_as_spans(assign, "assign"), _as_spans(_found(text, ACCESS), "access"), _as_spans(_found(text, HEX), "hex")))
    found = found.withColumn(runs, candidates)
    case = " ".join(f"when x.found rlike '{p}' then named_struct('kind', {KINDS.index(k)}, 'range', {entropy_range('x.found', a, b)})" for k, p, a, b in CLASSES)
    judged = F.expr(f"filter(transform(`{runs}`, x -> named_struct('start', x.start, 'hit', case {case} end)), x -> x.hit.range.first is not null)")
    found = found.withColumn(ranges, F.when(F.size(runs) > 0, judged))
    added = F.transform(F.col(ranges), lambda x: F.struct((x.start + x.hit.range.first).alias("start"), x.hit.kind.alias("kind"), (x.start + x.hit.range.last).alias("end")))
    every = F.array_sort(F.concat(base, F.coalesce(added, F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return found.withColumn(spans, every).drop(base, runs, ranges)


def span_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s.kind < 3)


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each stretch of text that spans cover replaced by ``mark``; null and empty texts stay, other columns too, whatever their names."""
    name = _free(docs, "__spans")
    found = found_secrets(docs, name)

    def kept(points: Column) -> Column:
        """Pieces between spans, cut out of 4 bytes a character: there, unlike in UTF-8, a place is found without walking to it."""
        piece = lambda a, b: F.decode(F.substring(points, a * 4 + 1, (b - a) * 4), "UTF-32")
        ends = F.transform(name, lambda x: x["end"])
        pieces = F.zip_with(name, _running(ends, F.greatest), lambda x, at: F.when(x["start"] >= at, piece(at, x["start"])))
        last = piece(F.array_max(ends), F.length("text"))
        return F.concat(F.array_join(F.filter(pieces, lambda p: p.isNotNull()), mark), F.lit(mark), last)

    whole = _let(F.encode(F.col("text").cast("string"), "UTF-32"), kept)
    return found.withColumn("text", F.when(F.size(name) > 0, whole).otherwise(F.col("text"))).drop(name)
