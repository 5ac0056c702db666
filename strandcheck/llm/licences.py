"""Licences found by the digest of a canonical form of whole texts and of their lines."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: Whole standard texts, one ``{"license", "text"}`` a line. Only the driver reads it.
TEXTS = Path(__file__).with_name("licences.jsonl")

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)

# Known licences and notices, as (identifier, text). Copyright lines are left out: they are dropped before comparing.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "MIT",
        "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.\n" + _WARRANTY,
    ),
    (
        "ISC",
        "ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY,
    ),
    (
        "0BSD",
        "BSD Zero Clause License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted.\n" + _ISC_WARRANTY,
    ),
)

# A line that only states ownership, and spellings that mean the same. Java and RE2 syntax, applied in this order to
# lower-case text.
OWNERSHIP = r"(?m)^[^a-z0-9\n]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$"
SAME = (
    (r"licence", "license"),
    (r"sub-licens", "sublicens"),
    (r"non-commercial", "noncommercial"),
    (r"non-infring", "noninfring"),
    (r"https://", "http://"),
    (r"&", " and "),
    (r"\bv(?:ersion|er)?[ .]*([0-9])", "version $1"),
)
PUNCTUATION = r"[^a-z0-9\n]+"
# The same for lines that keep their statement of ownership behind a mark, a capital letter that the lower-case text doesn't have; statements
# that give a year or stand alone, which are no running text wherever lines are broken; and what may follow a notice.
MARK = "O "
OWNED = OWNERSHIP.removesuffix(r"[^\n]*$")
PUNCTUATION_BUT_MARKS = r"[^a-z0-9O\n]+"
SURE = r"^O (?:copyright |c |by )*(?:[0-9]{4}\b|yyyy\b|year\b)|^O all rights reserved$"
RESERVED = r" all rights reserved$"
#: Texts are also known up to the line with these words and up to the one before it.
TERMS_END = "END OF TERMS AND CONDITIONS"
LOWER_FROM, LOWER_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def marked_lines(text: Column) -> Column:
    """Lines of a text in canonical form, the empty ones left out, with ``MARK`` before a statement of ownership."""
    out = F.regexp_replace(F.translate(text, LOWER_FROM, LOWER_TO), OWNED, MARK + "$0")
    for pattern, same in SAME:
        literal = not any(c in pattern for c in "\\[(")
        out = F.replace(out, F.lit(pattern), F.lit(same)) if literal else F.regexp_replace(out, pattern, same)
    lines = F.transform(F.split(F.regexp_replace(out, PUNCTUATION_BUT_MARKS, " "), "\n", -1), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x != "")


def _plain(line: Column) -> Column:
    return F.replace(line, F.lit(MARK), F.lit(""))


def _before(line: Column) -> Column:
    """What stands in a line before a statement of ownership."""
    return F.when(line.contains(MARK), F.trim(F.substring_index(line, MARK, 1))).otherwise(line)


def _joined(lines: Column) -> Column:
    return F.array_join(lines, " ")


def _unowned(lines: Column) -> Column:
    """A whole text without the lines that are surely of ownership, wherever the others are broken."""
    return _joined(F.transform(F.filter(lines, lambda x: ~x.rlike(SURE)), _plain))


def whole_texts(lines: Column) -> Column:
    """The forms of a whole text: without any line that begins like one of ownership, and without those that surely are."""
    strict = _joined(F.filter(F.transform(lines, _before), lambda x: x != ""))
    return F.when(F.exists(lines, lambda x: x.contains(MARK)), F.array_distinct(F.array(strict, _unowned(lines)))).otherwise(F.array(strict))


def _ends(text: Column, sizes: list[int], least: Column) -> Column:
    """The last ``n`` words of a text for each of the sizes, more than ``least`` and fewer than all."""
    words = F.split(text, " ", -1)
    fitting = F.filter(F.array(*(F.lit(n) for n in sizes)), lambda n: (n > least) & (n < F.size(words)))
    return F.transform(fitting, lambda n: _joined(F.slice(words, F.size(words) - n + 1, n)))


def known_licences(spark: SparkSession) -> DataFrame:
    """``(license, text)`` of ``KNOWN`` and of the texts in ``TEXTS``, with and without their title or what follows their terms."""
    rows = list(KNOWN) + [(k, t.split("\n", 1)[1]) for k, t in KNOWN if "\n" in t]
    for line in TEXTS.read_text(encoding="utf-8").splitlines():
        row = json.loads(line)
        name, text = row["license"], row["text"]
        rows.append((name, text))
        if name.startswith("BSD"):
            title, rest = text.split("\n", 1)
            rows += [(name, rest)]
        if TERMS_END in text:
            terms = text[: text.index(TERMS_END)]
            rows += [(name, terms), (name, terms + TERMS_END)]
    return spark.createDataFrame(rows, "license string, text string")


def known_digests(known: DataFrame) -> DataFrame:
    """``digest, n_words, licenses`` of known texts ``(license, text)``, those without words left out."""
    lines = known.select("license", marked_lines(F.col("text")).alias("lines"))
    forms = lines.select("license", F.explode(whole_texts(F.col("lines"))).alias("part")).filter("part <> '' and license is not null")
    sized = forms.select(F.sha2("part", 256).alias("digest"), F.size(F.split("part", " ", -1)).alias("n_words"), "license")
    return sized.groupBy("digest", "n_words").agg(F.array_sort(F.collect_set("license")).alias("licenses"))


def scanned(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Licences of ``docs`` (``doc_id, text``): ``doc_id, text_license, n_notices, licenses``.

    The canonical form lowers case, drops statements of ownership, unifies spellings and turns punctuation and
    runs of spaces into one. The digest of the whole text gives ``text_license``; lines with a known digest are
    counted in ``n_notices``, a text of one line once; ``licenses`` has the identifiers of all, sorted and comma-joined.
    A line that begins with a statement of ownership is known by its last words, the longest known ones; the same holds for a
    whole text if they begin in its first line. Lines of a whole text that begin like such a statement are left out, and in a second form only
    those that give a year or just reserve all rights, so that the text may be broken into lines anywhere. ``known`` (``license, text``)
    are the texts to look for, by default ``known_licences``; their digests are sent to all tasks. Null and empty texts have none; rows with
    the same id (or none) count as one document and each gets the sums of all; an empty table gives no rows.
    """
    digests = materialize(known_digests(known_licences(docs.sparkSession) if known is None else known), "licences")
    sizes = sorted(r["n_words"] for r in digests.select("n_words").distinct().collect())
    # the row number also keeps Spark from working out the lines once more to filter by them
    lines = docs.select(
        F.col("doc_id").cast("bigint"), F.monotonically_increasing_id().alias("row"),
        F.coalesce(marked_lines(F.col("text").cast("string")), F.array().cast("array<string>")).alias("lines"),
    )
    none = F.array().cast("array<string>")
    first = F.get("lines", F.lit(0))
    begun = _joined(F.array(_plain(first), _unowned(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))))))
    begun = F.trim(begun)
    owned = first.startswith(MARK) if sizes else F.lit(False)
    whole = F.concat(
        whole_texts(F.col("lines")),
        F.when(owned, _ends(begun, sizes, F.size(F.split(begun, " ", -1)) - F.size(F.split(_plain(first), " ", -1)))).otherwise(none),
    )

    def parts(line: Column) -> Column:
        tail = F.regexp_replace(_plain(F.substr(line, F.instr(line, MARK) + F.lit(len(MARK)))), RESERVED, "")
        return F.when(line.contains(MARK), F.concat(F.array(_before(line)), _ends(tail, sizes, F.lit(0)))).otherwise(F.array(line))

    unit = lambda no, part: F.struct(no.cast("int").alias("line"), part.alias("part"))
    units = F.concat(
        F.transform(whole, lambda x: unit(F.lit(0), x)),
        F.flatten(F.transform("lines", lambda line, no: F.transform(parts(line), lambda x: unit(no + 1, x)))),
    )
    looked_up = lines.select("doc_id", "row", F.explode(units).alias("u")).select("doc_id", "row", "u.line", F.sha2("u.part", 256).alias("digest"))
    longest = looked_up.join(F.broadcast(digests), "digest").groupBy("doc_id", "row", "line").agg(F.max_by("licenses", "n_words").alias("found"))
    hits = longest.groupBy("doc_id").agg(
        F.min(F.when(F.col("line") == 0, F.get("found", F.lit(0)))).alias("text_license"),
        F.count(F.when(F.col("line") > 0, 1)).alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("found")))), ",").alias("licenses"),
    )
    ids = docs.select(F.col("doc_id").cast("bigint"))
    return ids.join(hits.withColumnRenamed("doc_id", "hit_id"), ids.doc_id.eqNullSafe(F.col("hit_id")), "left").select(
        "doc_id", "text_license", F.coalesce("n_notices", F.lit(0)).cast("bigint").alias("n_notices"), F.coalesce("licenses", F.lit("")).alias("licenses")
    )


def oracle() -> str:
    """What ``KNOWN`` gives in DuckDB's SQL, with whole lines of ownership dropped."""
    form = f"regexp_replace(translate(text, '{LOWER_FROM}', '{LOWER_TO}'), '{OWNERSHIP}', '', 'g')"
    for pattern, same in SAME:
        form = f"regexp_replace({form}, '{pattern}', '{same.replace('$', chr(92))}', 'g')"
    form = f"list_filter(list_transform(string_split(regexp_replace({form}, '{PUNCTUATION}', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    rows = ", ".join("('{}', '{}')".format(*(v.replace("'", "''") for v in k)) for k in KNOWN)
    return f"""
with k as (select distinct sha256(array_to_string({form}, ' ')) as digest, license from (values {rows}) as t(license, text)),
l as (select doc_id, {form} as lines from documents),
u as (select doc_id, true as whole, sha256(array_to_string(lines, ' ')) as digest from l where len(lines) > 0
  union all select doc_id, false, sha256(x) from (select doc_id, unnest(lines) as x from l)),
h as (select doc_id, min(case when whole then license end) as text_license, count(*) filter (where not whole) as n_notices,
  string_agg(distinct license, ',' order by license) as licenses from u join k using (digest) group by doc_id)
select d.doc_id, text_license, coalesce(n_notices, 0) as n_notices, coalesce(licenses, '') as licenses
from documents d left join h on d.doc_id is not distinct from h.doc_id
"""
