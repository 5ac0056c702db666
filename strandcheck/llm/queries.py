"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, curves, decontaminate, jaccard, language, licences, merkle, middle, packing, pages, quality, records, secrets
from .common import held_out, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scanned(table(spark, folder, "documents"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    rows = packing.packed(table(spark, folder, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], given.schema)
    examples = chat.formatted_examples(given.unionByName(extra))
    read = examples.select(
        "conv_id", "turn_no", chat.read_turns(F.col("formatted")).alias("turns"), F.length("formatted").cast("bigint").alias("chars"),
        chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
    )
    whole = read.groupBy("conv_id").agg(
        F.max_by("turns", "turn_no").alias("turns"), F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn_no", "loss"))), lambda x: x.loss), "").alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return whole.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identified(table(spark, folder, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    scores = quality.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scores.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.decontaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op7_token_records(spark: SparkSession, folder: str) -> DataFrame:
    files = records.write_records(table(spark, folder, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=0)
    return records.read_records(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents"))


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.found_secrets(table(spark, folder, "documents"))

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint")

    return found.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])),
        F.sha2(secrets.span_text(secrets.base_spans(F.col("spans"))), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"),
    )


def op10_curve_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return curves.nearest_neighbours(table(spark, folder, "embeddings"))


def op11_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extracted(table(spark, folder, "pages"))


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = middle.filled_in_middle(table(spark, folder, "documents"))
    text = middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verified(table(spark, folder, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS_6 = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

OP6_SQL = f"""
with d as (select doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '{_WORDS_6}'), []) as w from documents),
b as (select item_id, regexp_extract_all({_LOWER.format("text")}, '{_WORDS_6}') as w from benchmark),
bw as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
m as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.g = bw.g and dw.n = bw.n),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) group by 1),
t as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as s
  from (select distinct doc_id, cast(item_id as varchar) as s from m) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(w) as contaminated
from d left join h on d.doc_id = h.doc_id left join t on d.doc_id = t.doc_id
"""

OP8_SQL = f"""
with recursive d as (select doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
g as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from g x join g y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
e as (select a, b from l union select b, a from l),
r as (select doc_id as id, doc_id as reached from n union select r.id, e.b from r join e on e.a = r.reached),
k as (select id, min(reached) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id
from d left join n on n.doc_id = d.doc_id left join k on k.id = d.doc_id
"""

OP1_SQL = licences.oracle()

_ESCAPED = "regexp_replace({}, '" + chat.CONTROL + "', '\\1\\\\\\2\\3', 'g')"
OP3_SQL = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o as (select conv_id, role, text, row_number() over w as k, count(*) over (partition by conv_id) as n,
  sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + {len(chat.OPEN + chat.BODY + chat.CLOSE)}) over w as upto
  from c window w as (partition by conv_id order by turn, role, text rows unbounded preceding))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  length(coalesce(string_agg(case when role = 'assistant' then text end, '' order by k), '')) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by k), '')) as loss_sha256,
  cast(sum(case when role = 'assistant' or k = n then upto end) as bigint) as formatted_chars
from o group by conv_id
"""


def _sql_spans(pattern: str, kind: str, check: str, text: str = "t") -> str:
    """DuckDB text for the spans of a pattern: starts are summed lengths of what lies between and in earlier matches."""
    quoted = pattern.replace("'", "''")
    return f"""select doc_id, row_no, a as start, a + length(f) as stop, '{kind}' as kind, f from (
      select doc_id, row_no, unnest(m) as f, unnest(list_transform(range(1, len(m) + 1),
        lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) as a
      from (select doc_id, row_no, regexp_extract_all({text}, '{quoted}') as m, string_split_regex({text}, '{quoted}') as g from d)) where {check}"""


def _sql_entropy() -> str:
    parts = "[" + ",".join(str(secrets.scaled(n)) for n in range(secrets.ENTROPY_WINDOW + 1)) + "]"
    width = secrets.ENTROPY_WINDOW
    cases = " ".join(f"when regexp_matches(f, '{p}') then '{k}:{secrets.sum_limit(b)}'" for k, p, _, b in secrets.CLASSES)
    return f"""select doc_id, row_no, start + list_min(o) - 1 as start, start + list_max(o) - 1 + {width} as stop, split_part(class, ':', 1) as kind, f from (
      select doc_id, row_no, start, class, f, list_filter(range(1, length(f) - {width} + 2), lambda i: list_sum(list_transform(
        list_transform(list_distinct(string_split(substr(f, i, {width}), '')), lambda c: len(list_filter(string_split(substr(f, i, {width}), ''), lambda e: e = c))), lambda n: ({parts})[n + 1])) <= cast(split_part(class, ':', 2) as int)) as o
      from (select *, case {cases} end as class from r where not regexp_matches(f, '{secrets.ALLOWED}'))) where len(o) > 0"""


def _sql_blanked(text: str) -> str:
    for word in secrets.PLACEHOLDERS:
        text = f"regexp_replace({text}, '(?i){word}', '{' ' * len(word)}', 'g')"
    return text


OP9_SQL = f"""
with d as (select doc_id, row_number() over () as row_no, coalesce(text, '') as t from documents),
r as ({_sql_spans(secrets.CANDIDATE, "run", "true", _sql_blanked("t"))}),
s as ({_sql_spans(secrets.ASSIGN, "assign", f"length(regexp_extract(f, '{secrets.ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 8")}
  union all {_sql_spans(secrets.ACCESS, "access", "true")}
  union all {_sql_spans(secrets.HEX, "hex", "true")}
  union all {_sql_entropy()}),
k as (select doc_id, row_no, kind, kind || ':' || start || ':' || stop as s, start, list_position({list(secrets.KINDS)}, kind) as no from s)
select d.doc_id, count(*) filter (where no = 1) as n_assign, count(*) filter (where no = 2) as n_access, count(*) filter (where no = 3) as n_hex,
  sha256(coalesce(string_agg(s, ',' order by start, no) filter (where no <= 3), '')) as base_sha256,
  coalesce(string_agg(s, ',' order by start, no), '') as spans
from d left join k on k.row_no = d.row_no group by d.doc_id, d.row_no
"""

# Knows pages with one article element that holds headline, paragraphs, line breaks and bold text, as the given ones have; the operator knows more.
_TEXT_11 = "regexp_replace(regexp_replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g')"
_DECODED_11 = f"regexp_replace(regexp_replace({_TEXT_11}, '&quot;?', chr(34), 'g'), '&amp;?', '&', 'g')"
OP11_SQL = f"""
with t as (select page_id, url, coalesce(trim(regexp_replace({_DECODED_11}, '[ \\t\\r\\n\\f]+', ' ', 'g')), '') as text from pages)
select page_id, url, text, length(text) as n_chars from t
"""

OP12_SQL = """
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select *, coalesce(regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+'), []) as w,
  [cast('0x' || substr(h, 8 * k + 1, 8) as bigint) for k in range(4)] as r from d),
c as (select *, len(w) as n, least(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) as low, greatest(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) as high from u),
p as (select *, coalesce(array_to_string(w[1:low], ''), '') as a, coalesce(array_to_string(w[low + 1:high], ''), '') as b, coalesce(array_to_string(w[high + 1:n], ''), '') as z,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 100 then 'plain' when r[4] % 100 < 50 then 'spm' else 'psm' end as form from c)
select doc_id, n, form, case when form <> 'plain' then length(a) end as prefix_chars, case when form <> 'plain' then length(b) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || a || '<S>' || z || '<M>' || b else '<S>' || z || '<P>' || a || '<M>' || b end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""


def _sql_tree(name: str, leaves: str, height: int) -> str:
    """Levels ``name_0`` to ``name_height`` of trees over ``leaves(g, i, h)``; a tree of one node stays as it is. Siblings stand beside each node."""
    out = [f"{name}_0 as (select *, count(*) over (partition by g) as n from ({leaves}))"]
    for k in range(height):
        out.append(f"""{name}_{k + 1} as (select g, i // 16 as i, case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '' order by i)) end as h,
          (any_value(n) + 15) // 16 as n from {name}_{k} group by g, i // 16)""")
        out.append(f"""{name}_w{k} as (select g, i, n > 1 as up,
          coalesce(string_agg(h, '') over (partition by g, i // 16 order by i rows between unbounded preceding and 1 preceding), '') as l,
          coalesce(string_agg(h, '') over (partition by g, i // 16 order by i rows between 1 following and unbounded following), '') as r from {name}_{k})""")
    return ",\n".join(out)


def _sql_manifest(height: int = 6) -> str:
    def framed(column: str) -> str:
        text = f"cast({column} as varchar)"
        return f"case when {column} is null then '-' else strlen({text}) || ':' || {text} end"

    heads = [framed(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = _LOWER.format("text")
    whole, changed = (f"sha256({' || '.join([*heads, framed(t)])})" for t in ("text", lower))
    joins, proof, folds = [], [], ["case when d.tampered then d.changed else d.h end as f_0"]
    steps = [("leaf", k, "d.g", f"d.i // {16**k}") for k in range(height)] + [("top", k, "0", f"d.source_no // {16**k}") for k in range(height)]
    for no, (name, k, group, at) in enumerate(steps):
        alias = f"{name}{k}"
        joins.append(f"join {name}_w{k} {alias} on {alias}.g = {group} and {alias}.i = {at}")
        proof.append(f"case when {alias}.up then {alias}.l || {alias}.r else '' end")
        folds.append(f"case when {alias}.up then sha256({alias}.l || f_{no} || {alias}.r) else f_{no} end as f_{no + 1}")
    return f"""
with crc as (select list(v order by b) as t from (select b, list_reduce(list_prepend(b, range(8)),
    lambda c, j: xor(c >> 1, 3988292384 * (c & 1))) as v from (select unnest(range(256)) as b))),
d as (select doc_id, source, {whole} as h, {changed} as changed,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ascii(x)::bigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 as tampered from documents, crc),
o as (select *, dense_rank() over (order by source nulls first) - 1 as g, row_number() over (partition by source order by doc_id nulls first, h) - 1 as i from d),
{_sql_tree("leaf", "select g, i, h from o", height)},
{_sql_tree("top", f"select 0 as g, g as i, h from leaf_{height}", height)},
e as (select d.doc_id, d.h as leaf, s.h as subroot, t.h as root, sha256({' || '.join(proof)}) as proof_sha256, {', '.join(folds)}
  from (select *, g as source_no from o) d join leaf_{height} s on s.g = d.g cross join top_{height} t {' '.join(joins)})
select doc_id, leaf, subroot, root, proof_sha256, f_{len(steps)} as folded_root, f_{len(steps)} = root as verified from e
"""


OP13_SQL = _sql_manifest()

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {
    "op1_license_scan": op1_license_scan,
    "op2_packing": op2_packing,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_language_id": op4_language_id,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_token_records": op7_token_records,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_secret_scan": op9_secret_scan,
    "op10_curve_neighbours": op10_curve_neighbours,
    "op11_html_extraction": op11_html_extraction,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": OP1_SQL,
    "op3_chat_formatting": OP3_SQL,
    "op6_benchmark_decontamination": OP6_SQL,
    "op8_jaccard_join": OP8_SQL,
    "op9_secret_scan": OP9_SQL,
    "op11_html_extraction": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
