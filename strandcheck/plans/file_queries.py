"""Queries over file names, headers and display values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import names as N
from ..operators import datasets, headers
from ..session import materialize
from . import views as V
from .registry import query

_FQ = r"(?i)\.(?:fastq|fq)(?:\.gz)?$"
_ROLE = r"(?i)(?:^|[_-])([RI])([12])(?:[_-]\d+)?$"


def _clean(text: str) -> str:
    return (
        f"lower(regexp_replace(regexp_replace(regexp_replace(replace({text}, '\\', '/'), '\\s+', '_', 'g'), '(?i)_S\\d+$', ''), '_+$', ''))"
    )


_STEM = f"regexp_replace(name, '{_FQ}', '')"
_SELECTED = f"(select name, size, modified, min(position) as position from ({V.FILES_SQL}) f where regexp_matches(name, '{K.SUPPORTED_PATTERN}') group by all)"
_TYPED = f"""(select *, case when regexp_matches(name, '(?i)\\.bam$') then 'BAM' when regexp_matches(name, '(?i)\\.bai$') then 'BAI' when regexp_matches(name, '{_FQ}') then 'FASTQ' when regexp_matches(name, '(?i)\\.fai$') then 'FAI' else 'FILE' end as type,
 {_STEM} st from {_SELECTED} s)"""
_LABELLED = f"""(select name, size, position, type, case when type = 'FASTQ' then st end stem,
 case when type = 'FASTQ' then case when regexp_matches(st, '{_ROLE}') then lower(concat(regexp_extract(st, '{_ROLE}', 1), regexp_extract(st, '{_ROLE}', 2))) else 'unknown' end end "role",
 case when type = 'FASTQ' and regexp_matches(st, '{_ROLE}') then nullif(regexp_extract(st, '(?i)[_-]L(\\d{{3}})[_-]', 1), '') end lane,
 case when type = 'FASTQ' then case when regexp_matches(st, '{_ROLE}') then {_clean(f"regexp_replace(regexp_replace(st, '{_ROLE}', ''), '(?i)[_-]L[0-9][0-9][0-9]$', '')")} else {_clean('st')} end
   when type = 'BAM' then {_clean("regexp_replace(name, '(?i)\\.bam$', '')")} end dataset_key from {_TYPED} t)"""


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """The selected files, written once because most queries use them in several joins."""
    return materialize(datasets.selected_files(V.run_files(spark, folder)), "selected")


@query("selected_files", f"select name, size, position from {_SELECTED} s")
def selected_files(spark: SparkSession, folder: str) -> DataFrame:
    chosen = datasets.selected_files(V.run_files(spark, folder))
    return chosen.select("name", "size", "position")


@query(
    "selection_totals",
    f"select type, count(*) files, cast(sum(size) as bigint) bytes from {_TYPED} t group by type",
)
def selection_totals(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.selection_totals(datasets.selected_files(V.run_files(spark, folder)))


@query("classify_files", f'select name, position, type, "role", lane, stem, dataset_key from {_LABELLED} l')
def classify_files(spark: SparkSession, folder: str) -> DataFrame:
    out = datasets.labelled_files(datasets.selected_files(V.run_files(spark, folder)))
    return out.select("name", "position", "type", "role", "lane", "stem", "dataset_key")


_PAIRS = f"""(select b.name bam, b.position bam_position, i.name bai, i.position bai_position from {_TYPED} b join {_TYPED} i
 on lower(i.name) = concat(lower(b.name), '.bai') or lower(i.name) = concat(regexp_replace(lower(b.name), '\\.bam$', ''), '.bai') where b.type = 'BAM' and i.type = 'BAI')"""
_MATCHED = f"""(select bam, bam_position, arg_min(bai, bai_position) bai, count(*) candidates from {_PAIRS} p group by all)"""


@query(
    "bai_match",
    f"select *, case when candidates > 1 then concat('Multiple BAI candidates matched; using ', bai, '.') end warning from {_MATCHED} m",
)
def bai_match(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.matched_bai(_files(spark, folder))


@query(
    "unassigned_bai",
    f"select name, size, 'No uniquely matching BAM' reason from {_TYPED} t where type = 'BAI' and name not in (select bai from {_MATCHED} m)",
)
def unassigned_bai(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.unassigned_bai(_files(spark, folder))


_ROLE_TEXT = ", ".join(
    f"case when {r} > 1 then concat('{r.upper()} ×', cast({r} as varchar)) when {r} = 1 then '{r.upper()}' end"
    for r in ("r1", "r2", "i1", "i2")
)


@query(
    "dataset_resolution",
    f"""with l as {_LABELLED}, bm as (select *, row_number() over (partition by dataset_key order by position, name) nth from l where type = 'BAM'),
b as (select case when nth > 1 then concat(dataset_key, '#', name) else dataset_key end dataset_id, regexp_replace(name, '(?i)\\.bam$', '') as label, name bam, bai, coalesce(candidates, 0) > 1 mb, nth > 1 sk from bm left join {_MATCHED} m on m.bam = bm.name and m.bam_position = bm.position),
f as (select dataset_key dataset_id, count(*) filter (where "role" = 'r1') r1, count(*) filter (where "role" = 'r2') r2, count(*) filter (where "role" = 'i1') i1, count(*) filter (where "role" = 'i2') i2, count(*) filter (where "role" = 'unknown') "unknown",
  count(distinct lane) lanes from l where type = 'FASTQ' group by dataset_key),
j as (select coalesce(b.dataset_id, f.dataset_id) dataset_id, coalesce(label, split_part(f.dataset_id, '/', -1)) as label, bam, bai, coalesce(r1, 0) r1, coalesce(r2, 0) r2, coalesce(i1, 0) i1, coalesce(i2, 0) i2, coalesce("unknown", 0) "unknown", coalesce(lanes, 0) lanes, coalesce(mb, false) mb, coalesce(sk, false) sk from b full join f on f.dataset_id = b.dataset_id),
t as (select *, concat_ws('/', {_ROLE_TEXT}) rd from j),
s as (select *, concat_ws(' + ', case when bam is not null then 'BAM' end, case when bai is not null then 'BAI' end, case when rd <> '' then concat(rd, case when lanes > 1 then concat(' across ', cast(lanes as varchar), ' lanes') else '' end) end) sm from t)
select dataset_id, label, bam, bai, r1, r2, i1, i2, "unknown", lanes, case when sm = '' then 'No recognized genomic files' else sm end summary,
 concat_ws(' ', case when mb then concat('Multiple BAI candidates matched; using ', bai, '.') end, case when "unknown" > 0 then 'Some FASTQ files have no recognizable R1/R2/I1/I2 suffix.' end, case when sk then 'Another BAM has the same sample key; kept apart.' end) warnings from s""",
)
def dataset_resolution(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.resolve_datasets(_files(spark, folder))


@query(
    "dataset_members",
    f"""with l as {_LABELLED}, bm as (select *, row_number() over (partition by dataset_key order by position, name) k from l where type = 'BAM'),
b as (select case when k > 1 then concat(dataset_key, '#', name) else dataset_key end dataset_id, name bam, bai from bm left join {_MATCHED} m on m.bam = bm.name and m.bam_position = bm.position)
select dataset_key dataset_id, "role", name, row_number() over (partition by dataset_key, "role" order by case when "role" in ('r1', 'r2') then name end nulls first, position, name) nth from l where type = 'FASTQ'
union all select dataset_id, 'bam', bam, 1 from b union all select dataset_id, 'bai', bai, 1 from b where bai is not null""",
)
def dataset_members(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.dataset_files(_files(spark, folder))


def _bytes_sql() -> str:
    cases = ["when size < 1024 then concat(cast(size as varchar), ' B')"]
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), start=1):
        value = f"cast(size as double) / {1024**power}"
        shown = (
            f"printf(case when {value} >= 100 then '%.0f {unit}' when {value} >= 10 then '%.1f {unit}' "
            f"else '%.2f {unit}' end, {value})"
        )
        cases.append(f"when size < {1024 ** (power + 1)} then {shown}")
    return "case " + " ".join(cases) + " end"


@query(
    "display_values",
    f"""with v as (select o_orderkey, cast(floor(o_totalprice * o_totalprice * (o_orderkey % 1000 + 1) * case when o_orderkey % 5 = 0 then 0.0001 else 1 end) as bigint) size from orders)
select o_orderkey, size, {_bytes_sql()} shown, printf('%.1f%%', (o_orderkey % 997) / 997 * 100) percent from v""",
)
def display_values(spark: SparkSession, folder: str) -> DataFrame:
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    factor = F.when(key % 5 == 0, F.lit(0.0001)).otherwise(F.lit(1.0))
    size = F.floor(price * price * (key % 1000 + 1) * factor).cast("bigint")
    rows = V.table(spark, folder, "orders").select("o_orderkey", size.alias("size"))
    share = (key % 997).cast("double") / F.lit(997.0)
    return rows.select(
        "o_orderkey", "size", N.format_bytes(F.col("size")).alias("shown"), N.format_percent(share).alias("percent")
    )


_HEADER_SQL = r"""(select concat('f', cast(c_custkey as varchar)) file, concat('@HD', chr(9), 'VN:1.6', chr(9), case when c_custkey % 3 = 0 then 'SO:coordinate' else 'GO:none' end, chr(13), chr(10),
 '@SQ', chr(9), 'SN:chr1', chr(9), 'LN:', cast(c_custkey + 1000 as varchar), chr(9), 'UR:http://h:80/', cast(c_custkey as varchar), chr(10), 'free text', chr(10),
 '@RG', chr(9), 'ID:a', chr(9), 'SM:', c_name, chr(9), 'LB:', c_mktsegment, chr(10), '@RG', chr(9), 'ID:b', chr(9), 'SM:', case when c_custkey % 2 = 0 then c_name else 'other' end, chr(9), 'LB:', chr(9), 'SM:last', chr(10),
 '@PG', chr(9), 'ID:p1', chr(9), 'PN:', case when c_nationkey % 2 = 0 then 'cellranger' else '' end, chr(9), ':bad', chr(10), '@PG', chr(9), 'ID:p2', chr(9), 'CL:run --x a:b', chr(10), '@CO', chr(9), c_name, chr(9), 'note', chr(10), '@XX', chr(9), 'A:b') t from customer)"""


def _headers(spark: SparkSession, folder: str) -> DataFrame:
    c, name = F.col("c_custkey"), F.col("c_name")
    text = F.concat(
        F.lit("@HD\tVN:1.6\t"), F.when(c % 3 == 0, "SO:coordinate").otherwise("GO:none"), F.lit("\r\n"),
        F.lit("@SQ\tSN:chr1\tLN:"), (c + 1000).cast("string"), F.lit("\tUR:http://h:80/"), c.cast("string"),
        F.lit("\nfree text\n@RG\tID:a\tSM:"), name, F.lit("\tLB:"), F.col("c_mktsegment"),
        F.lit("\n@RG\tID:b\tSM:"), F.when(c % 2 == 0, name).otherwise("other"), F.lit("\tLB:\tSM:last\n@PG\tID:p1\tPN:"),
        F.when(F.col("c_nationkey") % 2 == 0, "cellranger").otherwise(""),
        F.lit("\t:bad\n@PG\tID:p2\tCL:run --x a:b\n@CO\t"), name, F.lit("\tnote\n@XX\tA:b"),
    )
    return V.table(spark, folder, "customer").select(
        F.concat(F.lit("f"), c.cast("string")).alias("file"), text.alias("header_text")
    )


@query(
    "header_parse",
    rf"""with l as (select file, cast(generate_subscripts(string_split(t, chr(10)), 1) - 1 as int) line_no, unnest(string_split(t, chr(10))) line from {_HEADER_SQL} h),
p as (select file, line_no, string_split(regexp_replace(line, '\r$', ''), chr(9)) x from l where line like '@%'), q as (select file, line_no, substr(x[1], 2) as type, x[2:] r from p),
k as (select *, list_filter(r, lambda f: instr(f, ':') > 1) e from q where substr(type, 1, 2) in ('HD', 'SQ', 'RG', 'PG', 'CO'))
select file, line_no, type, case when type <> 'CO' then array_to_string(list_sort(list_distinct(list_transform(e, lambda f: concat(split_part(f, ':', 1), '=', substr(list_filter(e, lambda g: split_part(g, ':', 1) = split_part(f, ':', 1))[-1], length(split_part(f, ':', 1)) + 2))))), '|') end fields,
 case when type = 'CO' then array_to_string(r, chr(9)) end as "comment" from k""",
)
def header_parse(spark: SparkSession, folder: str) -> DataFrame:
    lines = headers.header_lines(_headers(spark, folder))
    shown = F.array_join(
        F.sort_array(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|"
    )
    return lines.withColumn("fields", shown)


@query(
    "header_summary",
    rf"""select concat('f', cast(c_custkey as varchar)) file, case when c_custkey % 3 = 0 then 'coordinate' end sort_order, case when true then concat(c_name, ', last') end samples, c_mktsegment libraries,
 case when c_nationkey % 2 = 0 then 'cellranger → p2' else 'p1 → p2' end programs, case when c_nationkey % 2 = 0 then 'p1 cellranger  p2  run --x a:b' else 'p1   p2  run --x a:b' end program_text from customer""",
)
def header_summary(spark: SparkSession, folder: str) -> DataFrame:
    return headers.header_summary(headers.header_lines(_headers(spark, folder)))
