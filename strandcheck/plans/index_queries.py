"""Queries over BAM index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import constants as K
from ..operators import contigs
from ..operators import index as ops
from ..session import materialize
from . import views as V
from .registry import query


def _round(df: DataFrame, *names: str, digits: int = 8) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


_NAMED_SQL = f"""(select m.file, m.ref_id, coalesce(n.n_name, concat('ref_', cast(m.ref_id as varchar))) as name, mapped, placed_unmapped from ({V.META_SQL}) m
 left join (select n_nationkey, case when n_nationkey % 6 = 5 then null when n_nationkey = 24 then 'chrM' when n_nationkey = 7 then 'mt' else concat('chr', cast(n_nationkey + 1 as varchar)) end n_name from nation) n on n.n_nationkey = m.ref_id)"""


def _named(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("n_nationkey")
    name = (
        F.when(key % 6 == 5, F.lit(None))
        .when(key == 24, "chrM")
        .when(key == 7, "mt")
        .otherwise(F.concat(F.lit("chr"), (key + 1).cast("string")))
    )
    refs = V.table(spark, folder, "nation").select(
        key.alias("ref_id"), name.alias("name"), F.lit(None).cast("bigint").alias("length")
    )
    return contigs.reference_dictionary(refs, V.index_meta(V.index_base(spark, folder)), ["file"])


@query("idxstats", f"select file, ref_id, name, mapped, placed_unmapped from {_NAMED_SQL} n")
def idxstats(spark: SparkSession, folder: str) -> DataFrame:
    return _named(spark, folder).select("file", "ref_id", "name", "mapped", "placed_unmapped")


@query(
    "index_totals",
    f"""with m as (select file, cast(sum(mapped) as bigint) mapped, cast(sum(placed_unmapped) as bigint) placed_unmapped from ({V.META_SQL}) x group by file)
select f.file, mapped, placed_unmapped, no_coordinate unplaced_unmapped, placed_unmapped + no_coordinate total_unmapped, round(mapped / (mapped + placed_unmapped + no_coordinate), 8) mapped_fraction from ({V.INDEX_FILES_SQL}) f left join m on m.file = f.file""",
)
def index_totals(spark: SparkSession, folder: str) -> DataFrame:
    base = materialize(V.index_base(spark, folder), "index-base")
    totals = ops.index_totals(V.index_meta(base), V.index_files(base))
    return _round(totals, "mapped_fraction")


@query(
    "mito_fraction",
    f"""select file, arg_min(name, ref_id) filter (where mito) mito_name, arg_min(mapped, ref_id) filter (where mito) mito_mapped, round(arg_min(mapped, ref_id) filter (where mito) / sum(mapped), 8) mito_fraction
from (select *, lower(name) in ('chrm', 'mt', 'm') mito from {_NAMED_SQL} n) x group by file""",
)
def mito_fraction(spark: SparkSession, folder: str) -> DataFrame:
    return _round(ops.mito_fraction(_named(spark, folder)), "mito_fraction")


@query(
    "top_references",
    f"""select file, ref_id, name, mapped, cast(rk as int) as rank from (select *, row_number() over (partition by file order by coalesce(mapped, 0) desc, ref_id) rk from {_NAMED_SQL} n) x where rk <= 40""",
)
def top_references(spark: SparkSession, folder: str) -> DataFrame:
    return ops.top_references(_named(spark, folder)).select("file", "ref_id", "name", "mapped", "rank")


@query(
    "virtual_offsets",
    f"""select file, ref_id, bin, chunk_index, beg >> 16 beg_block, beg & 65535 beg_within, "end" >> 16 end_block, concat_ws(':', cast(ref_id as varchar), cast(bin as varchar), cast(chunk_index as varchar)) region from ({V.CHUNKS_SQL}) c where beg <> 0""",
)
def virtual_offsets(spark: SparkSession, folder: str) -> DataFrame:
    chunks = V.index_chunks(V.index_base(spark, folder)).filter("beg <> 0")
    return chunks.select(
        "file", "ref_id", "bin", "chunk_index",
        A.offset_block(F.col("beg")).alias("beg_block"),
        A.offset_within(F.col("beg")).alias("beg_within"),
        A.offset_block(F.col("end")).alias("end_block"),
        A.region_id(F.col("ref_id"), F.col("bin"), F.col("chunk_index")).alias("region"),
    )


def _beyond(rule: int, source: str, offset: str, label: str, bin_no: str, item: str) -> str:
    return f"""select x.file, ref_id, {bin_no} bin, {rule} rule, cast({item} as bigint) item, concat('index of reference ', cast(ref_id as varchar), {label}, ' lies past the last byte of the BAM (', cast({offset} >> 16 as varchar), ' >= ', cast(bam_size as varchar), ')') message
 from {source} x join f on f.file = x.file where {offset} >> 16 >= bam_size"""


def _chunk(rule: int, condition: str, what: str) -> str:
    return f"select file, ref_id, bin, {rule}, chunk_index, concat('index of reference ', cast(ref_id as varchar), ' bin ', cast(bin as varchar), '{what}') from cp where {condition}"


_BIN_LABEL = "concat(' bin ', cast(bin as varchar), ' chunk {}')"
_ERRORS_SQL = f"""(with f as ({V.INDEX_FILES_SQL}), c as ({V.CHUNKS_SQL}), l as ({V.LINEAR_SQL}), m as ({V.META_SQL}),
cp as (select *, lag(beg >> 16) over (partition by file, ref_id, bin order by chunk_index) prev from c),
lp as (select *, last_value(nullif(voffset, 0) ignore nulls) over (partition by file, ref_id order by "interval" rows between unbounded preceding and 1 preceding) prev from l)
select file, -1 ref_id, -1 bin, 1 rule, cast(0 as bigint) item, concat('numbers of references differ (BAM: ', cast(bam_n_ref as varchar), ', index: ', cast(n_ref as varchar), ')') message from f where n_ref <> bam_n_ref
union all {_beyond(2, 'l', 'voffset', "concat(' linear interval ', cast(" + '"interval"' + " as varchar))", '-1', '"interval"')}
union all select file, ref_id, -1, 3, "interval", concat('index of reference ', cast(ref_id as varchar), ' has linear offsets that go back') from lp where voffset <> 0 and voffset < prev
union all {_beyond(4, 'c', 'beg', _BIN_LABEL.format('start'), 'bin', 'chunk_index')}
union all {_beyond(5, 'c', '"end"', _BIN_LABEL.format('end'), 'bin', 'chunk_index')}
union all {_chunk(6, '"end" <= beg', ' has a chunk that holds nothing')}
union all {_chunk(7, 'prev > 0 and beg >> 16 < prev', ' has chunks out of order')}
union all {_chunk(8, '"end" >> 16 < beg >> 16', ' has a chunk that ends in an earlier block')}
union all {_beyond(9, 'm', 'ref_beg', "' metadata start'", '37450', '0')}
union all {_beyond(10, 'm', 'ref_end', "' metadata end'", '37450', '0')}
union all select file, ref_id, 37450, 11, 0, concat('index of reference ', cast(ref_id as varchar), ' has metadata that end before they begin') from m where ref_end < ref_beg)"""


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The index tables. What they come from is written once and read many times."""
    base = materialize(V.index_base(spark, folder), "index-base")
    return (
        V.index_chunks(base),
        materialize(V.index_linear(base), "linear"),
        V.index_meta(base),
        materialize(V.index_files(base), "index-files"),
    )


@query("index_validation_errors", f"select * from {_ERRORS_SQL} e")
def index_validation_errors(spark: SparkSession, folder: str) -> DataFrame:
    return ops.validation_errors(*_tables(spark, folder))


_FIRST_SQL = f"""(select file, row_number() over (partition by file order by ref_id, case when rule <= 3 then 0 when rule <= 8 then 1 else 2 end, bin, item, rule) as position, message from {_ERRORS_SQL} e)"""


@query(
    "index_status",
    f"""with s as (select file, string_agg(message, '; ' order by position) t from {_FIRST_SQL} x where position <= 5 group by file)
select f.file, case when t is null then 'pass' else 'failed' end status, concat('BAI validation failed: ', t) || '' as error from ({V.INDEX_FILES_SQL}) f left join s on s.file = f.file""",
)
def index_status(spark: SparkSession, folder: str) -> DataFrame:
    chunks, linear, meta, files = _tables(spark, folder)
    return ops.index_status(files, ops.validation_errors(chunks, linear, meta, files))


@query(
    "seek_points_global",
    f"""with c as ({V.CHUNKS_SQL}), l as ({V.LINEAR_SQL}), n as (select file, count(distinct beg) s from c where beg <> 0 group by file),
e as (select file, ref_id, beg v, 0 src from c where beg <> 0 union all select l.file, ref_id, voffset, 1 from l left join n on n.file = l.file where voffset <> 0 and coalesce(s, 0) < 8),
p as (select file, v voffset, arg_min(ref_id, src * 1000 + ref_id) ref_id from e group by file, v), r as (select *, row_number() over (partition by file order by voffset) - 1 i, count(*) over (partition by file) k from p),
w as (select distinct file, case when k <= 64 then j else cast(floor(j * (k - 1) / 63 + 0.5) as bigint) end i from (select distinct file, k from r) x, range(64) t(j))
select r.file, ref_id, voffset, voffset >> 16 compressed, voffset & 65535 uncompressed from r join w on w.file = r.file and w.i = r.i""",
)
def seek_points_global(spark: SparkSession, folder: str) -> DataFrame:
    chunks, linear, _, files = _tables(spark, folder)
    return ops.global_seek_points(chunks, linear, files, K.PROBE_POINTS)


def _stratified_sql(k: int) -> str:
    return f"""with c as ({V.CHUNKS_SQL}), l as ({V.LINEAR_SQL}), n as (select file, ref_id, count(*) s from c where beg <> 0 group by all),
e as (select file, ref_id, bin, chunk_index ix, beg v, 0 src from c where beg <> 0 union all select l.file, l.ref_id, null, "interval", voffset, 1 from l left join n on n.file = l.file and n.ref_id = l.ref_id where voffset <> 0 and coalesce(s, 0) < 2),
o as (select *, row_number() over (partition by file, ref_id, v order by src desc, bin desc, ix desc) d from e), p as (select *, row_number() over (partition by file, ref_id order by v) - 1 i, count(*) over (partition by file, ref_id) k from o where d = 1),
s as (select file, ref_id, max(k) k from p group by all), q as (select *, greatest(1, {k} // count(*) over (partition by file)) quota from s),
w as (select file, ref_id, i, min(rd) rd from (select file, ref_id, rd, least(k - 1, cast(floor(rd * (k - 1) / greatest(1, quota - 1) + 0.5) as bigint)) i from q, range({k}) t(rd) where rd < quota) x group by all),
z as (select p.*, row_number() over (partition by p.file order by rd, p.ref_id) - 1 point_no from p join w on w.file = p.file and w.ref_id = p.ref_id and w.i = p.i)
select file, cast(point_no as int) point_no, ref_id, v voffset, v >> 16 compressed, v & 65535 uncompressed, concat_ws(':', cast(ref_id as varchar), coalesce(cast(bin as varchar), 'linear'), cast(ix as varchar)) region from z where point_no < {k}"""


@query("seek_points_stratified", _stratified_sql(K.SEEK_POINTS["quick"]))
def seek_points_stratified(spark: SparkSession, folder: str) -> DataFrame:
    chunks, linear, _, files = _tables(spark, folder)
    return ops.stratified_seek_points(chunks, linear, files, K.SEEK_POINTS["quick"])


@query("seek_points_deep", _stratified_sql(200))
def seek_points_deep(spark: SparkSession, folder: str) -> DataFrame:
    """More points than references, so that every reference has several rounds."""
    chunks, linear, _, files = _tables(spark, folder)
    return ops.stratified_seek_points(chunks, linear, files, 200)
