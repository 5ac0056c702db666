"""Queries over FASTQ-shaped reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import reads as R
from ..operators import inference
from ..operators import reads as ops
from . import views as V
from .registry import query

_SPACES = "e' \\t\\n\\r\\x0b\\x0c'"


def _round(df: DataFrame, *names: str, digits: int = 8) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(
    "fastq_read_totals",
    f"""select count(*) reads, count(distinct seq) unique_sequences, cast(quantile_disc(length(seq), 0.5) as bigint) median_length,
 round((count(*) - count(distinct seq))/count(*), 8) duplication, round(avg(case when contains(seq, 'AGATCGGAAGAGC') then 1.0 else 0.0 end), 8) adapter_fraction,
 round(avg(case when regexp_matches(seq, 'A{{12,}}$') then 1.0 else 0.0 end), 8) poly_a_fraction, round(avg(case when regexp_matches(seq, 'G{{12,}}$') then 1.0 else 0.0 end), 8) poly_g_fraction from ({V.READS_SQL}) r""",
)
def fastq_read_totals(spark: SparkSession, folder: str) -> DataFrame:
    out = ops.read_totals(V.reads(spark, folder).select("seq"))
    return _round(out, "duplication", "adapter_fraction", "poly_a_fraction", "poly_g_fraction")


# Motifs occur too rarely in hashed sequences, so they are also looked for in
# the whole texts, written in the alphabet of bases.
_MOTIF_SQL = "(select doc_id, lang, translate(text, 'eiornsldupmhEIORNSLDUPMH', 'AAAAGGGCTTTTAAAAGGGCTTTT') seq from documents)"


@query(
    "text_motifs",
    f"""select lang, count(*) reads, count(distinct seq) unique_sequences, cast(quantile_disc(length(seq), 0.5) as bigint) median_length, round((count(*) - count(distinct seq))/count(*), 8) duplication,
 round(avg(case when contains(seq, 'AGATCGGAAGAGC') then 1.0 else 0.0 end), 8) adapter_fraction,
 round(avg(case when regexp_matches(seq, 'A{{12,}}$') then 1.0 else 0.0 end), 8) poly_a_fraction, round(avg(case when regexp_matches(seq, 'G{{12,}}$') then 1.0 else 0.0 end), 8) poly_g_fraction from {_MOTIF_SQL} r group by lang""",
)
def text_motifs(spark: SparkSession, folder: str) -> DataFrame:
    seq = F.translate("text", "eiornsldupmhEIORNSLDUPMH", "AAAAGGGCTTTTAAAAGGGCTTTT")
    docs = V.table(spark, folder, "documents").select("lang", seq.alias("seq"))
    out = ops.read_totals(docs, ["lang"])
    return _round(out, "duplication", "adapter_fraction", "poly_a_fraction", "poly_g_fraction")


_CELLS = f"""(select cycle, case when b in ('A','C','G','T') then b else 'N' end b, greatest(0, ascii(c) - 33) q
from (select unnest(range(1, length(seq) + 1)) as cycle, unnest(string_split(seq, '')) as b, unnest(string_split(qual, '')) as c from ({V.READS_SQL}) r) x)"""


@query(
    "fastq_base_totals",
    f"""select count(*) bases, round(avg(case when q >= 20 then 1.0 else 0.0 end), 8) q20, round(avg(case when q >= 30 then 1.0 else 0.0 end), 8) q30, round(avg(case when b = 'N' then 1.0 else 0.0 end), 8) n_fraction from {_CELLS} c""",
)
def fastq_base_totals(spark: SparkSession, folder: str) -> DataFrame:
    sums = ops.cycle_sums(V.reads(spark, folder).select("seq", "qual"))
    return _round(ops.base_totals(sums), "q20", "q30", "n_fraction")


_FRACTIONS = ", ".join(
    f"round(avg(case when b = '{b}' then 1.0 else 0.0 end), 8) frac_{b.lower()}" for b in "ACGTN"
)


@query(
    "fastq_per_cycle",
    f"select cast(cycle as int) as cycle, count(*) reads, round(avg(q), 8) mean_q, {_FRACTIONS} from {_CELLS} c group by cycle",
)
def fastq_per_cycle(spark: SparkSession, folder: str) -> DataFrame:
    sums = ops.cycle_sums(V.reads(spark, folder).select("seq", "qual"))
    out = ops.per_cycle(sums)
    return _round(out, "mean_q", *[f"frac_{b}" for b in "acgtn"])


@query(
    "fastq_cycle_entropy",
    f"""select round(avg(h), 8) mean_cycle_entropy from (select cycle, sum(case when b <> 'N' then -p * log2(p) else 0 end) h from (select cycle, b, n / sum(n) over (partition by cycle) p from (select cycle, b, count(*) n from {_CELLS} c group by all) x) y group by cycle) z""",
)
def fastq_cycle_entropy(spark: SparkSession, folder: str) -> DataFrame:
    sums = ops.cycle_sums(V.reads(spark, folder).select("seq", "qual"))
    return _round(ops.cycle_entropy(ops.per_cycle(sums)), "mean_cycle_entropy")


@query("fastq_length_histogram", f"select cast(length(seq) as int) length, count(*) n from ({V.READS_SQL}) r group by 1")
def fastq_length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return ops.length_histogram(V.reads(spark, folder))


@query(
    "fastq_gc_histogram",
    f"""with g as (select least(20, cast(floor((length(seq) - length(translate(seq, 'GC', ''))) / length(seq) * 20) as int)) k from ({V.READS_SQL}) r)
select cast(i as int) gc_bin, count(k) n from range(21) t(i) left join g on k = i group by i""",
)
def fastq_gc_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return ops.gc_histogram(V.reads(spark, folder))


@query(
    "fastq_top_sequences",
    f"select seq, count(*) n, case when length(seq) > 80 then concat(substr(seq, 1, 77), '…') else seq end shown from ({V.READS_SQL}) r group by seq order by n desc, seq limit 8",
)
def fastq_top_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return ops.top_sequences(V.reads(spark, folder))


_CHECKED = f"""(select read_id % 3 grp, header, s seq, q qual, header like '@%' and plus like '+%' and length(s) = length(q) and length(s) > 0 ok
from (select *, upper(trim(seq, {_SPACES})) s, trim(qual, {_SPACES}) q from ({V.RAW_READS_SQL}) r) x)"""


@query(
    "fastq_integrity",
    f"""with v as {_CHECKED}, g as (select grp, count(*) filter (where ok) reads, count(*) filter (where not ok) malformed, false incomplete_tail,
 cast(sum(length(translate(seq, 'ACGTNRYKMSWBDHV.-', ''))) filter (where ok) as bigint) invalid_bases, cast(sum(length(regexp_replace(qual, '[!-~]', '', 'g'))) filter (where ok) as bigint) invalid_quality,
 count(*) filter (where ok and regexp_extract(header, '{K.READ_NUMBER_PATTERN}', 1) = '1') read_number_1, count(*) filter (where ok and regexp_extract(header, '{K.READ_NUMBER_PATTERN}', 1) = '2') read_number_2 from v group by grp),
c as (select grp, cast(min(unicode(ch)) as bigint) quality_min, cast(max(unicode(ch)) as bigint) quality_max from (select grp, unnest(string_split(qual, '')) ch from v where ok) x group by grp)
select g.grp, reads, malformed, incomplete_tail, invalid_bases, invalid_quality, quality_min, quality_max, read_number_1, read_number_2, not (read_number_1 > 0 and read_number_2 > 0) read_number_consistent,
 case when invalid_quality > 0 then 'invalid quality bytes' else 'Phred+33 printable range (encoding remains ambiguous for high-quality-only reads)' end quality_encoding from g join c on c.grp = g.grp""",
)
def fastq_integrity(spark: SparkSession, folder: str) -> DataFrame:
    raw = V.raw_reads(spark, folder).withColumn("grp", F.col("read_id") % 3)
    return ops.integrity(raw, ["grp"])


@query(
    "illumina_headers",
    """with h as (select event_id, case event_id % 4 when 0 then concat('@', event_type, ':', cast(user_id as varchar), ':FC', cast(event_id % 7 as varchar), ':', cast(event_id % 8 + 1 as varchar), ':', cast(1100 + event_id % 9 as varchar), ':', cast(event_id as varchar), ':5 ', cast(event_id % 2 + 1 as varchar), ':', case when value > 10 then 'Y' else 'N' end, ':0:ACGT+TT')
  when 1 then concat('@read', cast(event_id as varchar), '/', cast(event_id % 3 as varchar)) when 2 then concat(event_type, ':1:A:2:3:4:5 2:N:18:', cast(user_id as varchar)) else concat('@', props, ' 1') end header from events)
select event_id, nullif(regexp_extract(header, '(?:\\s|/)([12])(?:[:\\s]|$)', 1), '') read_number, nullif(regexp_extract(header, '^@?([^: ]+):(\\d+):([^: ]+):(\\d+):(\\d+):(\\d+):(\\d+)\\s+([12]):([YN]):\\d+:[^\\s]+', 1), '') instrument, nullif(regexp_extract(header, '^@?([^: ]+):(\\d+):([^: ]+):(\\d+):(\\d+):(\\d+):(\\d+)\\s+([12]):([YN]):\\d+:[^\\s]+', 2), '') run, nullif(regexp_extract(header, '^@?([^: ]+):(\\d+):([^: ]+):(\\d+):(\\d+):(\\d+):(\\d+)\\s+([12]):([YN]):\\d+:[^\\s]+', 3), '') flowcell,
 try_cast(regexp_extract(header, '^@?([^: ]+):(\\d+):([^: ]+):(\\d+):(\\d+):(\\d+):(\\d+)\\s+([12]):([YN]):\\d+:[^\\s]+', 4) as bigint) lane, try_cast(regexp_extract(header, '^@?([^: ]+):(\\d+):([^: ]+):(\\d+):(\\d+):(\\d+):(\\d+)\\s+([12]):([YN]):\\d+:[^\\s]+', 5) as bigint) tile, try_cast(regexp_extract(header, '^@?([^: ]+):(\\d+):([^: ]+):(\\d+):(\\d+):(\\d+):(\\d+)\\s+([12]):([YN]):\\d+:[^\\s]+', 8) as bigint) "read", case when regexp_matches(header, '^@?([^: ]+):(\\d+):([^: ]+):(\\d+):(\\d+):(\\d+):(\\d+)\\s+([12]):([YN]):\\d+:[^\\s]+') then regexp_extract(header, '^@?([^: ]+):(\\d+):([^: ]+):(\\d+):(\\d+):(\\d+):(\\d+)\\s+([12]):([YN]):\\d+:[^\\s]+', 9) = 'Y' end filtered,
 try_cast(regexp_extract(header, '^@?[^: ]+:\\d+:[^: ]+:\\d+:\\d+:\\d+:\\d+\\s+[12]:[YN]:(\\d+):([^\\s]+)', 1) as bigint) control, nullif(regexp_extract(header, '^@?[^: ]+:\\d+:[^: ]+:\\d+:\\d+:\\d+:\\d+\\s+[12]:[YN]:(\\d+):([^\\s]+)', 2), '') "index"
from h""",
)
def illumina_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Headers of four styles made from events, parsed."""
    i, text = F.col("event_id"), lambda c: c.cast("string")
    full = F.concat(
        F.lit("@"), "event_type", F.lit(":"), text(F.col("user_id")), F.lit(":FC"), text(i % 7), F.lit(":"),
        text(i % 8 + 1), F.lit(":"), text(i % 9 + 1100), F.lit(":"), text(i), F.lit(":5 "), text(i % 2 + 1),
        F.lit(":"), F.when(F.col("value") > 10, "Y").otherwise("N"), F.lit(":0:ACGT+TT"),
    )
    header = (
        F.when(i % 4 == 0, full)
        .when(i % 4 == 1, F.concat(F.lit("@read"), text(i), F.lit("/"), text(i % 3)))
        .when(i % 4 == 2, F.concat("event_type", F.lit(":1:A:2:3:4:5 2:N:18:"), text(F.col("user_id"))))
        .otherwise(F.concat(F.lit("@"), "props", F.lit(" 1")))
    )
    rows = V.table(spark, folder, "events").select("event_id", header.alias("header"))
    parsed = rows.select(
        "event_id", R.read_number(F.col("header")).alias("read_number"), R.illumina_fields(F.col("header")).alias("p")
    )
    return parsed.select("event_id", "read_number", "p.*")


# FASTQ files of a run: one per order, with a median length from its lines.
_RUN_SQL = f"""(select concat('set_', cast(o_custkey as varchar)) dataset_id, o_orderkey as position,
 concat('s_', cast(o_orderkey as varchar), case o_orderkey % 5 when 0 then '_R1_001' when 1 then '_R2' when 2 then '_I1' when 3 then '.1' else '' end, '.fastq') file_name,
 case when o_orderkey % 5 = 0 then 26 + o_orderkey % 4 when o_orderkey % 7 = 0 then 28 else cast(floor(o_totalprice) as bigint) % 60 + 40 end median_length,
 case when o_orderkey % 11 = 0 then o_orderkey % 2 + 1 end illumina_read, case when o_orderkey % 6 <> 0 then o_orderkey % 3 end lane,
 case when o_orderstatus = 'P' then 'unreadable' end error from orders)"""


def _run(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    tail = (
        F.when(k % 5 == 0, "_R1_001").when(k % 5 == 1, "_R2").when(k % 5 == 2, "_I1").when(k % 5 == 3, ".1").otherwise("")
    )
    return V.table(spark, folder, "orders").select(
        F.concat(F.lit("set_"), F.col("o_custkey").cast("string")).alias("dataset_id"),
        k.alias("position"),
        F.concat(F.lit("s_"), k.cast("string"), tail, F.lit(".fastq")).alias("file_name"),
        F.when(k % 5 == 0, k % 4 + 26)
        .when(k % 7 == 0, 28)
        .otherwise(F.floor("o_totalprice") % 60 + 40)
        .cast("bigint")
        .alias("median_length"),
        F.when(k % 11 == 0, k % 2 + 1).alias("illumina_read"),
        F.when(k % 6 != 0, k % 3).alias("lane"),
        F.when(F.col("o_orderstatus") == "P", "unreadable").alias("error"),
    )


@query(
    "pair_layout",
    f"""with u as (select *, case when regexp_matches(file_name, '_R1_001') then 'r1' when file_name like '%\\_R2.%' escape '\\' then 'r2' when file_name like '%\\_I1.%' escape '\\' then 'i1' else 'unknown' end role from {_RUN_SQL} r where error is null),
g as (select *, row_number() over (partition by dataset_id order by case when role = 'i1' then 1 else 0 end, coalesce(illumina_read, case when regexp_matches(file_name, '(?i)[_.-]R?1(?:[_.-]|$)') then 1 else 9 end), position) nth from u),
n as (select dataset_id, count(*) c, min(position) filter (where role = 'r1') p1, min(position) filter (where role = 'r2') p2, max(position) filter (where nth = 1 and role <> 'i1') g1, max(position) filter (where nth = 2 and role <> 'i1') g2 from g group by dataset_id having count(*) >= 2),
x as (select *, coalesce(p1, g1) a from n), y as (select *, coalesce(p2, case when g1 <> a then g1 end, g2) b from x)
select y.dataset_id, f.file_name r1, s.file_name r2, case when f.median_length between 24 and 32 and s.median_length >= 50 then '10x-like barcode/UMI + cDNA layout' else 'Paired sequencing reads' end layout,
 case when f.median_length = 28 and s.median_length >= 50 then 'medium' else 'low' end confidence from y join u f on f.position = a join u s on s.position = b""",
)
def pair_layout(spark: SparkSession, folder: str) -> DataFrame:
    return inference.pair_layout(_run(spark, folder))


@query(
    "fastq_bam_consistency",
    f"""with u as (select *, case when illumina_read = 1 or regexp_matches(file_name, '_R1_001') then 'r1' when illumina_read = 2 or file_name like '%\\_R2.%' escape '\\' then 'r2' end side from {_RUN_SQL} r where error is null),
s as (select dataset_id, arg_min(median_length, position) filter (where side = 'r1') m1, arg_min(median_length, position) filter (where side = 'r2') m2, min(position) filter (where side = 'r1') q1, min(position) filter (where side = 'r2') q2 from u where side is not null group by dataset_id),
l as (select s.*, (select lane from u where position = q1) l1, (select lane from u where position = q2) l2 from s),
b as (select concat('set_', cast(c_custkey as varchar)) dataset_id, case when c_nationkey = 3 then 0 else 16 end bl, case when c_nationkey % 2 = 0 then 12 else 10 end ul, 40 + c_custkey % 60 rl from customer where c_mktsegment <> 'MACHINERY'),
c as (select b.dataset_id, case when bl > 0 then m1 = bl + ul end r1_layout, abs(m2 - rl) <= 5 r2_length, not coalesce(nullif(l1, 0) <> nullif(l2, 0), false) lane_agreement from b join l on l.dataset_id = b.dataset_id)
select *, case when not r1_layout or not r2_length or not lane_agreement then 'warn' when r1_layout or r2_length or lane_agreement then 'pass' else 'limited' end status from c""",
)
def fastq_bam_consistency(spark: SparkSession, folder: str) -> DataFrame:
    bam = V.table(spark, folder, "customer").select(
        F.concat(F.lit("set_"), F.col("c_custkey").cast("string")).alias("dataset_id"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Generic alignment").otherwise(K.SC_RNA).alias("assay"),
        F.when(F.col("c_nationkey") == 3, 0).otherwise(16).alias("barcode_length"),
        F.when(F.col("c_nationkey") % 2 == 0, 12).otherwise(10).alias("umi_length"),
        (F.col("c_custkey") % 60 + 40).alias("read_length_median"),
    )
    return inference.consistency(bam, _run(spark, folder))
