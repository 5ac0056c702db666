"""Queries over alignment records, reference dictionaries and barcodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import constants as K
from ..operators import alignments as ops
from ..operators import barcodes, compare, contigs, convergence, histograms, inference, knee
from ..session import materialize
from . import views as V
from .registry import query

ALN = V.ALIGNMENTS_SQL
GENES = V.GENE_ALIGNMENTS_SQL


def _records(spark: SparkSession, folder: str) -> int:
    """Alignment records, as the footers of the table tell."""
    return V.table(spark, folder, "lineitem").count()


def _round(df: DataFrame, *names: str, digits: int = 8) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _margin(p: str, n: str) -> str:
    return (
        f"1.96*sqrt(({p})*(1-({p}))/{n}+1.96*1.96/(4.0*{n}*cast({n} as double)))/(1+1.96*1.96/{n})"
    )


@query(
    "per_reference_qc",
    f"""with a as ({ALN}),
d as (select ref_name,pos,read_name,flag,max(mapq) mapq,max(cb) cb from a group by ref_name,pos,read_name,flag),
g as (select ref_name,count(*) n,sum(case when (flag & 4)=0 then 1 else 0 end) m,
        sum(case when (flag & 1024)<>0 then 1 else 0 end) dup,count(distinct cb) cbs,quantile_disc(mapq,0.5) med from d group by ref_name)
select ref_name, cast(n as bigint) records, cast(m as bigint) mapped, cast(dup as bigint) duplicates,
  cast(cbs as bigint) barcodes, cast(med as bigint) mapq_median, round(cast(m as double)/n,6) mapped_fraction,
  round(1.96*sqrt((cast(m as double)/n)*(1-cast(m as double)/n)/n+1.96*1.96/(4.0*n*n))/(1+1.96*1.96/n),6) mapped_margin
from g""",
)
def per_reference_qc(spark: SparkSession, folder: str) -> DataFrame:
    return ops.per_reference_qc(V.alignments(spark, folder))


_SURVIVOR = "record_no, mapq, l_seq, spliced, cb, ub, gx, re, nh"


@query(
    "dedup_records",
    f"""select file, ref_id, pos, read_name, flag, mapq, cast(l_seq as bigint) l_seq, cb, ub from (
select *, row_number() over (partition by file, ref_id, pos, read_name, flag
  order by record_no, mapq, l_seq, spliced, cb nulls first, ub nulls first, gx nulls first, re, nh) k from ({ALN}) a) where k = 1""",
)
def dedup_records(spark: SparkSession, folder: str) -> DataFrame:
    order = [c.strip() for c in _SURVIVOR.split(",")]
    kept = ops.dedup_records(V.alignments(spark, folder), order, by=["file"])
    return kept.select(
        "file", "ref_id", "pos", "read_name", "flag", "mapq", F.col("l_seq").cast("bigint").alias("l_seq"), "cb", "ub"
    )


_FLAGS_SQL = " union all ".join(
    f"select '{n}' as name, cast(sum(case when {c} then 1 else 0 end) as bigint) n, count(*) t from a"
    for n, c in (
        ("mapped", "(flag & 4) = 0"),
        ("unmapped", "(flag & 4) <> 0"),
        ("paired", "(flag & 1) <> 0"),
        ("proper_pair", "(flag & 2) <> 0"),
        ("duplicate", "(flag & 1024) <> 0"),
        ("secondary", "(flag & 256) <> 0"),
        ("supplementary", "(flag & 2048) <> 0"),
    )
)
_DISTINCT = f"with a as (select distinct ref_id, pos, read_name, flag from ({ALN}) x)"


@query(
    "flag_counts",
    f"""{_DISTINCT} select name, n, round(n/t, 8) estimate, round({_margin('n/t', 't')}, 8) margin from ({_FLAGS_SQL}) f""",
)
def flag_counts(spark: SparkSession, folder: str) -> DataFrame:
    once = ops.dedup_records(V.alignments(spark, folder), keep=ops.RECORD_KEY)
    return _round(ops.flag_counts(once), "estimate", "margin")


@query(
    "alignment_classes",
    f"""{_DISTINCT}, c as (select case when (flag & 4) <> 0 then 'unmapped' when (flag & 256) <> 0 then 'secondary' when (flag & 2048) <> 0 then 'supplementary' else 'primary' end name from a),
f as (select k.name, cast(count(c.name) as bigint) n, (select count(*) from a) t from (values ('primary'),('secondary'),('supplementary'),('unmapped')) k(name) left join c on c.name = k.name group by k.name)
select name, n, round(n/t, 8) estimate, round({_margin('n/t', 't')}, 8) margin from f""",
)
def alignment_classes(spark: SparkSession, folder: str) -> DataFrame:
    once = ops.dedup_records(V.alignments(spark, folder), keep=ops.RECORD_KEY)
    return _round(ops.alignment_classes(once), "estimate", "margin")


@query(
    "region_counts",
    f"""with a as ({ALN}), g as (select file, re, count(*) n, sum(count(*)) over (partition by file) t from a group by file, re)
select file, re region, case re when 'E' then 'Exonic' when 'N' then 'Intronic' else 'Intergenic' end as label, n,
  round(n/cast(t as double), 8) estimate, round({_margin('n/cast(t as double)', 'cast(t as double)')}, 8) margin from g where re is not null""",
)
def region_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _round(ops.region_counts(V.alignments(spark, folder), ["file"]), "estimate", "margin")


@query(
    "mapq_histogram",
    f"""with a as ({ALN}), f as (select distinct file from a)
select f.file, cast(m as int) mapq, count(a.mapq) n from f cross join range(256) r(m) left join a on a.file = f.file and a.mapq = m group by all""",
)
def mapq_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return ops.mapq_histogram(V.alignments(spark, folder), ["file"])


@query("read_length_histogram", f"select l_seq, count(*) n from ({ALN}) a group by l_seq")
def read_length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return ops.read_length_histogram(V.alignments(spark, folder))


@query(
    "record_medians",
    f"""select file, cast(quantile_disc(mapq, 0.5) as bigint) mapq_median, cast(quantile_disc(l_seq, 0.5) as bigint) read_length_median
from ({ALN}) a group by file""",
)
def record_medians(spark: SparkSession, folder: str) -> DataFrame:
    return ops.medians(V.alignments(spark, folder), ["file"])


@query(
    "spliced_multimapped",
    f"""select file, count(*) records, cast(sum(case when spliced then 1 else 0 end) as bigint) spliced,
cast(sum(case when nh > 1 then 1 else 0 end) as bigint) multimapped from ({ALN}) a group by file""",
)
def spliced_multimapped(spark: SparkSession, folder: str) -> DataFrame:
    totals = ops.record_totals(V.alignments(spark, folder), ["file"])
    return totals.select("file", "records", "spliced", "multimapped")


_TAGS = ("cb", "ub", "gx", "gn", "re", "nh")


@query(
    "tag_presence",
    f"""with a as ({GENES}), t as ({' union all '.join(f"select '{t.upper()}' tag, count({t}) n, count(*) r from a" for t in _TAGS)})
select tag, n, round(n/r, 8) fraction from t where n > 0""",
)
def tag_presence(spark: SparkSession, folder: str) -> DataFrame:
    aln = V.alignments(spark, folder, genes=True)
    tags = F.array_compact(F.array(*[F.when(F.col(t).isNotNull(), t.upper()) for t in _TAGS]))
    return _round(ops.tag_presence(aln.select(tags.alias("tags_present"))), "fraction")


@query(
    "reference_names",
    f"""with a as ({ALN}), c as (select ref_id, count(*) n from a group by ref_id)
select c.ref_id, coalesce(r.n_name, cast(c.ref_id as varchar)) as name, n from c left join (select * from nation where n_regionkey <> 2) r on r.n_nationkey = c.ref_id""",
)
def reference_names(spark: SparkSession, folder: str) -> DataFrame:
    """Left join to a dictionary that misses some references."""
    refs = (
        V.table(spark, folder, "nation")
        .filter("n_regionkey <> 2")
        .select(F.col("n_nationkey").alias("ref_id"), F.col("n_name").alias("name"))
    )
    return ops.records_per_reference(V.alignments(spark, folder), refs)


@query(
    "read_groups_topk",
    f"""select * from (select concat('rg', cast(l_seq as varchar)) rg, count(*) n from ({ALN}) a group by l_seq) g order by n desc, rg limit 20""",
)
def read_groups_topk(spark: SparkSession, folder: str) -> DataFrame:
    aln = V.alignments(spark, folder)
    return ops.read_groups(aln.select(F.concat(F.lit("rg"), F.col("l_seq").cast("string")).alias("rg")))


@query(
    "sampled_coverage",
    f"""select file, count(distinct concat(cast(ref_id as varchar), ':', cast(4681 + (pos >> 7) as varchar), ':', cast(nh as varchar))) regions,
  count(distinct ref_id) "references" from ({ALN}) a group by file""",
)
def sampled_coverage(spark: SparkSession, folder: str) -> DataFrame:
    aln = V.alignments(spark, folder)
    region = A.region_id(F.col("ref_id"), F.shiftright("pos", 7) + 4681, F.col("nh"))
    return ops.coverage(aln.select("file", "ref_id", region.alias("region")), ["file"])


# Barcodes

_BARCODES = f"(select cb, count(*) reads from ({ALN}) a where cb is not null and cb <> '' group by cb)"


@query(
    "barcode_rank",
    f"select cb, reads, row_number() over (order by reads desc, cb) as rank from {_BARCODES} t",
)
def barcode_rank(spark: SparkSession, folder: str) -> DataFrame:
    ranked = barcodes.ranked_barcodes(barcodes.barcode_counts(V.alignments(spark, folder)))
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


_MOLS = f"""(select cb, nullif(ub, '') ub, coalesce(nullif(gx, ''), nullif(gn, '')) gene, count(*) reads,
  sum(case when lower(ref_name) in ('chrm', 'mt', 'm') then 1 else 0 end) mito from ({GENES}) a where cb is not null and cb <> '' group by 1, 2, 3)"""
_METRICS = f"""(select cb, cast(sum(reads) as bigint) reads, count(distinct ub) umis, count(distinct split_part(gene, ';', 1)) genes, sum(mito)/sum(reads) mito_fraction from {_MOLS} m group by cb)"""


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    aln = V.alignments(spark, folder, genes=True)
    return materialize(barcodes.barcode_metrics(barcodes.molecules(aln)), "barcodes", _records(spark, folder))


@query(
    "barcode_metrics",
    f"""select row_number() over (order by reads desc, cb) as rank, cb, reads, umis, genes, round(mito_fraction, 8) mito_fraction
from {_METRICS} t""",
)
def barcode_metrics(spark: SparkSession, folder: str) -> DataFrame:
    ranked = barcodes.ranked_barcodes(_metrics(spark, folder))
    return _round(ranked, "mito_fraction").withColumn("rank", F.col("rank").cast("bigint"))


def _knee_sql(source: str, key: str, by: str = "") -> str:
    """Knee over every rank of the full barcode table, in SQL."""
    part = f"partition by {by} " if by else ""
    lead = f"{by}, " if by else ""
    return f"""with c as (select {lead}{key} k, count(*) n from {source} where {key} is not null group by {lead}{key}),
k as (select {lead}n, row_number() over ({part}order by n desc, k)-1 i, count(*) over ({part}) t from c),
p as (select *, greatest(1,cast(floor(t*0.002) as bigint)) s from k), q as (select *, greatest(s+10, cast(floor(t*0.92) as bigint)) e from p),
z as (select *, log10(s+1) x1, log10(e+1) x2, log10(max(case when i=s then n end) over ({part})) y1, log10(max(case when i=e then greatest(1,n) end) over ({part})) y2 from q),
w as (select {lead}i,n,t, abs((y2-y1)*log10(i+1)-(x2-x1)*log10(n)+x2*y1-y2*x1)/sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) dist from z where i>s and i<e and t>=50),
r as (select *, row_number() over ({part}order by round(dist, 12) desc, i) o from w)
select {lead}cast(i+1 as bigint) estimated_cells, n as threshold_reads, case when t >= 500 and dist > 0.08 then 'medium' else 'low' end as confidence, round(dist,6) curvature from r where o = 1"""


@query("barcode_knee", _knee_sql(f"({ALN}) a", "cb"))
def barcode_knee(spark: SparkSession, folder: str) -> DataFrame:
    counts = barcodes.barcode_counts(V.alignments(spark, folder))
    return _round(knee.barcode_knee(knee.count_of_counts(counts)), "curvature", digits=6)


@query("user_activity_knee", _knee_sql("events", "user_id", "event_type"))
def user_activity_knee(spark: SparkSession, folder: str) -> DataFrame:
    """The same knee over event counts per user, one per event type."""
    counts = V.table(spark, folder, "events").groupBy("event_type", "user_id").agg(
        F.count(F.lit(1)).alias("reads")
    )
    hist = knee.count_of_counts(counts, by=["event_type"])
    return _round(knee.barcode_knee(hist, ["event_type"]), "curvature", digits=6)


@query(
    "barcode_shape",
    f"""with m as {_METRICS}, b as (select file, m.* from m cross join (select 'all' file) f),
kn as ({_knee_sql('(select cb, unnest(range(reads)) u from ' + _METRICS + ' mm)', 'cb')}),
r as (select b.*, row_number() over (order by reads desc, umis desc, genes desc, cb) rk, coalesce((select estimated_cells from kn), 0) k from b)
select count(*) barcodes, median(reads) reads_median, median(umis) umis_median, median(genes) genes_median,
  median(reads) filter (where rk <= k) cell_reads_median, median(umis) filter (where rk <= k) cell_umis_median, median(genes) filter (where rk <= k) cell_genes_median,
  round(coalesce(sum(reads) filter (where rk > k), 0) / sum(reads), 8) ambient_tail_fraction,
  round(quantile_cont(mito_fraction, 0.25), 8) mito_p25, round(quantile_cont(mito_fraction, 0.5), 8) mito_median, round(quantile_cont(mito_fraction, 0.75), 8) mito_p75
from r""",
)
def barcode_shape(spark: SparkSession, folder: str) -> DataFrame:
    shape = barcodes.barcode_shape(_metrics(spark, folder))
    return _round(shape, "ambient_tail_fraction", "mito_p25", "mito_median", "mito_p75")


@query(
    "unique_molecules",
    f"""select file, count(*) molecules from (select distinct file, cb, ub, coalesce(nullif(gx, ''), nullif(gn, ''), '') g from ({GENES}) a
where coalesce(cb, '') <> '' and coalesce(ub, '') <> '') t group by file""",
)
def unique_molecules(spark: SparkSession, folder: str) -> DataFrame:
    aln = V.alignments(spark, folder, genes=True)
    found = barcodes.unique_molecules(barcodes.molecules(aln, by=["file"]), ["file"])
    return materialize(found, "molecules", _records(spark, folder))


_TOKENS = f"""(select file, unnest(list_filter(string_split(coalesce(nullif(gn, ''), nullif(gx, '')),';'), lambda x: x<>'')) gene
  from ({GENES}) a where coalesce(nullif(gn, ''), nullif(gx, '')) is not null)"""


@query("top_genes", f"select gene, count(*) n from {_TOKENS} t group by gene order by n desc, gene limit 15")
def top_genes(spark: SparkSession, folder: str) -> DataFrame:
    return ops.top_genes(V.alignments(spark, folder, genes=True))


@query("unique_genes", f"select file, count(distinct gene) genes from {_TOKENS} t group by file")
def unique_genes(spark: SparkSession, folder: str) -> DataFrame:
    return ops.unique_genes(V.alignments(spark, folder, genes=True), by=["file"])


# Statistics over other columns


@query(
    "histogram_median_lower",
    """with h as (select l_returnflag, cast(l_quantity as bigint) v from lineitem)
select l_returnflag, quantile_disc(v, 0.5) as value from h group by l_returnflag""",
)
def histogram_median_lower(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.table(spark, folder, "lineitem").select("l_returnflag", F.col("l_quantity").cast("bigint").alias("v"))
    hist = histograms.value_counts(rows, "v", ["l_returnflag"])
    return histograms.histogram_quantile(hist, "v", "n", 0.5, ["l_returnflag"])


@query(
    "histogram_percentile_lower",
    """with h as (select l_returnflag, cast(l_quantity as bigint) v, row_number() over (partition by l_returnflag order by l_quantity) - 1 i, count(*) over (partition by l_returnflag) n from lineitem)
select l_returnflag, max(case when i = cast(floor(0.9*(n-1)) as bigint) then v end) as value from h group by l_returnflag""",
)
def histogram_percentile_lower(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.table(spark, folder, "lineitem").select("l_returnflag", F.col("l_quantity").cast("bigint").alias("v"))
    hist = histograms.value_counts(rows, "v", ["l_returnflag"])
    return histograms.histogram_quantile(hist, "v", "n", 0.9, ["l_returnflag"])


@query(
    "price_quartiles",
    """select l_returnflag, round(quantile_cont(d, 0.25), 10) p25, round(quantile_cont(d, 0.5), 10) p50, round(quantile_cont(d, 0.75), 10) p75
from (select l_returnflag, l_extendedprice/200000 d from lineitem) t group by l_returnflag""",
)
def price_quartiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact interpolated quartiles of a column with unbounded cardinality."""
    rows = V.table(spark, folder, "lineitem").select(
        "l_returnflag", (F.col("l_extendedprice") / 200000).alias("d")
    )
    probs = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    return _round(histograms.unit_quantiles(rows, "d", probs, ["l_returnflag"]), *probs, digits=10)


@query(
    "proportion_margins",
    f"""select l_returnflag, n, round(n/t, 8) estimate, round({_margin('n/t', 't')}, 8) margin from (select l_returnflag, count(*) n, cast((select count(*) from lineitem) as double) t from lineitem group by l_returnflag) g""",
)
def proportion_margins(spark: SparkSession, folder: str) -> DataFrame:
    lines = V.table(spark, folder, "lineitem")
    counts = lines.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    out = counts.select(
        "l_returnflag",
        "n",
        A.proportion(F.col("n"), total).alias("estimate"),
        A.wilson_margin(F.col("n"), total).alias("margin"),
    )
    return _round(out, "estimate", "margin")


# Contigs and reference dictionaries


@query(
    "fai_n50",
    """with a as (select lang, n_chars len, sum(n_chars) over (partition by lang order by n_chars desc, doc_id rows unbounded preceding) cum,
  row_number() over (partition by lang order by n_chars desc, doc_id) rk, sum(n_chars) over (partition by lang) total from documents)
select lang, count(*) contigs, cast(sum(len) as bigint) total_length, arg_min(len, rk) filter (where cum >= total/2) n50, min(rk) filter (where cum >= total/2) l50,
  max(len) longest, min(len) shortest from a group by lang""",
)
def fai_n50(spark: SparkSession, folder: str) -> DataFrame:
    return contigs.fai_summary(V.table(spark, folder, "documents"), ["lang"], "n_chars")


@query(
    "fai_n50_total",
    """with a as (select n_chars len, sum(n_chars) over (order by n_chars desc, doc_id rows unbounded preceding) cum,
  row_number() over (order by n_chars desc, doc_id) rk, sum(n_chars) over () total from documents)
select count(*) contigs, cast(sum(len) as bigint) total_length, arg_min(len, rk) filter (where cum >= total/2) n50, min(rk) filter (where cum >= total/2) l50,
  max(len) longest, min(len) shortest from a""",
)
def fai_n50_total(spark: SparkSession, folder: str) -> DataFrame:
    return contigs.fai_summary(V.table(spark, folder, "documents"), (), "n_chars")


_FINGERPRINT_SQL = f"""with r as ({V.REFS_SQL}), k as (select *, regexp_matches(name, '{K.MITO_PATTERN}') mito, regexp_matches(name, '{K.ALT_DECOY_PATTERN}') alt from r),
s as (select *, length < 1000000 and not mito and not alt small from k),
b(o, label, len) as (values (0,'GRCh38 / hg38',248956422),(1,'GRCh37 / hg19',249250621),(2,'GRCm38 / mm10',195471971),(3,'GRCm39 / mm39',195154279)),
h as (select file, min(o * 2 + case when name = 'chr1' then 0 else 1 end) hit from r join b on b.len = r.length and name in ('chr1', '1') group by file),
c as (select file, count(*) reference_count, count(*) filter (where regexp_matches(name, '(?i)^chr')) cn,
 count(*) filter (where regexp_matches(name, '{K.CHR_NAME_PATTERN}')) cl, count(*) filter (where regexp_matches(name, '{K.BARE_NAME_PATTERN}')) bl,
 count(*) filter (where regexp_matches(name, '{K.PRIMARY_CHR_PATTERN}')) pc, count(*) filter (where regexp_matches(name, '{K.PRIMARY_BARE_PATTERN}')) pb,
 arg_min(name, ref_id) filter (where mito) mitochondrial, count(*) filter (where regexp_matches(name, '{K.SEX_PATTERN}')) sex_chromosomes,
 count(*) filter (where alt) alt_decoy_count, count(*) filter (where small) small_count from s group by file),
d as (select c.*, hit, cn >= reference_count - cn chrs, case when cn >= reference_count - cn then pc else pb end primary_count from c left join h on h.file = c.file)
select d.file, coalesce((select label from b where o = hit // 2), 'Unknown reference') build, case when hit is null then 'low' else 'high' end confidence,
 case when hit is not null then case when hit % 2 = 0 then 'chr-prefixed' else 'non-prefixed' end when cl > bl then 'chr-prefixed' when bl > 0 then 'non-prefixed' else 'custom' end build_naming,
 case when chrs then 'chr-prefixed' else 'non-prefixed' end naming, primary_count, case when primary_count >= 20 then cast(24 as bigint) end expected_primary,
 primary_count >= 24 primary_complete, mitochondrial, sex_chromosomes, alt_decoy_count, small_count, least(20, small_count) small_shown, reference_count from d"""


@query("reference_fingerprint", _FINGERPRINT_SQL)
def reference_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return contigs.fingerprint(V.references(spark, folder))


@query(
    "special_contigs",
    f"""with k as (select *, case when regexp_matches(name, '{K.ALT_DECOY_PATTERN}') then 'alt_decoy' when length < 1000000 and not regexp_matches(name, '{K.MITO_PATTERN}') then 'small' end kind from ({V.REFS_SQL}) r)
select file, kind, position, name from (select *, row_number() over (partition by file, kind order by ref_id) as position from k where kind is not null) t where position <= 20""",
)
def special_contigs(spark: SparkSession, folder: str) -> DataFrame:
    out = contigs.special_contigs(V.references(spark, folder))
    return out.withColumn("position", F.col("position").cast("bigint"))


# Interpretation

_PROGRAM_SQL = "case when file = 'sample_0' then 'CellRanger count' else 'star' end"


def _program(spark: SparkSession) -> F.Column:
    return F.when(F.col("file") == "sample_0", "CellRanger count").otherwise("star")


_PROFILE_SQL = f"""(select file, count(*) records, count(cb)/count(*) cb_share, count(ub)/count(*) ub_share, count(gx)/count(*) gx_share, count(gn)/count(*) gn_share, count(re)/count(*) re_share,
  arg_min(length(split_part(cb, '-', 1)), record_no) filter (where length(split_part(cb, '-', 1)) > 0) barcode_length, arg_min(length(ub), record_no) filter (where cb <> '' and ub <> '') umi_length,
  count(*) filter (where (flag & 4) = 0) mapped, count(*) filter (where (flag & 1024) <> 0) duplicate from ({GENES}) a group by file)"""


@query(
    "assay_label",
    f"""with p as (select *, cb_share > 0.1 c, ub_share > 0.1 u, gx_share > 0.1 or gn_share > 0.1 g, re_share > 0.05 r, contains(lower({_PROGRAM_SQL}), 'cellranger') x from {_PROFILE_SQL} q),
s as (select *, (c and u and g) or x si from p)
select file, round(cb_share, 8) cb_share, round(ub_share, 8) ub_share, round(gx_share, 8) gx_share, round(gn_share, 8) gn_share, round(re_share, 8) re_share, barcode_length, umi_length,
 case when si then 'Single-cell RNA sequencing' when c and not u then 'Barcoded sequencing' else 'Generic alignment' end assay,
 case when si then case when c and u and g and r then 'high' else 'medium' end when c and not u then 'medium' else 'low' end assay_confidence,
 case when si then case when barcode_length = 16 and umi_length = 12 then 'Compatible with 3′ v3/v3.1' else '10x-like chemistry; read structure not fully resolved' end end chemistry,
 case when si then concat_ws(', ', case when barcode_length is not null then concat('CB ', cast(barcode_length as varchar), ' nt') end, case when umi_length is not null then concat('UB ', cast(umi_length as varchar), ' nt') end,
   case when g then 'GX/GN present' end, case when r then 'RE present' end, case when x then 'Cell Ranger @PG' end) end evidence from s""",
)
def assay_label(spark: SparkSession, folder: str) -> DataFrame:
    aln = V.alignments(spark, folder, genes=True)
    labelled = inference.assay(inference.tag_profile(aln, ["file"]), _program(spark))
    return _round(labelled, "cb_share", "ub_share", "gx_share", "gn_share", "re_share")


_KNEES_BY_FILE = _knee_sql(f"({ALN}) a", "cb", "file")
_MITO_BY_FILE = f"""(select file, median(m/r) mito_median from (select file, cb, count(*) r, sum(case when ref_name = 'chrM' then 1 else 0 end) m from ({ALN}) a where cb is not null group by file, cb) t group by file)"""


@query(
    "qc_flags",
    f"""with kn as ({_KNEES_BY_FILE}), j as (select p.*, kn.confidence kc, mito_median from {_PROFILE_SQL} p left join kn on kn.file = p.file left join {_MITO_BY_FILE} m on m.file = p.file)
select file, cast(1 as int) check_no, 'alignment' as "check", case when mapped/records >= 0.9 then 'good' else 'warn' end as level, 'Alignment fraction' as label, round(mapped/records, 8) as value from j
union all select file, 2, 'duplication', case when duplicate/records <= 0.5 then 'good' else 'warn' end, 'Duplicate reads', round(duplicate/records, 8) from j
union all select file, 3, 'gene-assignment', case when greatest(gx_share, gn_share) >= 0.5 then 'good' else 'warn' end, 'Gene assignment tags', round(greatest(gx_share, gn_share), 8) from j
union all select file, 4, 'mitochondrial', case when mito_median is null or mito_median <= 0.2 then 'good' else 'warn' end, 'Mitochondrial signal', round(mito_median, 8) from j
union all select file, 5, 'barcode-knee', case when kc = 'medium' then 'good' else 'warn' end, 'Barcode knee', null from j
union all select file, 6, 'reference-contigs', 'good', 'Reference contigs', 0 from j""",
)
def qc_flags(spark: SparkSession, folder: str) -> DataFrame:
    needed = ("file", "record_no", "ref_name", "flag", "cb", "ub", "gx", "gn", "re")
    count = _records(spark, folder)
    aln = materialize(V.alignments(spark, folder, genes=True).select(*needed), "records", count)
    metrics = materialize(barcodes.barcode_metrics(barcodes.molecules(aln, by=["file"]), ["file"]), "barcodes", count)
    knees = knee.barcode_knee(knee.count_of_counts(metrics, by=["file"]), ["file"])
    mito = histograms.unit_quantiles(metrics, "mito_fraction", {"mito_median": 0.5}, ["file"])
    refs = (
        V.table(spark, folder, "nation")
        .select(
            F.lit("reference").alias("file"),
            F.col("n_nationkey").alias("ref_id"),
            F.when(F.col("n_nationkey") == 24, "chrM")
            .otherwise(F.concat(F.lit("chr"), (F.col("n_nationkey") + 1).cast("string")))
            .alias("name"),
            F.lit(50_000_000).cast("bigint").alias("length"),
        )
    )
    special = contigs.fingerprint(refs).select(F.col("small_count") + F.col("alt_decoy_count"))
    row = (
        aln.groupBy("file")
        .agg(*ops.total_columns(("file", "flag")), *inference.profile_columns())
        .join(knees.select("file", F.col("confidence").alias("knee_confidence")), "file", "left")
        .join(mito, "file", "left")
        .withColumn("special_contigs", special.scalar())
    )
    return _round(inference.qc_flags(row, ["file"]).drop("note"), "value")


def convergence_sql(source: str, batch: int, by: str = "one") -> str:
    """Snapshots per point with the stop rule; ``source`` has point_no mapq l_seq re cb and ``by``."""
    return f"""with p as {source}, c as (select {by}, point_no, count(*) n, count(*) filter (where re = 'E') e from p group by all),
f as (select {by}, cb, min(point_no) point_no from p where cb is not null group by all), nb as (select {by}, point_no, count(*) b from f group by all),
s as (select c.{by}, c.point_no, cast(sum(n) over w as bigint) records, sum(e) over w e, sum(coalesce(b,0)) over w b from c left join nb on nb.point_no = c.point_no and nb.{by} = c.{by} window w as (partition by c.{by} order by c.point_no)),
q as (select s.*, (select quantile_disc(mapq, 0.5) from p where p.point_no <= s.point_no and p.{by} = s.{by}) mapq_median, (select quantile_disc(l_seq, 0.5) from p where p.point_no <= s.point_no and p.{by} = s.{by}) read_length_median from s),
k as (select {by}, point_no, records, e/records ef, b/records br, mapq_median mm, read_length_median lm, records // {batch} cp, records // {batch} - coalesce(lag(records) over (partition by {by} order by point_no) // {batch}, 0) cr from q),
l as (select *, lag(case when cr > 0 then ef end ignore nulls) over w pe, lag(case when cr > 0 then br end ignore nulls) over w pb, lag(case when cr > 0 then mm end ignore nulls) over w pm, lag(case when cr > 0 then lm end ignore nulls) over w pl from k window w as (partition by {by} order by point_no)),
g as (select *, case when cr > 1 then true when cr = 1 then pe is not null and abs(ef-pe) <= 0.01 and abs(br-pb) <= 0.01 and abs(mm-pm) <= 2 and abs(lm-pl) <= 2 end agree from l),
t as (select *, cp >= 4 and coalesce(last_value(agree ignore nulls) over (partition by {by} order by point_no), false) stable from g)
select {by}, point_no, records, round(ef, 8) exonic_fraction, round(br, 8) barcode_rate, cast(mm as bigint) mapq_median, cast(lm as bigint) read_length_median, cp checkpoints, cr crossed, stable,
 stable and coalesce(max(cast(stable as int)) over b4, 0) = 0 stop_here, coalesce(max(cast(stable as int)) over b4, 0) = 1 past_stop
from t window b4 as (partition by {by} order by point_no rows between unbounded preceding and 1 preceding)"""


@query(
    "convergence_checkpoints",
    "select * exclude (one) from ("
    + convergence_sql(f"(select 1 one, ref_id point_no, mapq, l_seq, re, cb from ({ALN}) a)", 2500)
    + ") x",
)
def convergence_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """One seek point per reference, a checkpoint every 2,500 records."""
    records = V.alignments(spark, folder).select(
        F.col("ref_id").alias("point_no"), "mapq", "l_seq", "re", "cb"
    )
    out = convergence.convergence(convergence.snapshots(records), batch=2500)
    return _round(out, "exonic_fraction", "barcode_rate")


@query(
    "golden_compare",
    """with e as (select l_suppkey k, count(*) v from lineitem group by l_suppkey), o as (select l_suppkey k, sum(case when l_tax > 0.001 or l_discount > 0.04 or l_quantity < 48 then 1 else 0 end) v from lineitem group by l_suppkey)
select e.k as contig, cast(o.v as double) observed, cast(e.v as double) expected, greatest(1, e.v * 0.03) tolerance, abs(o.v - e.v) <= greatest(1, e.v * 0.03) "within" from e join o on o.k = e.k""",
)
def golden_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of most lines per supplier against all lines, within 3 %."""
    most = (F.col("l_tax") > 0.001) | (F.col("l_discount") > 0.04) | (F.col("l_quantity") < 48)
    both = V.table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("contig")).agg(
        F.count(F.lit(1)).alias("expected"), F.count_if(most).alias("observed")
    )
    observed = both.select("contig", F.col("observed").alias("value"))
    expected = both.select("contig", F.col("expected").alias("value"))
    return compare.outside_tolerance(observed, expected, "contig", absolute=1.0, relative=0.03)


_RULES_SQL = ", ".join(f"('{k}', {a}, {r}, '{d}', {str(q).lower()})" for k, a, r, d, q in compare.GOLDEN_RULES)


@query(
    "golden_rules",
    f"""with a as (select * from ({ALN}) x), rules(kind, absolute, relative, direction, required) as (values {_RULES_SQL}),
o as (select 'mapped' kind, ref_name as "key", cast(count(*) filter (where (flag & 4) = 0) as double) v from a group by 2
 union all select 'cells', file, count(distinct cb) from a group by 2 union all select 'r2_length', 'run', max(l_seq) from a
 union all select 'file_length', file, quantile_disc(l_seq, 0.5) from a where file <> 'sample_3' group by 2
 union all select 'region_coverage', s.file, count(g.ref_id) / count(*) from (select file, ref_id from (select distinct file from a) f, (select distinct ref_id from a) r) s
  left join (select file, ref_id from a where mapq > 49 and spliced group by all having count(*) >= 3) g on g.file = s.file and g.ref_id = s.ref_id group by 2),
e as (select 'mapped' kind, ref_name as "key", cast(count(*) as double) v from a group by 2
 union all select 'cells', file, count(*) / 2 from a group by 2 union all select 'r1_length', 'run', 28 union all select 'r2_length', 'run', 100
 union all select 'file_length', file, round(avg(l_seq)) from a group by 2 union all select 'region_coverage', file, 1 from a group by 2 union all select 'reads', 'run', count(*) from a),
j as (select e.kind, e."key", o.v observed, e.v expected, greatest(absolute, abs(e.v) * relative) tolerance, direction, required from e left join o on o.kind = e.kind and o."key" = e."key" left join rules r on r.kind = e.kind)
select kind, "key", round(observed, 8) observed, round(expected, 8) expected, round(tolerance, 8) tolerance, case when direction is null then 'no rule' when observed is null then case when required then 'missing' else 'skipped' end
 when direction <> 'most' and observed < expected - tolerance or direction <> 'least' and observed > expected + tolerance then 'outside' else 'within' end verdict from j""",
)
def golden_rules(spark: SparkSession, folder: str) -> DataFrame:
    """What the alignments give by six kinds of rules against what is expected of them, missing values included."""
    aln = V.alignments(spark, folder)

    def values(rows: DataFrame, kind: str, key: str | None, value) -> DataFrame:
        keyed = rows.groupBy(key) if key else rows.groupBy()
        name = F.col(key) if key else F.lit("run")
        return keyed.agg(value.cast("double").alias("value")).select(F.lit(kind).alias("kind"), name.alias("key"), "value")

    every, one = F.count(F.lit(1)), spark.range(1)
    refs = aln.agg(F.collect_set("ref_id").alias("refs")).scalar()
    strata = aln.select("file").distinct().select("file", F.explode(refs).alias("ref_id"))
    rich = aln.filter("mapq > 49 and spliced").groupBy("file", "ref_id").count().filter("count >= 3")
    observed = (
        values(aln, "mapped", "ref_name", F.count_if(F.col("flag").bitwiseAND(4) == 0))
        .unionByName(values(aln, "cells", "file", F.count_distinct("cb")))
        .unionByName(values(aln, "r2_length", None, F.max("l_seq")))
        .unionByName(values(aln.filter("file <> 'sample_3'"), "file_length", "file", histograms.lower_median("l_seq")))
        .unionByName(compare.represented_share(rich, strata, stratum="ref_id"))
    )
    expected = (
        values(aln, "mapped", "ref_name", every)
        .unionByName(values(aln, "cells", "file", every / 2))
        .unionByName(values(one, "r1_length", None, F.lit(28)))
        .unionByName(values(one, "r2_length", None, F.lit(100)))
        .unionByName(values(aln, "file_length", "file", F.round(F.avg("l_seq"))))
        .unionByName(values(aln, "region_coverage", "file", F.lit(1)))
        .unionByName(values(aln, "reads", None, every))
    )
    return _round(compare.judged(observed, expected, spark.createDataFrame(compare.GOLDEN_RULES, compare.RULE_SCHEMA)), "observed", "expected", "tolerance")


@query(
    "multi_sample_comparison",
    f"""with a as ({ALN}), t as (select file, count(*) filter (where (flag & 4) = 0) m, count(*) n, count(*) filter (where (flag & 1024) <> 0) d from a group by file), kn as ({_KNEES_BY_FILE})
select t.file, round(m/n, 8) mapped_fraction, n records, estimated_cells, cast(case when m/n >= 0.9 then 0 else 1 end + case when d/n <= 0.5 then 0 else 1 end as bigint) warnings
from t left join kn on kn.file = t.file where (select count(*) from t) > 1""",
)
def multi_sample_comparison(spark: SparkSession, folder: str) -> DataFrame:
    aln = V.alignments(spark, folder)
    totals = ops.record_totals(aln.select("file", "flag"), ["file"])
    mapped = A.proportion(F.col("mapped"), F.col("records"))
    duplicate = A.proportion(F.col("duplicate"), F.col("records"))
    warn = lambda good: F.when(good, 0).otherwise(1)
    knees = knee.barcode_knee(
        knee.count_of_counts(barcodes.barcode_counts(aln, ["file"]), by=["file"]), ["file"]
    )
    out = compare.sample_comparison(
        totals.select("file", mapped.alias("mapped_fraction")),
        totals.select("file", "records"),
        knees,
        totals.select(
            "file", (warn(mapped >= K.MAPPED_GOOD) + warn(duplicate <= K.DUPLICATE_GOOD)).alias("warnings")
        ),
    )
    return _round(out, "mapped_fraction")
