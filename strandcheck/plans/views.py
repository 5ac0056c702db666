"""Sequencing-shaped views of the given tables, for Spark and as SQL.

Each view has a DataFrame builder and a SQL text with the same rows, so a
query over it can be checked against another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder, read as its files are laid out."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _text(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


# Reads: one per document, as long as the text. Its letters stand for bases and qualities, all else is a space in between.
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_AS_BASES = ("ACGT" * 13)[:13] + "N" + ("ACGT" * 13)[14:]
_AS_QUALITIES = "".join(chr(33 + (7 * i + 11) % 41) for i in range(52)).replace("'", "&")
READS_SQL = f"""
select doc_id as read_id, translate(t, '{_LETTERS} ', '{_AS_BASES}N') as seq, translate(t, '{_LETTERS} ', '{_AS_QUALITIES}!') as qual, header
from (select doc_id, regexp_replace(text, '[^A-Za-z]', ' ', 'g') as t,
  concat('@', source, ':', cast(length(text) % 9 as varchar), ':', lang, ':', cast(doc_id % 8 + 1 as varchar), ':', cast(1101 + doc_id % 50 as varchar),
     ':', cast(doc_id as varchar), ':7 ', cast(doc_id % 2 + 1 as varchar), ':', case when doc_id % 5 = 0 then 'Y' else 'N' end, ':0:ACGT') as header
from documents) d
"""


def reads(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    letters = F.regexp_replace("text", "[^A-Za-z]", " ")
    header = F.concat(
        F.lit("@"), "source", F.lit(":"), _text(F.length("text") % 9), F.lit(":"), "lang", F.lit(":"),
        _text(F.col("doc_id") % 8 + 1), F.lit(":"), _text(F.col("doc_id") % 50 + 1101), F.lit(":"),
        _text("doc_id"), F.lit(":7 "), _text(F.col("doc_id") % 2 + 1), F.lit(":"),
        F.when(F.col("doc_id") % 5 == 0, "Y").otherwise("N"), F.lit(":0:ACGT"),
    )
    return docs.select(
        F.col("doc_id").alias("read_id"),
        F.translate(letters, f"{_LETTERS} ", f"{_AS_BASES}N").alias("seq"),
        F.translate(letters, f"{_LETTERS} ", f"{_AS_QUALITIES}!").alias("qual"),
        header.alias("header"),
    )


# Raw four-line records: reads with defects that depend on the read id.
RAW_READS_SQL = f"""
select read_id,
  case when read_id % 37 = 5 then substr(header, 2) else header end as header,
  case when read_id % 41 = 7 then lower(seq) when read_id % 43 = 9 then concat(seq, '*') when read_id % 47 = 0 then concat(' ', seq, ' ') else seq end as seq,
  case when read_id % 53 = 11 then '' else '+' end as plus,
  case when read_id % 59 = 13 then substr(qual, 2) when read_id % 43 = 9 then concat(qual, 'I') when read_id % 61 = 3 then concat(substr(qual, 2), 'é') else qual end as qual
from ({READS_SQL}) x
"""


def raw_reads(spark: SparkSession, folder: str) -> DataFrame:
    base, i = reads(spark, folder), F.col("read_id")
    return base.select(
        "read_id",
        F.when(i % 37 == 5, F.expr("substr(header, 2)")).otherwise(F.col("header")).alias("header"),
        F.when(i % 41 == 7, F.lower("seq"))
        .when(i % 43 == 9, F.concat("seq", F.lit("*")))
        .when(i % 47 == 0, F.concat(F.lit(" "), "seq", F.lit(" ")))
        .otherwise(F.col("seq"))
        .alias("seq"),
        F.when(i % 53 == 11, "").otherwise("+").alias("plus"),
        F.when(i % 59 == 13, F.expr("substr(qual, 2)"))
        .when(i % 43 == 9, F.concat("qual", F.lit("I")))
        .when(i % 61 == 3, F.concat(F.expr("substr(qual, 2)"), F.lit("é")))
        .otherwise(F.col("qual"))
        .alias("qual"),
    )


_CORE_SQL = """cast(n_nationkey as int) ref_id,
 case when n_nationkey=24 then 'chrM' else concat('chr', cast(n_nationkey+1 as varchar)) end ref_name,
 l_orderkey pos, concat('r', cast(l_orderkey as varchar), ':', cast(l_linenumber as varchar)) read_name,
 cast(l_quantity as int) mapq,
 (1 | (case when l_linestatus='F' then 2 else 0 end) | (case when l_returnflag='R' and l_quantity<10 then 4 else 0 end)
    | (case when l_tax>0.075 then 256 else 0 end) | (case when l_discount>0.085 then 1024 else 0 end)
    | (case when l_linenumber=7 then 2048 else 0 end)) flag,
 cast(50+l_quantity as int) l_seq, (l_partkey % 3 = 0) spliced,
 case when l_partkey % 13 <> 0 then concat(translate(substr(md5(cast(cast(floor(power(l_partkey,3)/4000000.0) as bigint) as varchar)),1,16),'0123456789abcdef','ACGTACGTACGTACGT'),'-1') end cb,
 case when l_partkey % 7 <> 0 then translate(substr(md5(concat('u',cast(l_orderkey % 97 as varchar))),1,12),'0123456789abcdef','ACGTACGTACGTACGT') end ub,
 case when l_partkey % 5 <> 0 then concat('ENSG',cast(l_partkey as varchar)) end gx,
 case l_returnflag when 'A' then 'E' when 'N' then 'N' else 'I' end re, l_linenumber nh,
 concat('sample_', cast(l_suppkey % 4 as varchar)) file,
 l_orderkey * 8 + l_linenumber record_no"""

# Alignments without gene names: no part join needed.
ALIGNMENTS_SQL = f"""select {_CORE_SQL}
from lineitem join supplier on s_suppkey=l_suppkey join nation on n_nationkey=s_nationkey"""

# Alignments with gene names, from the words of the part name.
GENE_ALIGNMENTS_SQL = f"""select {_CORE_SQL},
 case when l_partkey % 11 <> 0 then replace(p_name,' ',';') end gn
from lineitem join supplier on s_suppkey=l_suppkey join nation on n_nationkey=s_nationkey join part on p_partkey=l_partkey"""


def alignments(spark: SparkSession, folder: str, genes: bool = False) -> DataFrame:
    """Alignment records from line items, placed by the supplier's nation."""
    return as_alignments(alignment_lines(spark, folder, genes), genes)


def alignment_lines(spark: SparkSession, folder: str, genes: bool = False) -> DataFrame:
    """The line items that :func:`as_alignments` makes alignment records of.

    The part table is joined only where gene names are wanted. No join has a
    broadcast hint: Spark broadcasts a side only below its size threshold.
    """
    lines = table(spark, folder, "lineitem")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    rows = lines.join(suppliers, F.col("s_suppkey") == F.col("l_suppkey"))
    if genes:
        parts = table(spark, folder, "part").select("p_partkey", "p_name")
        rows = rows.join(parts, F.col("p_partkey") == F.col("l_partkey"))
    return rows


def as_alignments(rows: DataFrame, genes: bool = False) -> DataFrame:
    """Line items as alignment records, row by row."""
    bit = lambda condition, value: F.when(condition, value).otherwise(0)
    flag = (
        F.lit(1)
        .bitwiseOR(bit(F.col("l_linestatus") == "F", 2))
        .bitwiseOR(bit((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 10), 4))
        .bitwiseOR(bit(F.col("l_tax") > 0.075, 256))
        .bitwiseOR(bit(F.col("l_discount") > 0.085, 1024))
        .bitwiseOR(bit(F.col("l_linenumber") == 7, 2048))
    )
    letters = lambda text, n: F.translate(
        F.substring(F.md5(text), 1, n), "0123456789abcdef", "ACGTACGTACGTACGT"
    )
    part, exact = F.col("l_partkey"), F.col("l_partkey").cast("double")
    # a product is rounded once; Spark's pow() is at times one unit in the last place off
    cell = F.floor(exact * exact * exact / F.lit(4000000.0)).cast("bigint")
    columns = [
        F.col("s_nationkey").cast("int").alias("ref_id"),
        F.when(F.col("s_nationkey") == 24, "chrM")
        .otherwise(F.concat(F.lit("chr"), _text(F.col("s_nationkey") + 1)))
        .alias("ref_name"),
        F.col("l_orderkey").alias("pos"),
        F.concat(F.lit("r"), _text("l_orderkey"), F.lit(":"), _text("l_linenumber")).alias("read_name"),
        F.col("l_quantity").cast("int").alias("mapq"),
        flag.alias("flag"),
        (F.col("l_quantity") + 50).cast("int").alias("l_seq"),
        (part % 3 == 0).alias("spliced"),
        F.when(part % 13 != 0, F.concat(letters(_text(cell), 16), F.lit("-1"))).alias("cb"),
        F.when(
            part % 7 != 0, letters(F.concat(F.lit("u"), _text(F.col("l_orderkey") % 97)), 12)
        ).alias("ub"),
        F.when(part % 5 != 0, F.concat(F.lit("ENSG"), _text("l_partkey"))).alias("gx"),
        F.when(F.col("l_returnflag") == "A", "E")
        .when(F.col("l_returnflag") == "N", "N")
        .otherwise("I")
        .alias("re"),
        F.col("l_linenumber").alias("nh"),
        F.concat(F.lit("sample_"), _text(F.col("l_suppkey") % 4)).alias("file"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("record_no"),
    ]
    if genes:
        columns.append(F.when(part % 11 != 0, F.replace("p_name", F.lit(" "), F.lit(";"))).alias("gn"))
    return rows.select(*columns)


# Reference dictionaries: 25 assemblies of customers, named by position.
REFS_SQL = """
select concat('assembly_', cast(c_custkey % 25 as varchar)) file, cast(c_custkey // 25 as int) ref_id,
  case when c_custkey // 25 < 22 then concat(p, cast(c_custkey // 25 + 1 as varchar))
       when c_custkey // 25 = 22 then concat(p, 'X') when c_custkey // 25 = 23 then concat(p, 'Y')
       when c_custkey // 25 = 24 then case when p = '' then 'MT' else 'chrM' end
       when c_custkey // 25 % 4 = 0 then concat('chr1_KI', cast(c_custkey // 25 as varchar), 'v1_random')
       when c_custkey // 25 % 4 = 1 then concat('HLA-A*', cast(c_custkey // 25 as varchar))
       when c_custkey // 25 % 4 = 2 then concat('chrUn_', cast(c_custkey // 25 as varchar))
       else concat('chr', cast(c_custkey // 25 as varchar), '_decoy') end as name,
  case when c_custkey // 25 = 0 then case c_custkey % 25 % 5 when 0 then 248956422 when 1 then 249250621 when 2 then 195471971 when 3 then 195154279 else 1000 end
       when c_custkey // 25 < 24 then 50000000 + c_custkey
       else cast(abs(c_acctbal) * 200 as bigint) + 16569 end as length
from (select *, case when c_custkey % 25 % 3 = 2 then '' else 'chr' end p from customer)
"""


def references(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    group, place = key % 25, F.floor(key / 25)
    prefix = F.when(group % 3 == 2, "").otherwise("chr")
    number = _text(place)
    name = (
        F.when(place < 22, F.concat(prefix, _text(place + 1)))
        .when(place == 22, F.concat(prefix, F.lit("X")))
        .when(place == 23, F.concat(prefix, F.lit("Y")))
        .when(place == 24, F.when(prefix == "", "MT").otherwise("chrM"))
        .when(place % 4 == 0, F.concat(F.lit("chr1_KI"), number, F.lit("v1_random")))
        .when(place % 4 == 1, F.concat(F.lit("HLA-A*"), number))
        .when(place % 4 == 2, F.concat(F.lit("chrUn_"), number))
        .otherwise(F.concat(F.lit("chr"), number, F.lit("_decoy")))
    )
    kind = group % 5
    first = (
        F.when(kind == 0, 248956422)
        .when(kind == 1, 249250621)
        .when(kind == 2, 195471971)
        .when(kind == 3, 195154279)
        .otherwise(1000)
    )
    length = (
        F.when(place == 0, first)
        .when(place < 24, key + 50000000)
        .otherwise((F.abs("c_acctbal") * 200).cast("bigint") + 16569)
    )
    return table(spark, folder, "customer").select(
        F.concat(F.lit("assembly_"), _text(group)).alias("file"),
        place.cast("int").alias("ref_id"),
        name.alias("name"),
        length.cast("bigint").alias("length"),
    )


# File names of a sequencing run: one FASTQ per order, BAM and BAI per customer.
FILES_SQL = """
select concat('Sample ', cast(o_custkey as varchar), case when o_orderkey % 3 = 0 then concat('_S', cast(o_custkey % 9 + 1 as varchar)) else '' end,
    '_L00', cast(o_orderkey % 4 + 1 as varchar),
    case substr(o_orderpriority, 1, 1) when '1' then '_R1_001' when '2' then '_R2_001' when '3' then '-i1' when '4' then '_I2' else '' end,
    case when o_orderstatus = 'F' then '.fastq.gz' when o_orderstatus = 'O' then '.fastq' else '.FQ.GZ' end) as name,
  cast(floor(o_totalprice) as bigint) as size, o_orderdate as modified, o_orderkey * 2 as position
from orders
union all
select concat('Sample ', cast(c_custkey as varchar), case when c_custkey % 10 = 9 then '_S2' else '' end, '.bam'), c_custkey * 1000 + 7, null, c_custkey * 8 + 1 from customer
union all
select concat('sample ', cast(c_custkey as varchar), case when c_custkey % 10 = 9 then '_S2' else '' end, '.bam.bai'), c_custkey + 100, null, c_custkey * 8 + 3 from customer where c_mktsegment <> 'BUILDING'
union all
select concat('Sample ', cast(c_custkey as varchar), '.BAI'), c_custkey + 50, null, c_custkey * 8 + 5 from customer where c_nationkey % 3 = 0
union all
select concat('notes ', cast(s_suppkey as varchar), case when s_suppkey % 2 = 0 then '.txt' when s_suppkey % 3 = 0 then '.FAI' else '.bam.gz' end), s_suppkey, null, s_suppkey * 8 + 7 from supplier
"""


def run_files(spark: SparkSession, folder: str) -> DataFrame:
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    suppliers = table(spark, folder, "supplier")
    order, cust = F.col("o_orderkey"), F.col("c_custkey")
    first = F.substring("o_orderpriority", 1, 1)
    role = (
        F.when(first == "1", "_R1_001")
        .when(first == "2", "_R2_001")
        .when(first == "3", "-i1")
        .when(first == "4", "_I2")
        .otherwise("")
    )
    suffix = (
        F.when(F.col("o_orderstatus") == "F", ".fastq.gz")
        .when(F.col("o_orderstatus") == "O", ".fastq")
        .otherwise(".FQ.GZ")
    )
    fastq = orders.select(
        F.concat(
            F.lit("Sample "), _text("o_custkey"),
            F.when(order % 3 == 0, F.concat(F.lit("_S"), _text(F.col("o_custkey") % 9 + 1))).otherwise(""),
            F.lit("_L00"), _text(order % 4 + 1), role, suffix,
        ).alias("name"),
        F.floor("o_totalprice").alias("size"),
        F.col("o_orderdate").alias("modified"),
        (order * 2).alias("position"),
    )
    none = F.lit(None).cast(orders.schema["o_orderdate"].dataType)
    s2 = F.when(cust % 10 == 9, "_S2").otherwise("")
    bams = customers.select(
        F.concat(F.lit("Sample "), _text(cust), s2, F.lit(".bam")), cust * 1000 + 7, none, cust * 8 + 1
    )
    bais = customers.filter(F.col("c_mktsegment") != "BUILDING").select(
        F.concat(F.lit("sample "), _text(cust), s2, F.lit(".bam.bai")), cust + 100, none, cust * 8 + 3
    )
    short = customers.filter(F.col("c_nationkey") % 3 == 0).select(
        F.concat(F.lit("Sample "), _text(cust), F.lit(".BAI")), cust + 50, none, cust * 8 + 5
    )
    supp = F.col("s_suppkey")
    end = F.when(supp % 2 == 0, ".txt").when(supp % 3 == 0, ".FAI").otherwise(".bam.gz")
    notes = suppliers.select(F.concat(F.lit("notes "), _text(supp), end), supp, none, supp * 8 + 7)
    return fastq.union(bams).union(bais).union(short).union(notes)


# Index tables of the alignments, with defects at fixed bins and intervals.
_INDEXED_SQL = f"""select file, ref_id, cast(4681 + (((pos * 8191) % 536870912) >> 14) as int) bin, cast(((pos * 8191) % 536870912) >> 14 as int) "interval", nh - 1 chunk_index,
  ((ref_id * 40000000 + ((pos * 8191) % 536870912) // 16 + nh * 8) << 16) | ((pos * 37 + nh * 13) % 65536) voffset, flag from ({ALIGNMENTS_SQL}) a"""

CHUNKS_SQL = f"""
select file, ref_id, bin, chunk_index, case when bin % 17 = 3 then e + 5 when bin % 19 = 4 and chunk_index = 2 then b + (cast(1000000 as bigint) << 16) else b end beg,
  case when bin % 23 = 6 then b when bin % 29 = 7 then e + (cast(2000000000 as bigint) << 16) else e end "end"
from (select file, ref_id, bin, chunk_index, min(voffset) b, max(voffset) + 64 e from ({_INDEXED_SQL}) i group by all)
"""
LINEAR_SQL = f"""
select file, ref_id, "interval", case when "interval" % 31 = 5 then 0 when "interval" % 13 = 9 then greatest(65536, voffset - (cast(30000 as bigint) << 16)) else voffset end voffset
from (select file, ref_id, "interval", min(voffset) voffset from ({_INDEXED_SQL}) i group by all)
"""
META_SQL = f"""
select file, ref_id, case when ref_id % 9 = 4 then e + 9 else b end ref_beg, case when ref_id = 21 then e + (cast(3000000000 as bigint) << 16) else e end ref_end, mapped, placed_unmapped
from (select file, ref_id, min(voffset) b, max(voffset) + 64 e, cast(sum(case when (flag & 4) = 0 then 1 else 0 end) as bigint) mapped,
  cast(sum(case when (flag & 4) <> 0 then 1 else 0 end) as bigint) placed_unmapped from ({_INDEXED_SQL}) i group by all)
"""
INDEX_FILES_SQL = f"""
select file, 25 n_ref, case when file = 'sample_3' then null else count(*) // 50 end no_coordinate, cast(1100000000 as bigint) bam_size, case when file = 'sample_2' then 26 else 25 end bam_n_ref
from ({ALIGNMENTS_SQL}) a group by file
"""


def index_base(spark: SparkSession, folder: str) -> DataFrame:
    """Offsets and counts per chunk: all index tables follow from this one.

    At most seven chunks per bin and 32,768 bins per reference and file, so
    the table stops growing once the index is full.
    """
    rows = alignments(spark, folder).select("file", "ref_id", "pos", "nh", "flag")
    wrapped = (F.col("pos") * 8191) % 536870912
    interval = F.shiftright(wrapped, 14)
    block = F.col("ref_id").cast("bigint") * 40000000 + F.floor(wrapped / 16) + F.col("nh") * 8
    within = (F.col("pos") * 37 + F.col("nh") * 13) % 65536
    mapped = F.col("flag").bitwiseAND(4) == 0
    placed = rows.select(
        "file",
        "ref_id",
        interval.cast("int").alias("interval"),
        (F.col("nh") - 1).alias("chunk_index"),
        F.shiftleft(block, 16).bitwiseOR(within).alias("voffset"),
        mapped.alias("mapped"),
    )
    return placed.groupBy("file", "ref_id", "interval", "chunk_index").agg(
        F.min("voffset").alias("b"),
        (F.max("voffset") + 64).alias("e"),
        F.count_if("mapped").alias("mapped"),
        F.count_if(~F.col("mapped")).alias("unmapped"),
    )


def _blocks(n: int) -> Column:
    return F.lit(n << 16).cast("bigint")


def index_chunks(base: DataFrame) -> DataFrame:
    bin_no = (F.col("interval") + 4681).cast("int")
    b, e = F.col("b"), F.col("e")
    return base.select(
        "file", "ref_id", bin_no.alias("bin"), "chunk_index",
        F.when(bin_no % 17 == 3, e + 5)
        .when((bin_no % 19 == 4) & (F.col("chunk_index") == 2), b + _blocks(1000000))
        .otherwise(b)
        .alias("beg"),
        F.when(bin_no % 23 == 6, b).when(bin_no % 29 == 7, e + _blocks(2000000000)).otherwise(e).alias("end"),
    )


def index_linear(base: DataFrame) -> DataFrame:
    grouped = base.groupBy("file", "ref_id", "interval").agg(F.min("b").alias("v"))
    i, v = F.col("interval"), F.col("v")
    changed = F.when(i % 31 == 5, 0).when(i % 13 == 9, F.greatest(_blocks(1), v - _blocks(30000))).otherwise(v)
    return grouped.select("file", "ref_id", "interval", changed.cast("bigint").alias("voffset"))


def index_meta(base: DataFrame) -> DataFrame:
    grouped = base.groupBy("file", "ref_id").agg(
        F.min("b").alias("b"),
        F.max("e").alias("e"),
        F.sum("mapped").alias("mapped"),
        F.sum("unmapped").alias("placed_unmapped"),
    )
    ref = F.col("ref_id")
    return grouped.select(
        "file",
        "ref_id",
        F.when(ref % 9 == 4, F.col("e") + 9).otherwise(F.col("b")).alias("ref_beg"),
        F.when(ref == 21, F.col("e") + _blocks(3000000000)).otherwise(F.col("e")).alias("ref_end"),
        "mapped",
        "placed_unmapped",
    )


def index_files(base: DataFrame) -> DataFrame:
    counted = base.groupBy("file").agg(F.sum(F.col("mapped") + F.col("unmapped")).alias("n"))
    return counted.select(
        "file",
        F.lit(25).alias("n_ref"),
        F.when(F.col("file") != "sample_3", F.floor(F.col("n") / 50)).alias("no_coordinate"),
        F.lit(1100000000).cast("bigint").alias("bam_size"),
        F.when(F.col("file") == "sample_2", 26).otherwise(25).alias("bam_n_ref"),
    )
