"""Queries of readers, annotation features and conversions between formats, and their SQL.

Readers are run over files that are first written from a whole table into the shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean
from ..operators import annotate, convert, sam, variants
from ..schema import REFFLAT_COLUMNS
from ..session import checkpoint_dir
from ..sources import annotation as annotation_files
from ..sources import fastx, records
from ..sources import sam as sam_files
from . import annotation
from . import inputs as I

Query = Callable[[SparkSession, str], DataFrame]


def _written(lines: DataFrame, ending: str = "txt") -> str:
    """A folder with text files of the column ``value``."""
    path = f"{checkpoint_dir(lines.sparkSession)}/{uuid.uuid4().hex}.{ending}"
    lines.select("value").write.text(path)
    return path


def _tabbed(*columns: str | Column) -> Column:
    return F.concat_ws("\t", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]).alias("value")


def _read_unmapped(s: SparkSession, d: str) -> DataFrame:
    rows = I.read(s, d, "unmapped").select(_tabbed("unmapped_no", F.regexp_replace(F.coalesce("sequence", F.lit("")), r"[\r\n\t]", "")))
    return records.read_unmapped(s, _written(rows))


def _read_fasta(s: SparkSession, d: str) -> DataFrame:
    reads = I.full_records(s, d).where(F.col("seq").isNotNull()).select("record_no", "seq")
    half = F.expr("cast(length(seq) div 2 as int)")
    lines = reads.select(F.concat(F.lit(">"), F.col("record_no").cast("string"), F.lit(" x\n"), F.substring("seq", F.lit(1), half), F.lit("\n"), F.expr("substring(seq, length(seq) div 2 + 1)")).alias("value"))
    return fastx.read_fasta(s, _written(lines, "fa")).select("header", "seq")


def _read_fastq(s: SparkSession, d: str) -> DataFrame:
    reads = I.full_records(s, d).where(F.col("seq").isNotNull())
    return fastx.read_fastq(s, _written(reads.select(convert.fastq_line(F.col("record_no").cast("string"), F.col("seq")).alias("value")), "fq")).select("header", "seq", "qual")


def _records_text(s: SparkSession, d: str) -> DataFrame:
    """Records of fanse_packed with one hit, as two lines each."""
    rows = I.read(s, d, "fanse_packed").where(F.col("ref_names").rlike(r"^[\w.:-]+\z") & F.col("strands").isin("F", "R") & F.col("positions").rlike(r"^[0-9]{1,9}\z") & F.col("mismatches").isNotNull())
    first, second = _tabbed("packed_id", F.lit("ACGT")), _tabbed("strands", "ref_names", "mismatches", "positions", F.lit(1))
    return rows.select(F.concat(first, F.lit("\n"), second).alias("value"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("header", "seq", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("strands", "ref_names", "mismatches", "positions")], "multi_count")


def _read_ranges(s: SparkSession, d: str) -> DataFrame:
    path = _written(_records_text(s, d).coalesce(1), "rec")
    files = [r[0] for r in s.read.format("binaryFile").load(path).select("path").collect()]
    return _shown(records.read_record_ranges(s, [f.removeprefix("file:") for f in files], 100_000))


def _read_sam(s: SparkSession, d: str) -> DataFrame:
    rows = sam.sam_rows(I.full_records(s, d))
    head, back = sam_files.read_sam(s, _written(sam.sam_lines(rows), "sam"))
    return back.select("qname", "flag", "rname", "pos", "mapq", "cigar", "seq", F.array_join("tags", " ").alias("tags"))


def _read_refflat(s: SparkSession, d: str) -> DataFrame:
    rows = I.read(s, d, "refflat").where(F.col("txname").isNotNull())
    plain = {c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n#]", "") for c in REFFLAT_COLUMNS}
    back = annotation_files.read_refflat(s, _written(rows.select(_tabbed(*plain.values())), "refflat"))
    return back.select(clean(F.col("txname")).alias("txname"), "txstart", "txend", "exoncount", "txlength", F.size("exons").alias("n_exons"))


def features(s: SparkSession, d: str, kind: str) -> DataFrame:
    """Feature lines of every transcript with a gene and a span: itself, its exons and its coding span, after the lines of a file."""
    t = annotation.transcripts(s, d).where(F.col("genename").isNotNull() & (F.col("txstart") < F.col("txend")))
    part = lambda name, i, a, z: F.struct(F.lit(name).alias("feature"), i.alias("line_no"), a.cast("long").alias("s"), z.cast("long").alias("e"))
    exons = F.transform("exons", lambda x, i: part("exon", i.cast("long") + 2, x["s"], x["e"]))
    coding = F.when(F.col("cdsstart") < F.col("cdsend"), F.array(part("CDS", F.lit(1 << 20).cast("long"), F.col("cdsstart"), F.col("cdsend")))).otherwise(F.array().cast("array<struct<feature:string,line_no:bigint,s:bigint,e:bigint>>"))
    own = F.array(part("transcript", F.lit(1).cast("long"), F.col("txstart"), F.col("txend")))
    rows = t.select("txname", "genename", "chrom", "strand", F.explode(F.concat(own, exons, coding)).alias("p"))
    quoted = lambda k, c: F.concat(F.lit(f'{k} "'), F.col(c), F.lit('";'))
    if kind == "gtf":
        attributes = F.concat_ws(" ", quoted("gene_id", "genename"), quoted("transcript_id", "txname"))
    else:
        attributes = F.when(F.col("p.feature") == "transcript", F.concat(F.lit("ID=transcript:"), F.col("txname"), F.lit(";Parent=gene:"), F.col("genename"))).otherwise(F.concat(F.lit("Parent=transcript:"), F.col("txname")))
    return rows.select("p.line_no", F.col("chrom").alias("seqid"), F.lit("made").alias("source"), "p.feature", (F.col("p.s") + 1).alias("start"), F.col("p.e").alias("end"), F.lit(".").alias("score"), "strand", F.lit(".").alias("phase"), attributes.alias("attributes"))


def _transcripts(kind: str) -> Query:
    return lambda s, d: annotate.transcripts(features(s, d, kind), kind).select("genename", "txname", "chrom", "strand", "txstart", "txend", "cdsstart", "cdsend", "exoncount", "txlength", "cdslength")


def _fasta_to_fastq(s: SparkSession, d: str) -> DataFrame:
    return convert.fasta_to_fastq(I.full_records(s, d).where(F.col("seq").isNotNull()))


def _fastq_to_fasta(s: SparkSession, d: str) -> DataFrame:
    return convert.fastq_to_fasta(I.full_records(s, d).where(F.col("seq").isNotNull()))


def _genotyped(s: SparkSession, d: str) -> DataFrame:
    """Rows with three samples, made from the keys of all orders."""
    o, key, cust = I.read(s, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    call = lambda a, b: F.concat((a % 3).cast("string"), F.lit("/"), (b % 2).cast("string"), F.lit(":9"))
    return o.select(key.alias("line_no"), F.when(key % 4 == 0, ".").otherwise("DP=3").alias("info"), F.lit("GT:DP").alias("format"), F.array(call(key, cust), call(cust, key), F.lit("./.:0")).alias("samples"))


def _browser_snps(s: SparkSession, d: str) -> DataFrame:
    o, key, cust = I.read(s, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    base = lambda n: F.substring(F.lit("ACGT"), (n % 4 + 1).cast("int"), F.lit(1))
    snps = o.select(
        F.lit("c").alias("chrom"), key.alias("start"), F.concat(F.lit("rs"), key.cast("string")).alias("name"), F.lit("+").alias("strand"), base(key).alias("ref"), F.concat(base(key), F.lit("/"), base(key + cust % 3 + 1)).alias("observed"),
        F.lit("genomic").alias("mol_type"), F.lit("single").alias("class"), F.when(cust % 2 == 0, "unknown").otherwise("by-freq").alias("valid"), F.lit(0.0).alias("avg_het"),
    )
    return variants.snps_to_vcf(snps).select("id", "pos", "ref", "alt", "info")


def queries() -> dict[str, Query]:
    return {
        "read_unmapped": _read_unmapped, "read_fasta": _read_fasta, "read_fastq": _read_fastq, "read_records": lambda s, d: _shown(records.read_records(s, _written(_records_text(s, d), "rec"))), "read_record_ranges": _read_ranges,
        "read_sam": _read_sam, "read_refflat": _read_refflat, "transcripts_of_gtf": _transcripts("gtf"), "transcripts_of_gff3": _transcripts("gff3"), "fasta_to_fastq": _fasta_to_fastq, "fastq_to_fasta": _fastq_to_fasta,
        "fill_allele_counts": lambda s, d: variants.fill_allele_counts(_genotyped(s, d)).select("line_no", "info"),
        "select_samples": lambda s, d: variants.select_samples(_genotyped(s, d), ["a", "b", "c"], ["c", "a"]).select("line_no", F.array_join("samples", " ").alias("samples")),
        "snps_to_vcf": _browser_snps,
    }


def oracle_sql() -> dict[str, str]:
    reads = "select record_no, sq from rec where sq is not null"
    single = "select packed_id, strands, ref_names, mismatches, positions from fanse_packed where regexp_full_match(ref_names, '[\\w.:-]+') and strands in ('F', 'R') and regexp_full_match(positions, '[0-9]{1,9}') and mismatches is not null"
    shown = f"select packed_id::varchar as header, 'ACGT' as seq, strands, ref_names, mismatches::varchar as mismatches, positions::bigint::varchar as positions, 1 as multi_count from ({single})"
    tx = annotation.oracle_sql()["interval_union"]
    with_tx, union = tx[: tx.index(" select txname, coalesce(n, 0)::bigint as union_length")], tx
    # The lengths of the union of exons come from that query; the rest stands in the transcripts.
    features_sql = f"""{with_tx} select genename, txname, chrom, strand, txstart::bigint as txstart, txend::bigint as txend, case when cdsstart < cdsend then cdsstart else txstart end::bigint as cdsstart,
      case when cdsstart < cdsend then cdsend else txstart end::bigint as cdsend, len(exons)::int as exoncount, union_length as txlength, case when cdsstart < cdsend then cdsend - cdsstart else 0 end::bigint as cdslength
      from tx join ({union}) using (txname) where genename is not null and txstart < txend"""
    calls = "[o_orderkey % 3, o_custkey % 2, o_custkey % 3, o_orderkey % 2]"
    n = lambda a: f"len(list_filter({calls}, lambda x: x = {a}))"
    shown_n = lambda a: f"case when {n(a)} > 0 then {n(a)}::varchar else '' end"
    counts = f"case list_max({calls}) when 0 then '' when 1 then {shown_n(1)} else {shown_n(1)} || chr(9) || {shown_n(2)} end"
    base = lambda k: f"substr('ACGT', (({k}) % 4 + 1)::int, 1)"
    sam_body = "select * from (" + _sam_sql() + ")"
    return {
        "read_unmapped": "select unmapped_no::varchar as read_id, rtrim(regexp_replace(coalesce(sequence, ''), '[\\r\\n\\t]', '', 'g'), ' ') as sequence from unmapped",
        "read_fasta": I.sql(f"select record_no || ' x' as header, regexp_replace(sq, '\\s', '', 'g') as seq from ({reads})", "rec"),
        "read_fastq": I.sql(f"select record_no::varchar as header, sq as seq, repeat('I', length(sq)) as qual from ({reads})", "rec"),
        "read_records": shown, "read_record_ranges": shown,
        "read_sam": f"select qname, flag, rname, pos, mapq, cigar, seq, concat_ws(' ', xm, xn, nm, xs, sa) as tags from ({sam_body})",
        "read_refflat": f"""select nullif(trim(txname, {I.BLANK}), '') as txname, txstart::bigint as txstart, txend::bigint as txend, exoncount::bigint as exoncount, txlength::bigint as txlength,
          least(len(a), len(b))::int as n_exons from (select *, list_filter(string_split(coalesce(exonstarts, ''), ','), lambda x: trim(x) <> '') as a, list_filter(string_split(coalesce(exonends, ''), ','), lambda x: trim(x) <> '') as b from refflat where txname is not null)""",
        "transcripts_of_gtf": features_sql, "transcripts_of_gff3": features_sql,
        "fasta_to_fastq": I.sql("select '@' || header || chr(10) || sq || chr(10) || '+' || chr(10) || repeat('I', length(sq)) as value from rec where sq is not null", "rec"),
        "fastq_to_fasta": I.sql("select '>' || header || chr(10) || sq as value from rec where sq is not null", "rec"),
        "fill_allele_counts": f"select o_orderkey as line_no, case when o_orderkey % 4 = 0 then '' else 'DP=3;' end || 'AC=' || {counts} || ';AN=4' as info from orders",
        "select_samples": "select o_orderkey as line_no, './.:0 ' || (o_orderkey % 3) || '/' || (o_custkey % 2) || ':9' as samples from orders",
        "snps_to_vcf": f"select 'rs' || o_orderkey as id, o_orderkey + 1 as pos, {base('o_orderkey')} as ref, {base('o_orderkey + o_custkey % 3 + 1')} as alt, 'molType=genomic;class=single' || case when o_custkey % 2 = 0 then '' else ';valid=by-freq' end as info from orders",
    }


def _sam_sql() -> str:
    from . import alignments

    return alignments.oracle_sql()["sam_rows"]
