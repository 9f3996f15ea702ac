"""Queries of alignment functions, projections, pileup and sorting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar, flags, mapq
from ..functions.fmt import cell
from ..functions.seq import reverse_complement
from ..functions.text import clean
from ..operators import convert, hits, pileup, sam, sort
from . import inputs as I
from .inputs import sql

Query = Callable[[SparkSession, str], DataFrame]

#: Half-open regions of the region query.
REGIONS = (("Qv00t0008933-01", 0, 400), ("Qv00t0008127-00", 100, 150), ("Qv00t0001481-01", 1000, 3000))
BED_ROWS = 5000


def _hits(s: SparkSession, d: str) -> DataFrame:
    return hits.explode_hits(I.full_records(s, d))


def _value(f: Callable[[], Column]) -> Query:
    """One value per hit with an alignment string."""
    return lambda s, d: _hits(s, d).where(F.col("alignment").isNotNull()).select("record_no", "hit_idx", f().alias("value"))


def _reverse() -> Column:
    return F.col("strand") == "R"


def _primary() -> Column:
    return F.col("hit_idx") == 0


def _sam(s: SparkSession, d: str) -> DataFrame:
    return sam.sam_rows(I.full_records(s, d)).drop("sample_id", "rnext", "pnext", "tlen", "qual")


def _bam(s: SparkSession, d: str) -> DataFrame:
    return sam.bam_rows(I.full_records(s, d)).drop("sample_id")


def _sam_lines(s: SparkSession, d: str) -> DataFrame:
    return sam.sam_lines(sam.sam_rows(I.full_records(s, d)))


def _records_out(df: DataFrame) -> DataFrame:
    return df.select("record_no", F.size("hits").alias("n_hits"))


def _region_table(s: SparkSession, d: str) -> DataFrame:
    table = s.createDataFrame(list(REGIONS), "ref_name string, start long, end long")
    return _records_out(sam.filter_region_table(I.full_records(s, d), table))


def _bed(s: SparkSession, d: str) -> DataFrame:
    return convert.bed6(I.full_records(s, d)).drop("sample_id")


def _reads(s: SparkSession, d: str) -> DataFrame:
    return I.full_records(s, d).where(F.col("seq").isNotNull()).select("record_no", "header", "seq")


def _unmapped(s: SparkSession, d: str) -> DataFrame:
    rows = I.read(s, d, "unmapped")
    name, seq = F.coalesce(clean(F.col("read_id")), F.lit("")), convert.unmapped_sequence(F.col("sequence"))
    return rows.select("unmapped_no", convert.fasta_line(name, seq).alias("fasta"), convert.fastq_line(name, seq).alias("fastq"))


def _references(s: SparkSession, d: str) -> DataFrame:
    return I.read(s, d, "ref_dict").select(clean(F.col("ref_name")).alias("ref_name"), "ref_length", "ref_ord")


def _pileup(least: int) -> Query:
    return lambda s, d: pileup.pileup(I.full_records(s, d), _references(s, d), least).select("ref_name", "pos", "depth", F.md5("bases").alias("bases"), F.length("quals").alias("n_quals"))


def _sorted_sam(s: SparkSession, d: str) -> DataFrame:
    rows = sam.sam_rows(I.full_records(s, d))
    return rows.withColumn("line_no", F.col("record_no") * 1000 + F.col("hit_idx"))


def _sort_coord(s: SparkSession, d: str) -> DataFrame:
    return sort.sort_by_coordinate(_sorted_sam(s, d)).select("rname", "pos", "flag", "line_no")


def _sort_name(s: SparkSession, d: str) -> DataFrame:
    return sort.sort_by_name(_sorted_sam(s, d)).select("qname", "line_no")


def _cells(s: SparkSession, d: str) -> DataFrame:
    return I.read(s, d, "counts").select("count_id", cell(F.col("multi_em")).alias("multi_em"), cell(F.col("final_eq")).alias("final_eq"))


def queries() -> dict[str, Query]:
    a = lambda: F.col("alignment")
    return {
        "reverse_complement": lambda s, d: _reads(s, d).select("record_no", reverse_complement(F.col("seq")).alias("value")),
        "cigar": _value(lambda: cigar.cigar(a(), _reverse())), "cigar_by_op": _value(lambda: cigar.cigar_by_op(a(), _reverse())), "nm": _value(lambda: cigar.edit_distance(a())),
        "flag": lambda s, d: _hits(s, d).select("record_no", "hit_idx", flags.sam_flag(F.col("strand"), ~_primary()).alias("value")),
        "mapq": _value(lambda: mapq.mapq(a(), _primary(), F.col("multi_count"))), "mapq_legacy": _value(lambda: mapq.mapq_legacy(a(), F.col("mismatch"), _primary(), F.col("multi_count"))),
        "consistency": _value(lambda: F.round(mapq.consistency(a()), 6)),
        "sam_rows": _sam, "sam_lines": _sam_lines, "bam_rows": _bam, "sam_header": lambda s, d: sam.sam_header(_references(s, d)),
        "region_filter": lambda s, d: _records_out(sam.filter_regions(I.full_records(s, d), REGIONS)), "region_table_filter": _region_table,
        "bed6": _bed, "bed_limit": lambda s, d: _records_out(convert.bed_limit(I.full_records(s, d), BED_ROWS)),
        "fasta_rows": lambda s, d: _reads(s, d).select("record_no", convert.fasta_line(F.col("header"), F.col("seq")).alias("value")),
        "fastq_rows": lambda s, d: _reads(s, d).select("record_no", convert.fastq_line(F.col("header"), F.col("seq")).alias("value")), "unmapped_rows": _unmapped,
        "pileup": _pileup(1), "pileup_zero_depth": _pileup(0), "pileup_depth": lambda s, d: pileup.depth(I.full_records(s, d), _references(s, d)),
        "sort_coord": _sort_coord, "sort_name": _sort_name, "cell_format": _cells,
        "read_preview": lambda s, d: hits.preview(I.full_records(s, d)).select("record_no", "header"),
    }


def oracle_sql() -> dict[str, str]:
    aln = "select *, length(aln) as len from hits where aln is not null"
    # Characters of each alignment on the reference's strand, and runs of equal ones: by character, and by operation.
    op = "case when c = '.' then 'M' when c = 'x' then 'X' when c = '-' then 'D' when regexp_matches(c, '^[A-Za-z]$') then 'I' else 'S' end"
    chars = f"select record_no, hit_idx, i, c, {op} as o from (select record_no, hit_idx, i, (case when strand = 'R' then reverse(aln) else aln end)[i] as c from ({aln}), unnest(range(1, len + 1)) as t(i))"

    def runs(by: str) -> str:
        return (
            f"select record_no, hit_idx, string_agg(n::varchar || o, '' order by p0) as cigar from (select record_no, hit_idx, any_value(o) as o, count(*) as n, min(i) as p0 from "
            f"(select *, i - row_number() over (partition by record_no, hit_idx, {by} order by i) as g from ({chars})) group by record_no, hit_idx, {by}, g) group by all"
        )

    dots = "length(regexp_replace(aln, '[^.]', '', 'g'))"
    wrong = "length(regexp_replace(aln, '[^x]', '', 'g'))"
    gaps = "len(list_filter(regexp_extract_all(aln, '[^.x]+'), lambda x: x <> ''))"
    nm = "length(regexp_replace(aln, '[^A-Za-z-]', '', 'g'))"
    level = lambda v: f"case {' '.join(f'when {v} >= {n} then {n}' for n in reversed(mapq.LEVELS))} else 0 end"
    score = f"(2 * {dots} - 4 * {wrong} - 6 * {gaps} - (length(aln) - {dots} - {wrong} - {gaps}))"
    best = "(2 * length(replace(aln, '-', '')))"
    raw = f"(({score} / {best}::double * 60 - case when mc > 1 then least(60, 5 * log2(mc)) else 0 end) * case when hit_idx = 0 then 1 else 0.6 end)"
    quality = f"case when {best} = 0 then 0 else {level(f'greatest(0, least(60, {raw}))')} end"
    runs_of_dots = "list_transform(list_filter(regexp_extract_all(aln, '\\.+'), lambda x: x <> ''), lambda x: length(x))"
    even = f"case when len({runs_of_dots}) = 0 then 0 else least(10, (list_avg({runs_of_dots}) + list_max({runs_of_dots})) / 20.0) end"
    eff = "length(regexp_replace(aln, '[-S]', '', 'g'))"
    legacy = f"((greatest(0, 60 - mm / {eff}::double * 300) * least(1, {eff} / 100.0) - case when mc > 1 then least(30, 10 * log2(mc)) else 0 end + {even}) * case when hit_idx = 0 then 1 else 0.7 end)"
    rc = "translate(reverse(sq), 'ATCGNatcgn', 'TAGCNtagcn')"
    on_strand = f"case when strand = 'R' then {rc} else sq end"
    flag = "(case when strand = 'R' then 16 else 0 end + case when hit_idx > 0 then 256 else 0 end)"
    whole = "select record_no from hits group by 1 having count(*) = count(aln)"
    scored = f"select h.*, {quality} as q, {nm} as nm, cigar from hits h semi join ({whole}) w on w.record_no = h.record_no left join ({{c}}) c using (record_no, hit_idx) where sq is not null"
    sam_body = f"""select record_no, hit_idx, header as qname, {flag} as flag, ref as rname, pos + 1 as pos, q as mapq, coalesce(cigar, '') as cigar, {on_strand} as seq, 'XM:i:' || mm as xm, 'XN:i:' || mc as xn,
      'NM:i:' || last_value(nm) over w as nm, 'XS:i:' || q as xs,
      case when hit_idx = 0 and mc > 1 and k > 1 then 'SA:Z:' || string_agg(case when hit_idx > 0 then concat_ws(',', ref, pos + 1, strand, coalesce(cigar, ''), q, mm) end, ';') over w end as sa
      from ({scored.format(c=runs('c'))}) window w as (partition by record_no order by hit_idx rows between unbounded preceding and unbounded following) qualify hit_idx = 0 or mc > 1"""
    sam_keys = f"select qname, rname, pos, flag, record_no * 1000 + hit_idx as line_no from ({sam_body})"
    region = " or ".join(f"(x.ref = '{n}' and x.pos >= {a} and x.pos < {b})" for n, a, b in REGIONS)
    in_region = sql(f"select record_no, len(h) as n_hits from rec where len(list_filter(h, lambda x: {region})) > 0", "rec")
    blank = I.BLANK
    ref = f"select trim(ref_name, {blank}) as ref, ref_length from ref_dict"
    bases = f"select ref, pos + i - 1 as p, record_no, hit_idx, sq[i] as b from hits join ({ref}) using (ref), unnest(range(1, least(length(sq), ref_length - pos) + 1)) as t(i) where sq is not null and pos >= 0"
    piled = f"select ref, p, count(*) as depth, string_agg(b, '' order by record_no, hit_idx) as bases from ({bases}) group by all"
    shown = "ref as ref_name, p + 1 as pos, depth, md5(bases) as bases, depth as n_quals"
    every = f"select ref, unnest(range(0, ref_length)) as p from ({ref})"
    reads = "select record_no, header, sq from rec where sq is not null"
    unmapped = f"(select unmapped_no, coalesce(trim(read_id, {blank}), '') as name, coalesce(nullif(trim(coalesce(sequence, ''), ' ' || chr(9) || chr(10) || chr(13)), ''), 'N') as s from unmapped)"
    cells = lambda v: f"case when {v} is null then '*' when abs({v} - round_even({v}, 0)) < 1e-6 then round_even({v}, 0)::bigint::varchar else printf('%.1f', round_even(({v}::decimal(24,6))::double, 1)) end"
    per_hit = lambda v: sql(f"select record_no, hit_idx, {v} as value from ({aln})", "hits")
    return {
        "reverse_complement": sql(f"select record_no, {rc} as value from ({reads})", "rec"),
        "cigar": sql(f"select record_no, hit_idx, coalesce(cigar, '') as value from ({aln}) left join ({runs('c')}) using (record_no, hit_idx)", "hits"),
        "cigar_by_op": sql(f"select record_no, hit_idx, coalesce(cigar, '') as value from ({aln}) left join ({runs('o')}) using (record_no, hit_idx)", "hits"),
        "nm": per_hit(nm), "flag": sql(f"select record_no, hit_idx, {flag} as value from hits", "hits"), "mapq": per_hit(quality),
        "mapq_legacy": per_hit(f"case when {eff} = 0 then 0 else {level(f'greatest(0, least(60, {legacy}))')} end"), "consistency": per_hit(f"round(({even})::double, 6)"),
        "sam_rows": sql(sam_body, "hits"),
        "sam_lines": sql(f"select concat_ws(chr(9), qname, flag, rname, pos, mapq, cigar, '*', '0', '0', seq, '*', xm, xn, nm, xs, sa) as value from ({sam_body})", "hits"),
        "bam_rows": sql(f"select record_no, hit_idx, header as qname, {flag} as flag, ref as rname, pos, q as mapq, coalesce(cigar, '') as cigar, {on_strand} as seq, repeat('?', length(sq)) as qual, nm, mm as xm, mc as xn from ({scored.format(c=runs('o'))})", "hits"),
        "sam_header": f"select ref_ord + 2 as line_no, '@SQ' || chr(9) || 'SN:' || trim(ref_name, {blank}) || chr(9) || 'LN:' || ref_length as value from ref_dict union all select 0, '@HD' || chr(9) || 'VN:1.6' || chr(9) || 'SO:unsorted' union all select 1, '@PG' || chr(9) || 'ID:hitloom' || chr(9) || 'PN:hitloom' || chr(9) || 'VN:0.1.0'",
        "region_filter": in_region, "region_table_filter": in_region,
        "bed6": sql("select record_no, hit_idx, ref as chrom, pos as start, pos + length(sq) as \"end\", '#' || header as name, 0 as score, case when strand = 'F' then '+' else '-' end as strand_sign from hits where pos is not null and sq is not null", "hits"),
        "bed_limit": sql(f"select record_no, n_hits from (select record_no, len(h) as n_hits, coalesce(sum(len(h)) over (order by record_no rows between unbounded preceding and 1 preceding), 0) as before from rec) where before < {BED_ROWS}", "rec"),
        "fasta_rows": sql(f"select record_no, '>' || header || chr(10) || sq as value from ({reads})", "rec"),
        "fastq_rows": sql(f"select record_no, '@' || header || chr(10) || sq || chr(10) || '+' || chr(10) || repeat('I', length(sq)) as value from ({reads})", "rec"),
        "unmapped_rows": f"select unmapped_no, '>' || name || chr(10) || s as fasta, '@' || name || chr(10) || s || chr(10) || '+' || chr(10) || repeat('I', length(s)) as fastq from {unmapped}",
        "pileup": sql(f"select {shown} from ({piled})", "hits"),
        "pileup_zero_depth": sql(f"select ref as ref_name, p + 1 as pos, coalesce(depth, 0) as depth, md5(coalesce(bases, '')) as bases, coalesce(depth, 0) as n_quals from ({every}) left join ({piled}) using (ref, p)", "hits"),
        "pileup_depth": sql(f"select ref as ref_name, p as pos, depth from ({piled})", "hits"),
        "sort_coord": sql(f"select rname, pos, flag, line_no from ({sam_keys})", "hits"), "sort_name": sql(f"select qname, line_no from ({sam_keys})", "hits"),
        "cell_format": f"select count_id, {cells('multi_em')} as multi_em, {cells('final_eq')} as final_eq from counts",
        "read_preview": sql("select record_no, header from rec order by record_no limit 10", "rec"),
    }
