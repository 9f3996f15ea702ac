"""Queries of annotation processing over refflat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals
from ..functions.attrs import strip_id
from ..functions.text import clean
from ..operators import annotate, coverage, tracks
from . import inputs as I

Query = Callable[[SparkSession, str], DataFrame]

SCALARS = "genename chrom strand txstart txend cdsstart cdsend exonstarts exonends symbol t_biotype protein_id txlength cdslength utr5length utr3length".split()


def transcripts(s: SparkSession, d: str) -> DataFrame:
    """One row per clean txname with its valid exons: of several rows, the greatest by the scalar columns in order."""
    rows = I.read(s, d, "refflat").select(clean(F.col("txname")).alias("txname"), *[clean(F.col(c)).alias(c) if c in ("genename", "symbol") else F.col(c) for c in SCALARS], F.coalesce(coverage.paired("exonstarts_list", "exonends_list"), F.array()).alias("exons"))
    best = rows.where(F.col("txname").isNotNull()).groupBy("txname").agg(F.max_by(F.struct(*SCALARS, "exons"), F.struct(*SCALARS)).alias("t"))
    return best.select("txname", "t.*")


def _union_length(s: SparkSession, d: str) -> DataFrame:
    return transcripts(s, d).select("txname", intervals.union_length(F.col("exons")).alias("union_length"), F.size(intervals.merged(F.col("exons"))).alias("n_blocks"))


def _intersection(s: SparkSession, d: str) -> DataFrame:
    """Exons against the coding span."""
    span = F.array(F.struct(F.col("cdsstart").cast("long").alias("s"), F.col("cdsend").cast("long").alias("e")))
    t = transcripts(s, d).where(F.col("cdsstart") < F.col("cdsend"))
    return t.select("txname", intervals.intersection_length(F.col("exons"), span).alias("shared_length"))


def _metrics(s: SparkSession, d: str) -> DataFrame:
    return annotate.gene_metrics(transcripts(s, d))


def _covered(s: SparkSession, d: str) -> DataFrame:
    """Coding spans as the covered intervals."""
    t = transcripts(s, d)
    cover = t.select("genename", F.col("cdsstart").cast("long").alias("s"), F.col("cdsend").cast("long").alias("e"))
    return annotate.gene_metrics(t, cover).select("genename", "genereadcoveredlength")


def _strings(s: SparkSession, d: str) -> DataFrame:
    a, b = annotate.exon_strings(F.col("exons"))
    return transcripts(s, d).select("txname", a.alias("starts"), b.alias("ends"), annotate.exon_labels(F.array_sort("exons")).alias("labels"))


def _rna(s: SparkSession, d: str) -> DataFrame:
    t = annotate.rna_coordinates(transcripts(s, d))
    a, b = annotate.exon_strings(F.col("exons"), trailing=True)
    return t.select("txname", "chrom", "strand", "txstart", "txend", "cdsstart", "cdsend", a.alias("starts"), b.alias("ends"))


def _validate(s: SparkSession, d: str) -> DataFrame:
    return annotate.validate(annotate.with_gene_metrics(transcripts(s, d)))


def _ids(s: SparkSession, d: str) -> DataFrame:
    prefixed = F.concat(F.element_at(F.array(*[F.lit(p) for p in ("gene:", "transcript:", "CDS:", "mRNA:", "")]), (F.coalesce("txlength", F.lit(0)) % 5 + 1).cast("int")), "txname")
    return transcripts(s, d).select("txname", strip_id(prefixed).alias("value"))


def _classes(s: SparkSession, d: str) -> DataFrame:
    each = transcripts(s, d).select("txname", F.size("exons").alias("k"), F.posexplode("exons").alias("i", "x"))
    kind, colour = annotate.exon_class(F.col("i"), F.col("k"))
    return each.select("txname", F.col("i").alias("exon"), kind.alias("kind"), colour.alias("colour"), annotate.exon_class(F.col("i"), F.col("k"), "position")[1].alias("gradient"))


def queries() -> dict[str, Query]:
    return {
        "interval_union": _union_length, "interval_intersection": _intersection, "gene_metrics": _metrics, "gene_read_covered": _covered, "exon_strings": _strings, "rna_coordinates": _rna,
        "exon_bed": lambda s, d: tracks.exon_bed(transcripts(s, d)), "bed12": lambda s, d: tracks.bed12(transcripts(s, d)), "exon_gtf": lambda s, d: tracks.exon_gtf(annotate.rna_coordinates(transcripts(s, d))),
        "unified_gtf": lambda s, d: tracks.unified_gtf(transcripts(s, d)), "validators": _validate, "extract_id": _ids, "exon_class": _classes,
    }


def oracle_sql() -> dict[str, str]:
    b = I.BLANK
    cols = ", ".join(f"nullif(trim({c}, {b}), '') as {c}" if c in ("genename", "symbol") else c for c in SCALARS)
    tx = f"""select * exclude rn from (select *, row_number() over (partition by txname order by {', '.join(f'{c} desc nulls last' for c in SCALARS)}) as rn from (select nullif(trim(txname, {b}), '') as txname, {cols},
      coalesce(list_filter(list_transform(range(1, least(len(exonstarts_list), len(exonends_list)) + 1), lambda i: struct_pack(s := exonstarts_list[i], e := exonends_list[i])), lambda x: x.s is not null and x.e is not null and x.s < x.e), []) as exons from refflat)
      where txname is not null) where rn = 1"""
    with_tx = f"with tx as materialized ({tx}), ex as materialized (select *, i - 1 as i0, exons[i].s as s, exons[i].e as e, row_number() over (partition by txname order by exons[i].s, exons[i].e) as k from tx, unnest(range(1, len(exons) + 1)) as t(i))"

    def united(source: str, key: str, out: str) -> str:
        return f"""(select {key}, sum(e - s)::bigint as {out}, count(*) as {out}_blocks from (select {key}, min(s) as s, max(e) as e from (select *, sum(new) over (partition by {key} order by s, e rows unbounded preceding) as blk from
          (select *, (s > coalesce(max(e) over (partition by {key} order by s, e rows between unbounded preceding and 1 preceding), s - 1))::int as new from ({source}))) group by {key}, blk) group by {key})"""

    exons = "select txname, s, e from ex"
    genes = "select genename, s, e from ex where genename is not null"
    spans = "select genename, cdsstart as s, cdsend as e from tx where genename is not null and cdsstart < cdsend"
    metrics = f"""select g.*, case when nn > 0 then nn else coalesce(genelongesttxlength, 0) end::bigint as geneeffectivelength, nn as genenonoverlaplength, case when nn > 0 then nn else coalesce(genelongesttxlength, 0) end::bigint as genereadcoveredlength from
      (select genename, max(txlength) as genelongesttxlength, max(cdslength) as genelongestcdslength from tx where genename is not null group by 1) g left join (select genename, coalesce(n, 0) as nn from (select distinct genename from tx where genename is not null) left join {united(genes, 'genename', 'n')} using (genename)) using (genename)"""
    metrics = metrics.replace("nn as genenonoverlaplength", "nn as genenonoverlaplength")
    rgb = lambda a, c, d: f"(i0 * {a})::varchar || ',' || (i0 * {c})::varchar || ',' || (i0 * {d})::varchar"
    clamp = "least(255, i0 * 40)::varchar || ',' || least(255, i0 * 60)::varchar || ',' || least(255, i0 * 80)::varchar"
    rna = "select *, coalesce(sum(e - s) over (partition by txname order by s, e rows between unbounded preceding and 1 preceding), 0)::bigint as rs, sum(e - s) over (partition by txname order by s, e rows unbounded preceding)::bigint as re from ex"
    q = lambda name, v: f"'{name} \"' || coalesce(({v})::varchar, '') || '\"'"
    ids = f"{q('gene_id', 'genename')} || '; ' || {q('transcript_id', 'txname')}"
    gtf = lambda feature, a, z, at, frame=".": f"select txname as seqname, '{tracks.SOURCE}' as source, '{feature}' as feature, ({a})::bigint as start, ({z})::bigint as \"end\", '.' as score, '+' as strand, '{frame}' as frame, {at} as attributes"
    joined = lambda v, by: f"string_agg(({v})::varchar, ',' order by {by})"
    exon_id = "txname || '_exon' || (i0 + 1)"
    return {
        "interval_union": f"{with_tx} select txname, coalesce(n, 0)::bigint as union_length, coalesce(n_blocks, 0)::int as n_blocks from tx left join {united(exons, 'txname', 'n')} using (txname)",
        "interval_intersection": f"""{with_tx} select txname, coalesce(n, 0)::bigint as shared_length from tx left join {united('select txname, greatest(s, cdsstart) as s, least(e, cdsend) as e from ex where greatest(s, cdsstart) < least(e, cdsend)', 'txname', 'n')} using (txname) where cdsstart < cdsend""",
        "gene_metrics": f"{with_tx} {metrics}",
        "gene_read_covered": f"""{with_tx} select genename, (coalesce(x.n, 0) + coalesce(c.n, 0) - coalesce(a.n, 0))::bigint as genereadcoveredlength from (select distinct genename from tx where genename is not null)
          left join {united(genes, 'genename', 'n')} x using (genename) left join {united(spans, 'genename', 'n')} c using (genename) left join {united(genes + ' union all ' + spans, 'genename', 'n')} a using (genename)""",
        "exon_strings": f"{with_tx} select txname, coalesce({joined('s', 'k')}, '') as starts, coalesce({joined('e', 'k')}, '') as ends, coalesce(string_agg('Exon' || k || '(' || s || '-' || e || ')', ';' order by k), '') as labels from tx left join (select txname, s, e, k from ex) using (txname) group by txname",
        "rna_coordinates": f"{with_tx} select txname, txname as chrom, '+' as strand, 0::bigint as txstart, any_value(txlength)::bigint as txend, any_value(utr5length)::bigint as cdsstart, any_value(utr5length + cdslength)::bigint as cdsend, coalesce({joined('rs', 'rs')} || ',', '') as starts, coalesce({joined('re', 'rs')} || ',', '') as ends from tx left join (select txname, rs, re from ({rna})) using (txname) group by txname",
        "exon_bed": f"{with_tx} select chrom, s as start, e as \"end\", {exon_id} as name, 0 as score, strand, s as thick_start, e as thick_end, {rgb(30, 50, 70)} as item_rgb from ex",
        "bed12": f"{with_tx} select any_value(chrom) as chrom, any_value(txstart) as start, any_value(txend) as \"end\", txname as name, 1000 as score, any_value(strand) as strand, any_value(cdsstart) as thick_start, any_value(cdsend) as thick_end, '{tracks.BLUE}' as item_rgb, count(*)::int as block_count, {joined('e - s', 'k')} || ',' as block_sizes, {joined('s - txstart', 'k')} || ',' as block_starts from ex group by txname",
        "exon_gtf": f"{with_tx} {gtf('exon', 'rs + 1', 're', ids + ' || ' + repr('; ') + ' || ' + q('exon_number', 'k') + ' || ' + repr('; ') + ' || ' + q('exon_id', 'txname || ' + repr('_exon') + ' || k') + ' || ' + repr('; ') + ' || ' + q('color', rgb(40, 60, 80).replace('i0', '(k - 1)')))} from ({rna})",
        "unified_gtf": f"""{with_tx} {gtf('transcript', '1', 'txlength', ids + " || '; ' || " + " || '; ' || ".join(q(n, v) for n, v in (('gene_name', 'coalesce(symbol, genename)'), ('biotype', 't_biotype'), ('tx_length', 'txlength'), ('cds_length', 'cdslength'), ('utr5_length', 'utr5length'), ('utr3_length', 'utr3length'))))} from tx
          union all {gtf('exon', 's + 1', 'e', ids + " || '; ' || " + " || '; ' || ".join((q('exon_number', 'i0 + 1'), q('exon_id', exon_id), q('color', clamp))))} from ex
          union all {gtf('CDS', 'cdsstart + 1', 'cdsend', ids + " || '; ' || " + q('protein_id', 'protein_id'), '0')} from tx where cdsstart < cdsend
          union all {gtf('five_prime_UTR', '1', 'utr5length', ids)} from tx where utr5length > 0 union all {gtf('three_prime_UTR', 'txlength - utr3length + 1', 'txlength', ids)} from tx where utr3length > 0""",
        "exon_class": f"{with_tx} select txname, i0::int as exon, case when i0 = 0 then 'first' when i0 = len(exons) - 1 then 'last' else 'middle' end as kind, case when i0 = 0 then '255,100,100' when i0 = len(exons) - 1 then '100,100,255' else '100,255,100' end as colour, {clamp} as gradient from ex",
        "extract_id": f"{with_tx} select txname, case when coalesce(txlength, 0) % 5 = 3 then 'mRNA:' else '' end || txname as value from tx",
        "validators": "select true as non_overlap_ok, true as covered_ok",
    }
