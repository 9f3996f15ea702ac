"""Inputs of the queries from the domain tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean
from ..operators import count, gene, hits, quant


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def records(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per record_no, the latest delivery."""
    return hits.latest_records(read(spark, sf_dir, "fanse_record"), columns)


def full_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with hits; ``seq`` without line-end remains."""
    r = records(spark, sf_dir, "sample_id", "header", "seq", "alignment", "strands", "ref_names", "mismatches", "positions", "multi_count")
    return hits.with_hits(r).withColumn("seq", clean(F.col("seq")))


def combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count.combinations(records(spark, sf_dir, "sample_id", "ref_names"))


ANNOTATION = ("genename", "chrom", "strand", "txlength", "isoformeffectivelength", "cdslength", "genelongesttxlength", "genelongestcdslength", "geneeffectivelength", "symbol", "description")


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per clean ``txname``: of several, the greatest by the columns in order (the table has no order of its own)."""
    rows = read(spark, sf_dir, "refflat").select(clean(F.col("txname")).alias("txname"), *[clean(F.col(c)).alias(c) if c in ("genename", "symbol") else F.col(c) for c in ANNOTATION])
    return rows.where(F.col("txname").isNotNull()).groupBy("txname").agg(F.max(F.struct(*ANNOTATION)).alias("a")).select("txname", "a.*")


def tx_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count.lengths_of(annotation(spark, sf_dir))


def gene_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gene.gene_lengths(annotation(spark, sf_dir))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gene.classified(combos(spark, sf_dir), gene.transcripts_to_genes(annotation(spark, sf_dir)))


def length_maps(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    return quant.length_maps(annotation(spark, sf_dir), level)


BLANK = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)"

#: Common table expressions that the queries' SQL starts from.
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "rec": ((), f"""select *, coalesce(multi_count, len(h)) as mc from (select *, list_filter(list_transform(range(1, len(ref_names) + 1), lambda i:
        struct_pack(ref := trim(ref_names[i], {BLANK}), strand := strands[i], pos := positions[i], mm := mismatches[i], aln := alignment[i])), lambda x: x.ref is not null and x.ref <> '') as h,
        nullif(trim(seq, {BLANK}), '') as sq from (select *, row_number() over (partition by record_no order by loaded_at desc) as rn from fanse_record) where rn = 1 and record_no is not null) where len(h) > 0"""),
    "hits": (("rec",), "select record_no, sample_id, header, sq, mc, i - 1 as hit_idx, h[i].ref as ref, h[i].strand as strand, h[i].pos as pos, h[i].mm as mm, h[i].aln as aln, len(h) as k from rec, unnest(range(1, len(h) + 1)) as t(i)"),
    "combos": (("rec",), "select sample_id, list_transform(h, lambda x: x.ref) as ids, count(*) as n from rec group by all"),
    "each": (("combos",), "select sample_id, ids, n, i, ids[i] as key from combos, unnest(range(1, len(ids) + 1)) as t(i)"),
    "ann": ((), f"""select * exclude rn from (select *, row_number() over (partition by txname order by {', '.join(c + ' desc nulls last' for c in ANNOTATION)}) as rn from
        (select nullif(trim(txname, {BLANK}), '') as txname, nullif(trim(genename, {BLANK}), '') as genename, nullif(trim(symbol, {BLANK}), '') as symbol, {', '.join(c for c in ANNOTATION if c not in ('genename', 'symbol'))} from refflat)
        where txname is not null) where rn = 1"""),
    "txlen": (("ann",), "select txname as key, txlength::double as length from ann"),
    "iso_u": (("combos",), "select sample_id, ids[1] as key, n from combos where len(ids) = 1"),
    "iso_eq": (("combos",), "select sample_id, key, sum(n / k) as n from (select sample_id, unnest(list_distinct(ids)) as key, n, len(ids) as k from combos where len(ids) > 1) group by all"),
    "iso_ma": (("each",), "select sample_id, key, sum(n) as n from each where len(ids) > 1 group by all"),
    "iso_w": (("iso_u", "txlen"), "select sample_id, key, rpk * 1e6 / sum(rpk) over (partition by sample_id) as tpm from (select sample_id, key, n / (length / 1000.0) as rpk from iso_u join txlen using (key) where length > 0 and n > 0)"),
    "iso_x": (("each", "iso_w"), "select sample_id, ids, n, key, i, tpm, sum(tpm) over (partition by sample_id, ids) as total from each left join iso_w using (sample_id, key) where len(ids) > 1"),
    "iso_em": (("iso_x",), "select sample_id, key, sum(v) as n from (select distinct sample_id, ids, key, n * tpm / total as v from iso_x where tpm is not null and total > 0) group by all"),
    "iso_lost": (("iso_x",), "select distinct sample_id, array_to_string(ids, ',') as key, n from iso_x where coalesce(total, 0) <= 0"),
    "cls": (("each", "ann"), "select sample_id, ids, any_value(n) as n, list_sort(list(distinct genename) filter (genename is not null)) as genes, max(genename) filter (i = 1) as first_gene from each left join ann on txname = key group by sample_id, ids having count(genename) > 0"),
    "gen_u": (("cls",), "select sample_id, genes[1] as key, sum(n)::bigint as n from cls where len(genes) = 1 group by all"),
    "gcombos": (("cls",), "select sample_id, genes as ids, sum(n)::bigint as n from cls where len(genes) > 1 group by all"),
    "geach": (("gcombos",), "select sample_id, ids, n, i, ids[i] as key from gcombos, unnest(range(1, len(ids) + 1)) as t(i)"),
    "gen_eq": (("geach",), "select sample_id, key, sum(n / len(ids)) as n from geach group by all"),
    "glen": (("ann",), "select genename as key, max(genelongesttxlength)::double as length from ann where genename is not null group by 1"),
    "gen_w": (("gen_u", "glen"), "select sample_id, key, rpk * 1e6 / sum(rpk) over (partition by sample_id) as tpm from (select sample_id, key, n / (length / 1000.0) as rpk from gen_u join glen using (key) where length > 0 and n > 0)"),
    "gen_x": (("geach", "gen_w"), "select sample_id, ids, n, key, i, tpm, sum(tpm) over (partition by sample_id, ids) as total from geach left join gen_w using (sample_id, key)"),
    "gen_em": (("gen_x",), "select sample_id, key, sum(n * tpm / total) as n from gen_x where tpm is not null and total > 0 group by all"),
    "gmap": (("ann",), "select genename as key, coalesce(max(genelongesttxlength), 0)::double as length, case when max(geneeffectivelength) > 0 then max(geneeffectivelength) else coalesce(max(genelongesttxlength), 0) end::double as eff from ann where genename is not null group by 1"),
    "tmap": (("ann",), "select txname as key, coalesce(txlength, 0)::double as length, case when isoformeffectivelength > 0 then isoformeffectivelength else coalesce(txlength, 0) end::double as eff from ann"),
    "gen_fem": (("gen_u", "gen_em"), "select sample_id, key, sum(n)::double as n from (select * from gen_u union all select * from gen_em) group by all"),
    "gen_feq": (("gen_u", "gen_eq"), "select sample_id, key, sum(n)::double as n from (select * from gen_u union all select * from gen_eq) group by all"),
    "iso_fem": (("iso_u", "iso_em"), "select sample_id, key, sum(n)::double as n from (select * from iso_u union all select * from iso_em) group by all"),
    "iso_feq": (("iso_u", "iso_eq"), "select sample_id, key, sum(n)::double as n from (select * from iso_u union all select * from iso_eq) group by all"),
    "expr": (("gen_fem", "gmap"), """select sample_id, key, n, length, eff, case when sum(rpk) over w > 0 then rpk * 1e6 / sum(rpk) over w else 0 end as tpm,
        case when sum(n) over w > 0 and length > 0 then n / (length / 1000.0) / (sum(n) over w / 1e6) else 0 end as rpkm from
        (select sample_id, key, n, coalesce(length, 0) as length, coalesce(eff, 0) as eff, case when eff > 0 then n / (eff / 1000.0) else 0 end as rpk from gen_fem left join gmap using (key)) window w as (partition by sample_id)"""),
}


def sql(body: str, *tables: str) -> str:
    """``body`` after the common table expressions it needs."""
    order: list[str] = []

    def need(t: str) -> None:
        for d in SQL[t][0]:
            need(d)
        if t not in order:
            order.append(t)

    for t in tables:
        need(t)
    return "with " + ", ".join(f"{t} as materialized ({SQL[t][1]})" for t in order) + " " + body
