"""Queries of the counts per transcript and gene, their result tables and layouts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import count, gene, quant
from ..session import cut_lineage
from ..sinks import tables
from . import inputs as I
from .inputs import sql

Query = Callable[[SparkSession, str], DataFrame]


def _keyed(df: DataFrame) -> DataFrame:
    """Counts rounded to six places, so that the order of additions doesn't show."""
    return df.select("sample_id", "key", F.round(F.col("n").cast("double"), 6).alias("n"))


def _iso(f) -> Query:
    return lambda s, d: _keyed(f(I.combos(s, d)))


def _iso_len(f) -> Query:
    return lambda s, d: _keyed(f(I.combos(s, d), I.tx_lengths(s, d)))


def _gene(f) -> Query:
    return lambda s, d: _keyed(f(I.classified(s, d)))


def _gene_len(f) -> Query:
    return lambda s, d: _keyed(f(I.classified(s, d), I.gene_lengths(s, d)))


def _n(table: str, where: str = "true") -> str:
    return sql(f"select sample_id, key, round(n::double, 6) as n from {table} where {where}", table)


def _combos(body: str) -> str:
    return sql(f"select sample_id, key, round(sum(n)::double, 6) as n from ({body}) group by all", "combos", "each")


def _tpm(s: SparkSession, d: str) -> DataFrame:
    w = count.weights(count.unique(I.combos(s, d)), I.tx_lengths(s, d))
    return w.select("sample_id", "key", F.round("tpm", 4).alias("tpm"))


def _summary(s: SparkSession, d: str) -> DataFrame:
    out = count.summary(I.combos(s, d), I.tx_lengths(s, d))
    return out.select("sample_id", *[F.col(c).cast("long").alias(c) for c in ("total_reads", "unique_mapped", "multi_mapped", "cannot_allocate")], *[F.round(c, 5).alias(c) for c in ("multi_equal", "multi_em", "final_em", "final_eq")])


def _class(s: SparkSession, d: str) -> DataFrame:
    return I.classified(s, d).select("sample_id", F.array_join("ids", ",").alias("ids"), "n", F.array_join("genes", ",").alias("genes"), "first_gene")


def _split(s: SparkSession, d: str) -> DataFrame:
    c = I.combos(s, d)
    return gene.unique_split(gene.classified(c, gene.transcripts_to_genes(I.annotation(s, d))), c)


def _multi_to_gene(s: SparkSession, d: str) -> DataFrame:
    return gene.gene_combinations(I.classified(s, d)).select("sample_id", F.array_join("ids", ",").alias("key"), "n")


def _ratios(s: SparkSession, d: str) -> DataFrame:
    r = gene.ratios(I.classified(s, d), I.gene_lengths(s, d))
    return r.select("sample_id", "key", F.round("multi_equal_ratio", 6).alias("multi_equal_ratio"), F.round("multi_em_ratio", 6).alias("multi_em_ratio"))


def _final_ma_counted(s: SparkSession, d: str) -> DataFrame:
    from ..compat import Compat

    return _keyed(gene.final_ma(I.classified(s, d), Compat.corrected()))


def _lengths(level: str) -> Query:
    return lambda s, d: I.length_maps(s, d, level)


def _expression(s: SparkSession, d: str) -> DataFrame:
    return quant.expression(gene.final_em(I.classified(s, d), I.gene_lengths(s, d)), I.length_maps(s, d, "gene"))


def _rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _tpm_columns(s: SparkSession, d: str) -> DataFrame:
    c = I.classified(s, d)
    wide = _counts_wide(gene.final_em(c, I.gene_lengths(s, d)), gene.final_eq(c))
    return _rounded(quant.add_quant_columns(wide, "key", ["Final_EM", "Final_EQ", "absent"], I.length_maps(s, d, "gene"), "both"))


def _counts_wide(em: DataFrame, eq: DataFrame) -> DataFrame:
    return em.withColumnRenamed("n", "Final_EM").join(eq.withColumnRenamed("n", "Final_EQ"), ["sample_id", "key"], "full")


SAMPLES = ("S01", "S02", "S03", "S04")


def _matrix(s: SparkSession, d: str) -> DataFrame:
    return _rounded(quant.sample_matrix(_expression(s, d), SAMPLES, ("n", "tpm", "rpkm")))


def _matrix_all(s: SparkSession, d: str) -> DataFrame:
    """The matrix over every sample there is; its columns are looked up first, so the expression values are written once."""
    return _rounded(quant.sample_matrix(cut_lineage(_expression(s, d)), None, ("n", "tpm", "rpkm")))


def _isoform_unique(s: SparkSession, d: str) -> DataFrame:
    return _rounded(tables.isoform_unique_table(I.combos(s, d), I.tx_lengths(s, d), I.annotation(s, d)), 5)


def _isoform_multi(s: SparkSession, d: str) -> DataFrame:
    eff = I.length_maps(s, d, "isoform").select("key", F.col("eff_length").alias("length"))
    return tables.isoform_multi_table(I.combos(s, d), I.tx_lengths(s, d), eff, I.annotation(s, d)).drop("m_em", "m_eq")


def _gene_unique(s: SparkSession, d: str) -> DataFrame:
    a = I.annotation(s, d)
    return _rounded(tables.gene_unique_table(I.combos(s, d), gene.transcripts_to_genes(a), I.gene_lengths(s, d), a), 5)


def _gene_multi(s: SparkSession, d: str) -> DataFrame:
    eff = I.length_maps(s, d, "gene").select("key", F.col("eff_length").alias("length"))
    return tables.gene_multi_table(I.combos(s, d), gene.transcripts_to_genes(I.annotation(s, d)), I.gene_lengths(s, d), eff)


def queries() -> dict[str, Query]:
    return {
        "isoform_raw": _iso(count.raw), "isoform_first_id": _iso(count.first_id), "isoform_unique": _iso(count.unique), "isoform_multi_combo": _iso(count.multi), "isoform_multi2all": _iso(count.multi_to_all),
        "isoform_multi_equal": _iso(count.multi_equal), "isoform_tpm_unique": _tpm,
        "isoform_multi_em": _iso_len(lambda c, n: count.multi_em(c, count.weights(count.unique(c), n))), "isoform_unallocated": _iso_len(lambda c, n: count.multi_em_unallocated(c, count.weights(count.unique(c), n))),
        "isoform_final_em": _iso_len(count.final_em), "isoform_final_eq": _iso(count.final_eq), "isoform_final_ma": _iso(count.final_ma), "count_summary": _summary,
        "multi_mapping_info": lambda s, d: count.multi_mapped_reads(I.records(s, d, "sample_id", "header", "ref_names")),
        "gene_combo_class": _class, "gene_unique_to_gene": _gene(gene.unique_to_gene), "gene_first_id": _gene(gene.first_id), "gene_unique_to_isoform": _gene(gene.unique_to_isoform), "gene_unique_split": _split,
        "gene_multi_to_gene": _multi_to_gene, "gene_multi_equal": _gene(gene.multi_equal), "gene_multi_em": _gene_len(gene.multi_em), "gene_unallocated": _gene_len(gene.multi_em_unallocated),
        "gene_final_em": _gene_len(gene.final_em), "gene_final_eq": _gene(gene.final_eq), "gene_final_ma": _gene(gene.final_ma), "gene_final_ma_counted": _final_ma_counted, "gene_ratios": _ratios,
        "length_map_gene": _lengths("gene"), "length_map_isoform": _lengths("isoform"),
        "tpm_columns": _tpm_columns, "rpkm_columns": lambda s, d: _rounded(_expression(s, d)), "sample_matrix": _matrix, "sample_matrix_all": _matrix_all,
        "export_rsem": lambda s, d: _rounded(quant.export_rsem(_expression(s, d), decimals=1)), "export_salmon": lambda s, d: _rounded(quant.export_salmon(_expression(s, d))),
        "export_kallisto": lambda s, d: _rounded(quant.export_kallisto(_expression(s, d))), "export_featurecounts": lambda s, d: _rounded(quant.export_featurecounts(_expression(s, d), effective=True)),
        "isoform_unique_csv": _isoform_unique, "isoform_multi_csv": _isoform_multi, "gene_unique_csv": _gene_unique, "gene_multi_csv": _gene_multi,
    }


def _export(columns: str) -> str:
    return sql(f"select sample_id, {columns} from expr", "expr")


def _wide_sql(parts: dict[str, str]) -> str:
    return " union all ".join(f"select sample_id, {key} as key, n::double as n, '{name}' as kind from {table}" for name, (table, key) in parts.items())


def _cells(expr: str) -> str:
    return f"array_to_string(list({expr} order by i), ';')"


def _cell(v: str) -> str:
    return f"case when abs(({v}) - round_even({v}, 0)) < 1e-6 then round_even({v}, 0)::bigint::varchar else printf('%.1f', round_even((({v})::decimal(24,6))::double, 1)) end"


def _multi_cells(each: str, shown: list[str], label: str, more: str, tables: dict[str, str], unique: str, lengths: str, join: str) -> str:
    """SQL of a table with one row per combination and cells joined by ``;``."""
    joins = " ".join(f"left join (select sample_id, key, n as {k} from {t}) using (sample_id, key)" for k, t in tables.items())
    weights = f"(select sample_id, key, n / (eff / 1000.0) as w from {unique} join {lengths} using (key) where eff > 0 and n > 0)"
    base = f"select sample_id, ids, n, i, key, {', '.join(f'coalesce({k}, 0)::double as {k}' for k in tables)}, w, sum(w) over (partition by sample_id, ids) as total from (select * from {each} where len(ids) > 1) {joins} left join {weights} using (sample_id, key)"
    columns = "".join(f", {_cells(_cell(k))} as {k}" for k in shown)
    em = f"case when total > 0 then {_cell('n * coalesce(w, 0) / total')} else '*' end"
    ratio = lambda a, b: f"case when {b} <> 0 then printf('%.2f', round_even((({a} / {b})::decimal(24,6))::double, 2)) else '*' end"
    return f"select sample_id, any_value(n) as n, array_to_string(ids, ',') as {label}{columns}, {_cells(_cell('n / len(ids)'))} as multi_equal, {_cells(em)} as multi_EM, {_cells(ratio('m_em', 'Final_EM'))} as multi_EM_ratio, {_cells(ratio('m_eq', 'Final_EQ'))} as multi_equal_ratio{more} from ({base}) {join} group by sample_id, ids"


def oracle_sql() -> dict[str, str]:
    first = "select sample_id, ids[1] as key, n from combos"
    several = "len(ids) > 1"
    summary = """select c.sample_id, sum(c.n)::bigint as total_reads, sum(c.n) filter (len(ids) = 1)::bigint as unique_mapped, coalesce(sum(c.n) filter (len(ids) > 1), 0)::bigint as multi_mapped,
      coalesce(max(l.n), 0)::bigint as cannot_allocate, round(coalesce(max(q.n), 0), 5) as multi_equal, round(coalesce(max(m.n), 0), 5) as multi_em,
      round(coalesce(sum(c.n) filter (len(ids) = 1), 0) + coalesce(max(m.n), 0), 5) as final_em, round(coalesce(sum(c.n) filter (len(ids) = 1), 0) + coalesce(max(q.n), 0), 5) as final_eq
      from combos c left join (select sample_id, sum(n) as n from iso_lost group by 1) l using (sample_id) left join (select sample_id, sum(n) as n from iso_eq group by 1) q using (sample_id)
      left join (select sample_id, sum(n) as n from iso_em group by 1) m using (sample_id) group by c.sample_id"""
    split = """select sample_id, genes[1] as key, coalesce(sum(n) filter (sure), 0)::bigint as and_isoform, coalesce(sum(n) filter (not sure), 0)::bigint as but_not_isoform
      from (select c.*, len(ids) = 1 or u.key is not null as sure from cls c left join iso_u u on u.sample_id = c.sample_id and u.key = ids[1] where len(genes) = 1) group by all"""
    ratios = """select sample_id, key, round(coalesce(q, 0) / nullif(coalesce(u, 0) + coalesce(q, 0), 0), 6) as multi_equal_ratio, round(coalesce(m, 0) / nullif(coalesce(u, 0) + coalesce(m, 0), 0), 6) as multi_em_ratio from
      (select sample_id, key, sum(n) filter (k = 'u') as u, sum(n) filter (k = 'q') as q, sum(n) filter (k = 'm') as m from
      (select sample_id, key, n, 'u' as k from gen_u union all select sample_id, key, n, 'q' from gen_eq union all select sample_id, key, n, 'm' from gen_em) group by all) where u is not null or q is not null"""
    tpm_columns = """select sample_id, key, round(em, 4) as Final_EM, round(eq, 4) as Final_EQ, round(case when sum(kem) over w > 0 then kem * 1e6 / sum(kem) over w else 0 end, 4) as TPM_Final_EM,
      round(case when sum(keq) over w > 0 then keq * 1e6 / sum(keq) over w else 0 end, 4) as TPM_Final_EQ,
      round(case when sum(em) over w > 0 and len > 0 then coalesce(em, 0) / (len / 1000.0) / (sum(em) over w / 1e6) else 0 end, 4) as RPKM_Final_EM,
      round(case when sum(eq) over w > 0 and len > 0 then coalesce(eq, 0) / (len / 1000.0) / (sum(eq) over w / 1e6) else 0 end, 4) as RPKM_Final_EQ
      from (select sample_id, key, a.n as em, b.n as eq, coalesce(length, 0) as len, case when eff > 0 then coalesce(a.n, 0) / (eff / 1000.0) else 0 end as kem, case when eff > 0 then coalesce(b.n, 0) / (eff / 1000.0) else 0 end as keq
      from gen_fem a full join gen_feq b using (sample_id, key) left join gmap using (key)) window w as (partition by sample_id)"""
    matrix = ", ".join(f"round(coalesce(sum({v}) filter (sample_id = '{s}'), 0), 4) as {s}_{n}" for v, n in (("n", "count"), ("tpm", "tpm"), ("rpkm", "rpkm")) for s in SAMPLES)
    iso_parts = {
        "firstID": (f"({first})", "key"), "raw": ("combos", "array_to_string(ids, ',')"), "unique_to_isoform": ("iso_u", "key"), "multi_to_isoform": (f"(select * from combos where {several})", "array_to_string(ids, ',')"),
        "multi2all": ("iso_ma", "key"), "multi_equal": ("iso_eq", "key"), "multi_EM": ("iso_em", "key"), "multi_EM_cannot_allocate_tpm_isoform": ("iso_lost", "key"), "Final_EM": ("iso_fem", "key"), "Final_EQ": ("iso_feq", "key"),
        "Final_MA": ("(select * from iso_u union all select * from iso_ma)", "key"),
    }
    iso_csv = "select sample_id, w.key as Transcript, " + ", ".join(f"round(sum(n) filter (kind = '{k}'), 5) as {k}" for k in iso_parts) + f", any_value(genename) as genename, any_value(txlength) as txlength, any_value(cdslength) as cdslength, any_value(symbol) as symbol, any_value(description) as description from ({_wide_sql(iso_parts)}) w left join ann on txname = w.key group by sample_id, w.key"
    gen_parts = {
        "raw": ("gen_u", "key"), "firstID": ("(select * from cls where first_gene is not null)", "first_gene"), "unique_to_gene": ("gen_u", "key"), "unique_to_gene_and_isoform": (f"(select sample_id, key, and_isoform as n from ({split}))", "key"),
        "unique_to_gene_but_not_isoform": (f"(select sample_id, key, but_not_isoform as n from ({split}))", "key"), "multi_equal": ("gen_eq", "key"), "multi_EM": ("gen_em", "key"), "Final_EM": ("gen_fem", "key"), "Final_EQ": ("gen_feq", "key"), "Final_MA": ("gen_u", "key"),
    }
    gen_csv = (
        "select sample_id, key as Gene, " + ", ".join(f"round({k}_, 5) as {k}" for k in gen_parts) + ", round(case when Final_EQ_ > 0 then multi_equal_ / Final_EQ_ else 0 end, 5) as multi_equal_ratio, round(case when Final_EM_ > 0 then multi_EM_ / Final_EM_ else 0 end, 5) as multi_EM_ratio, symbol, genelongesttxlength, genelongestcdslength, geneeffectivelength"
        " from (select sample_id, w.key, " + ", ".join(f"coalesce(sum(n) filter (kind = '{k}'), 0) as {k}_" for k in gen_parts) + f" from ({_wide_sql(gen_parts)}) w group by all)"
        " left join (select genename as key, max(symbol) as symbol, max(genelongesttxlength) as genelongesttxlength, max(genelongestcdslength) as genelongestcdslength, max(geneeffectivelength) as geneeffectivelength from ann where genename is not null group by 1) using (key)"
    )
    return {
        "isoform_raw": _combos("select sample_id, array_to_string(ids, ',') as key, n from combos"), "isoform_first_id": _combos(first), "isoform_unique": _combos(f"{first} where len(ids) = 1"),
        "isoform_multi_combo": _combos(f"select sample_id, array_to_string(ids, ',') as key, n from combos where {several}"), "isoform_multi2all": _n("iso_ma"), "isoform_multi_equal": _n("iso_eq"),
        "isoform_tpm_unique": sql("select sample_id, key, round(tpm, 4) as tpm from iso_w", "iso_w"), "isoform_multi_em": _n("iso_em"), "isoform_unallocated": _n("iso_lost"),
        "isoform_final_em": _n("iso_fem"), "isoform_final_eq": _n("iso_feq"),
        "isoform_final_ma": sql("select sample_id, key, sum(n)::double as n from (select * from iso_u union all select * from iso_ma) group by all", "iso_u", "iso_ma"), "count_summary": sql(summary, "iso_lost", "iso_eq", "iso_em"),
        "multi_mapping_info": sql("select sample_id, array_to_string(list_transform(h, lambda x: x.ref), ',') as key, header as read from rec where len(h) > 1", "rec"),
        "gene_combo_class": sql("select sample_id, array_to_string(ids, ',') as ids, n, array_to_string(genes, ',') as genes, first_gene from cls", "cls"), "gene_unique_to_gene": _n("gen_u"),
        "gene_first_id": sql("select sample_id, first_gene as key, sum(n)::double as n from cls where first_gene is not null group by all", "cls"),
        "gene_unique_to_isoform": sql("select sample_id, genes[1] as key, sum(n)::double as n from cls where len(ids) = 1 group by all", "cls"), "gene_unique_split": sql(split, "cls", "iso_u"),
        "gene_multi_to_gene": sql("select sample_id, array_to_string(ids, ',') as key, n from gcombos", "gcombos"), "gene_multi_equal": _n("gen_eq"), "gene_multi_em": _n("gen_em"),
        "gene_unallocated": sql("select distinct sample_id, array_to_string(ids, ',') as key, n::double as n from gen_x where coalesce(total, 0) <= 0", "gen_x"),
        "gene_final_em": _n("gen_fem"), "gene_final_eq": _n("gen_feq"), "gene_final_ma": _n("gen_u"),
        "gene_final_ma_counted": sql("select sample_id, key, sum(n)::double as n from (select sample_id, key, n from gen_u union all select sample_id, key, n from geach) group by all", "gen_u", "geach"), "gene_ratios": sql(ratios, "gen_u", "gen_eq", "gen_em"),
        "length_map_gene": sql("select key, length, eff as eff_length from gmap", "gmap"), "length_map_isoform": sql("select key, length, eff as eff_length from tmap", "tmap"),
        "tpm_columns": sql(tpm_columns, "gen_fem", "gen_feq", "gmap"),
        "rpkm_columns": _export("key, round(n, 4) as n, length, eff as eff_length, round(tpm, 4) as tpm, round(rpkm, 4) as rpkm"),
        "sample_matrix": sql(f"select key, {matrix} from expr group by key", "expr"),
        "sample_matrix_all": sql("select key, round(coalesce(columns(* exclude key), 0), 4) from (pivot (select sample_id, key, n, tpm, rpkm from expr where sample_id is not null) on sample_id using sum(n) as count, sum(tpm) as tpm, sum(rpkm) as rpkm group by key)", "expr"),
        "export_rsem": _export("key as gene_id, length, eff as effective_length, round_even(n, 1) as expected_count"),
        "export_salmon": _export("key as Name, length as Length, eff as EffectiveLength, round(tpm, 4) as TPM, round(n, 4) as NumReads"),
        "export_kallisto": _export("key as target_id, length, eff as eff_length, round(n, 4) as est_counts, round(tpm, 4) as tpm"),
        "export_featurecounts": _export("key as Geneid, length as Length, eff as EffectiveLength, round(n, 4) as Count"),
        "isoform_unique_csv": sql(iso_csv, "combos", "iso_u", "iso_ma", "iso_eq", "iso_em", "iso_lost", "iso_fem", "iso_feq", "ann"),
        "isoform_multi_csv": sql(
            _multi_cells("each", ["raw", "firstID", "unique_to_isoform", "multi2all", "Final_EM", "Final_EQ"], "Transcripts", ", array_to_string(list(coalesce(genename, '0') order by i), ',') as GeneNames, array_to_string(list(coalesce(symbol, '0') order by i), ',') as Symbols, array_to_string(list(coalesce(description, '0') order by i), ',') as Descriptions",
                         {"raw": "iso_u", "firstID": "(select sample_id, ids[1] as key, sum(n) as n from combos group by all)", "unique_to_isoform": "iso_u", "multi2all": "iso_ma", "Final_EM": "iso_fem", "Final_EQ": "iso_feq", "m_em": "iso_em", "m_eq": "iso_eq"}, "iso_u", "tmap", "left join ann on txname = key"),
            "each", "iso_u", "iso_ma", "iso_fem", "iso_feq", "iso_em", "iso_eq", "tmap", "ann"),
        "gene_multi_csv": sql(
            "select *, case when multi_EM like '*%' then n else 0 end as multi_EM_cannot_allocate_tpm_gene from (" +
            _multi_cells("geach", ["unique_to_gene", "firstID", "Final_EM", "Final_EQ"], "Gene_Combination", "",
                         {"unique_to_gene": "gen_u", "firstID": "(select sample_id, first_gene as key, sum(n) as n from cls where first_gene is not null group by all)", "Final_EM": "gen_fem", "Final_EQ": "gen_feq", "m_em": "gen_em", "m_eq": "gen_eq"}, "gen_u", "gmap", "") + ")",
            "geach", "gen_u", "cls", "gen_fem", "gen_feq", "gen_em", "gen_eq", "gmap"),
        "gene_unique_csv": sql(gen_csv, "cls", "iso_u", "gen_u", "gen_eq", "gen_em", "gen_fem", "gen_feq", "ann"),
    }
