"""Queries of the general data-processing operators over the domain tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean, clean_names, strip
from ..operators import coverage, hotkeys, packed
from ..sources import rejects


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of fanse_raw that break the record format, with the reason."""
    return rejects.parse_records(_read(spark, sf_dir, "fanse_raw"), "raw_id").where(F.col("reason").isNotNull()).select("raw_id", "reason")


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that load."""
    ok = rejects.parse_records(_read(spark, sf_dir, "fanse_raw"), "raw_id").where(F.col("reason").isNull())
    lists = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("strands", "ref_names", "mismatches", "positions")]
    return ok.select("raw_id", "header", "seq", *lists, "multi_count")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the packed fields with its place in the list."""
    known = _read(spark, sf_dir, "ref_dict").select(strip(F.col("ref_name")))
    a = packed.split_packed(_read(spark, sf_dir, "fanse_packed"), "packed_id", ["ref_names", "strands", "positions"], known)
    b = packed.split_packed(_read(spark, sf_dir, "counts_isoform_level_multi"), "row_id", ["transcripts"], known)
    return a.withColumn("src_table", F.lit("fanse_packed")).unionByName(b.withColumn("src_table", F.lit("counts_isoform_level_multi")))


#: How the values of p5_known_names are set apart.
SIGNS = (", ", " ", " | ", ";", "  /  ")


def p5_known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, brands and types of parts, packed in several ways: names hold blanks and brands ``#``, which the dictionary of whole values protects."""
    parts = _read(spark, sf_dir, "part")
    names = [F.col(c) for c in ("p_name", "p_brand", "p_type")]
    known = parts.select(F.explode(F.array(*names)))
    sign = F.get(F.array(*[F.lit(x) for x in SIGNS]), (F.col("p_partkey") % len(SIGNS)).cast("int"))
    line = F.concat(names[0], sign, names[1], sign, names[2])
    return packed.split_packed(parts.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("["), line, F.lit("]"))).otherwise(line).alias("packed")), "p_partkey", ["packed"], known)


def _name_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Names of fanse_record with the mismatches of their hit, by frequency; the number of all names."""
    rows = _read(spark, sf_dir, "fanse_record").select("ref_names", "mismatches")
    hits = rows.select(F.explode(F.arrays_zip(F.col("ref_names").alias("name"), F.coalesce("mismatches", F.array()).alias("value"))).alias("h")).select(clean(F.col("h.name")).alias("name"), "h.value")
    total = rows.select(F.sum(F.size(clean_names(F.coalesce("ref_names", F.array().cast("array<string>")))))).first()[0] or 0
    return hotkeys.weighted_values(hits, F.col("name"), F.col("value")), total


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with at least 2 % of all names of fanse_record, genes with at least 2 % of all rows of counts."""
    names, total = _name_values(spark, sf_dir)
    counts = _read(spark, sf_dir, "counts").select("genename", "shard_no")
    genes = hotkeys.weighted_values(counts, clean(F.col("genename")), F.col("shard_no"))
    a = hotkeys.frequent_keys(names, 0.02, total).select(F.lit("fanse_record").alias("src_table"), F.col("key").alias("key_value"))
    return a.unionByName(hotkeys.frequent_keys(genes, 0.02, counts.count()).select(F.lit("counts").alias("src_table"), F.col("key").alias("key_value")))


def p6_reference_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per reference: hits, distinct mismatch counts and the most frequent one."""
    return hotkeys.key_profile(_name_values(spark, sf_dir)[0]).withColumnRenamed("key", "ref_name")


def p6_gene_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per gene: the median and 90th percentile of the raw counts."""
    w = hotkeys.weighted_values(_read(spark, sf_dir, "counts"), clean(F.col("genename")), F.col("raw"))
    return hotkeys.weighted_percentiles(w, [50, 90]).select(F.col("key").alias("genename"), "percent", F.col("value").alias("raw_value"))


def _exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "refflat").select("genename", "chrom", "exonstarts_list", "exonends_list")
    return rows.select(clean(F.col("genename")).alias("genename"), clean(F.col("chrom")).alias("chrom"), F.explode(coverage.paired("exonstarts_list", "exonends_list")).alias("x")).select("genename", "chrom", "x.s", "x.e")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exon blocks of each gene and chromosome and the gaps between them."""
    return coverage.blocks_and_gaps(_exons(spark, sf_dir), ["genename", "chrom"], "s", "e").select("genename", "chrom", "kind", "start_pos", "end_pos")


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_records, p5_found, p5_known_names, p6_found, p6_reference_profile, p6_gene_percentiles, p7_found)}


def oracle_sql() -> dict[str, str]:
    ws = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)"
    hits = f"(select nullif(trim(n, {ws}), '') as name, v from (select unnest(ref_names) as n, unnest(mismatches) as v from fanse_record))"
    genes = f"(select nullif(trim(genename, {ws}), '') as gene, raw from counts)"
    exons = f"""select nullif(trim(genename, {ws}), '') as genename, chrom, unnest(exonstarts_list[:n]) as s, unnest(exonends_list[:n]) as e
      from (select *, least(len(exonstarts_list), len(exonends_list)) as n from refflat)"""
    field = '"(?:[^"]|"")*"|[^"\\t][^\\t]*|'
    fields = lambda c: f"list_transform(regexp_extract_all(chr(9) || {c}, '\\t({field})', 1), lambda f: case when f like '\"%' then replace(f[2:-2], '\"\"', '\"') else f end)"
    number = "regexp_full_match({0}, '[0-9]+') and try_cast({0} as bigint) is not null"
    every = lambda c, test: f"len(list_filter(string_split({c}, ','), lambda x: not ({test}))) = 0"
    value = f"""trim(a[1], {ws}) <> '' and regexp_full_match(a[2], '[ACGTNacgtn]+') and {every('b[1]', "x = 'F' or x = 'R'")} and {every('b[2]', f"trim(x, {ws}) <> ''")} and {number.format('b[3]')}
      and {every('b[4]', number.format('x'))} and regexp_full_match(b[5], '0*[1-9][0-9]*') and len(string_split(b[1], ',')) = len(string_split(b[2], ',')) and len(string_split(b[2], ',')) = len(string_split(b[4], ','))
      and (len(a) = 2 or a[3] = '' or (len(string_split(a[3], ',')) = len(string_split(b[2], ',')) and {every('a[3]', "regexp_full_match(x, '[-.x*ACGTN]*') and length(replace(x, '-', '')) = length(a[2])")}))"""
    quoted = f"(?:{field})(?:\\t(?:{field}))*"
    raw = f"""(select raw_id, case when bad then 'quoting' when len(a) not in (2, 3) or len(b) <> 5 then 'column_count' when not ({value}) then 'value' end as reason, a, b from
      (select raw_id, not (regexp_full_match(h, '{quoted}') and regexp_full_match(x, '{quoted}')) as bad, case when h0 is null then [] else {fields('h')} end as a, case when x0 is null then [] else {fields('x')} end as b from
      (select raw_id, rec_head as h0, rec_hits as x0, coalesce(rtrim(rec_head, chr(13) || chr(10)), '') as h, coalesce(rtrim(rec_hits, chr(13) || chr(10)), '') as x from fanse_raw)))"""
    token = '"(?:[^"]|"")*"|\'\'(?:[^\'\']|\'\'\'\')*\'\'|[A-Za-z0-9._:-]+|\\s+|[^\\s]'
    listed = " union all ".join(
        f"select '{t}' as src_table, {k} as row_id, '{c}' as field_name, trim({c}, {ws}) as s from {t} where trim({c}, {ws}) <> ''"
        for t, k, cs in (("fanse_packed", "packed_id", ("ref_names", "strands", "positions")), ("counts_isoform_level_multi", "row_id", ("transcripts",)))
        for c in cs
    )
    packed_sql = f"""with f as (select *, row_number() over () as id from ({listed})),
      t as (select * exclude s, unnest(tokens) as tok, generate_subscripts(tokens, 1) as i from (select *, regexp_extract_all(case when length(s) > 1 and s[1] || s[-1] in ('()', '[]', '{{}}') then s[2:-2] else s end, '{token}') as tokens from f)),
      k as (select *, (length(tok) > 1 and tok[1] in (chr(34), chr(39))) or regexp_full_match(tok, '[A-Za-z0-9._:-]+') as val, not regexp_full_match(tok, '\\s+') as sign from t),
      g as (select *, coalesce(sum(val::int) over (partition by id order by i rows between unbounded preceding and 1 preceding), 0) as gap from k),
      n as (select id, gap, coalesce(sum(sign::int) filter (not val), 0) as signs from g group by id, gap),
      p as (select id, gap, sum(case when gap = 0 then signs else greatest(1, signs) end) over (partition by id order by gap) as place from n),
      v as (select g.*, place, case when tok[1] in (chr(34), chr(39)) then replace(tok[2:-2], tok[1] || tok[1], tok[1]) else tok end as value from g join p using (id, gap) where val)
      select src_table, row_id, field_name, place::int as item_pos, value as item_value from v where trim(value, {ws}) <> ''"""
    return {
        "p3_found": f"select raw_id, reason from {raw} where reason is not null",
        "p3_records": f"select raw_id, a[1] as header, a[2] as seq, b[1] as strands, b[2] as ref_names, array_to_string(list_transform(string_split(b[4], ','), lambda x: b[3]::bigint), ',') as mismatches, array_to_string(list_transform(string_split(b[4], ','), lambda x: x::bigint), ',') as positions, b[5]::bigint as multi_count from {raw} where reason is null",
        "p5_found": packed_sql,
        "p5_known_names": "select p_partkey as row_id, 'packed' as field_name, i - 1 as item_pos, [p_name, p_brand, p_type][i] as item_value from part, unnest([1, 2, 3]) as t(i)",
        "p6_found": f"""select 'fanse_record' as src_table, name as key_value from {hits} where name is not null group by name
          having count(*) >= 0.02 * (select count(name) from {hits}) union all
          select 'counts', gene from {genes} where gene is not null group by gene having count(*) >= 0.02 * (select count(*) from counts)""",
        "p6_reference_profile": f"""with c as (select name, v, count(*) as n from {hits} where name is not null group by 1, 2)
          select name as ref_name, sum(n)::bigint as n_rows, coalesce(sum(n) filter (v is not null), 0)::bigint as n_values, count(v) as n_distinct,
          (list(v order by n desc, v) filter (v is not null))[1] as mode from c group by name""",
        "p6_gene_percentiles": f"""with r as (select gene, raw, row_number() over (partition by gene order by raw) as k, count(*) over (partition by gene) as n
          from {genes} where gene is not null and raw is not null), p as (select unnest([50, 90]) as percent)
          select gene as genename, percent, raw as raw_value from r cross join p where k = greatest(1, ceil(percent * n / 100.0))""",
        "p7_found": f"""with x as (select genename, chrom, s, e from ({exons}) where genename is not null and s is not null and e is not null and s < e),
          f as (select *, s > coalesce(max(e) over w, s - 1) as new from x window w as (partition by genename, chrom order by s, e rows between unbounded preceding and 1 preceding)),
          b as (select *, sum(new::int) over (partition by genename, chrom order by s, e rows between unbounded preceding and current row) as block from f),
          m as (select genename, chrom, min(s) as s, max(e) as e from b group by genename, chrom, block)
          select genename, chrom, 'block' as kind, s as start_pos, e as end_pos from m union all
          select * from (select genename, chrom, 'gap', lag(e) over (partition by genename, chrom order by s) as p, s from m) where p is not null""",
    }
