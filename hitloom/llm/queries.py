"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean
from . import components, cooccur, heavy, leak, mix, pii


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of fanse_record in one group with all names they are linked to."""
    return components.name_groups(_read(spark, sf_dir, "fanse_record", "ref_names", "multi_count"))


def p1_record_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each record that maps to several transcripts."""
    records = _read(spark, sf_dir, "fanse_record", "record_no", "ref_names", "multi_count")
    return components.record_groups(records, components.name_groups(records))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names in at least 10 reads and at least 8 times as often as by chance."""
    pairs = cooccur.cooccurrence(_read(spark, sf_dir, "fanse_record", "record_no", "ref_names"), min_count=10, min_lift=8.0)
    return pairs.select(F.col("item_a").alias("ref_a"), F.col("item_b").alias("ref_b"))


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of names with its counts and lift."""
    pairs = cooccur.cooccurrence(_read(spark, sf_dir, "fanse_record", "record_no", "ref_names"))
    return pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def _frequent(spark: SparkSession, sf_dir: str, share: float) -> DataFrame:
    out = []
    for table, column in (("fanse_record", "seq"), ("unmapped", "sequence")):
        rows = _read(spark, sf_dir, table, column)
        hits = heavy.heavy_hitters(rows, F.upper(clean(F.col(column))), share)
        out.append(hits.select(F.lit(table).alias("src_table"), F.col("value").alias("seq_value"), "n"))
    return out[0].unionByName(out[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences in at least 0.4 % of all rows of either table."""
    return _frequent(spark, sf_dir, 0.004).select("src_table", "seq_value")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences in at least 0.1 % of all rows of either table, with counts."""
    return _frequent(spark, sf_dir, 0.001)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that hold 12 consecutive words of a test item, and the items."""
    return leak.leaked(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "eval_item", "item_id", "item_text"))


def _mix(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, DataFrame]:
    targets = _read(spark, sf_dir, "source_target", "source", "target_share", "max_repeat")
    return mix.mix_sources(_read(spark, sf_dir, "documents", "doc_id", "text", "source"), targets, **options), targets


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the largest mix with exact target shares, and how often each is used."""
    return _mix(spark, sf_dir)[0]


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source in that mix."""
    return mix.mix_report(*_mix(spark, sf_dir))


def p9_mix_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of as many tokens as the corpus has: sources over their cap are clamped, their excess goes to the others."""
    return _mix(spark, sf_dir, times=1.0)[0]


#: Of so large a mix some sources are over their cap at first, and others once the excess of these is handed on.
CLAMPED = 1.8


def p9_mix_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of 1.8 times the corpus's tokens, for which sources are clamped in two rounds."""
    return _mix(spark, sf_dir, times=CLAMPED)[0]


def p9_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by characters, which SQL can count."""
    return _mix(spark, sf_dir, times=CLAMPED, characters=True)[0]


def p9_characters_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source in the mix by characters."""
    return mix.mix_report(*_mix(spark, sf_dir, times=CLAMPED, characters=True))


def p9_exact_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mix with exact target shares by characters."""
    return _mix(spark, sf_dir, characters=True)[0]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal information in messages, by type, exactly as it stands."""
    return pii.find_pii(_read(spark, sf_dir, "documents", "doc_id", "text"))


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with typed placeholders for personal information."""
    return pii.redact_pii(_read(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_record_groups, p2_found, p2_pairs, p4_found, p4_counts, p8_found, p9_mix, p9_report, p9_mix_all, p9_mix_clamped, p9_characters, p9_characters_report, p9_exact_characters, p10_found, p10_redacted)}


def oracle_sql() -> dict[str, str]:
    blank = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)"
    names = f"select record_no, multi_count, list_sort(list_distinct(list_filter(list_transform(ref_names, lambda x: trim(x, {blank})), lambda x: x is not null and x <> ''))) as x from fanse_record"
    pairs = f"""with r as ({names}), i as (select distinct record_no, unnest(x) as item from r),
      n as (select item, count(*) as n from i group by item), t as (select count(distinct record_no) as n from i),
      p as (select a.item as a, b.item as b, count(*) as n from i a join i b on a.record_no = b.record_no and a.item < b.item group by 1, 2)
      select p.a, p.b, p.n as n_ab, na.n as n_a, nb.n as n_b, t.n as nn from p join n na on na.item = p.a join n nb on nb.item = p.b cross join t"""
    groups = f"""with recursive r as ({names}), e as (select distinct x[1] as a, unnest(x[2:]) as b from r where multi_count >= 2 and len(x) >= 2),
      u as (select a, b from e union select b, a from e),
      g(node, label) as (select a, least(a, min(b)) from u group by a union
        select u.b, g.label from g join u on u.a = g.node)
      select min(label) as group_ref, node as ref_name from g group by node"""
    heavy_sql = """select 'fanse_record' as src_table, upper(trim(seq, {b})) as seq_value, count(*) as n from fanse_record where trim(seq, {b}) <> '' group by 2
      having count(*) >= {s} * (select count(*) from fanse_record) union all
      select 'unmapped', upper(trim(sequence, {b})), count(*) from unmapped where trim(sequence, {b}) <> '' group by 2 having count(*) >= {s} * (select count(*) from unmapped)"""
    source = f"lower(replace(nullif(trim(source, {blank}), ''), '-', '_'))"

    def mixed(times: float | None) -> str:
        """Water-filling as a recursion of the level; documents in the order of their digest, summed up one by one."""
        level = "(select min(cap / w) from src where w > 0 and cap > 0)" if times is None else "(select last(level order by round) from fill)"
        return f"""with recursive goal as (select {source} as src, target_share as w, max_repeat as k from source_target where {source} is not null),
          one as (select doc_id, min((src, n)) as d from (select doc_id, {source} as src, length(text) as n from documents) where n > 0 and src in (select src from goal) group by doc_id),
          docs as (select doc_id, d[1] as src, d[2] as n, substr(md5('7:' || doc_id), 1, 15) as h from (select doc_id, [d[1]::varchar, d[2]::varchar] as d from one)),
          doc as (select doc_id, src, n::bigint as n, h from docs),
          src as (select src, w, k, coalesce(size, 0) as size, coalesce(size, 0) * k::double as cap from goal left join (select src, sum(n) as size from doc group by 1) using (src)),
          fill as (select 0 as round, 0.0::double as level, -1::bigint as n union all
            select round + 1, ({times or 0} * (select sum(size)::double from src) - coalesce(caps, 0)) / weight, m from
            (select f.round, f.n, sum(cap) filter (cap / w < f.level * (1 - 1e-12)) as caps, sum(w) filter (cap > 0 and w > 0 and cap / w >= f.level * (1 - 1e-12)) as weight, count(*) filter (cap / w < f.level * (1 - 1e-12)) as m
              from fill f, src group by f.round, f.n, f.level) where m <> n),
          part as (select src, w, size, floor(least(cap, {level} * w) / size + 1e-12) as whole, least(cap, {level} * w) as wanted from src where size > 0 and w > 0 and cap > 0),
          ranked as (select doc.*, whole, floor(wanted - whole * size) as rest, sum(n) over (partition by src order by h, doc_id rows unbounded preceding) as upto from doc join part using (src))
          select doc_id, src as source, n as n_tokens, (whole + (upto <= rest)::int)::int as repeats from ranked where whole + (upto <= rest)::int > 0"""

    report = f"""with m as ({mixed(CLAMPED)}), r as (select source as src, count(*) as n_docs, sum(n_tokens * repeats)::bigint as n_tokens, max(repeats) as top_repeat from m group by 1)
      select {source} as source, target_share, max_repeat, coalesce(n_docs, 0)::bigint as n_docs, coalesce(r.n_tokens, 0)::bigint as n_tokens, coalesce(top_repeat, 0)::int as top_repeat,
      round(coalesce(r.n_tokens / sum(r.n_tokens) over (), 0), 6) as actual_share from source_target left join r on r.src = {source}"""
    return {
        "p9_characters": mixed(CLAMPED),
        "p9_exact_characters": mixed(None),
        "p9_characters_report": report,
        "p2_found": f"select a as ref_a, b as ref_b from ({pairs}) where n_ab >= 10 and n_ab * nn >= 8 * n_a * n_b",
        "p2_pairs": f"select a as item_a, b as item_b, n_ab, n_a, n_b, round(n_ab * nn::double / (n_a::double * n_b), 6) as lift from ({pairs})",
        "p4_found": f"select src_table, seq_value from ({heavy_sql.format(b=blank, s=0.004)})",
        "p4_counts": heavy_sql.format(b=blank, s=0.001),
        "p1_found": groups,
        "p1_record_groups": f"select distinct r.record_no, g.group_ref from ({names}) r join ({groups}) g on g.ref_name = r.x[1] where r.multi_count >= 2 and len(r.x) >= 2",
    }
