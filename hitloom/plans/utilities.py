"""Queries of the utilities on references, SAM rows and variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean
from ..operators import sam, samutil, sitefilter, variants
from . import alignments
from . import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
TILE = 500


def _sam(s: SparkSession, d: str) -> DataFrame:
    rows = sam.sam_rows(I.full_records(s, d))
    return rows.withColumn("line_no", F.col("record_no") * 1000 + F.col("hit_idx")).withColumn("tags", F.array("xm", "nm"))


def _tiles(s: SparkSession, d: str) -> DataFrame:
    return variants.tiles(I.read(s, d, "ref_dict").select(clean(F.col("ref_name")).alias("ref_name"), "ref_length"), TILE)


def _compared(s: SparkSession, d: str) -> DataFrame:
    """First hits against the later hits of the same reads."""
    rows = _sam(s, d)
    return samutil.compare_alignments(rows.where("hit_idx = 0"), rows.where("hit_idx > 0"))


# Made-up variant rows, as the tables have none: alleles and annotation from arithmetic on the keys of all orders.
REFS, ALTS = ("A", "G", "C", "TA", "N", "TACGT"), ("A", "C", "G", "T", "AC", "GGT", "T,TA", "C,G", ".", "-AC", "+T", "CC", "GGGGG")


def sites(s: SparkSession, d: str) -> DataFrame:
    """Variant rows in which every filter finds something."""
    o, key, cust = I.read(s, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda xs, n: F.get(F.array(*[F.lit(x) for x in xs]), (n % len(xs)).cast("int"))
    number = lambda n: n.cast("string")
    depth = F.when(cust % 41 == 0, 20_000).otherwise(key % 9)
    info = F.concat(
        F.lit("NEIR=0."), number(cust % 10), F.lit(";DP="), number(depth), F.lit(";MQ="), number((key * 13 + cust) % 60 + 5),
        F.when(key % 3 > 0, F.concat(F.lit(";DP4=3,"), number(cust % 5), F.lit(","), number(key % 5), F.lit(","), number(cust % 4))).otherwise(""),
        F.when(key % 7 == 0, F.concat(F.lit(";PV4=0.3,1,0."), number(key % 2), F.lit(",0.000"), number(cust % 10), F.lit("5"))).otherwise(""),
    )
    return o.select(
        key.alias("line_no"), F.concat(F.lit("c"), number(cust % 3)).alias("chrom"), F.expr("o_orderkey div 3 * 4").alias("pos"), pick(REFS, key).alias("ref"), pick(ALTS, cust).alias("alt"),
        number(cust % 60).alias("qual"), info.alias("info"),
    )


def pileup_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of a consensus pileup, made up in the same way."""
    o, key, cust = I.read(s, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    gap = cust % 5 == 0
    pick = lambda xs, n: F.get(F.array(*[F.lit(x) for x in xs]), (n % len(xs)).cast("int"))
    call = F.when(gap, pick(("*/-AC", "+A/*", "-ACGTACG/*", "*/*"), key)).otherwise(pick(("A", "R", "G", "T"), key))
    return o.select(
        key.alias("line_no"), F.concat(F.lit("c"), (cust % 3).cast("string")).alias("chrom"), F.expr("o_orderkey * 3").alias("pos"), F.when(gap, "*").otherwise("A").alias("base"), call.alias("call"),
        (key % 40).cast("int").alias("cons_qual"), (cust % 70).cast("int").alias("snp_qual"), (key * 7 % 60 + 5).cast("int").alias("mapq"), ((key + cust) % 104).cast("int").alias("depth"),
        F.when(cust % 2 == 0, "*").otherwise("x").alias("first"), F.lit("y").alias("second"), (key % 3).cast("int").alias("n_first"), (cust % 3).cast("int").alias("n_second"),
    )


PILEUP = sitefilter.PileupFilter(min_snp_quality=8, min_indel_quality=8, dense_window=14)


def _lengths(s: SparkSession, d: str) -> DataFrame:
    return variants.indel_lengths(sites(s, d)).select("length", F.round("n", 6).alias("n"))


def _linkage(s: SparkSession, d: str) -> DataFrame:
    out = variants.linkage_stats(sites(s, d), 0.5)
    return out.select(F.col("n_strong").cast("long").alias("n_strong"), F.round("fraction", 6).alias("fraction"), F.col("length").cast("long").alias("length"))


def _quality(s: SparkSession, d: str) -> DataFrame:
    """All sites by quality; known are the alleles of the sites of good depth."""
    v = sites(s, d)
    return variants.quality_stats(v, v.where("info rlike ';DP=[5-9]' and alt <> '.'").select("chrom", "pos", "alt"), 0.1)


def queries() -> dict[str, Query]:
    return {
        "reference_tiles": _tiles, "aligned_length": lambda s, d: _sam(s, d).select("line_no", samutil.aligned_length(F.col("cigar")).alias("aligned_length")),
        "sam_to_fastq": lambda s, d: samutil.sam_to_fastq(_sam(s, d)), "best_alignments": lambda s, d: samutil.best_alignments(_sam(s, d)), "compare_alignments": _compared,
        "indel_lengths": _lengths, "linkage_stats": _linkage, "quality_stats": _quality, "site_filter": lambda s, d: sitefilter.filter_sites(sites(s, d)).select("line_no", "kind", "code"),
        "pileup_filter": lambda s, d: sitefilter.filter_pileup(pileup_lines(s, d), PILEUP).select("line_no", "code"),
    }


def oracle_sql() -> dict[str, str]:
    base = alignments.oracle_sql()["sam_rows"]
    rows = f"(select *, record_no * 1000 + hit_idx as line_no from ({base}))"
    total = lambda ops: f"list_sum(list_transform(list_filter(regexp_extract_all(cigar, '(\\d+)[{ops}]', 1), lambda x: x <> ''), lambda x: x::int))"
    score = f"greatest(1, coalesce({total('M')}, 0) - 5 * len(list_filter(regexp_extract_all(cigar, '\\d+[ID]'), lambda x: x <> '')) - 2 * coalesce({total('ID')}, 0))"
    best = f"select *, row_number() over w as k, lead(score) over w as second from (select *, {score}::int as score from {rows}) window w as (partition by qname order by score desc, line_no)"
    placed = lambda where: f"select qname, arg_max(struct_pack(b := flag & 16, r := rname, p := pos, q := mapq), line_no) as x from {rows} where {where} group by 1"
    level = "case when a.x.q >= 10 and b.x.q >= 10 then 'high high' when a.x.q >= 10 then 'high low' when b.x.q >= 10 then 'low high' end"
    classes = ", ".join(f"('{c}')" for c in samutil.CLASSES)
    listed = lambda xs, n: f"[{', '.join(repr(x) for x in xs)}][({n}) % {len(xs)} + 1]"
    v = f"""(select o_orderkey as line_no, 'c' || (o_custkey % 3) as chrom, o_orderkey // 3 * 4 as pos, {listed(REFS, 'o_orderkey')} as ref, {listed(ALTS, 'o_custkey')} as alt,
      (o_custkey % 60)::double as qual, (o_custkey % 10) / 10.0 as neir, case when o_custkey % 41 = 0 then 20000 else o_orderkey % 9 end as dp, (o_orderkey * 13 + o_custkey) % 60 + 5 as mq,
      case when o_orderkey % 3 > 0 then o_orderkey % 5 + o_custkey % 4 end as alts, case when o_orderkey % 7 = 0 then (o_custkey % 10) / 10000.0 + 0.00005 end as pv from orders)"""
    # Each filter rule as a join of every site with those near it; chains of close indels as a recursion.
    filtered = f"""with recursive own as (select line_no, chrom, pos, pos + length(ref) - 1 as stop, qual * 100 + coalesce(alts, -1) as score,
        case when len(list_filter(string_split(alt, ','), lambda x: length(x) > 1 and length(ref) = 1 or length(ref) > 1 and length(x) <> length(ref))) > 0 then 'indel' when length(ref) > 1 then 'mnp' else 'snp' end as kind,
        case when alts < 2 then 'a' when dp < 2 then 'd' when dp > 10000 then 'D' when mq < 10 then 'Q' when pv < 1e-4 then 'P' else '' end as code from {v} where alt <> '.'),
      near as (select x.line_no as x, t.line_no as t, x.kind = 'indel' as xg, t.kind = 'indel' as tg, t.code = '' as acts, t.pos - x.stop as gap, x.score >= 0 and x.score < t.score as weaker, x.pos as xpos
        from own t join own x on x.chrom = t.chrom and (x.pos, x.line_no) < (t.pos, t.line_no) and x.stop + 10 >= t.pos),
      met as (select x, t, bool_and(weaker) over (partition by t order by xpos, x) as won, weaker from near where not xg and not tg and acts and gap <= 0),
      i as (select *, row_number() over (partition by chrom order by pos, line_no) as k from own where kind = 'indel' and code = ''),
      chain as (select chrom, k, line_no as holder, stop, score, null::bigint as lost from i where k = 1 union all
        select i.chrom, i.k, case when kept then c.holder else i.line_no end, case when kept then c.stop else i.stop end, case when kept then c.score else i.score end,
          case when c.stop + 10 < i.pos then null when kept then i.line_no else c.holder end
        from (select *, k + 1 as following from chain) c join i on i.chrom = c.chrom and i.k = c.following, lateral (select c.stop + 10 >= i.pos and (c.score < 0 or c.score >= i.score) as kept))
      select line_no, kind, case when kind = 'indel' then case when line_no in (select lost from chain where lost is not null) then 'g' else code end
        when line_no in (select x from met where won) then 'M' when code <> '' then code when line_no in (select t from met where not weaker) then 'M'
        when line_no in (select t from near where xg) or line_no in (select x from near where tg and acts) then 'G' else '' end as code from own"""
    lines = f"""(select o_orderkey as line_no, 'c' || (o_custkey % 3) as chrom, o_orderkey * 3 as pos, o_custkey % 5 = 0 as gap, o_orderkey % 4 as c, o_custkey % 70 as q, o_orderkey * 7 % 60 + 5 as mq,
      (o_orderkey + o_custkey) % 104 as depth, o_custkey % 70 + 100 * (case when o_custkey % 2 = 0 then 0 else o_orderkey % 3 end + o_custkey % 3) as score from orders)"""
    piled = f"""with recursive every as (select *, pos + case when gap and c = 0 then 2 when gap and c = 2 then 7 else 0 end as stop, case when q < 8 and gap then 'i' when q < 8 then 's' when depth < 3 then 'd' when depth > 100 then 'D' else '' end as own
        from {lines} where case when gap then c <> 3 else c <> 0 end),
      l as (select * from every where own = ''),
      near as (select x.line_no as x, t.line_no as t, x.gap as xg, t.gap as tg, t.pos - x.stop as gap, x.pos as xpos, t.pos as tpos, x.score as xs, t.score as ts, t.q as tq
        from l t join l x on x.chrom = t.chrom and (x.pos, x.line_no) < (t.pos, t.line_no) and x.stop + 30 >= t.pos),
      duel as (select x, t, xs < ts as weaker, bool_and(xs < ts) over (partition by t order by xpos, x) as won from near where xg and tg),
      snp as (select *, mq >= 25 or line_no in (select t from near where xg and gap <= 10 and xs >= 25) as sure, row_number() over (partition by chrom order by pos, line_no) as k from l where not gap),
      walk as (select chrom, k, line_no, false as dense, case when sure then [pos] else [] end as counted from snp where k = 1 union all
        select s.chrom, s.k, s.line_no, d, case when d or s.sure then list_append(c.counted, s.pos)[-2:] else c.counted end
        from (select *, k + 1 as following from walk) c join snp s on s.chrom = c.chrom and s.k = c.following, lateral (select len(c.counted) = 2 and c.counted[1] + 14 >= s.pos as d)),
      dense as (select line_no from walk where dense),
      soon as (select x, arg_min(case when tg then 'G' else 'W' end, (tpos, t)) as code from near where not xg and (tg and gap <= 10 and tq >= 25 or not tg and gap <= 14 and t in (select line_no from dense)) group by x)
      select e.line_no, case when own <> '' then own when gap and (line_no in (select x from duel where won) or line_no in (select t from duel where not weaker)) then 'g'
        when gap then case when mq < 10 then 'Q' else '' end when line_no in (select line_no from dense) then 'W' when line_no in (select t from near where xg and not tg and gap <= 10 and xs >= 25) then 'G'
        when mq < 25 then 'Q' else coalesce(soon.code, '') end as code from every e left join soon on soon.x = e.line_no"""
    quality = f"""with recursive known as (select chrom, pos, max(alt) as known_alts from {v} where dp between 5 and 9 and alt <> '.' group by 1, 2),
      s as (select case when qual < 0 then 3 else qual end as q, alt <> '.' and alt <> ref as snp, ref || string_split(alt, ',')[1] in ('AG', 'GA', 'CT', 'TC') as ts, coalesce(list_contains(string_split(known_alts, ','), string_split(alt, ',')[1]), false) as hit
        from {v} left join known using (chrom, pos) where length(ref) = 1 and ref <> 'N' and length(string_split(alt, ',')[1]) = 1),
      c as (select q, sum(count(*)) over w as sites, sum(sum(snp::int)) over w as snps, sum(sum(ts::int)) over w as tss, sum(sum(hit::int)) over w as hits from s group by q window w as (order by q desc)),
      n as (select *, sites / (max(sites) over () + 1) as part, lag(sites, 1, 0) over (order by q desc) / (max(sites) over () + 1) as part0 from c),
      m as (select q, part from n where part0 <= 0.1 and part > 0.1 union all select n.q, n.part from m join n on n.part0 <= m.part + 0.1 and n.part > m.part + 0.1),
      o as (select *, snps - lag(snps, 1, 0) over (order by q desc) as ds, tss - lag(tss, 1, 0) over (order by q desc) as dt from c where q in (select q from m) or q = (select min(q) from c))
      select q as qual, sites::bigint as sites, snps::bigint as snps, tss::bigint as transitions, hits::bigint as hits, case when snps <> tss then round(tss / (snps - tss), 4) else 100.0 end::double as ts_tv,
        round(hits / (select count(*) from known), 4)::double as hit_share, case when snps > 0 then round(hits / snps, 4) else 0.0 end::double as hit_rate, case when ds <> dt then round(dt / (ds - dt), 4) else 100.0 end::double as step_ts_tv from o"""
    return {
        "reference_tiles": f"select trim(ref_name, {I.BLANK}) as ref_name, k * {TILE} + 1 as start, case when k = last then ref_length else (k + 1) * {TILE} end::bigint as \"end\" from (select *, greatest(0, floor(ref_length / {TILE}.0 - 1.1) + 1)::bigint as last from ref_dict where ref_length > 0), unnest(range(0, last + 1)) as t(k)",
        "aligned_length": f"select line_no, coalesce({total('MI')}, 0)::int as aligned_length from {rows}",
        "sam_to_fastq": f"select (line_no % 20)::int as file_no, '@' || qname || chr(10) || case when flag & 16 <> 0 then translate(reverse(seq), 'ATCGNatcgn', 'TAGCNtagcn') else seq end as value from {rows}",
        "best_alignments": f"select qname, line_no, flag, rname, pos, least(250, floor(250.0 * (score - coalesce(second, 0)) / score + 0.499))::int as mapq, cigar, score from ({best}) where k = 1",
        "compare_alignments": f"""select class, coalesce(n, 0) as n from (values {classes}) t(class) left join (select case when b.x is null then 'second missing ' || case when a.x.q >= 10 then 'high' else 'low' end
          when a.x is null then 'first missing ' || case when b.x.q >= 10 then 'high' else 'low' end else case when a.x.b = b.x.b and a.x.r = b.x.r and abs(a.x.p - b.x.p) < 100 then 'consistent ' else 'inconsistent ' end || ({level}) end as class,
          count(*) as n from ({placed('hit_idx = 0')}) a full join ({placed('hit_idx > 0')}) b using (qname) group by 1) using (class)""",
        "indel_lengths": f"select (case when x like '-%' then 1 - length(x) when x like '+%' then length(x) - 1 else length(x) - length(ref) end)::int as length, round(sum(1.0 / k)::double, 6) as n from (select ref, unnest(string_split(alt, ',')) as x, len(string_split(alt, ',')) as k from {v} where not (length(ref) = 1 and regexp_full_match(alt, '[A-Za-z](,[A-Za-z])*'))) group by 1",
        "site_filter": filtered, "pileup_filter": piled, "quality_stats": quality,
        "linkage_stats": f"select count(*) filter (pos > p and neir > 0.5) as n_strong, round(count(*) filter (pos > p and neir > 0.5) / count(*)::double, 6) as fraction, coalesce(sum(pos - p) filter (pos > p and neir > 0.5), 0)::bigint as length from (select *, lag(pos) over (partition by chrom order by line_no) as p from {v})",
    }
