"""Filters of variant sites, by their own annotation and by their neighbours.

Neighbours act within a few bases only. Sites are therefore cut into *pieces*
at gaps wider than that reach, whatever the length of a chromosome, and what
neighbours do to each other is stated as rules over windows of a piece. Two
rules depend on what earlier sites came to (which of several close indels is
still standing, how many SNPs in a row count); only these are folded over a
piece in Python, with a state of a few numbers.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .running import with_earlier_max

#: Bases of a chromosome over which running values are made at once.
TILE = 1 << 16
ORDER = ("pos", "line_no")

# Codes of the filters.
CODES = {
    "Q": "mapping quality", "d": "low depth", "D": "high depth", "a": "few alternate bases", "G": "SNP near a gap", "g": "adjacent gap",
    "P": "bias", "M": "overlapping MNP", "W": "dense SNPs", "s": "low SNP quality", "i": "low indel quality",
}


# The defaults of the filter of variant tables.
@dataclass(frozen=True)
class SiteFilter:
    min_depth: int = 2
    max_depth: int = 10_000
    min_alt: int = 2
    gap_window: int = 10
    snp_window: int = 10
    min_mapq: int = 10
    p_values: tuple[float, float, float, float] = (1e-4, 1e-100, 0.0, 1e-4)


# The defaults of the filter of consensus pileups.
@dataclass(frozen=True)
class PileupFilter:
    min_depth: int = 3
    max_depth: int = 100
    min_mapq_snp: int = 25
    min_mapq_gap: int = 10
    min_indel_score: float = 25.0
    indel_weight: float = 100.0
    snp_window: int = 10
    dense_window: int = 10
    max_snps: int = 2
    gap_window: int = 30
    min_snp_quality: float = 0.0
    min_indel_quality: float = 0.0


def in_pieces(sites: DataFrame, reach: int) -> DataFrame:
    """``sites(chrom, pos, end, line_no, ...)`` with ``piece``: sites of different pieces are further than ``reach`` apart.

    Rows without chromosome or position are left out.
    """
    tiled = sites.where(F.col("chrom").isNotNull() & F.col("pos").isNotNull()).withColumn("tile", F.floor(F.col("pos") / TILE))
    met = with_earlier_max(tiled, ["chrom"], "tile", ORDER, F.col("end"), "_top")
    starts = F.when(F.col("_top").isNull() | (F.col("_top") + reach < F.col("pos")), F.col("pos"))
    met = with_earlier_max(met.withColumn("_start", starts), ["chrom"], "tile", ORDER, F.col("_start"), "_before")
    return met.withColumn("piece", F.coalesce("_start", "_before")).drop("_top", "_start", "_before", "tile")


def contests(sites: DataFrame, width: int) -> DataFrame:
    """``(line_no, loses, beaten)`` among sites that reach each other: ``pos`` of the later within ``width`` of ``end`` of the earlier.

    A site that ``acts`` meets the earlier ones that reach its position, one after the other: it beats those of lower score
    until the first that isn't lower, to which it loses. Whom it meets doesn't depend on what came of them. Every site lies
    in the cells from its position to its reach, and the outcome in the cell of a site's position follows from the greatest
    scores before and after, so no two sites are paired up.
    """
    cells = sites.select("*", F.explode(F.sequence("pos", F.col("end") + width)).alias("cell"))
    by = Window.partitionBy("chrom", "cell").orderBy(*ORDER)
    arrives = F.col("acts") & (F.col("pos") == F.col("cell"))
    before = F.max("held").over(by.rowsBetween(Window.unboundedPreceding, -1))
    upto = F.max("held").over(by.rowsBetween(Window.unboundedPreceding, 0))
    challenge = F.max(F.when(arrives, F.col("score"))).over(by.rowsBetween(1, Window.unboundedFollowing))
    met = cells.select("line_no", F.coalesce(arrives & (before >= F.col("score")), F.lit(False)).alias("loses"), F.coalesce(challenge > upto, F.lit(False)).alias("beaten"))
    return met.groupBy("line_no").agg(F.max("loses").alias("loses"), F.max("beaten").alias("beaten"))


def fold_pieces(sites: DataFrame, columns: list[str], flag: str, folder: Callable[[], Callable[..., Iterator[int]]]) -> DataFrame:
    """``(line_no, flag)``: the lines that the fold of their piece yields. ``folder()`` starts one and gives the function that takes each site's ``columns``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, step = None, None
        for b in batches:
            out: list[int] = []
            for chrom, piece, *values in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)]):
                if (chrom, piece) != current:
                    current, step = (chrom, piece), folder()
                out.extend(step(*values))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array([True] * len(out))], names=["line_no", flag])

    rows = sites.select("chrom", "piece", *ORDER, *columns)
    return rows.repartition("chrom", "piece").sortWithinPartitions("chrom", "piece", *ORDER).mapInArrow(task, f"line_no long, {flag} boolean").distinct()


def last_standing(width: int) -> Callable[[], Callable[..., Iterator[int]]]:
    """Of indels that reach each other one is left standing at a time: the next one within reach takes its place if its score is higher, else falls."""

    def start():
        champion: list = []

        def step(pos: int, line: int, end: int, score: float, held: float) -> Iterator[int]:
            if champion and champion[0] + width >= pos:
                if champion[1] >= score:
                    yield line
                    return
                yield champion[2]
            champion[:] = end, held, line

        return step

    return start


def crowded(width: int, most: int) -> Callable[[], Callable[..., Iterator[int]]]:
    """SNPs that are more than ``most`` with the counting ones within ``width`` before them. A SNP counts if it is ``sure`` or crowded."""

    def start():
        counted: deque[int] = deque(maxlen=most)

        def step(pos: int, line: int, sure: bool) -> Iterator[int]:
            dense = len(counted) == most and (not most or counted[0] + width >= pos)
            if dense or sure:
                counted.append(pos)
            if dense:
                yield line

        return step

    return start


def _coded(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """``rows`` with the codes of ``codes(line_no, met)``, or their own where neighbours did nothing."""
    return rows.join(codes, "line_no", "left").withColumn("code", F.coalesce("met", "code")).drop("met")


def site_codes(vcf: DataFrame, o: SiteFilter = SiteFilter()) -> DataFrame:
    """Variant sites with ``kind`` (snp, mnp, indel), ``score`` and ``code``, the filter that the site's own annotation meets, or empty."""
    value = lambda k: F.expr(f"try_cast(regexp_extract(info, '(?i){k}', 1) as int)")
    four = [F.expr(f"try_cast(regexp_extract(info, '(?i)DP4=([0-9]+),([0-9]+),([0-9]+),([0-9]+)', {i}) as int)") for i in range(1, 5)]
    depth = F.coalesce(value("DP=([0-9]+)"), four[0] + four[1] + four[2] + four[3], F.lit(-1))
    alts, mq = F.coalesce(four[2] + four[3], F.lit(-1)), F.coalesce(value("MQ=([0-9]+)"), F.lit(-1))
    pv = [F.expr(f"try_cast(regexp_extract(info, 'PV4=([^,]+),([^,]+),([^,]+),([^,;]+)', {i}) as double)") for i in range(1, 5)]
    biased = F.lit(False)
    for v, least in zip(pv, o.p_values):
        biased = biased | F.coalesce(v < least, F.lit(False))
    alleles = F.split("alt", ",")
    other = F.exists(alleles, lambda x: F.length(x) != F.length("ref"))
    longer = F.exists(alleles, lambda x: F.length(x) > 1)
    kind = F.when(F.length("ref") > 1, F.when(other, "indel").otherwise("mnp")).otherwise(F.when(longer, "indel").otherwise("snp"))
    few, poor = (alts >= 0) & (alts < o.min_alt), (mq >= 0) & (mq < o.min_mapq)
    code = F.when(few, "a").when((depth >= 0) & (depth < o.min_depth), "d").when(depth > o.max_depth, "D").when(poor, "Q").when(biased, "P").otherwise("")
    score = F.coalesce(F.expr("try_cast(qual as double)"), F.lit(0.0)) * 100 + alts
    return vcf.where(F.col("alt") != ".").withColumns({"kind": kind, "score": score, "code": code})


def filter_sites(vcf: DataFrame, o: SiteFilter = SiteFilter()) -> DataFrame:
    """``site_codes`` with ``code`` also by neighbours. An empty code passes. ``line_no`` is unique; sites count in order of position and line.

    Only sites without a code of their own act:

    * an SNP or MNP loses (``M``) to an earlier one that covers its position and scores as high, and beats (``M``) the lower
      ones before that;
    * an SNP or MNP within ``snp_window`` after an indel, or before one that acts, gets ``G`` unless it has a code;
    * of indels within ``gap_window`` the one of the higher score stands, the others get ``g``.

    Scores that are held against later sites are whole; one below 0 (no quality and no depths) can't be beaten. A null
    chromosome or position keeps the site's own code; an empty table gives an empty result.
    """
    rows = site_codes(vcf, o)
    held = F.when(F.col("score") < 0, F.lit(2.0**62)).otherwise(F.floor("score").cast("double"))
    end = F.col("pos") + F.length("ref") - 1
    slim = rows.select("line_no", "chrom", "pos", end.alias("end"), (F.col("kind") == "indel").alias("gap"), (F.col("code") == "").alias("acts"), "code", "score", held.alias("held"))
    p = in_pieces(slim, max(o.gap_window, o.snp_window))

    by = Window.partitionBy("chrom", "piece").orderBy(*ORDER)
    gap, acts = F.col("gap"), F.col("acts")
    after_gap = F.max(F.when(gap, F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1)) + o.snp_window >= F.col("pos")
    before_gap = F.min(F.when(gap & acts, F.col("pos"))).over(by.rowsBetween(1, Window.unboundedFollowing)) <= F.col("end") + o.snp_window
    near = p.withColumns({"after_gap": F.coalesce(after_gap, F.lit(False)), "before_gap": F.coalesce(before_gap, F.lit(False))})
    fallen = fold_pieces(p.where(gap & acts), ["end", "score", "held"], "fallen", last_standing(o.gap_window))
    met = near.join(contests(p.where(~gap), 0), "line_no", "left").join(fallen, "line_no", "left")
    code = (
        F.when(gap, F.when(F.col("fallen"), "g").otherwise(F.col("code"))).when(F.col("beaten"), "M").when(~acts, F.col("code")).when(F.col("loses"), "M")
        .when(F.col("after_gap") | F.col("before_gap"), "G").otherwise("")
    )
    return _coded(rows, met.select("line_no", code.alias("met")))


def filter_pileup(lines: DataFrame, o: PileupFilter = PileupFilter()) -> DataFrame:
    """Variant lines of a consensus pileup ``(line_no, chrom, pos, base, call, cons_qual, snp_qual, mapq, depth, first, second, n_first, n_second)`` with ``code``.

    ``first`` and ``second`` are the alleles of an indel line, base ``*``, with the reads that show them. An indel's score is
    its quality plus ``indel_weight`` for every such read. Only lines without a code of their own (depth, quality) act:

    * an SNP that has ``max_snps`` counting ones within ``dense_window`` before it gets ``W``, as do those; SNPs of low mapping
      quality count only if they got ``W`` or ``G``;
    * an SNP within ``snp_window`` after an indel of ``min_indel_score``, or before one of that quality, gets ``G``;
    * an indel loses (``g``) to an earlier one within ``gap_window`` that scores as high, and beats the lower ones before that;
    * low mapping quality (``Q``) shows where nothing else does.

    ``line_no`` is unique; a null chromosome or position keeps the line's own code.
    """
    gap = F.col("base") == "*"
    rows = lines.where((F.upper("base") != F.upper("call")) & (F.col("call") != "*/*"))
    code = (
        F.when(gap & F.lit(o.min_indel_quality > 0) & (F.col("snp_qual") < o.min_indel_quality), "i").when(~gap & F.lit(o.min_snp_quality > 0) & (F.col("snp_qual") < o.min_snp_quality), "s")
        .when(F.col("depth") < o.min_depth, "d").when(F.col("depth") > o.max_depth, "D").otherwise("")
    )
    a, b = F.get(F.split("call", "/"), F.lit(0)), F.coalesce(F.get(F.split("call", "/"), F.lit(1)), F.lit(""))
    longer = F.when(F.length(a) > F.length(b), a).otherwise(b)
    reads = lambda allele, n: F.when(F.col(allele) != "*", F.coalesce(n, F.lit(0)) * o.indel_weight).otherwise(0.0)
    weight = F.col("snp_qual") + F.coalesce(reads("first", F.col("n_first")), F.lit(0.0)) + F.coalesce(reads("second", F.col("n_second")), F.lit(0.0))
    end = F.col("pos") + F.when(gap & F.startswith(longer, F.lit("-")), F.length(longer) - 1).otherwise(0)
    rows = rows.withColumn("code", code)
    poor = F.coalesce(F.col("mapq") < F.when(gap, o.min_mapq_gap).otherwise(o.min_mapq_snp), F.lit(False))
    slim = rows.where("code = ''").select("line_no", "chrom", "pos", end.alias("end"), gap.alias("gap"), F.lit(True).alias("acts"), weight.cast("double").alias("score"), weight.cast("double").alias("held"), poor.alias("poor"), (F.col("snp_qual") >= o.min_indel_score).alias("strong"))
    p = in_pieces(slim, max(o.gap_window, o.snp_window, o.dense_window))

    by = Window.partitionBy("chrom", "piece").orderBy(*ORDER)
    earlier, later = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    gap, place = F.col("gap"), F.struct(*ORDER)
    after_gap = F.coalesce(F.max(F.when(gap & (F.col("score") >= o.min_indel_score), F.col("end"))).over(earlier) + o.snp_window >= F.col("pos"), F.lit(False))
    p = p.withColumn("after_gap", after_gap).withColumn("sure", ~F.col("poor") | F.col("after_gap"))
    dense = fold_pieces(p.where(~gap), ["sure"], "dense", crowded(o.dense_window, o.max_snps))
    near = p.join(dense, "line_no", "left").join(contests(p.where(gap), o.gap_window), "line_no", "left")
    near = near.withColumns({"next_dense": F.min(F.when(F.col("dense"), place)).over(later), "next_gap": F.min(F.when(gap & F.col("strong"), place)).over(later)})
    dense_soon = F.coalesce(F.col("next_dense.pos") <= F.col("pos") + o.dense_window, F.lit(False))
    gap_soon = F.coalesce(F.col("next_gap.pos") <= F.col("pos") + o.snp_window, F.lit(False))
    low = F.when(F.col("poor"), "Q")
    met = F.when(gap, F.when(F.col("loses") | F.col("beaten"), "g").otherwise(F.coalesce(low, F.lit("")))).otherwise(
        F.when(F.col("dense"), "W").when(F.col("after_gap"), "G").when(F.col("poor"), "Q")
        .when(dense_soon & (~gap_soon | (F.col("next_dense") < F.col("next_gap"))), "W").when(gap_soon, "G").otherwise("")
    )
    return _coded(rows, near.select("line_no", met.alias("met")))
