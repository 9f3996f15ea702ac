import random

import pytest
from pyspark.sql import functions as F

from hitloom.compat import Compat
from hitloom.functions import cigar, flags, mapq, seq
from hitloom.operators import convert, hits, pileup, sam, sort

SCHEMA = "record_no long, sample_id string, header string, seq string, alignment array<string>, strands array<string>, ref_names array<string>, mismatches array<int>, positions array<long>, multi_count int"


def value(spark, column, **cells):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()]).select(column.alias("v")).first()[0]


def loop_mapq(a, primary, multi):
    import math

    score, gap = 0, False
    for c in a:
        if c in ".x":
            score, gap = score + (2 if c == "." else -4), False
        else:
            score, gap = score - (1 if gap else 6), True
    best = 2 * sum(c != "-" for c in a)
    if not best:
        return 0
    raw = score / best * 60 - (min(60, 5 * math.log2(multi)) if multi > 1 else 0)
    raw = max(0, min(60, raw if primary else raw * 0.6))
    return max(x for x in mapq.LEVELS if raw >= x)


def test_cigar(spark):
    c = lambda a, r=False: value(spark, cigar.cigar(F.col("a"), F.lit(r)), a=a)
    o = lambda a, r=False: value(spark, cigar.cigar_by_op(F.col("a"), F.lit(r)), a=a)
    assert c("..xx.A--.*") == "2M2X1M1I2D1M1S" and c("..xx.A--.*", True) == "1S1M2D1I1M2X2M"
    assert c("AC") == "1I1I" and o("AC") == "2I" and c("AA") == o("AA") == "2I" and c("") == o("") == ""
    assert o("xM*S-.") == "1X1I1S1I1D1M"
    assert value(spark, cigar.edit_distance(F.col("a")), a="..xx.A--.*") == 5


def test_mapq_equals_the_loop(spark):
    r = random.Random(1)
    rows = [("".join(r.choice("....x-A*") for _ in range(r.randrange(0, 30))), r.random() < 0.5, r.randrange(1, 9)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, p boolean, m int").select("a", "p", "m", mapq.mapq(F.col("a"), F.col("p"), F.col("m")).alias("q"))
    for x in df.collect():
        assert x.q == loop_mapq(x.a, x.p, x.m), x
    assert value(spark, mapq.mapq(F.col("a"), F.lit(True), F.lit(1)), a="." * 30) == 60


def test_flags_and_strands(spark):
    f = lambda s, **k: value(spark, flags.sam_flag(F.col("s"), **k), s=s)
    assert f("F") == 0 and f("R") == 16 and f("F", secondary=True) == 256 and f("R", secondary=True) == 272
    assert f("F", paired=True, proper=True, first=True) == 1 + 2 + 32 + 64
    assert f("R", unmapped=True, mate_unmapped=True, proper=True) == 16 + 4
    rc = seq.reverse_complement(F.col("s"))
    assert value(spark, rc, s="ACGTNacgtnX") == "XnacgtNACGT"
    assert value(spark, seq.reverse_complement(rc), s="ACGGTTN") == "ACGGTTN"


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        (1, "s", "r1", "ACGTA", [".....", "..x.A", "....."], ["F", "R", "F"], ["c1", "c2", "c1"], [0, 1, 0], [0, 3, 8], 3),
        (2, "s", "r2", "GGG", None, ["F"], ["c1"], [0], [1], 1),
        (3, "s", "r3", "TT", [".."], ["R"], [" c2\r"], [0], [9], None),
        (4, "s", "r4", "TT", [".."], ["R"], None, [0], [9], None),
        (5, "s", "r5", None, [".."], ["F"], ["c2"], [0], [0], 1),
        (6, "s", "r6", "AA", ["..", ".x"], ["F", "F"], ["c1", "c1"], [0, 0], [0, 1], 1),
    ]
    return hits.with_hits(spark.createDataFrame(rows, SCHEMA))


def test_sam_rows(records):
    rows = {(r.record_no, r.hit_idx): r for r in sam.sam_rows(records).collect()}
    assert set(rows) == {(1, 0), (1, 1), (1, 2), (3, 0), (6, 0)}  # 6: other hits need a multi_count over 1
    first, second = rows[1, 0], rows[1, 1]
    assert (first.flag, first.rname, first.pos, first.cigar, first.seq) == (0, "c1", 1, "5M", "ACGTA")
    assert (second.flag, second.pos, second.cigar, second.seq, second.sa) == (272, 4, "1I1M1X2M", "TACGT", None)
    assert first.nm == second.nm == "NM:i:0"  # that of the last hit
    assert first.sa == f"SA:Z:c2,4,R,1I1M1X2M,{second.mapq},1;c1,9,F,5M,{rows[1, 2].mapq},0"
    fixed = {(r.record_no, r.hit_idx): r for r in sam.sam_rows(records, Compat.corrected()).collect()}
    assert fixed[1, 1].nm == "NM:i:2" and ",-," in fixed[1, 0].sa
    assert rows[3, 0].rname == "c2" and rows[3, 0].xn == "XN:i:1"
    assert {(r.record_no, r.hit_idx) for r in sam.bam_rows(records).collect()} == set(rows) | {(6, 1)}
    assert sam.sam_lines(sam.sam_rows(records)).count() == 5


def test_regions(records):
    kept = lambda *r, **k: sorted(x.record_no for x in sam.filter_regions(records, list(r), **k).collect())
    assert kept(("c1", 0, 1)) == [1, 6]
    assert kept(("c2", 9, 10)) == [3] and kept() == [1, 2, 3, 5, 6] and kept(compat=Compat.corrected()) == []
    table = records.sparkSession.createDataFrame([("c2", 9, 10), ("c1", 1, 2), ("c1", 0, 9)], "ref_name string, start long, end long")
    assert sorted(x.record_no for x in sam.filter_region_table(records, table).collect()) == [1, 2, 3, 6]
    lengths = {"c1": 100, "c:2": 50}
    assert sam.parse_regions("c1:0-10, c1 ,c:2:3,zz,c1:5-,c1:x-2,c1:200-300", lengths) == ([("c1", 0, 10), ("c1", 0, 100), ("c:2", 3, 4)], ["zz", "c1:5-", "c1:x-2", "c1:200-300"])
    assert sam.parse_regions("c1:5-", lengths, Compat.corrected()) == ([("c1", 5, 100)], [])


def test_bed_and_fastx(records, spark):
    rows = [(r.chrom, r.start, r.end, r.name, r.strand_sign) for r in convert.bed6(records).where("record_no = 1").orderBy("hit_idx").collect()]
    assert rows == [("c1", 0, 5, "#r1", "+"), ("c2", 3, 8, "#r1", "-"), ("c1", 8, 13, "#r1", "+")]
    limited = lambda n: sorted(r.record_no for r in convert.bed_limit(records, n).collect())
    assert limited(1) == [1] and limited(4) == [1, 2] and limited(99) == [1, 2, 3, 5, 6]
    assert value(spark, convert.fastq_line(F.col("h"), F.col("s")), h="a", s="ACG") == "@a\nACG\n+\nIII"
    assert value(spark, convert.unmapped_sequence(F.col("s")), s=" \r") == "N"


def test_pileup_of_several_batches(spark):
    """Deep tiles whose rows come in several batches, hits over tile borders, against plain loops."""
    r = random.Random(4)
    refs = spark.createDataFrame([("a", 200, "ACGT" * 50), ("b", 70, None), ("c", 0, "")], "ref_name string, ref_length int, seq string")
    rows = [(k, "".join(r.choice("ACGTÑ") for _ in range(r.randrange(1, 90))), [r.choice("abx")], [r.randrange(-2, 190)], ["F"]) for k in range(60)]
    df = spark.createDataFrame(rows, "record_no long, seq string, ref_names array<string>, positions array<long>, strands array<string>")
    want = {}
    for _, letters, (name,), (pos,), _ in rows:
        for i, base in enumerate(letters):
            if pos >= 0 and pos + i < {"a": 200, "b": 70}.get(name, 0):
                want[name, pos + i + 1] = want.get((name, pos + i + 1), "") + base
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = pileup.pileup(hits.with_hits(df), refs).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(x.ref_name, x.pos): x.bases for x in got if x.bases} == want and len(got) == 270
    assert all(x.ref_base == ("ACGT"[(x.pos - 1) % 4] if x.ref_name == "a" else "N") and len(x.quals) == x.depth for x in got)


def test_pileup(records, spark):
    refs = spark.createDataFrame([("c1", 10, "acgtacgtac"), ("c2", 5, "ACGTA"), ("c3", 2, "GG")], "ref_name string, ref_length int, seq string")
    full = {(r.ref_name, r.pos): r for r in pileup.pileup(records, refs).collect()}
    assert len(full) == 17
    assert (full["c1", 2].bases, full["c1", 2].depth, full["c1", 2].ref_base, full["c1", 2].quals) == ("CGAA", 4, "C", "????")  # records 1, 2, 6 (twice)
    assert full["c1", 10].bases == "C" and full["c2", 5].bases == "C" and full["c3", 1].depth == 0  # hits end with the reference
    deep = {(r.ref_name, r.pos): r.depth for r in pileup.pileup(records, refs, 1).collect()}
    assert deep == {k: r.depth for k, r in full.items() if r.depth}
    assert {(r.ref_name, r.pos + 1): r.depth for r in pileup.depth(records, refs).collect()} == deep
    assert pileup.pileup(records, refs, 1, compat=Compat.corrected()).where("ref_name = 'c2' and pos = 4").first().bases == "T"


def test_sort(spark):
    rows = [(1, "q2", 0, "c2", 5), (2, "q1", 16, "c1", 5), (3, "q1", 0, "c1", 5), (4, "q3", 4, "*", 0), (5, "q0", 0, "c1", 0), (6, "q1", 0, "c1", 5)]
    df = spark.createDataFrame(rows, "line_no long, qname string, flag int, rname string, pos long")
    assert [r.line_no for r in sort.sort_by_coordinate(df).collect()] == [3, 6, 2, 5, 1, 4]
    assert [r.line_no for r in sort.sort_by_name(df).collect()] == [5, 2, 3, 6, 1, 4]
    head = spark.createDataFrame([(1, "@CO\tx"), (2, "@SQ\tb"), (3, "@HD\t1"), (4, "@SQ\ta"), (5, "@ZZ\t1")], "line_no long, value string")
    assert [r.line_no for r in sort.header_order(head).collect()] == [3, 2, 4, 1, 5]
