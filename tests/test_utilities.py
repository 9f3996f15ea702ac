import random

from pyspark.sql import functions as F

from hitloom.operators import samutil, sitefilter, variants

VCF = "line_no long, chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string, format string, samples array<string>"


def vcf(spark, rows):
    return spark.createDataFrame([(i, c, p, ".", r, a, q, ".", info, f, s) for i, (c, p, r, a, q, info, f, s) in enumerate(rows)], VCF)


def test_read_and_samples(spark, tmp_path):
    p = tmp_path / "a.vcf"
    p.write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\nc\t5\t.\tA\tG\t.\t.\tDP=3\tGT:PL\t0/1:1\t1/1:2\nshort\t1\n")
    rows, names = variants.read_vcf(spark, str(p))
    assert names == ["S1", "S2"] and rows.count() == 1
    assert variants.select_samples(rows, names, ["S2"]).first().samples == ["1/1:2"]
    assert variants.fill_allele_counts(rows).first().info == "DP=3;AC=3;AN=4"


def test_allele_counts(spark):
    rows = [("c", 1, "A", "G,T", "9", ".", "PL:GT", ["1:0/2", "2:2|1", "0,0,0", "3:./."]), ("c", 2, "A", "G", "9", "AC=7;X=1;AN=2", "GT", ["0/0"]), ("c", 3, "A", "G", "9", "X", "PL", ["1"])]
    assert [r.info for r in variants.fill_allele_counts(vcf(spark, rows)).orderBy("line_no").collect()] == ["AC=1\t2;AN=4", ";X=1;AC=;AN=2", "X"]


def test_tiles(spark):
    refs = spark.createDataFrame([("a", 1000), ("b", 1049), ("c", 1050), ("d", 0), ("e", 30)], "ref_name string, ref_length int")
    got = {}
    for r in variants.tiles(refs, 500).collect():
        got.setdefault(r.ref_name, []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {"a": [(1, 500), (501, 1000)], "b": [(1, 500), (501, 1049)], "c": [(1, 500), (501, 1000), (1001, 1050)], "e": [(1, 30)]}


def test_linkage_and_lengths(spark):
    rows = [("c", 10, "A", "G", "1", "NEIR=0.95", None, None), ("c", 15, "A", "G", "1", "NEIR=0.99", None, None), ("c", 18, "A", "G", "1", "x", None, None), ("c", 20, "AT", "A,ATTG", "1", "NEIR=0.1", None, None), ("d", 25, "A", "+CC", "1", "NEIR=1.0", None, None)]
    assert tuple(variants.linkage_stats(vcf(spark, rows)).first()) == (1, 0.25, 5)
    n = variants.indel_lengths(vcf(spark, rows))
    assert {r.length: r.n for r in n.collect()} == {-1: 0.5, 2: 1.5}
    assert tuple(variants.indel_frame(n).first()) == (2.0, 0.0, 0.0)


def test_quality_stats(spark):
    rows = [("c", 1, "A", "G", "30", "", None, None), ("c", 2, "A", "C", "20", "", None, None), ("c", 3, "A", "T", ".", "", None, None), ("c", 4, "AT", "A", "50", "", None, None), ("c", 5, "a", "g", "20", "", None, None), ("c", 6, "N", "G", "40", "", None, None)]
    ref = spark.createDataFrame([("c", 1), ("c", 9)], "chrom string, pos long")
    got = [tuple(r) for r in variants.quality_stats(vcf(spark, rows), ref, 0.1).orderBy(F.desc("qual")).collect()]
    assert got == [(30.0, 1, 1, 1, 1, 100.0, 0.5, 1.0, 100.0), (20.0, 3, 3, 2, 1, 2.0, 0.5, 0.3333, 1.0), (3.0, 4, 4, 2, 1, 1.0, 0.5, 0.25, 0.0)]
    assert variants.quality_stats(vcf(spark, []), ref).count() == 0
    alleles = spark.createDataFrame([("c", 1, "T,G"), ("c", 2, "T"), ("c", 9, "A")], "chrom string, pos long, alt string")
    assert [r.hits for r in variants.quality_stats(vcf(spark, rows), alleles, 0.9).collect()] == [1]
    assert [r.hits for r in variants.quality_stats(vcf(spark, rows), step=0.9).collect()] == [0]


def test_quality_stats_marks(spark):
    """Against the marks as a plain loop over sites from the best quality down."""
    r = random.Random(8)
    rows = [("c", i, r.choice("ACGT"), r.choice(["A", "C", "G", "T", "."]), str(r.choice([9, 9.5, 12, 30.25, 77, 410, -2])), "", None, None) for i in range(400)]
    best = sorted(({"q": max(float(x[4]), 0) or 3.0, "snp": x[3] not in (".", x[2])} for x in rows), key=lambda x: -x["q"])
    want, mark = [], 0.0
    for q in sorted({x["q"] for x in best}, reverse=True):
        seen = [x for x in best if x["q"] >= q]
        if len(seen) / 401 > mark + 0.15 or len(seen) == 400:
            want.append((q, len(seen), sum(x["snp"] for x in seen)))
            mark = len(seen) / 401
    assert [(x.qual, x.sites, x.snps) for x in variants.quality_stats(vcf(spark, rows), step=0.15).orderBy(F.desc("qual")).collect()] == want


def walked(sites, o):
    """The staging list as plain loops over all earlier sites of the chromosome."""
    out = [s["code"] for s in sites]
    for i, s in enumerate(sites):
        near = [j for j in range(i) if sites[j]["chrom"] == s["chrom"]]
        if out[i]:
            continue
        reach = lambda j, w: sites[j]["pos"] + sites[j]["span"] + w >= s["pos"]  # noqa: E731, B023
        if s["indel"]:
            for j in near:
                if not sites[j]["indel"] and not out[j] and reach(j, o.snp_window):
                    out[j] = "G"
            for j in near:
                if sites[j]["indel"] and not out[j] and reach(j, o.gap_window):
                    if sites[j]["score"] >= s["score"]:
                        out[i] = "g"
                        break
                    out[j] = "g"
        else:
            if any(sites[j]["indel"] and reach(j, o.snp_window) for j in near):
                out[i] = "G"
            for j in near:
                if not sites[j]["indel"] and reach(j, 0):
                    if sites[j]["score"] >= s["score"]:
                        out[i] = "M"
                        break
                    out[j] = "M"
    return out


def test_site_filter(spark):
    r, o = random.Random(3), sitefilter.SiteFilter(gap_window=6, snp_window=5)
    rows, pos = [], 0
    for i in range(300):
        pos = 1 if i == 150 else pos + r.choice([0, 1, 2, 4, 9, 30])
        a, b = r.choice([("A", "G"), ("A", "AT"), ("ATG", "A"), ("AT", "GC"), ("A", ".")])
        info = r.choice(["DP=20;MQ=40", "DP=1;MQ=40", "DP4=1,1,1,0;MQ=60", "DP=20;MQ=3", "DP=20000", "DP=9;PV4=0.5,0.5,0.5,0.00001", "DP=9"])
        rows.append(("c1" if i < 150 else "c2", pos, a, b, str(r.randrange(1, 9)), info, None, None))
    df = vcf(spark, rows)
    own = sitefilter.site_codes(df, o).select("line_no", "chrom", "pos", (F.length("ref") - 1).alias("span"), (F.col("kind") == "indel").alias("indel"), "score", "code").orderBy("line_no").collect()
    assert {x.code for x in own} == {"", "d", "a", "Q", "D", "P"}
    want = {x.line_no: c for x, c in zip(own, walked([x.asDict() for x in own], o))}
    got = {x.line_no: x.code for x in sitefilter.filter_sites(df, o).collect()}
    assert got == want and {"G", "g", "M"} <= set(got.values())


def test_conversions(spark):
    snps = spark.createDataFrame([("c", 9, "rs1", "+", "A", "A/G", "genomic", "single", "unknown", 0.0), ("c", 9, "rs2", "-", "A", "T/C", "genomic", "single", "by-freq", 0.5), ("c", 9, "rs3", "+", "-", "-/AC", "genomic", "ins", "unknown", 0.0)], "chrom string, start long, name string, strand string, ref string, observed string, mol_type string, class string, valid string, avg_het double")
    rows = {r.id: (r.pos, r.ref, r.alt, r.info) for r in variants.snps_to_vcf(snps).collect()}
    assert rows["rs1"] == (10, "A", "G", "molType=genomic;class=single") and rows["rs2"][1:] == ("A", "G", "molType=genomic;class=single;valid=by-freq;AF=0.5") and rows["rs3"][:3] == (9, "N", "NAC")
    calls = spark.createDataFrame([("rs1", "A/G", ["AG", "NN", "GG"]), ("rs2", "G/A", ["AA", "TA", "GG"]), ("rs4", "A/G", ["AG"]), ("rs1", "C/G", ["CC"])], "name string, alleles string, calls array<string>")
    sites = spark.createDataFrame([("c", 9, 10, "rs1", "A"), ("c", 9, 10, "rs2", "A"), ("c", 9, 12, "rs4", "A")], "chrom string, start long, end long, name string, ref string")
    assert [(r.id, r.alt, r.samples) for r in variants.genotypes_to_vcf(calls, sites).collect()] == [("rs1", "G", ["0/1", "./.", "1/1"])]
    lines = spark.createDataFrame([("c", 1, "*", c, "9") for c in ("*/*", "*/+AC", "-A/-A", "-A/-CCC", "+G/-CC", "+G/+TT")] + [("c", 2, "A", "R", "9")], "chrom string, pos long, base string, call string, qual string")
    assert sorted((r.ref, r.alt) for r in variants.indel_pileup_to_vcf(lines).collect()) == sorted([("N", "NAC"), ("NA", "N"), ("NCCC", "NNN,N"), ("NCC", "NGNN,N"), ("N", "NG,NTT")])


def test_sam_utilities(spark):
    rows = [(1, "q1", 0, "c", 10, 30, "5M2I3M1D", "ACGTACGTAC", "ABCDEFGHIJ", []), (2, "q1", 16, "c", 50, 5, "10M", "ACG", "XYZ", []), (3, "q2", 80, "d", 9, 7, "4M", "AC", "*", ["AS:i:77"]), (4, "q3", 128, "d", 9, 7, "*", "*", "*", [])]
    df = spark.createDataFrame(rows, "line_no long, qname string, flag int, rname string, pos long, mapq int, cigar string, seq string, qual string, tags array<string>")
    assert [r.v for r in df.orderBy("line_no").select(samutil.aligned_length(F.col("cigar")).alias("v")).collect()] == [10, 10, 4, 0]
    fq = {r.value for r in samutil.sam_to_fastq(df, 2).collect()}
    assert fq == {"@q1\nACGTACGTAC\n+\nABCDEFGHIJ", "@q1\nCGT\n+\nZYX", "@q2/1\nGT"}
    best = {r.qname: (r.line_no, r.mapq, r.score) for r in samutil.best_alignments(df).collect()}
    assert best == {"q1": (2, 225, 10), "q2": (3, 250, 77), "q3": (4, 250, 1)}
    assert {r.qname: r.mapq for r in samutil.best_alignments(df, recalibrate=False).collect()}["q2"] == 7
    assert {r.qname: r.mapq for r in samutil.best_alignments(df, multi_only=True).collect()} == {"q1": 225, "q2": 7, "q3": 7}
    moved = df.where("qname != 'q3'").withColumn("pos", F.col("pos") + F.when(F.col("qname") == "q2", 500).otherwise(1)).withColumn("mapq", F.lit(60))
    n = {r["class"]: r.n for r in samutil.compare_alignments(df, moved).collect()}
    assert len(n) == 10 and {k: v for k, v in n.items() if v} == {"consistent low high": 1, "inconsistent low high": 1, "second missing low": 1}


def test_consensus(spark):
    rows = [("c", 2, "A", ".", ".", "FQ=-40;MQ=20;DP=9", None, None), ("c", 3, "A", "G", ".", "FQ=-10.6;AF1=1;MQ=20;DP=9", None, None), ("c", 4, "G", "A", ".", "FQ=20;MQ=20;DP=9", None, None), ("c", 4, "GT", "G", ".", "x", None, None), ("c", 30, "C", ".", ".", "FQ=-200;MQ=3;DP=9", None, None), ("c", 125, "T", "C", ".", "FQ=-40;AF1=0.2;MQ=20;DP=9", None, None)]
    sites, gaps = variants.vcf_bases(vcf(spark, rows), window=1)
    lines = {r.line: (r.seq, r.qual) for r in variants.consensus_lines(sites, gaps).collect()}
    assert lines[0] == ("nAGr" + "n" * 25 + "c" + "n" * 30, "!I,5" + "!" * 25 + "~" + "!" * 30)
    assert lines[1] == ("n" * 60, "!" * 60) and lines[2] == ("nnnnT", "!!!!I")
    text = [r.value for r in variants.consensus_fastq(variants.consensus_lines(sites, gaps)).collect()]
    assert text[0] == "@c" and text[4] == "+" and len(text) == 8
    plp = spark.createDataFrame([("c", 1, "a", "R", 30, 0, 60, 9), ("c", 2, "A", "A", 30, 0, 9, 9), ("c", 2, "*", "+A/+A", 30, 90, 60, 9), ("c", 14, "A", "T", 30, 0, 60, 9)], "chrom string, pos long, base string, call string, cons_qual int, snp_qual int, mapq int, depth int")
    sites, gaps = variants.pileup_bases(plp, window=6)
    assert [r.seq for r in variants.consensus_lines(sites, gaps).collect()] == ["ra" + "n" * 11 + "T"]


def test_pileup_filter(spark):
    kind = "line_no long, chrom string, pos long, base string, call string, cons_qual int, snp_qual int, mapq int, depth int, first string, second string, n_first int, n_second int"
    snp = lambda i, pos, call="G", q=50, mapq=60, depth=9, chrom="c": (i, chrom, pos, "A", call, 9, q, mapq, depth, None, None, None, None)
    gap = lambda i, pos, call="*/-AC", q=50, n=5: (i, "c", pos, "*", call, 9, q, 60, 9, "*", call[2:], 4, n)
    rows = [snp(0, 1, "a"), snp(1, 10), snp(2, 100, depth=1), snp(3, 200, mapq=3), snp(4, 300, depth=1000), snp(5, 400), snp(6, 405), snp(7, 410), gap(8, 500), snp(9, 511), snp(10, 514), gap(11, 600, q=9), gap(12, 620), snp(13, 700), gap(14, 705), gap(15, 800, "*/*"), snp(16, 810, chrom="d")]
    df = spark.createDataFrame(rows, kind)
    code = {r.line_no: r.code for r in sitefilter.filter_pileup(df).collect()}
    assert code == {1: "", 2: "d", 3: "Q", 4: "D", 5: "W", 6: "W", 7: "W", 8: "", 9: "G", 10: "", 11: "g", 12: "", 13: "G", 14: "", 16: ""}
    strict = {r.line_no: r.code for r in sitefilter.filter_pileup(df, sitefilter.PileupFilter(min_snp_quality=60, min_indel_quality=60)).collect()}
    assert strict[1] == "s" and strict[8] == "i"


def plain_pileup(rows, o):
    """Codes of ``(chrom, pos, gap, end, score, qual, mapq, own)`` in order, each line against all earlier ones."""
    out = []
    for i, t in enumerate(rows):
        near = [j for j in range(i) if rows[j]["chrom"] == t["chrom"] and not rows[j]["own"]]
        gaps, snps = [j for j in near if rows[j]["gap"]], [j for j in near if not rows[j]["gap"]]
        within = lambda j, w: rows[j]["end"] + w >= t["pos"]  # noqa: E731, B023
        code = t["own"]
        if not code and t["gap"]:
            code = "Q" if t["mapq"] < o.min_mapq_gap else ""
            for j in snps:
                if t["qual"] >= o.min_indel_score and within(j, o.snp_window) and not out[j]:
                    out[j] = "G"
            for j in gaps:
                if within(j, o.gap_window):
                    if rows[j]["score"] >= t["score"]:
                        code = "g"
                        break
                    out[j] = "g"
        elif not code:
            code = "Q" if t["mapq"] < o.min_mapq_snp else ""
            close = [j for j in snps if within(j, o.dense_window)]
            if 1 + sum(out[j] in ("", "W", "G") for j in close) > o.max_snps:
                code = "W"
                for j in close:
                    out[j] = out[j] or "W"
            elif any(rows[j]["score"] >= o.min_indel_score and within(j, o.snp_window) for j in gaps):
                code = "G"
        out.append(code)
    return out


def test_pileup_filter_at_random(spark):
    r, o = random.Random(5), sitefilter.PileupFilter(gap_window=12, min_snp_quality=5, min_indel_quality=5, min_indel_score=210, dense_window=14, max_snps=2)
    kind = "line_no long, chrom string, pos long, base string, call string, cons_qual int, snp_qual int, mapq int, depth int, first string, second string, n_first int, n_second int"
    rows, plain, pos = [], [], 0
    for i in range(500):
        pos = 1 if i == 250 else pos + r.choice([0, 0, 1, 3, 5, 8, 40])
        chrom, gap = "a" if i < 250 else "b", r.random() < 0.3
        call = r.choice(["*/-AC", "+A/*", "-ACGTACG/*", "*/*"]) if gap else r.choice("AGCT")
        q, m, d, n = r.choice([3, 40, 220, 230]), r.choice([5, 15, 60, 60]), r.choice([1, 9, 9, 9, 9, 500]), r.choice([0, 1, 2])
        rows.append((i, chrom, pos, "*" if gap else "A", call, 9, q, m, d, "*", "x", 4, n))
        if call in ("A", "*/*"):
            continue
        own = ("i" if gap else "s") if q < 5 else "d" if d < 3 else "D" if d > 100 else ""
        span = {"*/-AC": 2, "-ACGTACG/*": 7}.get(call, 0)
        plain.append({"line": i, "chrom": chrom, "pos": pos, "gap": gap, "end": pos + span, "score": q + 100.0 * n, "qual": q, "mapq": m, "own": own})
    want = dict(zip([x["line"] for x in plain], plain_pileup(plain, o)))
    got = {x.line_no: x.code for x in sitefilter.filter_pileup(spark.createDataFrame(rows, kind), o).collect()}
    assert {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {}
    assert {"", "G", "g", "W", "Q", "s", "i", "d", "D"} <= set(got.values())


def test_site_filter_edges(spark):
    rows = [(None, 5, "A", "G", "9", "", None, None), ("c", None, "A", "G", "9", "DP=0", None, None), ("c", 70_000, "A", "G", ".", "", None, None), ("c", 70_000, "A", "T", "50", "", None, None), ("c", 65_530, "ACGTACGTACG", "A", "9", "DP4=0,0,3,3", None, None)]
    got = {r.line_no: r.code for r in sitefilter.filter_sites(vcf(spark, rows)).collect()}
    # Without quality and depths a score is below 0, which no later one beats.
    assert got == {0: "", 1: "d", 2: "", 3: "M", 4: ""}
    far = [("c", 65_530, "ACGTACGTACG", "A", "9", "DP4=0,0,3,3", None, None), ("c", 65_545, "A", "G", "9", "", None, None)]
    assert {r.line_no: r.code for r in sitefilter.filter_sites(vcf(spark, far)).collect()} == {0: "", 1: "G"}
    assert sitefilter.filter_sites(vcf(spark, [])).count() == 0
