import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from hitloom.compat import Compat
from hitloom.functions import attrs, intervals
from hitloom.operators import annotate, tracks
from hitloom.sinks import files
from hitloom.sources import annotation, counts, fastx, paths, records, sam

TEXT = "h1 x\tACGT\t....,..x.\nF,R\tt1,t2\t1\t5,6\t2\nh2\tAC\nF\tt,3\t0\t7\t1\n\nx\nh3\tAC\nF\tt4\t0\t8\t4\nshort\nF\tt\t0\t1\t1\nodd\tAC\n"


def test_records(spark, tmp_path):
    plain, packed, archive = tmp_path / "a.rec", tmp_path / "b.rec.gz", tmp_path / "c.rec.zip"
    plain.write_text(TEXT)
    with gzip.open(packed, "wt") as f:
        f.write(TEXT.replace("\n", "\r\n"))
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("first", TEXT)
        z.writestr("second", "no\n")
    want = [("h1 x", ["t1", "t2"], [5, 6], [1, 1], ["F", "R"], ["....", "..x."], 2), ("h2", ["t,3"], [7], [0], ["F"], None, 1), ("h3", ["t4"], [8], [0], ["F"], None, 4)]
    shown = lambda df: [(r.header, r.ref_names, r.positions, r.mismatches, r.strands, r.alignment, r.multi_count) for r in df.orderBy("record_no").collect()]
    for p in (plain, packed):
        assert shown(records.read_records(spark, str(p))) == want
    assert [r[0] for r in shown(records.read_records(spark, str(plain), stop_at_blank=True))] == ["h1 x", "h2"]
    for p in (plain, packed, archive):
        assert shown(records.read_record_ranges(spark, [str(p)])) == want
    empty = tmp_path / "e.zip"
    zipfile.ZipFile(empty, "w").close()
    with pytest.raises(ValueError):
        records.open_binary(str(empty))


def test_record_ranges_of_any_size(spark, tmp_path):
    p = tmp_path / "a.rec"
    p.write_text("".join(f"head{i}\t{'ACGT' * (i % 7 + 1)}\nF\tt{i}\t0\t{i}\t1\n" for i in range(300)))
    for size in (7, 31, 64, 1000):
        got = records.read_record_ranges(spark, [str(p)], size).select("header", "ref_names").collect()
        assert sorted(r.header for r in got) == sorted(f"head{i}" for i in range(300)), size


def test_record_ranges_at_malformed_lines(spark, tmp_path):
    bad = ["X\tt{i}\t0\t{i}\t1", "F\tt{i}\t0\t-{i}\t1", "", "F\tt{i}\t0\t{i}\t+1"]
    lines = [x for i in range(80) for x in (f"head{i}\t{'ACGT' * (i % 7 + 1)}", (bad[i // 3 % 4] if i % 3 else "F\tt{i}\t0\t{i}\t1").format(i=i))]
    lines[41] = lines[40] = "F\tt\t0\t1\t1"  # a first line that looks like a second one
    p = tmp_path / "a.rec"
    p.write_text("\n".join(lines))
    shown = lambda df: sorted((r.header, r.ref_names, r.strands, r.positions) for r in df.collect())
    want = shown(records.read_records(spark, str(p)))
    assert len(want) > 60
    for size in (23, 41, 64, 300):
        assert shown(records.read_record_ranges(spark, [str(p), str(p)], size)) == sorted(want * 2), size
    spark.dataSource.register(records.RecordSource)
    assert shown(records.from_lines(spark.read.format("records").option("path", str(p)).option("rangebytes", 50).load())) == want


def test_unmapped_and_fastx(spark, tmp_path):
    u = tmp_path / "u"
    u.write_bytes(b"r1\tACG\r\nr2\r\n\r\nr3\t")
    assert [tuple(r) for r in records.read_unmapped(spark, str(u)).collect()] == [("r1", "ACG"), ("r2", ""), ("r3", "")]
    fa = tmp_path / "a.fa"
    fa.write_bytes(b">one x\r\nac\r\ngt\r\n>two\nGG\n>one again\nTTT\n")
    assert [(r.header, r.seq) for r in fastx.read_fasta(spark, str(fa)).orderBy("record_no").collect()] == [("one x", "acgt"), ("two", "GG"), ("one again", "TTT")]
    assert [(r.ref_name, r.seq, r.ref_length) for r in fastx.read_references(spark, str(fa)).orderBy("ref_ord").collect()] == [("one", "TTT", 3), ("two", "GG", 2)]
    fq = tmp_path / "a.fq"
    fq.write_text("@a 1\nAC\n+\nII\nnoise\n@b\nGG\n+\nIJ\n\n@c\nT\n+\nI\n")
    assert [(r.header, r.seq, r.qual) for r in fastx.read_fastq(spark, str(fq)).orderBy("record_no").collect()] == [("a 1", "AC", "II"), ("b", "GG", "IJ")]


def test_sam_and_counts(spark, tmp_path):
    s = tmp_path / "a.sam"
    s.write_text("@HD\tVN:1\nq\t0\tc\t5\t60\t3M\t*\t0\t0\tACG\t*\tXM:i:1\tXN:i:2\nshort\t1\n@CO\tlate\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\n")
    head, rows = sam.read_sam(spark, str(s))
    assert head.count() == 2 and [(r.qname, r.pos, r.tags) for r in rows.orderBy("line_no").collect()] == [("q", 5, ["XM:i:1", "XN:i:2"]), ("q2", 0, [])]
    (tmp_path / "S1.counts_gene_level_unique.csv").write_text("Gene,Final_EM\ng1,2.50\ng2,\n")
    c = counts.read_counts(spark, str(tmp_path / "*.csv"))
    assert {(r.sample_id, r.key, r.n) for r in counts.long_counts(c, "Final_EM").collect()} == {("S1", "g1", 2.5), ("S1", "g2", 0.0)}
    assert {r.n for r in counts.long_counts(c, "absent").collect()} == {0.0}


def test_paths(tmp_path):
    for n in ("a.rec", "b.REC", "c.txt"):
        (tmp_path / n).write_text("")
    d = str(tmp_path)
    assert paths.resolve_inputs(f'"{d}/b.REC", {d}', [".rec"]) == [f"{d}/b.REC", f"{d}/a.rec"]
    assert paths.resolve_inputs(f"{d}/*.txt") == [f"{d}/c.txt"] and paths.resolve_inputs("") == []
    with pytest.warns(UserWarning):
        assert paths.resolve_inputs(f"{d}/none.x") == []


GTF = """#c
1\ts\ttranscript\t101\t400\t.\t-\t.\tgene_id "g1"; transcript_id "t1"; gene_name "old"; gene_biotype "pc";
1\ts\texon\t301\t400\t.\t-\t.\tgene_id "g1"; transcript_id "t1";
1\ts\texon\t101\t200\t.\t-\t.\tgene_id "g1"; transcript_id "t1";
1\ts\tCDS\t151\t200\t.\t-\t0\tgene_id "g1"; transcript_id "t1"; protein_id "p1";
1\ts\tfive_prime_UTR\t391\t400\t.\t-\t.\tgene_id "g1"; transcript_id "t1";
1\ts\texon\t1\t50\t.\t+\t.\tgene_id "g2"; transcript_id "late";
1\ts\ttranscript\t1\t60\t.\t+\t.\tgene_id "g2"; transcript_id "late";
1\ts\texon\t1\t99\t.\t+\t.\tgene_id "g2"
1\ts\tncRNA\t1\t99\t.\t+\t.\tgene_id "g9"; transcript_id "n";
2\ts\ttranscript\t151\t250\t.\t+\t.\tgene_id "g1"; transcript_id "t2";
2\ts\texon\t151\t250\t.\t+\t.\tgene_id "g1"; transcript_id "t2"; gene_name "new"; gene_biotype "last";
"""


def test_gtf(spark, tmp_path):
    p = tmp_path / "a.gtf"
    p.write_text(GTF)
    tx = annotate.transcripts(annotation.read_features(spark, str(p)), "gtf")
    rows = {r.txname: r for r in annotate.with_gene_metrics(tx).collect()}
    t1, late = rows["t1"], rows["late"]
    assert set(rows) == {"t1", "t2", "late"}
    assert (t1.txstart, t1.txend, t1.cdsstart, t1.cdsend, t1.txlength, t1.cdslength, t1.utr5length, t1.utr3length, t1.exoncount) == (100, 400, 150, 200, 200, 50, 10, 0, 2)
    assert (t1.symbol, t1.g_biotype, t1.t_biotype, t1.protein_id) == ("new", "last", "pc", "p1")  # the gene's last line gives its name
    assert (late.txlength, late.exoncount, late.cdsstart, late.cdsend) == (0, 0, 0, 0)  # its exon came before it
    assert (t1.genelongesttxlength, t1.genenonoverlaplength, t1.geneeffectivelength, t1.genereadcoveredlength) == (200, 250, 250, 250)  # whatever the chromosome
    assert late.geneeffectivelength == 0
    assert tuple(annotate.validate(annotate.with_gene_metrics(tx)).first()) == (True, True)
    rna = {r.txname: r for r in annotate.rna_coordinates(tx).collect()}["t1"]
    assert [tuple(x) for x in rna.exons] == [(0, 100), (100, 200)] and (rna.chrom, rna.strand, rna.txend, rna.cdsstart, rna.cdsend) == ("t1", "+", 200, 10, 60)
    three = tx.where("txname = 't1'").withColumn("exons", F.array(F.struct(F.lit(300).alias("s"), F.lit(330).alias("e")), F.struct(F.lit(100).alias("s"), F.lit(200).alias("e"))))
    assert [[tuple(x) for x in r.exons] for r in annotate.rna_coordinates(three, Compat.corrected()).collect()] == [[(0, 30), (30, 130)]]
    assert {r.feature for r in tracks.unified_gtf(tx).collect()} == {"transcript", "exon", "CDS", "five_prime_UTR"}
    assert {r.start for r in tracks.unified_gtf(tx, Compat.corrected()).where("feature = 'exon' and seqname = 't1'").collect()} == {1, 101}
    assert {tuple(annotate_row) for annotate_row in tx.where("txname = 't1'").select(annotate.exon_labels(F.array_sort("exons"))).collect()} == {("Exon1(100-200);Exon2(300-400)",)}
    genomic, rna_path = annotation.convert_annotation(spark, str(p))
    back = {r.txname: r for r in annotation.load_annotation(spark, str(p)).collect()}  # now from the converted file
    assert [tuple(x) for x in back["t1"].exons] == [(100, 200), (300, 400)] and back["t1"].genename == "g1" and back["t1"].symbol == "new" and back["t1"].geneeffectivelength == 250
    assert open(rna_path).readline().startswith("#geneName\ttxname\tchrom") and ",\t" in open(rna_path).read()
    cover = spark.createDataFrame([("g1", 0, 160), ("g1", 390, 1000)], "genename string, s long, e long")
    assert {r.genename: r.genereadcoveredlength for r in annotate.gene_metrics(tx, cover).collect()}["g1"] == 70


def test_gff3(spark, tmp_path):
    p = tmp_path / "a.gff3"
    p.write_text("c\ts\tgene\t1\t90\t.\t+\t.\tID=gene:G;Name=nm;biotype=pc;Note=a=b\nc\ts\tmRNA\t1\t90\t.\t+\t.\tID=transcript:T;Parent=gene:G\nc\ts\texon\t1\t90\t.\t+\t.\tParent=transcript:T\nc\ts\tCDS\t11\t40\t.\t+\t.\tID=CDS:P;Parent=transcript:T;protein_id=P\nc\ts\texon\t1\t9\t.\t+\t.\tParent=T,U\n")
    r = annotate.transcripts(annotation.read_features(spark, str(p)), "gff3").collect()
    assert [(x.txname, x.genename, x.symbol, x.g_biotype, x.description, x.txlength, x.cdsstart, x.cdsend, x.protein_id) for x in r] == [("T", "G", "nm", "pc", "a=b", 90, 10, 40, "P")]
    assert annotation.detect_kind("x.GFF") == "gff3" and annotation.detect_kind("x.txt", ["#", 'gene_id "a"; transcript_id "b";']) == "gtf" and annotation.detect_kind("x.refFlat") == "refflat"


def test_attributes_and_intervals(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    a = F.lit('gene_id "a"; gene_id "b"; x "gene_id";')
    assert one(attrs.gtf_attribute(a, "gene_id")) == "b" and one(attrs.gtf_attribute(a, "none")) is None
    assert one(attrs.strip_id(F.lit('gene:transcript:"x"'))) == "transcript:x" and one(attrs.strip_id(F.lit("mRNA:x"))) == "mRNA:x"
    iv = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in ((5, 9), (1, 3), (3, 4))])
    assert one(intervals.union_length(iv)) == 7 and [tuple(x) for x in one(intervals.merged(iv))] == [(1, 4), (5, 9)]
    other = F.array(F.struct(F.lit(2).alias("s"), F.lit(6).alias("e")))
    assert one(intervals.intersection_length(iv, other)) == 3


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("s1", "b", 1.5), ("s1", "a", None)], "sample_id string, key string, n double")
    out = str(tmp_path / "x.csv")
    files.write_single_csv(df, out, order=["key"])
    assert open(out).read() == "sample_id,key,n\ns1,a,\ns1,b,1.5\n"
    assert files.missing_outputs(df, {"x": out, "y": out + ".no"}) == ["y"]
    files.write_per_sample(df, str(tmp_path), "counts")
    assert (tmp_path / "counts" / "sample_id=s1").is_dir()


def test_stream(spark, tmp_path):
    from hitloom.streaming import incremental

    folder, seen = tmp_path / "in", {}
    folder.mkdir()
    (folder / "a.rec").write_text("h\tA\nF\tt1\t0\t1\t1\nh\tA\nF,F\tt1,t2\t0\t1,2\t2\n")
    sink = lambda df, _: seen.update({(r.sample_id, tuple(r.ids)): r.n for r in df.collect()})
    for more in (None, "h\tA\nF\tt1\t0\t1\t1\n"):
        if more:
            (folder / "b.rec").write_text(more)
        incremental.count_stream(incremental.stream_records(spark, str(folder)), sink, str(tmp_path / "state")).awaitTermination()
    assert seen == {("a.rec", ("t1",)): 1, ("a.rec", ("t1", "t2")): 1, ("b.rec", ("t1",)): 1}
    lengths = spark.createDataFrame([("t1", 100.0)], "key string, length double")
    incremental.final_em_sink(lengths, str(tmp_path / "out"))(spark.createDataFrame([("a", ["t1"], 1), ("a", ["t1", "t2"], 1)], "sample_id string, ids array<string>, n long"), 0)
    assert spark.read.parquet(str(tmp_path / "out")).first().n == 2.0


def test_windowed_loads(spark, tmp_path):
    from hitloom.streaming import incremental

    rows = [("S1", "2031-01-01 01:00:00"), ("S1", "2031-01-01 23:00:00"), ("S2", "2031-01-02 00:00:00"), ("S1", None)]
    df = spark.createDataFrame(rows, "sample_id string, t string").select("sample_id", F.col("t").cast("timestamp_ntz").alias("run_at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = incremental.windowed_loads(stream).writeStream.outputMode("complete").format("memory").queryName("loads").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.sample_id, str(r.window.start), r.n) for r in spark.table("loads").collect()) == [("S1", "2031-01-01 00:00:00", 2), ("S2", "2031-01-02 00:00:00", 1)]


def test_written_tables(spark):
    import os

    from pyspark.sql import functions as F

    from hitloom import session

    w = session.Written(spark.range(10).select("id", F.lit("x").alias("s")), n=F.count("*"), total=F.sum("id"))
    assert w.metrics == {"n": 10, "total": 45} and w.df.count() == 10
    path = w.path.removeprefix("file:")
    assert os.path.isdir(path)
    w.drop()
    assert not os.path.isdir(path)
    assert session.Written(spark.range(0)).df.count() == 0


def test_checkpoints_of_a_cluster_need_a_folder():
    from types import SimpleNamespace

    import pytest

    from hitloom import session

    conf = SimpleNamespace(get=lambda k, d=None: d)
    sc = SimpleNamespace(master="spark://h:7077", getCheckpointDir=lambda: None, getConf=lambda: conf)
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(SimpleNamespace(sparkContext=sc))
