import glob

import pytest

from hitloom import cli

RECORDS = "h1\tACGTA\t.....,..x..\nF,R\tt1,t2\t1\t0,3\t2\nh2\tAC\t..\nF\tt1\t0\t1\t1\n"
GTF = '1\ts\ttranscript\t1\t100\t.\t+\t.\tgene_id "g1"; transcript_id "t1";\n1\ts\texon\t1\t100\t.\t+\t.\tgene_id "g1"; transcript_id "t1";\n1\ts\ttranscript\t201\t300\t.\t+\t.\tgene_id "g2"; transcript_id "t2";\n1\ts\texon\t201\t300\t.\t+\t.\tgene_id "g2"; transcript_id "t2";\n'


def read(folder):
    return "".join(open(p).read() for p in sorted(glob.glob(f"{folder}/**/part-*", recursive=True)))


def test_commands(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "a.rec").write_text(RECORDS)
    (tmp_path / "a.gtf").write_text(GTF)
    (tmp_path / "r.fa").write_text(">t1\nACGTACGTAC\n>t2\nGGGGGGGG\n")
    run = lambda *a: cli.main([*a], spark)
    run("count", "-i", f"{d}/a.rec", "-o", f"{d}/c", "--annotation", f"{d}/a.gtf", "--level", "both", "--format", "all")
    assert "g1" in read(f"{d}/c/gene_unique") and "t1,t2" in read(f"{d}/c/isoform_unique") and "750000" not in read(f"{d}/c/salmon_genes")
    assert read(f"{d}/c/rsem_genes").startswith("gene_id,length,effective_length,expected_count")
    with pytest.raises(SystemExit):
        run("count", "-i", f"{d}/a.rec", "-o", f"{d}/x", "--level", "gene")
    run("sam", "-i", f"{d}/a.rec", "-o", f"{d}/s.sam", "-r", f"{d}/r.fa", "--region", "t2:0-8,zz", "--sort", "coord")
    assert [x.split("\t")[:4] for x in read(f"{d}/s.sam").splitlines()] == [["h1", "0", "t1", "1"], ["h1", "272", "t2", "4"]]
    assert open(f"{d}/s.sam.header").read().splitlines()[2:] == ["@SQ\tSN:t1\tLN:10", "@SQ\tSN:t2\tLN:8"]
    (tmp_path / "in.sam").write_text(open(f"{d}/s.sam.header").read() + read(f"{d}/s.sam"))
    run("sort", "-i", f"{d}/in.sam", "-o", f"{d}/sorted", "--by", "name")
    assert read(f"{d}/sorted") == read(f"{d}/s.sam")
    run("bed", "-i", f"{d}/a.rec", "-o", f"{d}/bed", "-n", "1")
    assert read(f"{d}/bed").splitlines() == ["t1\t0\t5\t#h1\t0\t+", "t2\t3\t8\t#h1\t0\t-"]
    run("fastx", "-i", f"{d}/a.rec", "-o", f"{d}/fx", "--to", "fastq")
    assert "@h2\nAC\n+\nII\n" in read(f"{d}/fx")
    run("mpileup", "-i", f"{d}/a.rec", "-o", f"{d}/pile", "-r", f"{d}/r.fa", "--min-depth", "1")
    assert "t1\t2\tC\t2\tCA\t??" in read(f"{d}/pile")
    (tmp_path / "S.counts_gene_level_unique.csv").write_text("Gene,Final_EM\ng1,3\ng2,1\n")
    run("quant", "-i", f"{d}/S.counts_gene_level_unique.csv", "-o", f"{d}/q", "--annotation", f"{d}/a.gtf", "--matrix")
    assert open(f"{d}/q/matrix.Final_EM.csv").read().splitlines()[1].startswith("g1,3.0,750000.0")
    run("annotate", "-i", f"{d}/a.gtf", "--tracks")
    assert (tmp_path / "a.genomic.refflat").exists() and (tmp_path / "a.genes.bed12").exists()


def test_count_of_both_levels(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "a.rec").write_text(RECORDS)
    (tmp_path / "a.gtf").write_text(GTF)
    run = lambda *a: cli.main([*a], spark)
    run("count", "-i", f"{d}/a.rec", "-o", f"{d}/iso", "--annotation", f"{d}/a.gtf")  # by transcript, for salmon
    assert "t1" in read(f"{d}/iso/salmon_isoforms") and not glob.glob(f"{d}/iso/salmon_genes")
    run("count", "-i", f"{d}/a.rec", "-o", f"{d}/both", "--annotation", f"{d}/a.gtf", "--level", "both", "--format", "all")
    assert read(f"{d}/both/rsem_isoforms").startswith("transcript_id,") and read(f"{d}/both/rsem_genes").startswith("gene_id,")
    report = read(f"{d}/both/summary_text").splitlines()
    assert report[0] == "total_reads: 2" and report[-6:] == [
        "Isoform-level multi-mapping events: 1", "Isoform-level total multi-mapped reads: 1", "Isoform-level average reads per multi-mapping event: 1.00",
        "Gene-level multi-mapping events: 1", "Gene-level total multi-mapped reads: 1", "Gene-level average reads per multi-mapping event: 1.00",
    ]
    (tmp_path / "S.counts_gene_level_unique.csv").write_text("Gene,Final_EM\ng1,3\ng2,1\n")
    (tmp_path / "S.counts_isoform_level_unique.csv").write_text("Transcript,Final_EM\nt1,3\nt2,1\n")
    run("quant", "-i", d, "-o", f"{d}/q", "--annotation", f"{d}/a.gtf", "--level", "both", "--matrix", "--format", "rsem")
    assert open(f"{d}/q/matrix.gene.Final_EM.csv").read().splitlines()[1].startswith("g1,3.0,") and open(f"{d}/q/matrix.isoform.Final_EM.csv").read().splitlines()[1].startswith("t1,3.0,")
    assert read(f"{d}/q/rsem.isoform.Final_EM").startswith("transcript_id,")
    with pytest.raises(SystemExit):
        run("quant", "-i", f"{d}/none.csv", "-o", f"{d}/x", "--annotation", f"{d}/a.gtf")


def test_zipped_records(spark, tmp_path):
    import zipfile

    from hitloom.sources import records

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.rec", RECORDS)
        z.writestr("other", "x")
    (tmp_path / "b.rec").write_text(RECORDS)
    rows = records.read_records(spark, [f"{tmp_path}/a.zip", f"{tmp_path}/b.rec"]).orderBy("file_name", "record_no").collect()
    assert [(r.file_name, r.record_no, r.header) for r in rows] == [("a.zip", 0, "h1"), ("a.zip", 1, "h2"), ("b.rec", 0, "h1"), ("b.rec", 1, "h2")]
