"""Command line: ``python -m hitloom.cli COMMAND ...``. Each command is a thin wrapper of one operator."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import annotate, convert, count, gene, hits, pileup, quant, sam, sort, tracks
from .session import Written, get_spark
from .sinks import files, tables
from .sources import annotation, counts, fastx, paths, records
from .sources import sam as sam_source

RECORD_FILES = None  # any file name


def _records(spark: SparkSession, inputs: str) -> DataFrame:
    found = paths.resolve_inputs(inputs, RECORD_FILES)
    if not found:
        raise SystemExit(f"no input files: {inputs}")
    return records.read_record_ranges(spark, found).withColumnRenamed("file_name", "sample_id")


def _count(spark: SparkSession, a: argparse.Namespace) -> None:
    level_needs_annotation = a.level in ("gene", "both")
    if level_needs_annotation and not a.annotation:
        raise SystemExit("counting by gene needs --annotation")
    inputs = paths.resolve_inputs(a.input, RECORD_FILES)
    if a.resume:
        # A run is skipped for the files whose folder of results is complete.
        probe = spark.range(0)
        todo = files.missing_outputs(probe, {p: os.path.join(a.output, "isoform_unique", f"sample_id={os.path.basename(p)}") for p in inputs})
        inputs = [p for p in inputs if p in todo]
        if not inputs:
            return
    # The text is read and parsed once; every table is made from the far smaller table of combinations.
    held = Written(count.combinations(_records(spark, ",".join(inputs))))
    combos = held.df
    noted = Written(annotation.load_annotation(spark, a.annotation)) if a.annotation else None
    note = noted.df if noted else None
    none = spark.createDataFrame([], "key string, length double")
    lengths = count.lengths_of(note, a.length) if note is not None else none
    out: dict[str, DataFrame] = {}
    sets = None
    if a.level in ("isoform", "both"):
        out["isoform_unique"] = tables.isoform_unique_table(combos, lengths, note)
        eff = quant.length_maps(note, "isoform").select("key", F.col("eff_length").alias("length")) if note is not None else none
        out["isoform_multi"] = tables.isoform_multi_table(combos, lengths, eff, note)
        if note is not None:
            expressed = quant.expression(count.final_em(combos, lengths), quant.length_maps(note, "isoform"))
            out |= {f"{f}_isoforms": quant.exported(expressed, f, "isoform") for f in quant.FORMATS[a.format]}
    if level_needs_annotation:
        genes = gene.transcripts_to_genes(note)
        gene_lengths = gene.gene_lengths(note, a.gene_length)
        sets = gene.classified(combos, genes)
        out["gene_unique"] = tables.gene_unique_table(combos, genes, gene_lengths, note)
        out["gene_multi"] = tables.gene_multi_table(combos, genes, gene_lengths, quant.length_maps(note, "gene").select("key", F.col("eff_length").alias("length")))
        expressed = quant.expression(gene.final_em(sets, gene_lengths), quant.length_maps(note, "gene"))
        out |= {f"{f}_genes": quant.exported(expressed, f) for f in quant.FORMATS[a.format]}
    out["summary"] = count.summary(combos, lengths)
    for name, df in out.items():
        files.write_per_sample(df, a.output, name)
    events = count.multi_events(combos)
    if sets is not None:
        events = events.unionByName(count.multi_events(gene.gene_combinations(sets), "gene"))
    files.write_text_per_sample(count.summary_lines(out["summary"], events), a.output, "summary_text")
    held.drop()
    if noted:
        noted.drop()


def _hits(spark: SparkSession, inputs: str) -> DataFrame:
    return hits.with_hits(_records(spark, inputs))


def _references(spark: SparkSession, path: str) -> DataFrame:
    return fastx.read_references(spark, path)


def _sam(spark: SparkSession, a: argparse.Namespace) -> None:
    refs = _references(spark, a.fasta)
    rows = _hits(spark, a.input)
    if a.region:
        lengths = {r.ref_name: r.ref_length for r in refs.select("ref_name", "ref_length").collect()}
        good, bad = sam.parse_regions(a.region, lengths)
        for part in bad:
            print(f"not a region: {part}", file=sys.stderr)
        rows = sam.filter_regions(rows, good)
    out = sam.sam_rows(rows)
    if a.sort:
        tied = out.withColumn("line_no", F.struct("sample_id", "record_no", "hit_idx"))
        out = sort.sort_by_coordinate(tied) if a.sort == "coord" else sort.sort_by_name(tied)
    files.write_single_text(sam.sam_header(refs), a.output + ".header", "line_no")
    files.write_parts(sam.sam_lines(out), a.output)


def _bed(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _hits(spark, a.input)
    if a.n:
        rows = convert.bed_limit(rows, a.n)
    files.write_parts(convert.bed6(rows).select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "name", F.col("score").cast("string"), "strand_sign").alias("value")), a.output)


def _fastx(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.kind == "unmapped":
        reads = records.read_unmapped(spark, paths.resolve_inputs(a.input)).select(F.col("read_id").alias("header"), convert.unmapped_sequence(F.col("sequence")).alias("seq"))
    elif a.kind in ("fasta", "fastq"):
        reads = (fastx.read_fasta if a.kind == "fasta" else fastx.read_fastq)(spark, paths.resolve_inputs(a.input))
    else:
        reads = _records(spark, a.input)
    files.write_parts(convert.fasta_to_fastq(reads) if a.to == "fastq" else convert.fastq_to_fasta(reads), a.output)


def _sort(spark: SparkSession, a: argparse.Namespace) -> None:
    header, rows = sam_source.read_sam(spark, paths.resolve_inputs(a.input, [".sam"]))
    rows = sort.sort_by_name(rows) if a.by == "name" else sort.sort_by_coordinate(rows)
    tags = F.when(F.size("tags") > 0, F.array_join("tags", "\t"))
    files.write_single_text(sort.header_order(header), a.output + ".header")
    files.write_parts(rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in sam.COLUMNS], tags).alias("value")), a.output)


def _mpileup(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = pileup.pileup(_hits(spark, a.input), _references(spark, a.fasta), a.min_depth, a.base_quality).orderBy("ref_name", "pos")
    files.write_parts(rows.select(F.concat_ws("\t", "ref_name", F.col("pos").cast("string"), "ref_base", F.col("depth").cast("string"), "bases", "quals").alias("value")), a.output)


def _quant(spark: SparkSession, a: argparse.Namespace) -> None:
    noted = Written(annotation.load_annotation(spark, a.annotation))
    found, note = 0, noted.df
    for level in ("gene", "isoform") if a.level == "both" else (a.level,):
        inputs = paths.resolve_inputs(a.input, [counts.SUFFIXES[level]])
        if not inputs:
            continue
        found += 1
        key = "Gene" if level == "gene" else "Transcript"
        tag = f".{level}" if a.level == "both" else ""
        rows, lengths = counts.read_counts(spark, inputs, level), quant.length_maps(note, level)
        for column in quant.count_types(a.count_type, rows.columns):
            expressed = quant.expression(counts.long_counts(rows, column, key), lengths)
            if a.matrix:
                files.write_single_csv(quant.sample_matrix(expressed, values=("n", "tpm", "rpkm")), os.path.join(a.output, f"matrix{tag}.{column}.csv"), order=["key"])
            for f in quant.FORMATS[a.format]:
                files.write_per_sample(quant.exported(expressed, f, level), a.output, f"{f}{tag}.{column}")
    noted.drop()
    if not found:
        raise SystemExit(f"no count files: {a.input}")


def _annotate(spark: SparkSession, a: argparse.Namespace) -> None:
    for path in annotation.convert_annotation(spark, a.input):
        print(path)
    if a.tracks:
        tx = annotation.load_annotation(spark, a.input)
        made = {"exons.bed": tracks.exon_bed(tx), "genes.bed12": tracks.bed12(tx), "exons.rna.gtf": tracks.exon_gtf(annotate.rna_coordinates(tx)), "unified.rna.gtf": tracks.unified_gtf(tx)}
        for name, df in made.items():
            files.write_single_csv(df, f"{os.path.splitext(a.input)[0]}.{name}", sep="\t", header=False)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hitloom")
    p.add_argument("--master", help="Spark master; by default that of the submitted session, else local[*]")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options: tuple) -> None:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("-i", "--input", required=True)
        for names, kw in options:
            c.add_argument(*names, **kw)

    out = (("-o", "--output"), {"required": True})
    fasta = (("-r", "--fasta"), {"required": True})
    formats = (("--format",), {"choices": sorted(quant.FORMATS), "default": "salmon"})
    command("count", _count, out, formats, (("--annotation",), {}), (("--level",), {"choices": ["isoform", "gene", "both"], "default": "isoform"}), (("--length",), {"default": "txlength"}), (("--gene-length",), {"default": "genelongesttxlength"}), (("--resume",), {"action": "store_true"}))
    command("sam", _sam, out, fasta, (("--region",), {}), (("--sort",), {"choices": ["coord", "name"]}))
    command("bed", _bed, out, (("-n",), {"type": int, "default": 0}))
    command("fastx", _fastx, out, (("--kind",), {"choices": ["records", "unmapped", "fasta", "fastq"], "default": "records"}), (("--to",), {"choices": ["fasta", "fastq"], "default": "fasta"}))
    command("sort", _sort, out, (("--by",), {"choices": ["coord", "name"], "default": "coord"}))
    command("mpileup", _mpileup, out, fasta, (("--min-depth",), {"type": int, "default": 0}), (("--base-quality",), {"type": int, "default": 30}))
    command("quant", _quant, out, formats, (("--annotation",), {"required": True}), (("--level",), {"choices": ["gene", "isoform", "both"], "default": "gene"}), (("--count-type",), {}), (("--matrix",), {"action": "store_true"}))
    command("annotate", _annotate, (("--tracks",), {"action": "store_true"}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(spark or SparkSession.getActiveSession() or get_spark("hitloom", a.master or "local[*]"), a)


if __name__ == "__main__":
    main()
