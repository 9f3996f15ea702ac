"""Readers of FASTA and FASTQ files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BLANKS = " \t\r\n"


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(header, seq, record_no)``: the header without ``>``, lines of the sequence joined.

    Files are split at ``>`` after a line end, so large ones are read by several tasks; ``record_no`` grows along each file.
    """
    rows = spark.read.option("lineSep", "\n>").text(paths).withColumn("record_no", F.monotonically_increasing_id())
    text = F.regexp_replace(F.replace("value", F.lit("\r"), F.lit("")), "^>", "")
    header = F.trim(F.substring_index(text, "\n", 1), F.lit(_BLANKS))
    seq = F.when(F.instr(text, "\n") > 0, F.regexp_replace(F.substring(text, F.instr(text, "\n") + F.lit(1), F.length(text)), r"\s", "")).otherwise("")
    return rows.where(F.trim(text, F.lit(_BLANKS)) != "").select(header.alias("header"), seq.alias("seq"), "record_no")


def fastq_reads(lines: list[str]) -> Iterator[tuple[str, str, str]]:
    """Header without ``@``, sequence and quality. Ends at a blank header; a header line without ``@`` is passed over alone."""
    i, n = 0, len(lines)
    while i < n:
        head = lines[i].strip()
        if not head:
            return
        if not head.startswith("@"):
            i += 1
            continue
        body = [x.strip() for x in lines[i + 1 : i + 4]] + [""] * 3
        yield head[1:], body[0], body[2]
        i += 4


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(header, seq, qual, file_name, record_no)``. One file per task, as sequencers write many and compressed ones can't be split."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["header", "seq", "qual", "file_name", "record_no"]
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held: list[tuple] = []
                for k, read in enumerate(fastq_reads(text.split("\n"))):
                    held.append((*read, name, k))
                    if len(held) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    return files.mapInArrow(task, "header string, seq string, qual string, file_name string, record_no long")


def read_references(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(ref_name, seq, ref_length, ref_ord)``: the name is the header's first word, the sequence in upper case.

    Of repeated names the last sequence counts, at the place of the first.
    """
    rows = read_fasta(spark, paths).select(F.element_at(F.split("header", r"\s+"), 1).alias("ref_name"), F.upper("seq").alias("seq"), "record_no")
    best = rows.groupBy("ref_name").agg(F.max_by("seq", "record_no").alias("seq"), F.min("record_no").alias("ref_ord"))
    return best.select("ref_name", "seq", F.length("seq").alias("ref_length"), "ref_ord")
