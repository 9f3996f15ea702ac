"""Readers and writer of gene annotation."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotate
from ..schema import REFFLAT_COLUMNS, REFFLAT_DEFAULT, REFFLAT_FILE_NAMES, REFFLAT_INTS
from ..sinks.files import write_single_text


def detect_kind(path: str, head: list[str] | None = None) -> str:
    """gtf, gff3 or refflat: by extension, else by the first line that is no comment; gff3 if that doesn't tell."""
    low = path.lower()
    for ends, kind in (((".gtf",), "gtf"), ((".gff3", ".gff"), "gff3"), ((".refflat",), "refflat")):
        if low.endswith(ends):
            return kind
    line = next((x for x in head or [] if not x.startswith("#")), "")
    return "gtf" if "gene_id" in line and "transcript_id" in line else "gff3"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows with ``line_no``; comments and lines of fewer than 9 fields are skipped, and so are those of more."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.trim(F.col("value"), F.lit(" \t\r\n")).alias("v"))
    f = F.split("v", "\t")
    n = lambda i: F.get(f, F.lit(i))
    rows = lines.where(~F.startswith("v", F.lit("#")) & (F.size(f) == 9))
    return rows.select("line_no", n(0).alias("seqid"), n(1).alias("source"), n(2).alias("feature"), n(3).cast("long").alias("start"), n(4).cast("long").alias("end"), n(5).alias("score"), n(6).alias("strand"), n(7).alias("phase"), n(8).alias("attributes"))


def _typed(rows: DataFrame, columns: list[str]) -> DataFrame:
    f = F.split("value", "\t", -1)
    out = rows.select(*[F.get(f, F.lit(i)).alias(c) for i, c in enumerate(columns)])
    out = out.withColumns({c: F.expr(f"try_cast(nullif(trim({c}), '') as double)").cast("long") for c in columns if c in REFFLAT_INTS})
    if "isoformeffectivelength" in columns:
        out = out.withColumn("isoformeffectivelength", F.coalesce("isoformeffectivelength", "txlength", F.lit(0).cast("long")))
    # try_cast, as Spark may evaluate this before the rows of comments are filtered out.
    places = lambda c: F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("bigint"))
    zipped = F.arrays_zip(places("exonstarts").alias("s"), places("exonends").alias("e"))
    return out.withColumn("exons", F.filter(zipped, lambda x: x["s"].isNotNull() & x["e"].isNotNull()))


def read_refflat(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Extended refFlat rows with ``exons``. Lines with ``#`` are comments.

    With ``header``, the first of them names the columns, and without one the shorter default list holds; else the file has
    the 26 fixed columns. The file's two columns that differ by case alone come out as genename (the gene's id) and symbol.
    """
    lines = spark.read.text(path)
    columns = list(REFFLAT_COLUMNS)
    if header:
        first = lines.where(F.startswith("value", F.lit("#"))).limit(1).collect()
        columns = list(REFFLAT_DEFAULT)
        if first:
            back = {v: k for k, v in REFFLAT_FILE_NAMES.items()}
            columns = [back.get(c, c.lower()) for c in first[0][0].strip()[1:].strip().split("\t")]
    return _typed(lines.where(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")), columns)


def write_refflat(tx: DataFrame, path: str, rna: bool = False) -> None:
    """One tab-separated file with the 26 columns and a ``#`` line of names; exon lists in RNA files end with a comma."""
    starts, ends = annotate.exon_strings(F.col("exons"), trailing=rna)
    shown = tx.withColumns({"exonstarts": starts, "exonends": ends, "exoncount": F.size("exons")})
    shown = shown.withColumns({c: F.lit(None).cast("string") for c in REFFLAT_COLUMNS if c not in shown.columns})
    names = [REFFLAT_FILE_NAMES.get(c, c) for c in REFFLAT_COLUMNS]
    # Names that differ by case alone can't be in one table, so the line of names is a row of its own.
    cells = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in REFFLAT_COLUMNS])
    head = tx.sparkSession.createDataFrame([(0, "", "#" + "\t".join(names))], "k int, txname string, value string")
    rows = shown.select(F.lit(1).alias("k"), "txname", cells.alias("value"))
    write_single_text(head.unionByName(rows).orderBy("k", "txname"), path)


def load_annotation(spark: SparkSession, path: str, metrics: bool = True) -> DataFrame:
    """Transcripts of any supported file; a converted ``<stem>.genomic.refflat`` beside a GTF or GFF3 file is taken instead of it."""
    kind = detect_kind(path, [r[0] for r in spark.read.text(path).where(~F.startswith("value", F.lit("#"))).limit(1).collect()])
    if kind == "refflat":
        return read_refflat(spark, path, header=True)
    ready = os.path.splitext(path)[0] + ".genomic.refflat"
    if os.path.exists(ready):
        return read_refflat(spark, ready, header=True)
    tx = annotate.transcripts(read_features(spark, path), kind)
    return annotate.with_gene_metrics(tx) if metrics else tx


def convert_annotation(spark: SparkSession, path: str) -> tuple[str, str]:
    """Write ``<stem>.genomic.refflat`` and ``<stem>.rna.refflat``; returns their paths."""
    stem = os.path.splitext(path)[0]
    tx = annotate.with_gene_metrics(annotate.transcripts(read_features(spark, path), detect_kind(path))).persist()
    try:
        write_refflat(tx, stem + ".genomic.refflat")
        write_refflat(annotate.rna_coordinates(tx), stem + ".rna.refflat", rna=True)
    finally:
        tx.unpersist()
    return stem + ".genomic.refflat", stem + ".rna.refflat"
