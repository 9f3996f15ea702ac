"""Browser tracks of transcripts: BED9 and GTF rows per exon, BED12 rows per transcript, and a unified GTF on the RNA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..compat import Compat
from .annotate import rgb, rna_exons

# The source column and colours of the tracks.
SOURCE, BLUE = "gxf_converter", "0,0,255"


def _exons(tx: DataFrame) -> DataFrame:
    rest = [c for c in tx.columns if c != "exons"]
    return tx.select(*rest, F.posexplode("exons").alias("i", "x")).select(*rest, "i", F.col("x.s").alias("s"), F.col("x.e").alias("e"))


def _exon_id() -> Column:
    return F.concat(F.col("txname"), F.lit("_exon"), (F.col("i") + 1).cast("string"))


def exon_bed(tx: DataFrame) -> DataFrame:
    """BED9, one row per exon; colours grow with the index and aren't bounded."""
    return _exons(tx).select("chrom", F.col("s").alias("start"), F.col("e").alias("end"), _exon_id().alias("name"), F.lit(0).alias("score"), "strand", F.col("s").alias("thick_start"), F.col("e").alias("thick_end"), rgb(F.col("i"), (30, 50, 70), clamp=False).alias("item_rgb"))


def _gtf(feature: str, start: Column, end: Column, attributes: Column, frame: str = ".") -> list[Column]:
    dot = F.lit(".")
    return [F.col("txname").alias("seqname"), F.lit(SOURCE).alias("source"), F.lit(feature).alias("feature"), start.cast("long").alias("start"), end.cast("long").alias("end"), dot.alias("score"), F.lit("+").alias("strand"), F.lit(frame).alias("frame"), attributes.alias("attributes")]


def _attributes(**values: Column) -> Column:
    return F.concat_ws("; ", *[F.concat(F.lit(k + ' "'), F.coalesce(v.cast("string"), F.lit("")), F.lit('"')) for k, v in values.items()])


def exon_gtf(rna_tx: DataFrame) -> DataFrame:
    """GTF rows of the exons of transcripts in RNA coordinates."""
    a = _attributes(gene_id=F.col("genename"), transcript_id=F.col("txname"), exon_number=F.col("i") + 1, exon_id=_exon_id(), color=rgb(F.col("i"), (40, 60, 80), clamp=False))
    return _exons(rna_tx).select(*_gtf("exon", F.col("s") + 1, F.col("e"), a))


def bed12(tx: DataFrame) -> DataFrame:
    """BED12, one row per transcript with exons, blocks by start."""
    ordered = F.array_sort("exons")
    blocks = lambda f: F.concat(F.array_join(F.transform(ordered, lambda x: f(x).cast("string")), ","), F.lit(","))
    return tx.where(F.size("exons") > 0).select(
        "chrom", F.col("txstart").alias("start"), F.col("txend").alias("end"), F.col("txname").alias("name"), F.lit(1000).alias("score"), "strand", F.col("cdsstart").alias("thick_start"), F.col("cdsend").alias("thick_end"),
        F.lit(BLUE).alias("item_rgb"), F.size("exons").alias("block_count"), blocks(lambda x: x["e"] - x["s"]).alias("block_sizes"), blocks(lambda x: x["s"] - F.col("txstart")).alias("block_starts"),
    )


def unified_gtf(tx: DataFrame, compat: Compat = Compat()) -> DataFrame:
    """Transcript, exon, CDS and UTR rows with the transcript as sequence, from transcripts in *genomic* coordinates."""
    ids = {"gene_id": F.col("genename"), "transcript_id": F.col("txname")}
    symbol = F.coalesce("symbol", "genename") if "symbol" in tx.columns else F.col("genename")
    whole = _attributes(**ids, gene_name=symbol, biotype=F.col("t_biotype"), tx_length=F.col("txlength"), cds_length=F.col("cdslength"), utr5_length=F.col("utr5length"), utr3_length=F.col("utr3length"))
    exons = tx if compat.unified_exons_genomic else tx.withColumn("exons", rna_exons(F.col("exons"), F.col("strand"), compat))
    of_exon = _attributes(**ids, exon_number=F.col("i") + 1, exon_id=_exon_id(), color=rgb(F.col("i"), (40, 60, 80), clamp=True))
    cds = (F.col("cdsstart") + 1, F.col("cdsend")) if compat.unified_exons_genomic else (F.col("utr5length") + 1, F.col("utr5length") + F.col("cdslength"))
    rows = [
        tx.select(*_gtf("transcript", F.lit(1), F.col("txlength"), whole)),
        _exons(exons).select(*_gtf("exon", F.col("s") + 1, F.col("e"), of_exon)),
        tx.where(F.col("cdsstart") < F.col("cdsend")).select(*_gtf("CDS", *cds, _attributes(**ids, protein_id=F.col("protein_id")), frame="0")),
        tx.where(F.col("utr5length") > 0).select(*_gtf("five_prime_UTR", F.lit(1), F.col("utr5length"), _attributes(**ids))),
        tx.where(F.col("utr3length") > 0).select(*_gtf("three_prime_UTR", F.col("txlength") - F.col("utr3length") + 1, F.col("txlength"), _attributes(**ids))),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
