"""Gene annotation: features to transcripts with lengths, gene metrics and coordinates on the RNA.

Transcript tables have one row per ``txname`` with ``exons``, an array of structs
``(s, e)``, half-open and 0-based.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..compat import Compat
from ..functions import attrs, intervals
from .coverage import merge_blocks

# Features that matter, by role.
TRANSCRIPTS = ("transcript", "mRNA")
PARTS = {"exon": "exons", "CDS": "cds", "five_prime_UTR": "utr5", "three_prime_UTR": "utr3"}
RELEVANT = ("gene", *TRANSCRIPTS, *PARTS, "start_codon", "stop_codon")


def _first(*values: Column) -> Column:
    return F.coalesce(*values, F.lit(""))


def with_ids(features: DataFrame, kind: str) -> DataFrame:
    """Relevant features with ``own_id``, ``transcript_id``, ``gene_id`` and the attributes used. ``kind``: gtf or gff3."""
    a = F.col("attributes")
    rows = features.where(F.col("feature").isin(*RELEVANT))
    is_tx = F.col("feature").isin(*TRANSCRIPTS)
    if kind == "gtf":
        get = lambda k: attrs.gtf_attribute(a, k)
        gene = attrs.strip_id(_first(get("gene_id")))
        return rows.withColumns(
            {
                "own_id": gene, "transcript_id": attrs.strip_id(_first(get("transcript_id"))), "gene_id": gene, "gene_name": F.coalesce(get("gene_name"), gene), "biotype": _first(get("gene_biotype"), get("biotype")),
                "description": _first(get("description")), "protein_id": _first(get("protein_id")), "own_protein_id": get("protein_id"), "tx_biotype": get("transcript_biotype"),
            }
        )
    get = lambda k: attrs.gff3_attribute(a, k)
    own, parent = _first(get("ID")), _first(get("Parent"))
    return rows.withColumns(
        {
            "own_id": own, "transcript_id": F.when(is_tx, own).otherwise(parent), "gene_id": parent, "gene_name": F.coalesce(get("Name"), get("gene_name"), F.when(is_tx, parent).otherwise(own)), "biotype": _first(get("biotype")),
            "description": _first(get("description"), get("Note")), "protein_id": _first(get("protein_id"), get("Derives_from")), "own_protein_id": get("protein_id"), "tx_biotype": get("transcript_biotype"),
        }
    )


def transcripts(features: DataFrame, kind: str) -> DataFrame:
    """One row per transcript or mRNA feature, with the parts that follow it in the file.

    ``features`` has ``line_no``, as the order of lines decides: the first row of a transcript counts, the last line of a
    gene id gives the gene's name, biotype and description, and a part belongs to a transcript only if that came before.
    Coordinates become 0-based. Without CDS, both CDS ends are the transcript's start.
    """
    rows = with_ids(features, kind)
    info = rows.groupBy(F.col("own_id").alias("gene_id")).agg(F.max_by(F.struct("gene_name", "biotype", "description"), "line_no").alias("g"))
    own = F.struct("line_no", "gene_id", F.col("seqid").alias("chrom"), "strand", (F.col("start") - 1).alias("txstart"), F.col("end").alias("txend"), "gene_name", "biotype", F.coalesce("tx_biotype", "biotype").alias("t_biotype"), "protein_id", "description")
    first = rows.where(F.col("feature").isin(*TRANSCRIPTS)).groupBy("transcript_id").agg(F.min_by(own, "line_no").alias("t")).select("transcript_id", "t.*")
    parts = rows.where(F.col("feature").isin(*PARTS)).select("transcript_id", F.col("line_no").alias("part_no"), "feature", (F.col("start") - 1).alias("s"), F.col("end").alias("e"), "own_protein_id")
    met = parts.join(first.select("transcript_id", "line_no"), "transcript_id").where(F.col("part_no") > F.col("line_no"))

    def listed(feature: str) -> Column:
        found = F.array_sort(F.collect_list(F.when(F.col("feature") == feature, F.struct("part_no", "s", "e"))))
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(PARTS[feature])

    protein = F.min_by("own_protein_id", F.when((F.col("feature") == "CDS") & (F.col("own_protein_id") != ""), F.col("part_no"))).alias("cds_protein")
    lists = met.groupBy("transcript_id").agg(*[listed(f) for f in PARTS], protein)
    out = first.join(lists, "transcript_id", "left").join(info, "gene_id", "left")
    empty = F.array().cast("array<struct<s:bigint,e:bigint>>")
    out = out.withColumns({c: F.coalesce(F.col(c).cast("array<struct<s:bigint,e:bigint>>"), empty) for c in PARTS.values()})
    bounds = {"cdsstart": F.coalesce(F.array_min(F.transform("cds", lambda x: x["s"])), F.col("txstart")), "cdsend": F.coalesce(F.array_max(F.transform("cds", lambda x: x["e"])), F.col("txstart"))}
    lengths = {n: intervals.union_length(F.col(c)) for n, c in (("txlength", "exons"), ("cdslength", "cds"), ("utr5length", "utr5"), ("utr3length", "utr3"))}
    return out.withColumns(bounds | lengths).select(
        F.col("gene_id").alias("genename"), F.col("transcript_id").alias("txname"), "chrom", "strand", "txstart", "txend", "cdsstart", "cdsend", F.size("exons").alias("exoncount"), "exons",
        F.coalesce(F.col("g.gene_name"), F.col("gene_name")).alias("symbol"), F.coalesce(F.col("g.biotype"), F.col("biotype")).alias("g_biotype"), "t_biotype",
        F.when(F.col("protein_id") == "", F.coalesce("cds_protein", F.lit(""))).otherwise(F.col("protein_id")).alias("protein_id"), F.coalesce(F.col("g.description"), F.col("description")).alias("description"),
        "txlength", F.col("txlength").alias("isoformeffectivelength"), "cdslength", "utr5length", "utr3length", "line_no",
    )


def gene_metrics(tx: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """``(genename, genelongesttxlength, genelongestcdslength, geneeffectivelength, genenonoverlaplength, genereadcoveredlength)``.

    Exons of all transcripts of a gene are united whatever their chromosome or strand; without any, the effective length is
    the longest transcript. ``covered``, if given, has ``(genename, s, e)``: intervals covered by reads; else the covered
    length is the effective one. The union goes through shards of the coordinates, so no gene's exons are gathered.
    """
    known = tx.where(F.col("genename").isNotNull())
    longest = known.groupBy("genename").agg(F.max("txlength").alias("genelongesttxlength"), F.max("cdslength").alias("genelongestcdslength"))

    def union(iv: DataFrame, name: str) -> DataFrame:
        blocks = merge_blocks(iv, ["genename"], "s", "e")
        return blocks.groupBy("genename").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias(name))

    exons = known.select("genename", F.explode("exons").alias("x")).select("genename", "x.s", "x.e")
    out = longest.join(union(exons, "n"), "genename", "left").withColumn("genenonoverlaplength", F.coalesce("n", F.lit(0)))
    out = out.withColumn("geneeffectivelength", F.when(F.col("genenonoverlaplength") > 0, F.col("genenonoverlaplength")).otherwise(F.coalesce("genelongesttxlength", F.lit(0))).cast("long"))
    if covered is None:
        out = out.withColumn("genereadcoveredlength", F.col("geneeffectivelength"))
    else:
        both = union(exons.unionByName(covered.select("genename", "s", "e")), "all_n")
        out = out.join(union(covered, "cov_n"), "genename", "left").join(both, "genename", "left")
        # What both unions hold: their lengths less that of all intervals together.
        shared = F.col("genenonoverlaplength") + F.coalesce("cov_n", F.lit(0)) - F.coalesce("all_n", F.lit(0))
        out = out.withColumn("genereadcoveredlength", shared)
    return out.select("genename", "genelongesttxlength", "genelongestcdslength", "geneeffectivelength", "genenonoverlaplength", "genereadcoveredlength")


def with_gene_metrics(tx: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    old = [c for c in ("genelongesttxlength", "genelongestcdslength", "geneeffectivelength", "genenonoverlaplength", "genereadcoveredlength") if c in tx.columns]
    return tx.drop(*old).join(gene_metrics(tx, covered), "genename", "left")


def exon_strings(exons: Column, trailing: bool = False) -> tuple[Column, Column]:
    """Starts and ends of exons by start, comma-separated; the RNA form has a trailing comma."""
    ordered = F.array_sort(exons)
    one = lambda f: F.array_join(F.transform(ordered, lambda x: x[f].cast("string")), ",")
    end = lambda c: F.when(F.size(ordered) > 0, F.concat(c, F.lit(","))).otherwise(F.lit(""))
    return (end(one("s")), end(one("e"))) if trailing else (one("s"), one("e"))


def rna_exons(exons: Column, strand: Column, compat: Compat = Compat()) -> Column:
    """Exons laid end to end from 0, in genomic order; with ``rna_keeps_genomic_order`` off, minus strands from their last exon."""
    ordered = F.array_sort(exons)
    if not compat.rna_keeps_genomic_order:
        ordered = F.when(strand == "-", F.reverse(ordered)).otherwise(ordered)
    kind = "array<struct<s:bigint,e:bigint>>"

    def step(acc: Column, x: Column) -> Column:
        at = F.coalesce(F.get(acc, F.size(acc) - 1)["e"], F.lit(0).cast("long"))
        return F.concat(acc, F.array(F.struct(at.alias("s"), (at + x["e"] - x["s"]).alias("e"))))

    return F.aggregate(ordered.cast(kind), F.array().cast(kind), step)


def rna_coordinates(tx: DataFrame, compat: Compat = Compat()) -> DataFrame:
    """Transcripts in coordinates of their own RNA: start 0, plus strand, the transcript as its own sequence."""
    return tx.withColumns(
        {
            "exons": rna_exons(F.col("exons"), F.col("strand"), compat), "txstart": F.lit(0).cast("long"), "txend": F.col("txlength").cast("long"), "cdsstart": F.col("utr5length").cast("long"),
            "cdsend": (F.col("utr5length") + F.col("cdslength")).cast("long"), "chrom": F.col("txname"), "strand": F.lit("+"),
        }
    )


def exon_labels(exons: Column) -> Column:
    """``Exon1(s-e);Exon2(s-e)``."""
    return F.array_join(F.transform(exons, lambda x, i: F.format_string("Exon%d(%d-%d)", i + 1, x["s"], x["e"])), ";")


def exon_class(index: Column, count: Column, by: str = "type") -> tuple[Column, Column]:
    """Class and colour of an exon by its index: first, last or middle, or a gradient."""
    if by == "type":
        kind = F.when(index == 0, "first").when(index == count - 1, "last").otherwise("middle")
        return kind, F.when(index == 0, "255,100,100").when(index == count - 1, "100,100,255").otherwise("100,255,100")
    if by == "position":
        return F.lit("exon"), rgb(index, (40, 60, 80), clamp=True)
    return F.lit("exon"), F.lit("100,100,100")


def rgb(index: Column, steps: tuple[int, int, int], clamp: bool) -> Column:
    parts = [F.least(F.lit(255), index * n) if clamp else index * n for n in steps]
    return F.concat_ws(",", *[p.cast("string") for p in parts])


def validate(tx: DataFrame) -> DataFrame:
    """``(non_overlap_ok, covered_ok)``, one row: lengths are not negative, equal the recomputed union, and the covered length doesn't exceed the effective one."""
    again = gene_metrics(tx).select("genename", F.col("genenonoverlaplength").alias("again"))
    seen = tx.where(F.col("genename").isNotNull()).groupBy("genename").agg(F.max("genenonoverlaplength").alias("n"), F.min("genenonoverlaplength").alias("low"), F.min("genereadcoveredlength").alias("c"), F.max(F.expr("genereadcoveredlength - geneeffectivelength")).alias("over"))
    both = seen.join(again, "genename")
    return both.agg(F.coalesce(F.bool_and((F.col("low") >= 0) & (F.col("n") == F.col("again"))), F.lit(True)).alias("non_overlap_ok"), F.coalesce(F.bool_and((F.col("c") >= 0) & (F.col("over") <= 0)), F.lit(True)).alias("covered_ok"))
