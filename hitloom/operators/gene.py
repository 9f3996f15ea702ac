"""Counts per gene, from the combinations of transcripts.

A combination is classified by the set of genes of its annotated transcripts:
none, and it is dropped; one, and its reads are the gene's own; several, and it
counts for the sorted set of genes, which is then shared as combinations of
transcripts are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..compat import Compat
from . import count
from .count import BY


def transcripts_to_genes(annotation: DataFrame, tx: str = "txname", gene: str = "genename") -> DataFrame:
    """``(tx, gene)`` of an annotation with one row per transcript; without null or blank ones."""
    return annotation.select(F.col(tx).alias("tx"), F.col(gene).alias("gene")).where(F.col("tx").isNotNull() & F.col("gene").isNotNull())


def classified(combos: DataFrame, genes: DataFrame) -> DataFrame:
    """``(sample_id, ids, n, genes, first_gene, first_tx)``: combinations with an annotated transcript."""
    each = combos.select(BY, "ids", "n", F.posexplode("ids").alias("at", "tx")).join(genes, "tx", "left")
    grouped = each.groupBy(BY, "ids", "n").agg(F.array_sort(F.collect_set("gene")).alias("genes"), F.max(F.when(F.col("at") == 0, F.col("gene"))).alias("first_gene"))
    return grouped.where(F.size("genes") > 0).withColumn("first_tx", F.element_at("ids", 1))


def _one() -> F.Column:
    return F.size("genes") == 1


def unique_to_gene(c: DataFrame) -> DataFrame:
    """Reads of one gene, of one transcript or several."""
    return count._summed(c.where(_one()).select(BY, F.element_at("genes", 1).alias("key"), "n"))


def first_id(c: DataFrame) -> DataFrame:
    """The gene of the first transcript gets the reads; none if that is not annotated."""
    return count._summed(c.where(F.col("first_gene").isNotNull()).select(BY, F.col("first_gene").alias("key"), "n"))


def unique_to_isoform(c: DataFrame) -> DataFrame:
    """Reads of a single transcript."""
    return count._summed(c.where((F.size("ids") == 1)).select(BY, F.element_at("genes", 1).alias("key"), "n"))


def unique_split(c: DataFrame, combos: DataFrame) -> DataFrame:
    """``(sample_id, key, and_isoform, but_not_isoform)``: the reads of one gene, by whether the first transcript has unique reads of its own."""
    own = count.unique(combos).select(BY, F.col("key").alias("first_tx"), F.lit(True).alias("own"))
    of_gene = c.where(_one()).join(own, [BY, "first_tx"], "left")
    sure = (F.size("ids") == 1) | F.coalesce("own", F.lit(False))
    return of_gene.groupBy(BY, F.element_at("genes", 1).alias("key")).agg(F.sum(F.when(sure, F.col("n")).otherwise(0)).alias("and_isoform"), F.sum(F.when(~sure, F.col("n")).otherwise(0)).alias("but_not_isoform"))


def gene_combinations(c: DataFrame) -> DataFrame:
    """``(sample_id, ids, n)``: reads of several genes by their sorted set."""
    return c.where(F.size("genes") > 1).groupBy(BY, F.col("genes").alias("ids")).agg(F.sum("n").alias("n"))


def gene_lengths(annotation: DataFrame, mode: str = "genelongesttxlength", gene: str = "genename") -> DataFrame:
    """``(key, length)``: per gene the greatest value of the first column there is of ``mode``, genelongesttxlength, txlength and geneeffectivelength."""
    have = {c.lower(): c for c in annotation.columns}
    column = next((have[c] for c in (mode.lower(), "genelongesttxlength", "txlength", "geneeffectivelength") if c in have), None)
    if column is None:
        raise ValueError("the annotation has no length column")
    return annotation.where(F.col(gene).isNotNull()).groupBy(F.col(gene).alias("key")).agg(F.max(F.col(column).cast("double")).alias("length"))


def multi_equal(c: DataFrame) -> DataFrame:
    return count.multi_equal(gene_combinations(c))


def multi_em(c: DataFrame, lengths: DataFrame) -> DataFrame:
    return count.multi_em(gene_combinations(c), count.weights(unique_to_gene(c), lengths))


def multi_em_unallocated(c: DataFrame, lengths: DataFrame) -> DataFrame:
    return count.multi_em_unallocated(gene_combinations(c), count.weights(unique_to_gene(c), lengths))


def final_em(c: DataFrame, lengths: DataFrame) -> DataFrame:
    return count.added(unique_to_gene(c), multi_em(c, lengths))


def final_eq(c: DataFrame) -> DataFrame:
    return count.added(unique_to_gene(c), multi_equal(c))


def final_ma(c: DataFrame, compat: Compat = Compat()) -> DataFrame:
    """Unique reads; with ``gene_final_ma_without_multi`` off, also every gene of each combination fully."""
    if compat.gene_final_ma_without_multi:
        return count.added(unique_to_gene(c))
    return count.added(unique_to_gene(c), count.multi_to_all(gene_combinations(c)))


def ratios(c: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(sample_id, key, multi_equal_ratio, multi_em_ratio)`` for genes with an equal-share count: the part of the count that was shared. Null where the final count is 0 or missing."""
    def one(df: DataFrame, name: str) -> DataFrame:
        return df.select(BY, "key", F.col("n").cast("double").alias("n"), F.lit(name).alias("kind"))

    parts = one(multi_equal(c), "equal").unionByName(one(multi_em(c, lengths), "em")).unionByName(one(unique_to_gene(c), "unique"))
    cols = [F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in ("equal", "em", "unique")]
    wide = parts.groupBy(BY, "key").agg(*cols)
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    eq, em = zero("unique") + zero("equal"), zero("unique") + zero("em")
    return wide.where(F.col("equal").isNotNull() | F.col("unique").isNotNull()).select(BY, "key", F.when(eq > 0, zero("equal") / eq).alias("multi_equal_ratio"), F.when(em > 0, zero("em") / em).alias("multi_em_ratio"))
