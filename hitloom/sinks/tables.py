"""Result tables of the counting step, one row per transcript, gene or combination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fmt import cell, joined_cells, ratio_cell
from ..operators import count, gene
from ..operators.count import BY


def _wide(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of the keys of all counts, one column per count; null where a count lacks the key. One shuffle, no joins."""
    long = None
    for name, df in parts.items():
        part = df.select(BY, "key", F.col("n").cast("double").alias("n"), F.lit(name).alias("kind"))
        long = part if long is None else long.unionByName(part)
    return long.groupBy(BY, "key").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in parts])


def isoform_unique_table(combos: DataFrame, lengths: DataFrame, annotation: DataFrame | None = None) -> DataFrame:
    """Counts of transcripts *and* of combinations (``A,B``), which share the column ``Transcript``, with annotation.

    ``lengths``: ``(key, length)``; ``annotation``: one row per ``txname`` with any of genename, txlength, cdslength, symbol
    and description.
    """
    u = count.unique(combos)
    tpm = count.weights(u, lengths)
    em = count.multi_em(combos, tpm)
    eq, ma = count.multi_equal(combos), count.multi_to_all(combos)
    parts = {
        "firstID": count.first_id(combos), "raw": count.raw(combos), "unique_to_isoform": u, "multi_to_isoform": count.multi(combos), "multi2all": ma, "multi_equal": eq, "multi_EM": em,
        "multi_EM_cannot_allocate_tpm_isoform": count.multi_em_unallocated(combos, tpm), "Final_EM": count.added(u, em), "Final_EQ": count.added(u, eq), "Final_MA": count.added(u, ma),
    }
    out = _wide(parts).withColumnRenamed("key", "Transcript")
    if annotation is not None:
        cols = [c for c in ("genename", "txlength", "cdslength", "symbol", "description") if c in annotation.columns]
        out = out.join(annotation.select(F.col("txname").alias("Transcript"), *cols), "Transcript", "left")
    return out


def gene_unique_table(combos: DataFrame, genes: DataFrame, lengths: DataFrame, annotation: DataFrame | None = None) -> DataFrame:
    """Counts of genes, 0 where a count lacks the gene, with the gene's annotation."""
    c = gene.classified(combos, genes)
    u = gene.unique_to_gene(c)
    split = gene.unique_split(c, combos)
    em, eq = gene.multi_em(c, lengths), gene.multi_equal(c)
    parts = {
        "raw": u, "firstID": gene.first_id(c), "unique_to_gene": u, "unique_to_gene_and_isoform": split.select(BY, "key", F.col("and_isoform").alias("n")),
        "unique_to_gene_but_not_isoform": split.select(BY, "key", F.col("but_not_isoform").alias("n")), "multi_equal": eq, "multi_EM": em,
        "Final_EM": count.added(u, em), "Final_EQ": count.added(u, eq), "Final_MA": count.added(u),
    }
    out = _wide(parts).fillna(0.0)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = out.withColumn("multi_equal_ratio", ratio("multi_equal", "Final_EQ")).withColumn("multi_EM_ratio", ratio("multi_EM", "Final_EM")).withColumnRenamed("key", "Gene")
    if annotation is not None:
        cols = [c for c in ("symbol", "genelongesttxlength", "genelongestcdslength", "geneeffectivelength") if c in annotation.columns]
        one = annotation.where(F.col("genename").isNotNull()).groupBy(F.col("genename").alias("Gene")).agg(*[F.max(c).alias(c) for c in cols])
        out = out.join(one, "Gene", "left")
    return out


def _field(name: str, then=lambda v: v):
    """A function of one argument, as higher-order functions need it."""
    return lambda h: then(h[name])


def _combination_table(combos: DataFrame, scalars: DataFrame, tpm: DataFrame, shown: Sequence[str], label: str) -> DataFrame:
    """One row per combination of several keys; cells of its keys in their order, joined by ``;``.

    ``scalars``: ``(sample_id, key, *shown)``. Shares within the combination come from ``tpm``.
    """
    several = combos.where(F.size("ids") > 1)
    each = several.select(BY, "ids", "n", F.posexplode("ids").alias("at", "key")).join(scalars, [BY, "key"], "left").join(tpm, [BY, "key"], "left")
    grouped = each.groupBy(BY, "ids", "n").agg(F.array_sort(F.collect_list(F.struct("at", *shown, "tpm"))).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, h: a + F.coalesce(h["tpm"], F.lit(0.0)))
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    cells = lambda f: joined_cells(F.transform("x", f))
    em = F.when(F.col("total") > 0, cells(lambda h: cell(F.col("n") * zero(h["tpm"]) / F.col("total")))).otherwise(cells(lambda h: F.lit("*")))
    out = [F.array_join("ids", ",").alias(label)]
    out += [cells(_field(s, lambda v: cell(zero(v)))).alias(s) for s in shown if s not in ("m_em", "m_eq")]
    out += [cells(lambda h: cell(F.col("n") / F.size("ids"))).alias("multi_equal"), em.alias("multi_EM")]
    out += [cells(lambda h: ratio_cell(zero(h["m_em"]), zero(h["Final_EM"]))).alias("multi_EM_ratio"), cells(lambda h: ratio_cell(zero(h["m_eq"]), zero(h["Final_EQ"]))).alias("multi_equal_ratio")]
    return grouped.withColumn("total", total).select(BY, "n", *out)


def isoform_multi_table(combos: DataFrame, lengths: DataFrame, eff_lengths: DataFrame, annotation: DataFrame | None = None) -> DataFrame:
    """One row per combination of transcripts. The EM shares shown here go by *effective* lengths, unlike the final counts."""
    u = count.unique(combos)
    em, eq = count.multi_em(combos, count.weights(u, lengths)), count.multi_equal(combos)
    single = combos.where(F.size("ids") == 1).select(BY, F.element_at("ids", 1).alias("key"), "n")
    parts = {"raw": single, "firstID": count.first_id(combos), "unique_to_isoform": u, "multi2all": count.multi_to_all(combos), "Final_EM": count.added(u, em), "Final_EQ": count.added(u, eq), "m_em": em, "m_eq": eq}
    out = _combination_table(combos, _wide(parts), count.weights(u, eff_lengths), list(parts), "Transcripts")
    if annotation is not None:
        names = annotation.select(F.col("txname").alias("key"), *[c for c in ("genename", "symbol", "description") if c in annotation.columns])
        each = combos.where(F.size("ids") > 1).select(BY, F.array_join("ids", ",").alias("Transcripts"), F.posexplode("ids").alias("at", "key")).join(names, "key", "left")
        cols = names.columns[1:]
        lists = each.groupBy(BY, "Transcripts").agg(F.array_sort(F.collect_list(F.struct("at", *[F.coalesce(F.col(c), F.lit("0")).alias(c) for c in cols]))).alias("x"))
        lists = lists.select(BY, "Transcripts", *[F.array_join(F.transform("x", _field(c)), ",").alias({"genename": "GeneNames", "symbol": "Symbols", "description": "Descriptions"}[c]) for c in cols])
        out = out.join(lists, [BY, "Transcripts"])
    return out


def gene_multi_table(combos: DataFrame, genes: DataFrame, lengths: DataFrame, eff_lengths: DataFrame) -> DataFrame:
    """One row per sorted set of genes; EM shares by effective lengths."""
    c = gene.classified(combos, genes)
    u = gene.unique_to_gene(c)
    em, eq = gene.multi_em(c, lengths), gene.multi_equal(c)
    parts = {"unique_to_gene": u, "firstID": gene.first_id(c), "Final_EM": count.added(u, em), "Final_EQ": count.added(u, eq), "m_em": em, "m_eq": eq}
    return _combination_table(gene.gene_combinations(c), _wide(parts), count.weights(u, eff_lengths), list(parts), "Gene_Combination").withColumn("multi_EM_cannot_allocate_tpm_gene", F.when(F.startswith("multi_EM", F.lit("*")), F.col("n")).otherwise(0))
