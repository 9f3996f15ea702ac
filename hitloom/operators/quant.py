"""Expression values, the matrix over samples and the layouts of common quantifiers.

Counts are long tables ``(sample_id, key, n)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .count import BY


def length_maps(annotation: DataFrame, level: str = "gene", mode: str | None = None) -> DataFrame:
    """``(key, length, eff_length)``, one row per transcript or gene; an effective length that is null or not above 0 is the length.

    gene: the greatest value of the chosen column per gene; isoform: the row's own (one row per transcript is expected).
    """
    have = {c.lower(): c for c in annotation.columns}
    first = lambda *names: next((have[n.lower()] for n in names if n and n.lower() in have), None)
    if level == "isoform":
        length, eff = first(mode or "txlength", "txlength", "isoformeffectivelength", "cdslength"), first("isoformeffectivelength")
        key, agg = "txname", None
    else:
        known = ("geneeffectivelength", "genelongestcdslength", "txlength", "genelongesttxlength")
        length, eff = first(mode if (mode or "").lower() in known else None, "genelongesttxlength", "txlength"), first("geneeffectivelength")
        key, agg = "genename", F.max
    if length is None:
        raise ValueError("the annotation has no length column")
    n = F.col(length).cast("double")
    e = F.col(eff).cast("double") if eff else n
    rows = annotation.where(F.col(key).isNotNull())
    out = rows.groupBy(F.col(key).alias("key")).agg(agg(n).alias("length"), agg(e).alias("e")) if agg else rows.select(F.col(key).alias("key"), n.alias("length"), e.alias("e"))
    return out.select("key", F.coalesce("length", F.lit(0.0)).alias("length"), F.when(F.col("e") > 0, F.col("e")).otherwise(F.coalesce("length", F.lit(0.0))).alias("eff_length"))


def _per_kb(n: Column, length: Column) -> Column:
    return F.coalesce(F.when(length > 0, n / (length / 1000.0)), F.lit(0.0))


def expression(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(sample_id, key, n, length, eff_length, tpm, rpkm)``.

    TPM goes by effective lengths, RPKM by lengths and by the sum of *all* counts of the sample, also of keys without a
    length. A length of 0 or none gives 0; null counts are 0. Sums per sample are joined back, so no sample is handled as a
    whole.
    """
    c = counts.select(BY, "key", F.coalesce(F.col("n").cast("double"), F.lit(0.0)).alias("n")).join(lengths, "key", "left")
    c = c.fillna(0.0, ["length", "eff_length"]).withColumn("rpk", _per_kb(F.col("n"), F.col("eff_length")))
    sums = c.groupBy(BY).agg(F.sum("rpk").alias("rpk_sum"), F.sum("n").alias("n_sum"))
    c = c.join(sums, BY)
    tpm = F.when(F.col("rpk_sum") > 0, F.col("rpk") * 1e6 / F.col("rpk_sum")).otherwise(0.0)
    rpkm = F.when(F.col("n_sum") > 0, _per_kb(F.col("n"), F.col("length")) / (F.col("n_sum") / 1e6)).otherwise(0.0)
    return c.select(BY, "key", "n", "length", "eff_length", tpm.alias("tpm"), rpkm.alias("rpkm"))


def add_quant_columns(wide: DataFrame, key: str, columns: Sequence[str], lengths: DataFrame, methods: str = "tpm", by: Sequence[str] = (BY,)) -> DataFrame:
    """``wide`` with ``TPM_<c>`` and/or ``RPKM_<c>`` (``methods``: tpm, rpkm, both) for each count column there is."""
    present = [c for c in columns if c in wide.columns]
    out = wide.join(lengths.withColumnRenamed("key", key), key, "left").fillna(0.0, ["length", "eff_length"])
    kb = {c: _per_kb(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.col("eff_length")) for c in present}
    sums = out.groupBy(*by).agg(*[F.sum(kb[c]).alias(f"rpk_sum_{c}") for c in present], *[F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(f"n_sum_{c}") for c in present])
    out = out.join(sums, list(by))
    for c in present:
        if methods in ("tpm", "both"):
            out = out.withColumn(f"TPM_{c}", F.when(F.col(f"rpk_sum_{c}") > 0, kb[c] * 1e6 / F.col(f"rpk_sum_{c}")).otherwise(0.0))
        if methods in ("rpkm", "both"):
            n = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
            out = out.withColumn(f"RPKM_{c}", F.when(F.col(f"n_sum_{c}") > 0, _per_kb(n, F.col("length")) / (F.col(f"n_sum_{c}") / 1e6)).otherwise(0.0))
    return out.drop("length", "eff_length", *[f"{x}_sum_{c}" for c in present for x in ("rpk", "n")])


def sample_matrix(expressed: DataFrame, samples: Sequence[str] | None = None, values: Sequence[str] = ("n", "tpm")) -> DataFrame:
    """One row per key, columns ``<sample>_count`` and ``<sample>_tpm``/``_rpkm``; 0 where a sample lacks the key.

    ``samples`` fixes the columns; if not given, they are looked up first (samples are few, keys many).
    """
    names = list(samples) if samples is not None else sorted(r[0] for r in expressed.select(BY).where(F.col(BY).isNotNull()).distinct().collect())
    label = {"n": "count"}
    aggs = [F.sum(F.when(F.col(BY) == s, F.col(v))).alias(f"{s}_{label.get(v, v)}") for v in values for s in names]
    return expressed.groupBy("key").agg(*aggs).fillna(0.0)


def export_rsem(e: DataFrame, level: str = "gene", decimals: int | None = None) -> DataFrame:
    n = F.bround("n", decimals) if decimals is not None else F.col("n")
    return e.select(BY, F.col("key").alias("gene_id" if level == "gene" else "transcript_id"), "length", F.col("eff_length").alias("effective_length"), n.alias("expected_count"))


def export_salmon(e: DataFrame) -> DataFrame:
    return e.select(BY, F.col("key").alias("Name"), F.col("length").alias("Length"), F.col("eff_length").alias("EffectiveLength"), F.col("tpm").alias("TPM"), F.col("n").alias("NumReads"))


def export_kallisto(e: DataFrame) -> DataFrame:
    return e.select(BY, F.col("key").alias("target_id"), "length", F.col("eff_length").alias("eff_length"), F.col("n").alias("est_counts"), "tpm")


def export_featurecounts(e: DataFrame, effective: bool = False) -> DataFrame:
    """With ``effective``, the four-column layout of the count step."""
    cols = [BY, F.col("key").alias("Geneid"), F.col("length").alias("Length"), *([F.col("eff_length").alias("EffectiveLength")] if effective else []), F.col("n").alias("Count")]
    return e.select(*cols)


#: Sets of layouts by name.
FORMATS = {"rsem": ("rsem",), "salmon": ("salmon",), "kallisto": ("kallisto",), "featureCounts": ("featureCounts",), "single": ("rsem",), "multi": ("salmon", "kallisto", "featureCounts"), "all": ("rsem", "salmon", "kallisto", "featureCounts")}
EXPORTERS = {"rsem": export_rsem, "salmon": export_salmon, "kallisto": export_kallisto, "featureCounts": export_featurecounts}


def exported(expressed: DataFrame, layout: str, level: str = "gene") -> DataFrame:
    """``expressed`` in one of the layouts; that of RSEM names its key by level."""
    return export_rsem(expressed, level) if layout == "rsem" else EXPORTERS[layout](expressed)


def count_types(choice: str | None, present: Sequence[str]) -> list[str]:
    """Count columns to export: one, ``all`` of those present, or a comma-separated list; by default Final_EM."""
    if not choice:
        return ["Final_EM"]
    if choice == "all":
        return [c for c in ("raw", "firstID", "unique_to_isoform", "unique_to_gene", "Final_EM", "Final_EQ", "Final_MA") if c in present]
    return [c.strip() for c in choice.split(",") if c.strip()]
