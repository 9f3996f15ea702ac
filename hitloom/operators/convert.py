"""Records as BED, FASTA and FASTQ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.seq import strand_sign
from .hits import explode_hits


def bed6(records: DataFrame) -> DataFrame:
    """One row per hit: reference, half-open 0-based span of the read's length, name, score 0 and strand sign (``-`` unless F)."""
    rest = [c for c in ("record_no", "sample_id") if c in records.columns]
    rows = explode_hits(records).where(F.col("position").isNotNull() & F.col("seq").isNotNull())
    return rows.select(
        *rest, "hit_idx", F.col("ref_name").alias("chrom"), F.col("position").alias("start"), (F.col("position") + F.length("seq")).alias("end"),
        F.concat(F.lit("#"), F.col("header")).alias("name"), F.lit(0).alias("score"), F.coalesce(strand_sign(F.col("strand")), F.lit("-")).alias("strand_sign"),
    )


def bed_limit(records: DataFrame, n: int, key: str = "record_no") -> DataFrame:
    """The first records by ``key`` that give at least ``n`` BED rows; the last one is not cut.

    Hits are summed up by ranges of keys first, so the running sum goes over ranges, and then over the one range in which
    ``n`` is reached.
    """
    sizes = records.select(F.col(key).alias("k"), F.size("hits").alias("w"))
    width = 4096
    ranges = sizes.groupBy(F.floor(F.col("k") / width).alias("range")).agg(F.sum("w").alias("w"))
    upto = ranges.select("range", "w", F.sum("w").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    cut = upto.where(F.col("upto") >= n).orderBy("range").limit(1).select("range", (F.col("upto") - F.col("w")).alias("before")).collect()
    if not cut:
        return records
    place = F.floor(F.col(key) / width)
    inside = records.where(place == cut[0]["range"])
    before = F.coalesce(F.sum(F.size("hits")).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + cut[0]["before"]
    inside = inside.withColumn("before", before).where(F.col("before") < n).drop("before")
    return records.where(place < cut[0]["range"]).unionByName(inside)


def fasta_line(header: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), seq)


def fastq_line(header: Column, seq: Column, qual: Column | None = None) -> Column:
    """Four lines; without qualities, the constant ``I``."""
    return F.concat(F.lit("@"), header, F.lit("\n"), seq, F.lit("\n+\n"), F.repeat(F.lit("I"), F.length(seq)) if qual is None else qual)


def unmapped_sequence(seq: Column) -> Column:
    """``N`` for an empty or null sequence."""
    s = F.trim(F.coalesce(seq, F.lit("")), F.lit(" \t\r\n"))
    return F.when(s == "", "N").otherwise(s)


def fasta_to_fastq(reads: DataFrame) -> DataFrame:
    return reads.select(fastq_line(F.col("header"), F.col("seq")).alias("value"))


def fastq_to_fasta(reads: DataFrame) -> DataFrame:
    return reads.select(fasta_line(F.col("header"), F.col("seq")).alias("value"))
