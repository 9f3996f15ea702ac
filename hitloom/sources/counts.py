"""Reader of count files, one per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = {"gene": ".counts_gene_level_unique.csv", "isoform": ".counts_isoform_level_unique.csv"}


def read_counts(spark: SparkSession, paths: str | list[str], level: str = "gene") -> DataFrame:
    """The files' columns with ``sample_id``, the file name without its suffix. Columns that a file lacks are null."""
    suffix = SUFFIXES[level].replace(".", r"\.")
    rows = spark.read.option("header", True).option("inferSchema", True).csv(paths)
    return rows.withColumn("sample_id", F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*){suffix}$", 1))


def long_counts(rows: DataFrame, column: str, key: str = "Gene") -> DataFrame:
    """``(sample_id, key, n)`` of one count column; 0 for every key if there is no such column."""
    n = F.col(column).cast("double") if column in rows.columns else F.lit(0.0)
    return rows.select("sample_id", F.col(key).alias("key"), F.coalesce(n, F.lit(0.0)).alias("n"))
