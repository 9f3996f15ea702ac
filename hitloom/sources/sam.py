"""Reader of SAM text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sam(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``(header, rows)``. Any line that starts with ``@`` is header; rows need 11 fields, others are skipped. ``line_no`` grows along each file."""
    lines = spark.read.text(paths).select(F.monotonically_increasing_id().alias("line_no"), F.regexp_replace("value", r"\r$", "").alias("value"))
    f = F.split("value", "\t")
    n = lambda i: F.get(f, F.lit(i))
    rows = lines.where(~F.startswith("value", F.lit("@")) & (F.size(f) >= 11)).select(
        "line_no", n(0).alias("qname"), n(1).cast("int").alias("flag"), n(2).alias("rname"), n(3).cast("long").alias("pos"), n(4).cast("int").alias("mapq"), n(5).alias("cigar"), n(6).alias("rnext"), n(7).cast("long").alias("pnext"),
        n(8).cast("long").alias("tlen"), n(9).alias("seq"), n(10).alias("qual"), F.slice(f, 12, 1 << 20).alias("tags"),
    )
    return lines.where(F.startswith("value", F.lit("@"))), rows
