"""Per-key results where a few keys hold most rows.

Rows are first counted by key *and value*. That grouping is combined map-side
and spreads a hot key over as many partitions as it has values, so what a key
sends on is its distinct values with weights instead of its rows. Distinct
counts, modes and percentiles are then exact results over weighted values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

#: Parts into which the span of a key's values is cut, round by round, on the way to a percentile.
PARTS = 1024


def weighted_values(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """``(key, value, n)``: the number of rows of each key and value. Rows with a null key are left out, null values are counted."""
    return df.select(key.alias("key"), value.alias("value")).where(F.col("key").isNotNull()).groupBy("key", "value").agg(F.count("*").alias("n"))


def key_profile(weighted: DataFrame) -> DataFrame:
    """``(key, n_rows, n_values, n_distinct, mode)`` from ``weighted_values``.

    ``n_values`` counts rows with a value, ``n_distinct`` distinct values, ``mode`` is the most frequent value, of equally
    frequent ones the smallest; null without any value. Every aggregate combines map-side.
    """
    has = F.col("value").isNotNull()
    best = F.min(F.when(has, F.struct((-F.col("n")).alias("w"), F.col("value").alias("value"))))
    return weighted.groupBy("key").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_values"), F.count("value").alias("n_distinct"), best["value"].alias("mode")
    )


def weighted_percentiles(weighted: DataFrame, percents: Sequence[int]) -> DataFrame:
    """``(key, percent, value)``: the smallest value with at least ``percent`` % of the key's non-null values at or below it.

    ``weighted`` holds whole-number values (null ones don't count; a key with null values only has no row).
    The span of each key's values, which depends on nothing but the data, is cut into ``PARTS`` ranges; the one that holds
    the percentile is cut again, until ranges are single values: one round for spans of up to 1,024, two up to a million,
    seven for any. A running sum goes over at most ``PARTS`` rows of a key and percentile, however many values it has.
    """
    w = weighted.where(F.col("value").isNotNull()).select("key", F.col("value").cast("long").alias("value"), "n")
    spans = w.groupBy("key").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("total"))
    # The rank of the wanted value, from 1. Spans are kept as decimals, as they may be wider than a long.
    rank = F.greatest(F.lit(1), F.ceil(F.col("percent") * F.col("total") / 100)).cast("long")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    todo = spans.select("key", wide("low").alias("low"), wide("high").alias("high"), F.explode(F.array(*[F.lit(int(p)) for p in percents])).alias("percent"), "total")
    todo = todo.select("key", "percent", rank.alias("rank"), "low", "high")
    todo = cut_lineage(todo)
    while True:
        width = F.ceil((F.col("high") - F.col("low") + 1) / F.lit(PARTS)).cast("decimal(20,0)")
        inside = w.join(todo.withColumn("width", width), "key").where((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")))
        part = F.floor((F.col("value") - F.col("low")) / F.col("width")).cast("int")
        sums = inside.groupBy("key", "percent", "rank", "low", "high", "width", part.alias("part")).agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("key", "percent").orderBy("part"))
        met = sums.withColumn("upto", upto).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        start = (F.col("low") + F.col("part") * F.col("width")).cast("decimal(20,0)")
        end = F.least("high", (start + F.col("width") - 1).cast("decimal(20,0)"))
        todo = cut_lineage(met.select("key", "percent", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), start.alias("low"), end.alias("high")))
        if todo.where(F.col("low") < F.col("high")).isEmpty():
            return todo.select("key", "percent", F.col("low").cast("long").alias("value"))


def frequent_keys(weighted: DataFrame, share: float, total: int) -> DataFrame:
    """``(key, n_rows)``: keys with at least ``share`` of ``total`` rows."""
    return key_profile(weighted).where(F.col("n_rows") >= F.lit(share * total - 1e-9)).select("key", "n_rows")
