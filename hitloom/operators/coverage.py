"""Continuous blocks and gaps of overlapping intervals, per entity.

Two levels, so that no entity is ever handled as a whole: intervals are clipped
at shard boundaries and merged within ``(entity, shard)``; then only the blocks
that touch a boundary, at most two per shard, are stitched together. Of a long
interval only the two clipped ends go to shards; the whole shards between them
stay one range, which takes part in the stitching.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .running import with_earlier_max

#: Width of a shard, and so the most distinct starts that are merged in one go. It doesn't depend on the data, so no stray coordinate can widen it.
WIDTH = 1 << 16


def _shard(c: str, width: int) -> Column:
    """The shard of a coordinate; the division rounds down, also below 0."""
    return F.expr(f"{c} div {width} - if({c} % {width} < 0, 1, 0)")


def _merge(df: DataFrame, part: list[str]) -> DataFrame:
    """Union of ``[s, e)`` within ``part``; touching intervals join."""
    before = Window.partitionBy(*part).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    run = df.withColumn("new", (F.col("s") > F.coalesce(F.max("e").over(before), F.col("s") - 1)).cast("int"))
    run = run.withColumn("block", F.sum("new").over(Window.partitionBy(*part).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*part, "block").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("block")


def merge_blocks(intervals: DataFrame, keys: list[str], start: str, end: str, width: int | None = None) -> DataFrame:
    """``(keys, start_pos, end_pos)``: the union of the half-open intervals of each entity, as disjoint blocks that don't touch.

    Rows with a null key, start or end and rows with ``start >= end`` are no intervals; repeats don't matter; other columns
    are ignored; an empty table gives an empty result.
    """
    width = width or WIDTH
    fine = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) < F.col(end))
    for k in keys:
        fine = fine & F.col(k).isNotNull()
    iv = intervals.where(fine).select(*keys, F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    iv = iv.withColumn("a", _shard("s", width)).withColumn("z", _shard("(e - 1)", width))
    wide = F.lit(width).cast("long")
    piece = lambda shard, s, e: F.struct(shard.alias("shard"), s.alias("s"), e.alias("e"))
    whole = F.array(piece(F.col("a"), F.col("s"), F.col("e")))
    clipped = F.array(piece(F.col("a"), F.col("s"), (F.col("a") + 1) * wide), piece(F.col("z"), F.col("z") * wide, F.col("e")))
    pieces = iv.select(*keys, F.explode(F.when(F.col("a") == F.col("z"), whole).otherwise(clipped)).alias("p")).select(*keys, "p.*")
    pieces = pieces.groupBy(*keys, "shard", "s").agg(F.max("e").alias("e"))

    # Whole shards inside long intervals, as ranges of shards; pieces that lie in one are part of it.
    ranges = iv.where(F.col("z") - F.col("a") > 1).groupBy(*keys, (F.col("a") + 1).alias("shard")).agg(F.max("z").alias("until"))
    met = pieces.join(ranges.select(*keys).distinct(), keys, "left_semi").select(*keys, "shard").distinct().withColumn("until", F.lit(None).cast("long"))
    upto = Window.partitionBy(*keys).orderBy("shard").rangeBetween(Window.unboundedPreceding, 0)
    covered = met.unionByName(ranges).withColumn("top", F.max("until").over(upto)).where(F.col("top") > F.col("shard")).select(*keys, "shard").distinct()
    local = _merge(pieces.join(covered, [*keys, "shard"], "left_anti"), [*keys, "shard"])

    touches = (F.col("s") == F.col("shard") * wide) | (F.col("e") == (F.col("shard") + 1) * wide)
    edges = local.where(touches).select(*keys, "s", "e").unionByName(ranges.select(*keys, (F.col("shard") * wide).alias("s"), (F.col("until") * wide).alias("e")))
    blocks = local.where(~touches).select(*keys, "s", "e").unionByName(_merge(edges, keys).select(*keys, "s", "e"))
    return blocks.select(*keys, F.col("s").alias("start_pos"), F.col("e").alias("end_pos"))


def _after_gaps(blocks: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``blocks`` with ``before``, the end of the block before of the same entity, or null."""
    return with_earlier_max(blocks.withColumn("shard", _shard("start_pos", width)), keys, "shard", ["start_pos"], F.col("end_pos"), "before").drop("shard")


def gaps_of(blocks: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """``(keys, start_pos, end_pos)``: what lies between neighbouring blocks of an entity, given disjoint blocks.

    Neighbours within a shard are found within it; the first block of a shard gets the end of the last one before it from
    a table with one row per entity and shard.
    """
    return _after_gaps(blocks, keys, width).where(F.col("before") < F.col("start_pos")).select(*keys, F.col("before").alias("start_pos"), F.col("start_pos").alias("end_pos"))


def blocks_and_gaps(intervals: DataFrame, keys: list[str], start: str, end: str, width: int | None = None) -> DataFrame:
    """``(keys, kind, start_pos, end_pos)``, ``kind`` being ``block`` or ``gap``."""
    row = lambda kind, s, e: F.struct(F.lit(kind).alias("kind"), F.col(s).alias("start_pos"), F.col(e).alias("end_pos"))
    block, gap = row("block", "start_pos", "end_pos"), row("gap", "before", "start_pos")
    rows = _after_gaps(merge_blocks(intervals, keys, start, end, width), keys, width or WIDTH)
    both = F.when(F.col("before") < F.col("start_pos"), F.array(block, gap)).otherwise(F.array(block))
    return rows.select(*keys, F.explode(both).alias("x")).select(*keys, "x.*")


def paired(starts: str, ends: str) -> Column:
    """The structs ``(s, e)`` of two arrays that pair by place. A null, a missing partner and ``s >= e`` give no pair; null for null arrays."""
    zipped = F.arrays_zip(F.col(starts).alias("s"), F.col(ends).alias("e"))
    return F.filter(zipped, lambda p: p["s"].isNotNull() & p["e"].isNotNull() & (p["s"] < p["e"]))
