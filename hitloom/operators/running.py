"""Running values along very long sequences of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


def with_earlier_max(df: DataFrame, keys: Sequence[str], tile: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the greatest ``value`` of all earlier rows of ``keys`` by ``order``, or null. Rows with a null key or tile are left out.

    ``tile`` numbers stretches of the order. Within a tile a window looks back, beyond it the greatest value of each earlier
    tile is carried on, so that no key is sorted as a whole. ``df`` is written to the shared checkpoint folder first, as it is
    read twice.
    """
    df = cut_lineage(df.withColumn("_v", value))
    inside = Window.partitionBy(*keys, tile).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(tile).rowsBetween(Window.unboundedPreceding, -1)
    carried = df.groupBy(*keys, tile).agg(F.max("_v").alias("_v")).select(*keys, tile, F.max("_v").over(earlier).alias("_carry"))
    return df.join(carried, [*keys, tile]).withColumn(name, F.greatest(F.max("_v").over(inside), "_carry")).drop("_v", "_carry")
