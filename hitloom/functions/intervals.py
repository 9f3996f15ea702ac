"""Half-open intervals in arrays of structs ``(s, e)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OF = "array<struct<s:bigint,e:bigint>>"


def merged(intervals: Column) -> Column:
    """The union as disjoint intervals in order; touching ones join. Empty for an empty array, null for null."""
    ordered = F.array_sort(intervals.cast(_OF))

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(acc) > 0) & (x["s"] <= last["e"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(ordered, F.array().cast(_OF), step)


def union_length(intervals: Column) -> Column:
    """Length of the union; 0 for an empty array, null for null."""
    ordered = F.array_sort(intervals.cast(_OF))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("to"))

    def step(acc: Column, x: Column) -> Column:
        begin = F.greatest(x["s"], F.coalesce(acc["to"], x["s"]))
        more = F.greatest(F.lit(0).cast("long"), x["e"] - begin)
        return F.struct((acc["n"] + more).alias("n"), F.greatest(F.coalesce(acc["to"], x["e"]), x["e"]).alias("to"))

    return F.aggregate(ordered, start, step, lambda acc: acc["n"])


def intersection_length(a: Column, b: Column) -> Column:
    """Length that both unions cover: by inclusion and exclusion, without pairing intervals."""
    return union_length(a) + union_length(b) - union_length(F.concat(a.cast(_OF), b.cast(_OF)))
