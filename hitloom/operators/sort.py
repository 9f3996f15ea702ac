"""Sorting of SAM rows. A line number breaks ties, as Spark's sort isn't stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coordinate_key(rname: str = "rname", pos: str = "pos", flag: str = "flag") -> list[Column]:
    """Reference by name with unmapped last, position with unplaced last, forward before reverse."""
    return [
        F.when(F.col(rname) == "*", "zzz_unmapped").otherwise(F.col(rname)),
        F.when(F.col(pos) > 0, F.col(pos).cast("long")).otherwise(F.lit(1 << 31).cast("long")),
        F.col(flag).bitwiseAND(F.lit(16)),
    ]


def sort_by_coordinate(rows: DataFrame, tie: str = "line_no") -> DataFrame:
    return rows.orderBy(*coordinate_key(), tie)


def sort_by_name(rows: DataFrame, tie: str = "line_no") -> DataFrame:
    return rows.orderBy("qname", tie)


def header_order(header: DataFrame) -> DataFrame:
    """Header lines ``(line_no, value)`` grouped: HD, SQ, RG, PG, CO, others; each group in file order."""
    kinds = ["@HD", "@SQ", "@RG", "@PG", "@CO"]
    kind = F.element_at(F.split("value", "\t"), 1)
    rank = F.lit(len(kinds))
    for i, k in enumerate(kinds):
        rank = F.when(kind == k, i).otherwise(rank)
    return header.orderBy(rank, "line_no")
