"""Cell formats of the result files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decimals(v: Column, places: int) -> Column:
    """Half-even decimals of ``v`` to six places, so that the order of additions doesn't decide ties."""
    return F.bround(v.cast("decimal(24,6)"), places).cast("string")


def cell(v: Column) -> Column:
    """``*`` for null, whole numbers without a point, else one decimal."""
    whole = F.abs(v - F.bround(v, 0)) < 1e-6
    return F.when(v.isNull(), "*").when(whole, F.bround(v, 0).cast("long").cast("string")).otherwise(_decimals(v, 1))


def ratio_cell(part: Column, whole: Column) -> Column:
    """Two decimals; ``*`` where ``whole`` is 0 or null."""
    ok = whole.isNotNull() & (whole != 0)
    return F.when(ok, _decimals(part / F.when(ok, whole), 2)).otherwise("*")


def joined_cells(cells: Column) -> Column:
    """Cells of one combination in one field."""
    return F.array_join(cells, ";")
