"""Sequence functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """The reverse complement; letters other than A, C, G, T and N stay."""
    return F.reverse(F.translate(seq, "ATCGNatcgn", "TAGCNtagcn"))


def on_strand(seq: Column, strand: Column) -> Column:
    """``seq`` as it lies on the reference: reverse-complemented on strand R."""
    return F.when(strand == "R", reverse_complement(seq)).otherwise(seq)


def strand_sign(strand: Column) -> Column:
    """``+`` for F, else ``-``."""
    return F.when(strand == "F", "+").otherwise("-")
