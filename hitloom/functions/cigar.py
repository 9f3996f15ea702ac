"""CIGAR and edit distance of alignment strings: ``.`` match, ``x`` mismatch, ``-`` deletion, a letter an inserted base, else soft clip."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _runs(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"((.)\2*)"), F.lit(1))


def _on_reference(alignment: Column, reverse: Column) -> Column:
    return F.when(reverse, F.reverse(alignment)).otherwise(alignment)


def _op(char: Column) -> Column:
    # "x" is a letter too, so it is tested before letters are.
    return F.when(char == ".", "M").when(char == "x", "X").when(char == "-", "D").when(char.rlike(r"^\p{L}$"), "I").otherwise("S")


def cigar(alignment: Column, reverse: Column) -> Column:
    """Run-length CIGAR where every *character* is a run of its own: inserted ``AC`` gives ``1I1I``. Empty for an empty alignment."""
    one = lambda r: F.concat(F.length(r).cast("string"), _op(F.substring(r, 1, 1)))
    return F.array_join(F.transform(_runs(_on_reference(alignment, reverse)), one), "")


def cigar_by_op(alignment: Column, reverse: Column) -> Column:
    """Run-length CIGAR by *operation*: inserted ``AC`` gives ``2I``."""
    a = F.regexp_replace(_on_reference(alignment, reverse), r"(?!x)\p{L}", "I")
    ops = F.translate(F.regexp_replace(a, r"[^.x\-I]", "S"), ".x-", "MXD")
    one = lambda r: F.concat(F.length(r).cast("string"), F.substring(r, 1, 1))
    return F.array_join(F.transform(_runs(ops), one), "")


def edit_distance(alignment: Column) -> Column:
    """Mismatches, deletions and inserted bases."""
    return F.length(F.regexp_replace(alignment, r"[^\-\p{L}]", ""))


def read_length(alignment: Column) -> Column:
    """Bases of the read that the alignment covers: all but deletions."""
    return F.length(F.replace(alignment, F.lit("-"), F.lit("")))
