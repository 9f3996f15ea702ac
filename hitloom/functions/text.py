"""Cleaning of names and sequences, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.strip() removes.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"


def strip(c: Column) -> Column:
    """``c`` without surrounding whitespace; null stays null."""
    return F.trim(c, F.lit(WHITESPACE))


def clean(c: Column) -> Column:
    """``c`` without surrounding whitespace; blank becomes null."""
    return F.nullif(strip(c), F.lit(""))


def clean_names(names: Column) -> Column:
    """The array ``names`` with every name stripped and null or blank ones dropped; order and repeats stay."""
    return F.filter(F.transform(names, strip), lambda n: n.isNotNull() & (n != ""))


def name_set(names: Column) -> Column:
    """The distinct clean names of ``names``, sorted by code point; null for a null array."""
    return F.array_sort(F.array_distinct(clean_names(names)))
