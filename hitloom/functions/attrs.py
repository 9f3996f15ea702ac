"""Attribute columns of GTF and GFF3."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of feature ids.
ID_PREFIXES = ("gene:", "transcript:", "mrna:", "cds:", "exon:", "CDS:")


def strip_id(value: Column) -> Column:
    """``value`` without one of the known prefixes and without double quotes."""
    return F.replace(F.regexp_replace(value, "^(" + "|".join(ID_PREFIXES) + ")", ""), F.lit('"'), F.lit(""))


def gtf_attribute(attributes: Column, key: str) -> Column:
    """Value of ``key "value";``, the last one if repeated; null if absent."""
    return F.try_element_at(F.regexp_extract_all(attributes, F.lit(rf'(?<!\w){key}\s+"([^"]*)";'), F.lit(1)), F.lit(-1))


def gff3_attribute(attributes: Column, key: str) -> Column:
    """Value of ``key=value`` up to the next ``;``, the last one if repeated, without a known prefix; null if absent."""
    found = F.regexp_extract_all(F.concat(F.lit(";"), attributes), F.lit(rf";\s*{key}=([^;]*)"), F.lit(1))
    return strip_id(F.trim(F.try_element_at(found, F.lit(-1))))
