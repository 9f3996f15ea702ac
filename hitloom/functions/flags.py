"""SAM flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bits of the SAM format.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, FAILED, DUPLICATE = (1 << i for i in range(11))


def sam_flag(strand: Column, secondary: Column | bool = False, paired: bool = False, proper: bool = False, unmapped: bool = False, mate_unmapped: bool = False, first: bool = False, second: bool = False, failed: bool = False, duplicate: bool = False) -> Column:
    """Flag of a hit. The mate of a paired hit on F lies on the reverse strand; proper and mate bits need ``paired``."""
    fixed = PAIRED * paired | PROPER * (paired and proper) | UNMAPPED * unmapped | MATE_UNMAPPED * (paired and mate_unmapped) | FIRST * first | SECOND * second | FAILED * failed | DUPLICATE * duplicate
    on_strand = F.when(strand == "R", REVERSE).when((strand == "F") & F.lit(paired), MATE_REVERSE).otherwise(0)
    other = F.when(secondary if isinstance(secondary, Column) else F.lit(secondary), SECONDARY).otherwise(0)
    return on_strand + other + F.lit(fixed)
