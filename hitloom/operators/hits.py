"""Records and their hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: Parallel arrays of a record and the field of a hit that each gives.
PARALLEL = {"ref_names": "ref_name", "strands": "strand", "positions": "position", "mismatches": "mismatch", "alignment": "alignment"}


def latest_records(df: DataFrame, columns: Sequence[str], key: str = "record_no", order: str = "loaded_at") -> DataFrame:
    """One row per ``key`` with ``columns``: the one with the greatest ``order``.

    The choice combines map-side, so a key delivered very often costs one row per task. Rows with a null key are left out.
    """
    packed = F.struct(*columns)
    best = F.max_by(packed, F.coalesce(F.col(order), F.lit("0001-01-01").cast("timestamp_ntz")))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("r")).select(key, "r.*")


def hit_array(names: str = "ref_names", **others: str) -> Column:
    """Array of structs, one per named hit: ``ref_name`` and the parallel ``others`` (field=column).

    Hits with a null or blank name are dropped, names are stripped, and a shorter parallel array leaves nulls.
    Null for a null list of names.
    """
    # A null array would make the whole zip null, so it stands for one without elements.
    zipped = F.arrays_zip(F.col(names).alias("ref_name"), *(F.coalesce(F.col(c), F.array()).alias(f) for f, c in others.items()))
    clean = F.transform(zipped, lambda h: F.struct(strip(h["ref_name"]).alias("ref_name"), *(h[f].alias(f) for f in others)))
    return F.filter(F.when(F.col(names).isNotNull(), clean), lambda h: h["ref_name"].isNotNull() & (h["ref_name"] != ""))


def with_hits(df: DataFrame) -> DataFrame:
    """``df`` with its parallel arrays replaced by ``hits``, an array of structs, and a ``multi_count`` that is never null."""
    have = {f: c for c, f in PARALLEL.items() if c in df.columns and c != "ref_names"}
    out = df.withColumn("hits", hit_array("ref_names", **have)).drop(*PARALLEL)
    if "multi_count" in df.columns:
        out = out.withColumn("multi_count", F.coalesce("multi_count", F.size("hits")))
    return out.where(F.size("hits") > 0)


def explode_hits(df: DataFrame) -> DataFrame:
    """One row per hit of ``with_hits``: the record's columns, ``hit_idx`` from 0 and the fields of the hit."""
    rest = [c for c in df.columns if c != "hits"]
    return df.select(*rest, F.posexplode("hits").alias("hit_idx", "h")).select(*rest, "hit_idx", "h.*")


def preview(df: DataFrame, n: int = 10, order: str = "record_no") -> DataFrame:
    """The first ``n`` records by ``order``; a top-n, not a sort of all."""
    return df.orderBy(order).limit(n)
