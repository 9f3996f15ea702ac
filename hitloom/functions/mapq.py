"""Mapping quality from alignment strings, in closed form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The levels a quality is rounded down to.
LEVELS = (0, 1, 3, 5, 10, 20, 30, 40, 50, 60)


@dataclass(frozen=True)
class Scoring:
    match: int = 2
    mismatch: int = -4
    gap_open: int = -6
    gap_extend: int = -1
    least: int = 0
    most: int = 60


def discretize(quality: Column) -> Column:
    """The greatest level not above ``quality``; 0 below all."""

    def level_of(q: Column) -> Column:
        out = F.lit(0)
        for level in LEVELS:
            out = F.when(q >= level, level).otherwise(out)
        return out

    # The lambda's variable holds the quality, so that it is worked out once and not for every level.
    return F.get(F.transform(F.array(quality), level_of), F.lit(0))


def _without(s: Column, *chars: str) -> Column:
    """Length of ``s`` without ``chars``."""
    for c in chars:
        s = F.replace(s, F.lit(c), F.lit(""))
    return F.length(s)


def _count(s: Column, char: str) -> Column:
    return F.length(s) - _without(s, char)


def mapq(alignment: Column, primary: Column, multi_count: Column, scoring: Scoring = Scoring()) -> Column:
    """Quality of a hit: affine gap score over that of a perfect one, less 5 per doubling of the number of hits, x 0.6 if not primary.

    A gap is a run of characters other than ``.`` and ``x``.
    """
    matches, wrong = _count(alignment, "."), _count(alignment, "x")
    gaps = F.regexp_extract_all(alignment, F.lit(r"[^.x]+"), F.lit(0))
    gap_chars = F.length(alignment) - matches - wrong
    score = scoring.match * matches + scoring.mismatch * wrong + scoring.gap_open * F.size(gaps) + scoring.gap_extend * (gap_chars - F.size(gaps))
    best = _without(alignment, "-") * scoring.match
    raw = score / best * scoring.most
    raw = F.when(multi_count > 1, raw - F.least(F.lit(60.0), F.log2(multi_count) * 5)).otherwise(raw)
    raw = F.when(primary, raw).otherwise(raw * 0.6)
    bounded = discretize(F.greatest(F.lit(float(scoring.least)), F.least(F.lit(float(scoring.most)), raw)))
    return F.when(best == 0, scoring.least).otherwise(bounded)


def consistency(alignment: Column) -> Column:
    """At most 10: mean and greatest length of runs of matches, over 20; 0 without any."""
    runs = F.transform(F.regexp_extract_all(alignment, F.lit(r"\.+"), F.lit(0)), F.length)
    mean = F.aggregate(runs, F.lit(0), lambda a, x: a + x) / F.size(runs)
    return F.when(F.size(runs) == 0, 0.0).otherwise(F.least(F.lit(10.0), (mean + F.array_max(runs)) / 20.0))


def mapq_legacy(alignment: Column, mismatches: Column, primary: Column, multi_count: Column) -> Column:
    """Older quality: from the mismatch rate, the length and the consistency of matches."""
    effective = _without(alignment, "-", "S")
    base = F.greatest(F.lit(0.0), 60 - mismatches / effective * 300)
    penalty = F.when(multi_count > 1, F.least(F.lit(30.0), 10 * F.log2(multi_count))).otherwise(0.0)
    raw = base * F.least(F.lit(1.0), effective / 100.0) - penalty + consistency(alignment)
    raw = F.when(primary, raw).otherwise(raw * 0.7)
    return F.when(effective == 0, 0).otherwise(discretize(F.greatest(F.lit(0.0), F.least(F.lit(60.0), raw))))
