"""Counts per transcript, with several ways to share reads that map to more than one.

Records are grouped once, by sample and the ordered list of names of their hits
(a *combination*); everything else works on that far smaller table. Tables of
counts have the columns ``sample_id, key, n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_names

BY = "sample_id"


def combinations(records: DataFrame, names: str = "ref_names", by: str = BY) -> DataFrame:
    """``(sample_id, ids, n)``: records by the ordered list of their clean names.

    Records without a clean name are left out. The grouping combines map-side: a list that holds most reads costs one row
    per task.
    """
    ids = records.select(F.col(by).alias(BY), clean_names(F.col(names)).alias("ids")).where(F.size("ids") > 0)
    return ids.groupBy(BY, "ids").agg(F.count("*").alias("n"))


def _summed(df: DataFrame) -> DataFrame:
    return df.groupBy(BY, "key").agg(F.sum("n").alias("n"))


def _multi() -> Column:
    return F.size("ids") > 1


def raw(combos: DataFrame) -> DataFrame:
    """By combination, as ``A,B``; order matters."""
    return combos.select(BY, F.array_join("ids", ",").alias("key"), "n")


def first_id(combos: DataFrame) -> DataFrame:
    """Every record counts for its first name."""
    return _summed(combos.select(BY, F.element_at("ids", 1).alias("key"), "n"))


def unique(combos: DataFrame) -> DataFrame:
    """Records of one name."""
    return combos.where(~_multi()).select(BY, F.element_at("ids", 1).alias("key"), "n")


def multi(combos: DataFrame) -> DataFrame:
    """Records of several names, by combination."""
    return raw(combos.where(_multi()))


def multi_to_all(combos: DataFrame) -> DataFrame:
    """Every occurrence of a name in a combination counts fully."""
    return _summed(combos.where(_multi()).select(BY, F.explode("ids").alias("key"), "n"))


def multi_equal(combos: DataFrame) -> DataFrame:
    """Each distinct name of a combination gets its reads over the number of names, repeats included, so a repeated name loses share."""
    share = combos.where(_multi()).select(BY, F.explode(F.array_distinct("ids")).alias("key"), (F.col("n") / F.size("ids")).alias("n"))
    return _summed(share)


def weights(unique_counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(sample_id, key, tpm)`` of counts by length; names without a positive length or count have none.

    ``lengths``: ``(key, length)``, one row per key.
    """
    rpk = unique_counts.join(lengths.where(F.col("length") > 0), "key").select(BY, "key", (F.col("n") / (F.col("length") / 1000.0)).alias("rpk")).where(F.col("rpk") > 0)
    total = rpk.groupBy(BY).agg(F.sum("rpk").alias("total"))
    return rpk.join(total, BY).select(BY, "key", (F.col("rpk") * 1e6 / F.col("total")).alias("tpm"))


def _weighted(combos: DataFrame, tpm: DataFrame) -> DataFrame:
    """Combinations with several names, each with the summed weight of its names (repeats counted) and its weighted names."""
    several = combos.where(_multi())
    each = several.select(BY, "ids", "n", F.explode("ids").alias("key")).join(tpm, [BY, "key"], "left")
    named = F.collect_set(F.when(F.col("tpm").isNotNull(), F.struct("key", "tpm")))
    return each.groupBy(BY, "ids", "n").agg(F.sum("tpm").alias("total"), named.alias("named"))


def multi_em(combos: DataFrame, tpm: DataFrame) -> DataFrame:
    """Reads of a combination in proportion to the weights of its names: one pass, no iteration.

    A repeated name counts repeatedly in the denominator but gets its share once.
    """
    each = _weighted(combos, tpm).where(F.col("total") > 0).select(BY, "n", "total", F.explode("named").alias("x"))
    return _summed(each.select(BY, F.col("x.key").alias("key"), (F.col("n") * F.col("x.tpm") / F.col("total")).alias("n")))


def multi_em_unallocated(combos: DataFrame, tpm: DataFrame) -> DataFrame:
    """Combinations of which no name has a weight; their reads go to none."""
    return raw(_weighted(combos, tpm).where(F.coalesce("total", F.lit(0.0)) <= 0).select(BY, "ids", "n"))


def added(*counts: DataFrame) -> DataFrame:
    """Sum over the union of keys."""
    out = None
    for c in counts:
        part = c.select(BY, "key", F.col("n").cast("double").alias("n"))
        out = part if out is None else out.unionByName(part)
    return _summed(out)


def final_em(combos: DataFrame, lengths: DataFrame) -> DataFrame:
    u = unique(combos)
    return added(u, multi_em(combos, weights(u, lengths)))


def final_eq(combos: DataFrame) -> DataFrame:
    return added(unique(combos), multi_equal(combos))


def final_ma(combos: DataFrame) -> DataFrame:
    return added(unique(combos), multi_to_all(combos))


def summary(combos: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per sample: reads, unique and multi ones, unallocated ones and the sums of the final counts."""
    base = combos.groupBy(BY).agg(
        F.sum("n").alias("total_reads"), F.sum(F.when(~_multi(), F.col("n")).otherwise(0)).alias("unique_mapped"), F.sum(F.when(_multi(), F.col("n")).otherwise(0)).alias("multi_mapped"),
        F.sum(F.when(_multi(), F.col("n") * F.size(F.array_distinct("ids")) / F.size("ids")).otherwise(0.0)).alias("multi_equal"),
    )
    tpm = weights(unique(combos), lengths)
    lost = multi_em_unallocated(combos, tpm).groupBy(BY).agg(F.sum("n").alias("cannot_allocate"))
    shared = multi_em(combos, tpm).groupBy(BY).agg(F.sum("n").alias("multi_em"))
    out = base.join(lost, BY, "left").join(shared, BY, "left").fillna({"cannot_allocate": 0, "multi_em": 0.0})
    return out.withColumn("final_em", F.col("unique_mapped") + F.col("multi_em")).withColumn("final_eq", F.col("unique_mapped") + F.col("multi_equal"))


def multi_events(combos: DataFrame, level: str = "isoform") -> DataFrame:
    """``(sample_id, level, events, reads, reads_per_event)``: combinations of several names and the reads they hold, for samples that have any."""
    several = combos.where(_multi()).groupBy(BY).agg(F.count("*").alias("events"), F.sum("n").alias("reads"))
    return several.select(BY, F.lit(level).alias("level"), "events", "reads", F.round(F.col("reads") / F.col("events"), 2).alias("reads_per_event"))


def summary_lines(summary: DataFrame, events: DataFrame) -> DataFrame:
    """``(sample_id, line_no, value)``: a report in text for each sample, from ``summary`` and ``multi_events``."""
    columns = [c for c in summary.columns if c != BY]
    stats = summary.select(BY, F.posexplode(F.array(*[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in columns])).alias("line_no", "value"))
    titles = {"events": "level multi-mapping events: ", "reads": "level total multi-mapped reads: ", "reads_per_event": "level average reads per multi-mapping event: "}
    named = F.array(*[F.concat(F.initcap("level"), F.lit("-" + title), F.format_string("%.2f" if c == "reads_per_event" else "%d", c)) for c, title in titles.items()])
    after = F.when(F.col("level") == "isoform", 100).otherwise(200)
    multi = events.select(BY, after.alias("after"), F.posexplode(named).alias("i", "value")).select(BY, (F.col("after") + F.col("i")).alias("line_no"), "value")
    return stats.unionByName(multi)


def multi_mapped_reads(records: DataFrame, names: str = "ref_names", read: str = "header", by: str = BY) -> DataFrame:
    """``(sample_id, key, read)``: the reads of each combination of several names, one row per read, so that no combination's reads are gathered."""
    rows = records.select(F.col(by).alias(BY), F.col(read).alias("read"), clean_names(F.col(names)).alias("ids")).where(_multi())
    return rows.select(BY, F.array_join("ids", ",").alias("key"), "read")


def lengths_of(annotation: DataFrame, mode: str = "txlength", key: str = "txname") -> DataFrame:
    """``(key, length)`` of transcripts: the first column there is of ``mode``, txlength, isoformeffectivelength and cdslength."""
    have = {c.lower(): c for c in annotation.columns}
    column = next((have[c] for c in (mode.lower(), "txlength", "isoformeffectivelength", "cdslength") if c in have), None)
    if column is None:
        raise ValueError("the annotation has no length column")
    return annotation.select(F.col(key).alias("key"), F.col(column).cast("double").alias("length"))
