"""Records as rows of the SAM and BAM formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..compat import Compat
from ..functions import cigar as C
from ..functions import flags, mapq, seq
from .hits import explode_hits

# SAM columns.
COLUMNS = "qname flag rname pos mapq cigar rnext pnext tlen seq qual".split()


def _scored(records: DataFrame) -> DataFrame:
    """Records whose every hit has an alignment string, with ``m``, the mapping quality of each hit."""
    quality = lambda h, i: mapq.mapq(h["alignment"], i == 0, F.col("multi_count"))
    full = records.where(~F.exists("hits", lambda h: h["alignment"].isNull()) & F.col("seq").isNotNull())
    return full.withColumn("m", F.transform("hits", quality))


def sam_rows(records: DataFrame, compat: Compat = Compat()) -> DataFrame:
    """SAM columns and tags, one row per hit; the first hit of a record is its primary.

    ``records``: ``with_hits`` with header, seq and multi_count. Hits after the first give rows only if ``multi_count`` is
    over 1, and then the primary row has an SA tag with all of them. Records without alignment strings give no row.
    Within one task, no shuffle.
    """
    reverse = lambda h: h["strand"] == "R"
    sign = lambda h: h["strand"] if compat.sa_strand_letters else seq.strand_sign(h["strand"])
    one = lambda h, i: F.concat_ws(
        ",", h["ref_name"], (h["position"] + 1).cast("string"), sign(h), C.cigar(h["alignment"], reverse(h)), F.get("m", i).cast("string"), h["mismatch"].cast("string")
    )
    several = (F.col("multi_count") > 1) & (F.size("hits") > 1)
    base = _scored(records)
    base = base.withColumn("sa", F.when(several, F.concat(F.lit("SA:Z:"), F.array_join(F.slice(F.transform("hits", one), 2, F.size("hits")), ";"))))
    base = base.withColumn("last_nm", C.edit_distance(F.element_at("hits", -1)["alignment"]))
    rows = explode_hits(base).where((F.col("hit_idx") == 0) | (F.col("multi_count") > 1))
    nm = F.col("last_nm") if compat.nm_of_last_hit else C.edit_distance(F.col("alignment"))
    on_reverse, quality = F.col("strand") == "R", F.get("m", F.col("hit_idx"))
    rest = [c for c in ("record_no", "sample_id", "file_name") if c in records.columns]
    return rows.select(
        *rest, "hit_idx",
        F.col("header").alias("qname"), flags.sam_flag(F.col("strand"), F.col("hit_idx") > 0).alias("flag"), F.col("ref_name").alias("rname"), (F.col("position") + 1).alias("pos"),
        quality.alias("mapq"), C.cigar(F.col("alignment"), on_reverse).alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"),
        seq.on_strand(F.col("seq"), F.col("strand")).alias("seq"), F.lit("*").alias("qual"),
        F.concat(F.lit("XM:i:"), F.col("mismatch").cast("string")).alias("xm"), F.concat(F.lit("XN:i:"), F.col("multi_count").cast("string")).alias("xn"),
        F.concat(F.lit("NM:i:"), nm.cast("string")).alias("nm"), F.concat(F.lit("XS:i:"), quality.cast("string")).alias("xs"), F.when(F.col("hit_idx") == 0, F.col("sa")).alias("sa"),
    )


def sam_lines(rows: DataFrame) -> DataFrame:
    """Tab-separated lines of ``sam_rows``."""
    return rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in (*COLUMNS, "xm", "xn", "nm", "xs", "sa")]).alias("value"))


def bam_rows(records: DataFrame) -> DataFrame:
    """Rows as for BAM: 0-based positions, CIGAR by operation, NM of each hit, quality 30 for every base, no SA tag; all hits."""
    rows = explode_hits(_scored(records))
    rest = [c for c in ("record_no", "sample_id", "file_name") if c in records.columns]
    return rows.select(
        *rest, "hit_idx",
        F.col("header").alias("qname"), flags.sam_flag(F.col("strand"), F.col("hit_idx") > 0).alias("flag"), F.col("ref_name").alias("rname"), F.col("position").alias("pos"),
        F.get("m", F.col("hit_idx")).alias("mapq"), C.cigar_by_op(F.col("alignment"), F.col("strand") == "R").alias("cigar"), seq.on_strand(F.col("seq"), F.col("strand")).alias("seq"),
        F.repeat(F.lit("?"), F.length("seq")).alias("qual"), C.edit_distance(F.col("alignment")).alias("nm"), F.col("mismatch").alias("xm"), F.col("multi_count").alias("xn"),
    )


def sam_header(references: DataFrame, name: str = "ref_name", length: str = "ref_length", order: str = "ref_ord", program: str = "hitloom", version: str = "0.1.0") -> DataFrame:
    """``(line_no, value)``: the header lines, references in their order. Repeated names: the last length at the first place."""
    lengths = references.where(F.col(name).isNotNull()).groupBy(name).agg(F.max_by(length, order).alias("n"), F.min(order).alias("at"))
    lines = lengths.select((F.col("at") + 2).cast("long").alias("line_no"), F.concat(F.lit("@SQ\tSN:"), F.col(name), F.lit("\tLN:"), F.col("n").cast("string")).alias("value"))
    fixed = references.sparkSession.createDataFrame([(0, "@HD\tVN:1.6\tSO:unsorted"), (1, f"@PG\tID:{program}\tPN:{program}\tVN:{version}")], "line_no long, value string")
    return fixed.unionByName(lines)


def in_regions(regions: Sequence[tuple[str, int, int]]) -> Column:
    """Whether any hit of a record *starts* within one of the half-open ``regions``. For literal, hence few, regions."""
    by_name: dict[str, list[tuple[int, int]]] = {}
    for name, start, end in regions:
        by_name.setdefault(name, []).append((start, end))

    def inside(h: Column) -> Column:
        out = F.lit(False)
        for name, spans in by_name.items():
            within = F.lit(False)
            for start, end in spans:
                within = within | ((h["position"] >= start) & (h["position"] < end))
            out = out | ((h["ref_name"] == name) & within)
        return out

    return F.exists("hits", inside)


def filter_regions(records: DataFrame, regions: Sequence[tuple[str, int, int]], compat: Compat = Compat()) -> DataFrame:
    """Records with a hit that starts in a region, with all their hits. Without a region: all records, or none if corrected."""
    if not regions:
        return records if compat.no_region_keeps_all else records.where(F.lit(False))
    return records.where(in_regions(regions))


def filter_region_table(records: DataFrame, regions: DataFrame, key: str = "record_no") -> DataFrame:
    """As ``filter_regions`` for a table ``(ref_name, start, end)`` of any size: an equi-join on the name with a range condition, then a semi-join."""
    starts = explode_hits(records.select(key, "hits")).select(key, "ref_name", "position")
    r = regions.select(F.col("ref_name"), F.col("start").alias("region_start"), F.col("end").alias("region_end")).distinct()
    met = starts.join(r, "ref_name").where((F.col("position") >= F.col("region_start")) & (F.col("position") < F.col("region_end"))).select(key).distinct()
    return records.join(met, key, "left_semi")


def parse_regions(text: str, lengths: dict[str, int], compat: Compat = Compat()) -> tuple[list[tuple[str, int, int]], list[str]]:
    """Half-open regions of ``chr``, ``chr:p`` and ``chr:s-e``, comma-separated, and the parts that are none.

    Starts are clamped to 0 and ends to the reference's length; unknown references, numbers that are none and spans outside
    the reference are returned as refused. ``chr:s-`` runs to the end if corrected.
    """
    good, bad = [], []
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, colon, span = part.rpartition(":") if ":" in part else (part, "", "")
        size = lengths.get(name)
        if size is None:
            bad.append(part)
            continue
        if not colon:
            good.append((name, 0, size))
            continue
        first, dash, last = span.partition("-")
        if dash and not last and not compat.open_region_ignored:
            last = str(size)
        if not first.isdigit() or dash and not last.isdigit():
            bad.append(part)
            continue
        start, end = (int(first), int(last)) if dash else (int(first), int(first) + 1)
        start, end = max(0, start), min(size, end)
        (good.append((name, start, end)) if start < end else bad.append(part))
    return good, bad
