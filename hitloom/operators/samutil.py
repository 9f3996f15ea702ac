"""Utilities on SAM rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.seq import reverse_complement


def _summed(cigar: Column, ops: str) -> Column:
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{ops}]"), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int"))


def aligned_length(cigar: Column) -> Column:
    """Summed lengths of M and I."""
    return _summed(cigar, "MI")


def sam_to_fastq(rows: DataFrame, files: int = 20) -> DataFrame:
    """``(file_no, value)``: reads as sequenced, named ``/1`` and ``/2`` by their flags, dealt to ``files`` files by line number.

    Rows without a sequence are left out; those without qualities give two lines only.
    """
    back = F.col("flag").bitwiseAND(F.lit(16)) != 0
    seq = F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    qual = F.when(back, F.reverse("qual")).otherwise(F.col("qual"))
    mate = F.concat(F.when(F.col("flag").bitwiseAND(F.lit(64)) != 0, "/1").otherwise(""), F.when(F.col("flag").bitwiseAND(F.lit(128)) != 0, "/2").otherwise(""))
    text = F.concat(F.lit("@"), F.col("qname"), mate, F.lit("\n"), seq, F.when(F.col("qual") != "*", F.concat(F.lit("\n+\n"), qual)).otherwise(""))
    return rows.where(F.col("seq") != "*").select(F.pmod("line_no", F.lit(files)).cast("int").alias("file_no"), text.alias("value"))


def alignment_score(match: int = 1, gap_open: int = 5, gap_base: int = 2) -> Column:
    """The AS tag, else matched bases less gap costs; at least 1."""
    tag = F.get(F.filter("tags", lambda t: F.startswith(t, F.lit("AS:i:"))), F.lit(0))
    own = _summed(F.col("cigar"), "M") * match - F.size(F.regexp_extract_all("cigar", F.lit(r"\d+[ID]"), F.lit(0))) * gap_open - _summed(F.col("cigar"), "ID") * gap_base
    score = F.coalesce(F.substring(tag, 6, 20).cast("int"), own)
    return F.greatest(F.lit(1), score)


def best_alignments(rows: DataFrame, factor: float = 250.0, recalibrate: bool = True, multi_only: bool = False) -> DataFrame:
    """One row per read name: the best-scoring one, the first of equals, with its quality by the distance to the second best.

    Only the two best rows of a name pass the exchange, as the rank is limited before it.
    """
    order = Window.partitionBy("qname").orderBy(F.col("score").desc(), "line_no")
    two = rows.withColumn("score", alignment_score()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2)
    fields = F.struct("line_no", "flag", "rname", "pos", "mapq", "cigar", "score")
    best = two.groupBy("qname").agg(F.min_by(fields, "rank").alias("b"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0)).alias("second"), F.count("*").alias("n"))
    quality = F.least(F.lit(250), F.floor(factor * (F.col("b.score") - F.col("second")) / F.col("b.score") + 0.499)).cast("int")
    if not recalibrate:
        quality = F.col("b.mapq")
    elif multi_only:
        quality = F.when(F.col("n") > 1, quality).otherwise(F.col("b.mapq"))
    return best.select("qname", "b.line_no", "b.flag", "b.rname", "b.pos", quality.alias("mapq"), "b.cigar", "b.score")


# Names of the classes of comparison, in order.
CLASSES = ("consistent high high", "consistent high low", "consistent low high", "inconsistent high high", "inconsistent high low", "inconsistent low high", "second missing high", "second missing low", "first missing high", "first missing low")


def compare_alignments(a: DataFrame, b: DataFrame, min_quality: int = 10, max_distance: int = 100) -> DataFrame:
    """``(class, n)``: reads of two sets of SAM rows by whether they lie at the same place and how sure either is.

    Of rows that repeat a name the last one counts. Reads that are unsure in both are in no class.
    """

    def placed(df: DataFrame, name: str) -> DataFrame:
        place = F.struct(F.col("flag").bitwiseAND(F.lit(16)).alias("back"), "rname", "pos", "mapq")
        return df.groupBy("qname").agg(F.max_by(place, "line_no").alias(name))

    both = placed(a, "a").join(placed(b, "b"), "qname", "full")
    same = (F.col("a.back") == F.col("b.back")) & (F.col("a.rname") == F.col("b.rname")) & (F.abs(F.col("a.pos") - F.col("b.pos")) < max_distance)
    sure = lambda x: F.col(f"{x}.mapq") >= min_quality
    level = F.when(sure("a") & sure("b"), "high high").when(sure("a"), "high low").when(sure("b"), "low high")
    name = (
        F.when(F.col("b").isNull(), F.when(sure("a"), "second missing high").otherwise("second missing low")).when(F.col("a").isNull(), F.when(sure("b"), "first missing high").otherwise("first missing low"))
        .otherwise(F.concat(F.when(same, "consistent ").otherwise("inconsistent "), level))
    )
    counted = both.select(name.alias("class")).where(F.col("class").isNotNull()).groupBy("class").agg(F.count("*").alias("n"))
    every = a.sparkSession.createDataFrame([(c,) for c in CLASSES], "class string")
    return every.join(counted, "class", "left").fillna(0, ["n"])
