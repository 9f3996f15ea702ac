"""Counting records as files arrive.

Counts by combination are a streaming aggregation; what needs the weights of all
unique reads (the rescue of multi-mapped ones) runs on its result per batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import count
from ..session import checkpoint_dir
from ..sources.records import from_lines


def stream_records(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Records of files that appear in ``folder``; a file is taken as a whole, once."""
    files = spark.readStream.option("wholetext", True).option("pathGlobFilter", pattern).format("text").load(folder)
    lines = files.select(F.col("_metadata.file_name").alias("file_name"), F.split(F.replace("value", F.lit("\r"), F.lit("")), "\n").alias("l"))
    pairs = lines.where(F.size("l") >= 2).select("file_name", "l", F.explode(F.sequence(F.lit(0), F.floor(F.size("l") / 2).cast("int") - 1)).alias("k"))
    return from_lines(pairs.select("file_name", F.col("k").cast("long").alias("record_no"), F.get("l", F.col("k") * 2).alias("line1"), F.get("l", F.col("k") * 2 + 1).alias("line2")))


def count_stream(records: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str | None = None, once: bool = True) -> StreamingQuery:
    """Hands all combination counts so far, ``(sample_id, ids, n)``, to ``sink`` after every batch; the sample is the file.

    The state holds one row per combination. ``checkpoint`` is a folder that all executors share; by default one in the
    session's checkpoint folder, so a restarted query goes on where it stopped.
    """
    combos = count.combinations(records, by="file_name")
    query = combos.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", checkpoint or f"{checkpoint_dir(records.sparkSession)}/count_stream")
    return (query.trigger(availableNow=True) if once else query).start()


def final_em_sink(lengths: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes the abundance-weighted final counts of all files so far."""

    def write(combos: DataFrame, _: int) -> None:
        combos.persist()
        try:
            count.final_em(combos, lengths).write.mode("overwrite").parquet(path)
        finally:
            combos.unpersist()

    return write


def windowed_loads(records: DataFrame, time: str = "run_at", window: str = "1 day", delay: str = "30 days") -> DataFrame:
    """Records per sample and window of ``time``, from a stream: rows later than ``delay`` behind the latest are left out."""
    stamped = records.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return stamped.groupBy(F.window(time, window), "sample_id").agg(F.count("*").alias("n"))
