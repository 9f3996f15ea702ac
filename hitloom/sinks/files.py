"""Single files with a fixed name, written by Spark and then moved into place."""

from __future__ import annotations

import contextlib
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.count import BY


def _fs(df: DataFrame, path: str):
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())


def _place(df: DataFrame, folder: str, path: str) -> None:
    """Move the one part file of ``folder`` to ``path``, through the file system of the path, so that any store works."""
    jvm, target, fs = _fs(df, path)
    part = next(s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)) if s.getPath().getName().startswith("part-"))
    fs.delete(target, False)
    fs.rename(part, target)
    fs.delete(jvm.org.apache.hadoop.fs.Path(folder), True)


def write_single_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, order: Sequence[str] = ()) -> None:
    """One CSV file; rows sorted by ``order``. For results of a size one task can write, such as counts per gene."""
    folder = path + ".parts"
    rows = df.orderBy(*order) if order else df
    rows.coalesce(1).write.mode("overwrite").option("header", header).option("sep", sep).option("emptyValue", "").csv(folder)
    _place(df, folder, path)


def write_single_text(lines: DataFrame, path: str, order: str | None = None) -> None:
    """One text file of the column ``value``."""
    folder = path + ".parts"
    rows = lines.orderBy(order) if order else lines
    rows.select("value").coalesce(1).write.mode("overwrite").text(folder)
    _place(lines, folder, path)


def write_parts(lines: DataFrame, folder: str) -> None:
    """Text in as many part files as the data has partitions: the way to write large SAM, BED or FASTQ results."""
    lines.select("value").write.mode("overwrite").text(folder)


def write_per_sample(df: DataFrame, folder: str, suffix: str, sep: str = ",", by: str = BY) -> None:
    """One folder per sample (``sample_id=...``), written in one pass over the data."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).option("header", True).option("sep", sep).csv(f"{folder}/{suffix}")


def write_text_per_sample(lines: DataFrame, folder: str, suffix: str, by: str = BY) -> None:
    """One folder per sample with a text file of the column ``value`` in the order of ``line_no``. For short reports."""
    lines.repartition(by).sortWithinPartitions(by, "line_no").select(by, "value").write.mode("overwrite").partitionBy(by).text(f"{folder}/{suffix}")


def missing_outputs(df: DataFrame, outputs: dict[str, str]) -> list[str]:
    """Keys of ``outputs`` whose path isn't there yet: what a resumed run has to do. A folder counts once its success mark is written."""
    out = []
    for key, path in outputs.items():
        jvm, p, fs = _fs(df, path)
        done = False
        with contextlib.suppress(Exception):
            done = fs.exists(p) and (fs.getFileStatus(p).isFile() or fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
        if not done:
            out.append(key)
    return out
