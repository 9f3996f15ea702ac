"""Readers of two-line alignment records and of unmapped reads.

``read_records`` reads whole files and pairs their lines: right for compressed
files and files of up to some hundred MB. ``RecordSource`` (format ``records``)
cuts large plain files into byte ranges; lines are counted first, so that every
range knows whether it begins with a first or a second line.
"""

from __future__ import annotations

import gzip
import io
import os
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import RECORD

#: Bytes of a plain file that one task reads.
RANGE_BYTES = 64 << 20


def record_columns(line1: Column, line2: Column) -> dict[str, Column]:
    """Fields of a pair of lines. Lists are split only if ``multi_count`` isn't 1; the one mismatch count is repeated for every position."""
    a, b = F.split(line1, "\t"), F.split(line2, "\t")
    multi = F.trim(F.get(b, F.lit(4))).cast("int")
    listed = lambda c: F.when(multi != 1, F.split(c, ",")).otherwise(F.array(c))
    places = listed(F.trim(F.get(b, F.lit(3)))).cast("array<bigint>")
    third = F.get(a, F.lit(2))
    return {
        "header": F.get(a, F.lit(0)), "seq": F.get(a, F.lit(1)), "alignment": F.when(F.coalesce(third, F.lit("")) != "", F.split(third, ",")),
        "strands": listed(F.get(b, F.lit(0))), "ref_names": listed(F.get(b, F.lit(1))), "mismatches": F.transform(places, lambda _: F.trim(F.get(b, F.lit(2))).cast("int")), "positions": places, "multi_count": multi,
    }


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(file_name, value)``: the text of the first member of each archive ``(file_name, content)``; an empty archive is an error."""
    for b in batches:
        for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                members = archive.namelist()
                if not members:
                    raise ValueError(f"empty archive: {name}")
                text = archive.read(members[0]).decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([text])], names=["file_name", "value"])


def read_records(spark: SparkSession, paths: str | list[str], stop_at_blank: bool = False) -> DataFrame:
    """Records of text files (plain, ``.gz``, or the first member of a ``.zip``), ``record_no`` being the pair's place in its file.

    Lines pair by parity; a pair with a blank line, with too few fields (2 and 5) or without its second line is skipped, or,
    with ``stop_at_blank``, ends the file at its first blank line. A number that is none is an error; use
    ``sources.rejects`` to set such rows apart.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    zipped, plain = [p for p in listed if p.endswith(".zip")], [p for p in listed if not p.endswith(".zip")]
    texts = []
    if plain:
        texts.append(spark.read.text(plain, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value"))
    if zipped:
        raw = spark.read.format("binaryFile").load(zipped).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")
        texts.append(raw.mapInArrow(_unzipped, "file_name string, value string"))
    whole = texts[0] if len(texts) == 1 else texts[0].unionByName(texts[1])
    files = whole.select("file_name", F.split(F.replace("value", F.lit("\r"), F.lit("")), "\n").alias("l"))
    if stop_at_blank:
        first = F.array_position(F.transform("l", F.trim), "")
        files = files.withColumn("l", F.when(first > 0, F.slice("l", F.lit(1), (first - 1).cast("int"))).otherwise(F.col("l")))
    pairs = files.where(F.size("l") >= 2).select("file_name", "l", F.explode(F.sequence(F.lit(0), F.floor(F.size("l") / 2).cast("int") - 1)).alias("k"))
    lines = pairs.select("file_name", F.col("k").cast("long").alias("record_no"), F.get("l", F.col("k") * 2).alias("line1"), F.get("l", F.col("k") * 2 + 1).alias("line2"))
    return from_lines(lines)


def from_lines(lines: DataFrame) -> DataFrame:
    """Records of ``(file_name, record_no, line1, line2)``; pairs with too few fields or a blank line are skipped."""
    full = (F.trim("line1") != "") & (F.trim("line2") != "") & (F.size(F.split("line1", "\t")) >= 2) & (F.size(F.split("line2", "\t")) >= 5)
    return lines.where(full).select("file_name", "record_no", *[c.alias(n) for n, c in record_columns(F.col("line1"), F.col("line2")).items()])


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, second: bool = False):
        self.path, self.start, self.end, self.second = path, start, end, second


def open_binary(path: str) -> io.BufferedIOBase:
    """A file, the content of a ``.gz``, or the first member of a ``.zip``; an empty zip is an error."""
    if path.endswith(".gz"):
        return gzip.open(path, "rb")
    if path.endswith(".zip"):
        archive = zipfile.ZipFile(path)
        names = archive.namelist()
        if not names:
            raise ValueError(f"empty archive: {path}")
        return io.BufferedReader(archive.open(names[0]))
    return open(path, "rb", buffering=1 << 20)


def _ranges(paths: list[str], size: int) -> list[_Range]:
    out = []
    for path in paths:
        if path.endswith((".gz", ".zip")):
            out.append(_Range(path, 0, 1 << 62))
            continue
        end = os.path.getsize(path)
        out += [_Range(path, a, min(end, a + size)) for a in range(0, end, size)]
    return out


def _breaks(path: str, start: int, end: int) -> int:
    """Line ends in ``[start, end)``."""
    n = 0
    with open(path, "rb", buffering=0) as f:
        f.seek(start)
        while start < end and (block := f.read(min(1 << 20, end - start))):
            n += block.count(b"\n")
            start += len(block)
    return n


def _to_count(ranges: list[_Range]) -> list[tuple[str, int, int]]:
    """The ranges whose line ends the next range of their file has to know."""
    return [(r.path, r.start, r.end) for r, after in zip(ranges, ranges[1:]) if after.start]


def _parities(ranges: list[_Range], counts: list[int]) -> str:
    """For each range 1 if an odd number of lines ends before it, else 0; ``counts`` are those of ``_to_count``."""
    out, n, left = [], 0, iter(counts)
    for r in ranges:
        n = n + next(left) if r.start else 0
        out.append(str(n & 1))
    return "".join(out)


def _pairs(path: str, start: int, end: int, second: bool = False) -> Iterator[tuple[int, str, str]]:
    """``(offset, line1, line2)`` of the records that start in ``[start, end)``.

    ``second``: an odd number of lines ends before ``start``. Lines pair by parity from the start of the file, whatever they hold.
    """
    with open_binary(path) as f:
        if start:
            f.seek(start - 1)
            if f.read(1) != b"\n":
                f.readline()  # the rest of a line that begins before the range
                second = not second
            if second:
                f.readline()
        offset = f.tell()
        while offset < end:
            line1 = f.readline()
            line2 = f.readline()
            if not line1 or not line2:
                return
            yield offset, line1.decode("utf-8", "ignore").rstrip("\r\n"), line2.decode("utf-8", "ignore").rstrip("\r\n")
            offset = f.tell()


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.parities = options.get("parities")

    def partitions(self) -> list[_Range]:
        out = _ranges(self.paths, self.bytes)
        parities = self.parities if self.parities is not None else _parities(out, [_breaks(*x) for x in _to_count(out)])
        if len(parities) != len(out):
            raise ValueError("the files changed since their lines were counted")
        for r, odd in zip(out, parities):
            r.second = odd == "1"
        return out

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        name, rows = os.path.basename(part.path), []
        types = [pa.string(), pa.int64(), pa.string(), pa.string()]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["file_name", "record_no", "line1", "line2"])

        for offset, a, b in _pairs(part.path, part.start, part.end, part.second):
            rows.append((name, offset, a, b))
            if len(rows) == 20_000:
                yield batch()
                rows = []
        if rows:
            yield batch()


class RecordSource(DataSource):
    """Pairs of lines of large files in a file system that all executors see; ``record_no`` is the record's byte offset.

    Without the option ``parities``, which ``read_record_ranges`` has the executors find, lines are counted in one pass before the first task.
    """

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("file_name", T.StringType()), T.StructField("record_no", T.LongType()), T.StructField("line1", T.StringType()), T.StructField("line2", T.StringType())])

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_record_ranges(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``read_records`` in byte ranges of plain files; ``.gz`` and ``.zip`` (first member) files are one range each.

    Files of several ranges are read twice: their lines are counted first, of which one number a range reaches the driver.
    """
    spark.dataSource.register(RecordSource)
    ranges = _ranges(paths, range_bytes)
    todo, sc = _to_count(ranges), spark.sparkContext
    counts = sc.parallelize(todo, min(len(todo), 4 * sc.defaultParallelism)).map(lambda x: _breaks(*x)).collect() if todo else []
    return from_lines(spark.read.format("records").option("path", ",".join(paths)).option("rangebytes", range_bytes).option("parities", _parities(ranges, counts)).load())


def read_unmapped(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(read_id, sequence)``: one read per line; without a tab the whole line is the id and the sequence is empty. Blank lines are skipped."""
    line = F.trim(F.col("value"), F.lit(" \t\r\n"))
    parts = F.split(line, "\t")
    rows = spark.read.text(paths).where(line != "")
    return rows.select(F.get(parts, F.lit(0)).alias("read_id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("sequence"))


def empty_records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RECORD)
