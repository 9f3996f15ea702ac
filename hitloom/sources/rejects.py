"""Loading two-line records while setting apart the ones that break the format.

Each record is parsed by Python's strict ``csv`` reader, one partition at a time
in Arrow batches; a structural exception of the reader, a wrong number of fields
or a field that its typed constructor refuses gives the reason of the failure,
and parsing goes on with the next record.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Written

RECORD = T.StructType(
    [
        T.StructField("header", T.StringType()),
        T.StructField("seq", T.StringType()),
        T.StructField("alignment", T.ArrayType(T.StringType())),
        T.StructField("strands", T.ArrayType(T.StringType())),
        T.StructField("ref_names", T.ArrayType(T.StringType())),
        T.StructField("mismatches", T.ArrayType(T.LongType())),
        T.StructField("positions", T.ArrayType(T.LongType())),
        T.StructField("multi_count", T.LongType()),
        T.StructField("reason", T.StringType()),
    ]
)
_ARROW = pa.struct(
    [
        ("header", pa.string()), ("seq", pa.string()), ("alignment", pa.list_(pa.string())), ("strands", pa.list_(pa.string())), ("ref_names", pa.list_(pa.string())),
        ("mismatches", pa.list_(pa.int64())), ("positions", pa.list_(pa.int64())), ("multi_count", pa.int64()), ("reason", pa.string()),
    ]
)

QUOTING, COLUMN_COUNT, VALUE = "quoting", "column_count", "value"
_BASES = re.compile(r"[ACGTNacgtn]+")
_DIGITS = re.compile(r"[0-9]+")
_FIRST_QUOTE = re.compile(r'(?:[^"]++|"")*+"')
_ALIGNED = re.compile(r"[.x\-*ACGTN]*")


class Refused(ValueError):
    """A field that its constructor doesn't take."""


class LineParser:
    """Strict tab-separated fields of one logical line; raises ``csv.Error`` on broken quoting."""

    def __init__(self) -> None:
        csv.field_size_limit(sys.maxsize)
        self.dialect = {"delimiter": "\t", "quotechar": '"', "doublequote": True, "strict": True}

    def __call__(self, line: str | None) -> list[str]:
        if line is None:
            return []
        line = line.rstrip("\r\n")
        if "\r" not in line and "\n" not in line:
            # A field left open asks for a second line; there is none, so the reader reports the end of data.
            return next(csv.reader([line], **self.dialect), [])
        # The reader takes a break inside a field for the end of the line, though here it is content, so two characters
        # that the line doesn't hold stand for it.
        stands = [c for c in map(chr, range(0xE000, 0xE000 + len(line) + 2)) if c not in line][:2]
        fields = next(csv.reader([line.replace("\r", stands[0]).replace("\n", stands[1])], **self.dialect), [])
        return [f.replace(stands[0], "\r").replace(stands[1], "\n") for f in fields]


def _number(text: str, least: int = 0) -> int:
    """A number of digits only; those too long to be counted with come out as a very large one."""
    if not _DIGITS.fullmatch(text):
        raise Refused(text)
    digits = text.lstrip("0")
    n = int(digits or "0") if len(digits) < 100 else 1 << 300
    if n < least:
        raise Refused(text)
    return n


def _below_2_63(text: str) -> int:
    if (n := _number(text)) >= 1 << 63:
        raise Refused(text)
    return n


def typed(head: list[str], hits: list[str]) -> tuple:
    """The fields of ``RECORD`` but for the reason; raises ``Refused``."""
    header, seq, alignment = head[0], head[1], head[2] if len(head) == 3 else ""
    if not header.strip() or not _BASES.fullmatch(seq):
        raise Refused(header)
    strands, names, places = hits[0].split(","), hits[1].split(","), hits[3].split(",")
    if any(s not in ("F", "R") for s in strands) or any(not n.strip() for n in names):
        raise Refused(hits[0])
    mismatches, positions = _below_2_63(hits[2]), [_below_2_63(x) for x in places]
    multi = _number(hits[4], 1)
    if not len(strands) == len(names) == len(positions):
        raise Refused(hits[1])
    aligned = None
    if alignment:
        aligned = alignment.split(",")
        if len(aligned) != len(names) or any(not _ALIGNED.fullmatch(a) or len(a) - a.count("-") != len(seq) for a in aligned):
            raise Refused(alignment)
    return header, seq, aligned, strands, names, [mismatches] * len(positions), positions, min(multi, (1 << 63) - 1)


def parse_pair(parse: LineParser, head: str | None, hits: str | None) -> tuple:
    """The fields of ``RECORD``; where the reason isn't null, the others are."""
    try:
        a, b = parse(head), parse(hits)
    except csv.Error:
        return (*[None] * 8, QUOTING)
    if len(a) not in (2, 3) or len(b) != 5:
        return (*[None] * 8, COLUMN_COUNT)
    try:
        return (*typed(a, b), None)
    except Refused:
        return (*[None] * 8, VALUE)


def parse_records(df: DataFrame, key: str, head: str = "rec_head", hits: str = "rec_hits", keep: bool = False) -> DataFrame:
    """``(key, header, seq, alignment, strands, ref_names, mismatches, positions, multi_count, reason)``, one row per row of ``df``.

    ``reason`` is null for a valid record, else the first that applies of ``quoting``, ``column_count`` and ``value``, with
    all other fields null. A null line has no fields. A carriage return at line end is no content. The one mismatch count of a record
    is repeated for every hit. Repeated rows are parsed each for itself; other columns of ``df`` are ignored; an empty table
    gives an empty result. A ``multi_count`` beyond 64 bits is valid and comes out as the largest long. With ``keep`` the two
    lines follow as they came.
    """
    kept = [head, hits] if keep else []

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = LineParser()
        for b in batches:
            rows = [parse_pair(parse, x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            columns = [pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)] if rows else [pa.array([], t.type) for t in _ARROW]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, *b.columns[1 : 1 + len(kept)]], names=[key, *(t.name for t in _ARROW), *kept])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *RECORD.fields, *(df.schema[c] for c in kept)])
    return df.select(key, head, hits).mapInArrow(task, schema)


def split_rejects(df: DataFrame, key: str, head: str = "rec_head", hits: str = "rec_hits") -> tuple[DataFrame, DataFrame]:
    """``(valid, rejects)``: the records, and ``(key, reason)`` with the two lines as they came. Every row of ``df`` is in exactly one of them.

    Keys may be null or repeat: lines travel with their row, and nothing is joined. Rows are parsed once, into a table in
    the shared checkpoint folder from which both are read.
    """
    parsed = Written(parse_records(df, key, head, hits, keep=True)).df
    return parsed.where(F.col("reason").isNull()).drop("reason", head, hits), parsed.where(F.col("reason").isNotNull()).select(key, "reason", head, hits)


def logical_lines(text: str) -> Iterator[str]:
    """Lines of a file, where a break inside a quoted field is part of it.

    A field is quoted if its first character is a quote; a quoted field that no later line closes ends with its first line,
    so that one broken row doesn't swallow the rest of the file; nor does a quote close it that opens a field of its own.
    A field may go on over any number of lines.
    """
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    # What a line does depends only on whether it begins inside a field, so the ends are found from the last line back:
    # the line with which the logical line ends that is inside a field at the start of line i; none if it never closes.
    n = len(lines)
    ends = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        if '"' not in lines[i]:
            ends[i] = ends[i + 1]
        elif not _opens_anew(lines[i]):
            ends[i] = ends[i + 1] if _open_field(lines[i], True) else i
    i = 0
    while i < n:
        j = ends[i + 1] if _open_field(lines[i]) else i
        if j == n:
            j = i
        yield lines[i] if i == j else "\n".join(lines[i : j + 1])
        i = j + 1


def _opens_anew(line: str) -> bool:
    """Whether the first single quote of ``line`` stands where a field begins and text follows it."""
    if not (m := _FIRST_QUOTE.match(line)):
        return False
    j = m.end() - 1
    return (j == 0 or line[j - 1] == "\t") and line[j + 1 : j + 2] not in ("", "\t", "\r")


def _open_field(line: str, inside: bool = False) -> bool:
    """Whether ``line`` ends inside a quoted field; ``inside``: it begins in one."""
    i, n = 0, len(line)
    while i <= n:
        if inside or i < n and line[i] == '"':
            i += not inside
            inside = False
            while True:
                j = line.find('"', i)
                if j < 0:
                    return True
                if line[j + 1 : j + 2] == '"':
                    i = j + 2
                    continue
                i = j + 1
                break
        j = line.find("\t", i)
        if j < 0:
            return False
        i = j + 1
    return False


def load_text(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejects)`` of two-line text files. ``rejects`` has ``file_name, record_no, reason, rec_head, rec_hits``.

    Lines are assembled quote-aware, one file per task, as what a quote opens may end anywhere in the file; blank lines are
    skipped; an odd line at the end of a file is a record without a second line. Files are parsed once, into a table in the
    shared checkpoint folder from which both are read.
    """
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = LineParser()
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines = [x for x in logical_lines(text or "") if x.strip("\r")]
                for at in range(0, len(lines), 40_000):
                    pairs = [(lines[i], lines[i + 1] if i + 1 < len(lines) else None) for i in range(at, min(at + 40_000, len(lines)), 2)]
                    rows = [(name, at // 2 + k, x, y, *parse_pair(parse, x, y)) for k, (x, y) in enumerate(pairs)]
                    types = [pa.string(), pa.int64(), pa.string(), pa.string(), *(t.type for t in _ARROW)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["file_name", "record_no", "rec_head", "rec_hits", *(t.name for t in _ARROW)])

    schema = T.StructType([T.StructField("file_name", T.StringType()), T.StructField("record_no", T.LongType()), T.StructField("rec_head", T.StringType()), T.StructField("rec_hits", T.StringType()), *RECORD.fields])
    parsed = Written(files.mapInArrow(task, schema)).df
    valid = parsed.where(F.col("reason").isNull()).drop("reason", "rec_head", "rec_hits")
    return valid, parsed.where(F.col("reason").isNotNull()).select("file_name", "record_no", "reason", "rec_head", "rec_hits")
