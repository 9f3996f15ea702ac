"""Bases of all hits over each reference position.

References are cut into tiles. A hit goes once to each tile it touches, with the
bases that lie there; the columns of a tile are put together from Arrow batches
as a whole, so there is never a row per base, and no position carries more of
its reference than its tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..compat import Compat
from ..functions.seq import reverse_complement
from .hits import explode_hits

#: Positions of a tile. All bases of a tile meet in one row, so a tile is small; the most covered reference is spread over many.
TILE = 64


def _placed_hits(records: DataFrame, references: DataFrame) -> DataFrame:
    """Hits with a sequence and a position from 0 on known references, with ``ref_length``."""
    return explode_hits(records).where(F.col("seq").isNotNull() & (F.col("position") >= 0)).join(references.select("ref_name", "ref_length"), "ref_name")


def tiled_hits(records: DataFrame, references: DataFrame, compat: Compat = Compat()) -> DataFrame:
    """``(ref_name, tile, at, record_no, hit_idx, bases)``: the bases of each hit in each tile it touches, from place ``at`` of the tile on. Hits end with their reference."""
    hits = _placed_hits(records, references)
    letters = F.col("seq") if compat.pileup_as_sequenced else F.when(F.col("strand") == "R", reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    end = F.least(F.col("position") + F.length("seq"), F.col("ref_length").cast("long"))
    cut = hits.select("ref_name", "position", "record_no", "hit_idx", letters.alias("b"), end.alias("end")).where(F.col("end") > F.col("position"))
    cut = cut.select("*", F.explode(F.sequence(F.expr(f"position div {TILE}"), F.expr(f"(end - 1) div {TILE}"))).alias("tile"))
    low, high = F.greatest("position", F.col("tile") * TILE), F.least("end", (F.col("tile") + 1) * TILE)
    part = F.substring("b", (low - F.col("position") + 1).cast("int"), (high - low).cast("int"))
    return cut.select("ref_name", "tile", (low - F.col("tile") * TILE).cast("int").alias("at"), "record_no", "hit_idx", part.alias("bases"))


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(ref_name, tile, part, cells)`` of sorted rows ``(ref_name, tile, at, bases)``: the column of each position, in the order of the rows. A tile that goes on in the next batch goes on in another part."""
    for part, b in enumerate(batches):
        if not b.num_rows:
            continue
        names, tiles = b.column(0).to_pylist(), b.column(1).to_pylist()
        group, firsts = np.zeros(len(names), np.int64), [0]
        for i in range(1, len(names)):
            if tiles[i] != tiles[i - 1] or names[i] != names[i - 1]:
                firsts.append(i)
            group[i] = len(firsts) - 1
        rows = b.column(3).to_pylist()
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        letters = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
        before = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        cell = np.repeat(group * TILE + b.column(2).to_numpy() - before, lengths) + np.arange(len(letters))
        text = letters[np.argsort(cell, kind="stable")].tobytes().decode("utf-32-le")
        ends = np.cumsum(np.bincount(cell, minlength=len(firsts) * TILE)).tolist()
        cells = [text[a:z] for a, z in zip([0, *ends], ends)]
        listed = pa.ListArray.from_arrays(pa.array(range(0, len(cells) + 1, TILE), pa.int32()), pa.array(cells, pa.string()))
        columns = [pa.array([names[i] for i in firsts]), pa.array([tiles[i] for i in firsts], pa.int64()), pa.array([part] * len(firsts), pa.int32()), listed]
        yield pa.RecordBatch.from_arrays(columns, names=["ref_name", "tile", "part", "cells"])


def _reference_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(ref_name, tile, size, letters)`` of ``(ref_name, ref_length, seq)``; without a sequence letters are null."""
    for b in batches:
        for name, n, seq in zip(*(c.to_pylist() for c in b.columns)):
            for at in range(0, n or 0, TILE << 12):
                starts = range(at, min(n, at + (TILE << 12)), TILE)
                letters = [None if seq is None else seq[i : i + TILE] for i in starts]
                columns = [pa.array([name] * len(starts), pa.string()), pa.array([i // TILE for i in starts], pa.int64()), pa.array([min(TILE, n - i) for i in starts], pa.int32()), pa.array(letters, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["ref_name", "tile", "size", "letters"])


def depth(records: DataFrame, references: DataFrame) -> DataFrame:
    """``(ref_name, pos, depth)`` without placing single bases: each hit adds 1 where it starts and takes 1 where it ends.

    Changes are summed map-side by position, so a deep position costs one row per task.
    """
    hits = _placed_hits(records, references)
    end = F.least(F.col("position") + F.length("seq"), F.col("ref_length").cast("long"))
    ends = F.array(F.struct(F.col("position").alias("pos"), F.lit(1).alias("d")), F.struct(end.alias("pos"), F.lit(-1).alias("d")))
    change = hits.where(end > F.col("position")).select("ref_name", F.explode(ends).alias("x")).groupBy("ref_name", "x.pos").agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy("ref_name").orderBy("pos")
    steps = change.select("ref_name", "pos", F.sum("d").over(w).alias("depth"), F.lead("pos").over(w).alias("to")).where(F.col("depth") > 0)
    return steps.select("ref_name", F.explode(F.sequence("pos", F.col("to") - 1)).alias("pos"), "depth")


def pileup(records: DataFrame, references: DataFrame, min_depth: int = 0, base_quality: int = 30, compat: Compat = Compat()) -> DataFrame:
    """``(ref_name, pos, ref_base, depth, bases, quals)``, positions from 1, bases in the order of records and hits.

    Read and reference are walked together from the hit's start to the end of the reference; hits on unknown references are
    left out; every hit counts, also of multi-mapped reads. With ``min_depth`` 0 every position of every reference is there,
    also uncovered ones. ``references``: ``(ref_name, ref_length)``, unique names, and perhaps ``seq``, else bases are ``N``.
    """
    hits = tiled_hits(records, references, compat).repartition("ref_name", "tile").sortWithinPartitions("ref_name", "tile", "record_no", "hit_idx")
    parts = hits.select("ref_name", "tile", "at", "bases").mapInArrow(_columns, "ref_name string, tile long, part int, cells array<string>")
    tiles = parts.groupBy("ref_name", "tile").agg(F.array_sort(F.collect_list(F.struct("part", "cells"))).alias("parts"))
    joined = F.transform(F.sequence(F.lit(0), F.lit(TILE - 1)), lambda i: F.array_join(F.transform("parts", lambda p: F.get(p["cells"], i)), ""))
    none = F.array_repeat(F.lit(""), TILE)
    cells = F.when(F.col("parts").isNull(), none).when(F.size("parts") == 1, F.col("parts")[0]["cells"]).otherwise(joined)
    seq = F.col("seq") if "seq" in references.columns else F.lit(None).cast("string").alias("seq")
    refs = references.select("ref_name", F.col("ref_length").cast("long").alias("ref_length"), seq).mapInArrow(_reference_tiles, "ref_name string, tile long, size int, letters string")
    every = refs.join(tiles, ["ref_name", "tile"], "left" if min_depth <= 0 else "inner")
    rows = every.select("ref_name", "tile", "letters", F.posexplode(F.slice(cells, F.lit(1), F.col("size"))).alias("i", "bases"))
    rows = rows.where(F.length("bases") >= min_depth)
    base = F.coalesce(F.upper(F.substring("letters", F.col("i") + 1, F.lit(1))), F.lit("N"))
    quals = F.repeat(F.lit(chr(base_quality + 33)), F.length("bases"))
    return rows.select("ref_name", (F.col("tile") * TILE + F.col("i") + 1).alias("pos"), base.alias("ref_base"), F.length("bases").alias("depth"), "bases", quals.alias("quals"))
