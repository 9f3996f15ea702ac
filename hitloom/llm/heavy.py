"""Most frequent values of a column with very many distinct ones, in bounded memory.

Values travel as 64-bit hashes with counts. Each task first adds up equal hashes
of a few hundred thousand rows, so a value that fills a third of the table costs
a handful of rows per task; the hashes are then partitioned, and every partition
keeps a count-min sketch with conservative update and a bounded heap of the
heaviest hashes. A hash lives in one partition, so the heaps are disjoint and
their union is their merge.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose equal hashes are added up before the shuffle, and hashes that one sketch update takes at once.
BATCH = 1 << 18
#: Parts that hashes are numbered by, many to a task, so that those of one task can be taken again.
PARTS = 1 << 16


def _add_up(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(hashes, return_inverse=True)
    return values, np.bincount(at, weights=counts, minlength=len(values)).astype(np.int64)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal hashes of each ``BATCH`` rows as one row."""
    held: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        h = np.concatenate(held)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _add_up(h, np.ones(len(h)))], names=["h", "n"])

    for b in batches:
        if b.num_rows:
            held.append(b.column(0).to_numpy(zero_copy_only=False))
            size += b.num_rows
        if size >= BATCH:
            yield out()
            held, size = [], 0
    if size:
        yield out()


class CountMin:
    """Count-min sketch of weighted 64-bit hashes with conservative update. Estimates are never below the true count."""

    def __init__(self, width: int, depth: int = 4):
        self.width, self.table = width, np.zeros((depth, width), dtype=np.int64)
        rng = np.random.default_rng(20310101)
        self.mult = rng.integers(1, 2**63, size=depth, dtype=np.uint64) | np.uint64(1)

    def _cells(self, hashes: np.ndarray) -> list[np.ndarray]:
        u = hashes.astype(np.int64).view(np.uint64)
        return [((u * m) >> np.uint64(33)) % np.uint64(self.width) for m in self.mult]

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Adds distinct ``hashes``; returns their new estimates.

        Only cells below an item's new estimate are raised, and only up to it. Estimates are taken before the batch is added,
        so items of one batch that share cells are overestimated a little more than if added one by one, never underestimated.
        """
        cells = self._cells(hashes)
        est = np.minimum.reduce([row[c] for row, c in zip(self.table, cells)]) + counts
        for row, c in zip(self.table, cells):
            np.maximum.at(row, c, est)
        return est

    def estimate(self, hashes: np.ndarray) -> np.ndarray:
        return np.minimum.reduce([row[c] for row, c in zip(self.table, self._cells(hashes))])


def sketch_stream(batches: Iterator[tuple[np.ndarray, np.ndarray]], least: int, width: int, capacity: int) -> tuple[dict[int, int], int]:
    """Heap of at most ``capacity`` hashes with an estimate of at least ``least``, and the largest estimate that was pushed out (0: none)."""
    sketch, kept, lost = CountMin(width), {}, 0
    for hashes, counts in batches:
        est = sketch.add(hashes, counts)
        for i in np.flatnonzero(est >= least):
            kept[int(hashes[i])] = int(est[i])
        if len(kept) > capacity:
            ranked = heapq.nlargest(capacity + 1, kept.items(), key=lambda x: x[1])
            lost = max(lost, ranked[-1][1])
            kept = dict(ranked[:-1])
    return kept, lost


def heavy_hitters(df: DataFrame, value: Column, share: float, width: int = 1 << 16, capacity: int | None = None) -> DataFrame:
    """``(value, n)``: the values that make up at least ``share`` of all rows of ``df``, with exact counts.

    Null values are no candidates but count as rows. Ties at the threshold are kept. An empty table gives an empty result.

    Memory: per task a sketch of ``4 * width`` counters and a heap of ``capacity`` hashes (default ``8 / share``). No more than
    ``1 / share`` values can reach the threshold, so the heaps together, and the table of candidates that is broadcast for
    the exact count, stay small for any input. A heap that had to push out a hash that might reach the threshold tells that
    its sketch is too narrow for its stream: the hashes of that task alone are taken again, with both four times as large,
    until nothing is pushed out. The exact count is always one of candidates only.
    """
    total = df.count()
    values = df.select(value.alias("value")).where(F.col("value").isNotNull())
    empty = values.groupBy("value").agg(F.count("*").alias("n")).where(F.lit(False))
    if not total:
        return empty
    least = max(1, int(np.ceil(share * total - 1e-9)))
    room = capacity or int(8 / share)
    spark = df.sparkSession
    partial = values.select(F.xxhash64("value").alias("h")).mapInArrow(_partial, "h long, n long").withColumn("part", F.pmod("h", F.lit(PARTS)).cast("int"))

    def heaps(width: int, room: int):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: set[int] = set()

            def grouped() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                held, size = [], 0
                for b in batches:
                    parts.update(np.unique(b.column(2).to_numpy(zero_copy_only=False)).tolist())
                    held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)))
                    size += b.num_rows
                    if size >= BATCH:
                        yield _add_up(*map(np.concatenate, zip(*held)))
                        held, size = [], 0
                if size:
                    yield _add_up(*map(np.concatenate, zip(*held)))

            kept, lost = sketch_stream(grouped(), least, width, room)
            again = sorted(parts) if lost >= least else []
            columns = [pa.array([*kept, *[None] * len(again)], pa.int64()), pa.array([*[None] * len(kept), *again], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "again"])

        return task

    candidates, rows = set(), partial
    while True:
        # At most `room` hashes of each task, a few in practice, and the numbers of parts to take again.
        found = rows.repartition("part").mapInArrow(heaps(width, room), "h long, again int").collect()
        candidates |= {r.h for r in found if r.h is not None}
        again = sorted({r.again for r in found if r.again is not None})
        if not again:
            break
        width, room = width * 4, room * 4
        rows = partial.join(F.broadcast(spark.createDataFrame([(p,) for p in again], "part int")), "part", "left_semi").select("h", "n", "part")
    if not candidates:
        return empty
    table = spark.createDataFrame([(h,) for h in sorted(candidates)], "h long")
    exact = values.withColumn("h", F.xxhash64("value")).join(F.broadcast(table), "h", "left_semi")
    return exact.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") >= least)
