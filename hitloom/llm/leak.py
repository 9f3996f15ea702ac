"""Held-out test passages inside documents: Wu-Manber search over words.

The patterns are all runs of ``m`` consecutive words of the test items. A block
is two words. The shift table tells for a block how far the window may move
without skipping a pattern, so most of a text is never looked at; where the shift
is 0, the hash of the window selects, in the bucket of the block, the patterns
that are compared directly. Patterns are kept as places in the items' words, so
an item costs memory in proportion to its words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import spread
from .mailtext import _WORD, words

#: Characters of test items whose patterns go to the tasks at once (some 100 MB in a worker); more are searched block by block.
BLOCK_CHARS = 4 << 20


class WuManber:
    """Search for all runs of ``length`` words of the items ``(id, text)``."""

    def __init__(self, items: Iterable[tuple], length: int):
        self.length, self.jump = length, length - 1
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], dict[int, list[tuple[int, int]]]] = defaultdict(dict)
        self.ids, self.words = [], []
        for item, text in items:
            w = _WORD.findall((text or "").lower())
            n = len(w) - length + 1
            if n <= 0:
                continue
            k = len(self.ids)
            self.ids.append(item)
            self.words.append(w)
            for i in range(1, len(w)):
                # The block ends at place i. Of the patterns that hold it, the one in which it comes latest moves the window least.
                block = w[i - 1], w[i]
                self.shift[block] = min(self.shift.get(block, self.jump), max(0, length - 1 - i))
                if i >= length - 1:
                    start = i - length + 1
                    self.bucket[block].setdefault(hash(tuple(w[start : i + 1])), []).append((k, start))

    def search(self, text: list[str]) -> set:
        """Ids of all items of which a pattern occurs in ``text``."""
        found, shift, jump, m, n = set(), self.shift.get, self.jump, self.length, len(text)
        i = m - 1
        while i < n:
            block = text[i - 1], text[i]
            if step := shift(block, jump):
                i += step
                continue
            window = text[i - m + 1 : i + 1]
            for k, start in self.bucket[block].get(hash(tuple(window)), ()):
                if self.words[k][start : start + m] == window:
                    found.add(self.ids[k])
            i += 1
        return found


_built: dict[int, WuManber] = {}


def _matcher(held, length: int) -> WuManber:
    """One matcher per worker process and block of items."""
    key = hash((tuple(held.value), length))
    if key not in _built:
        if len(_built) > 4:
            _built.clear()
        _built[key] = WuManber(held.value, length)
    return _built[key]


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple]]:
    """The rows of ``items(id, text)`` in blocks of ``size`` characters or one item."""
    block, held = [], 0
    for row in items.toLocalIterator():
        if block and held + len(row[1]) > size:
            yield block
            block, held = [], 0
        block.append(tuple(row))
        held += len(row[1])
    if block:
        yield block


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", length: int = 12) -> DataFrame:
    """``(doc_id, item_id)``: documents that hold at least ``length`` consecutive words of an item, and the items they hold.

    Case, punctuation, line breaks, reply marks and markup between words don't count; encoded text parts count as decoded.
    Null and empty texts hold nothing; items of fewer than ``length`` words (or null) are in no document; a passage that is
    part of several items gives each of them. Repeated documents give one row per id and item.

    Items come to the driver in blocks of ``BLOCK_CHARS``; each block costs one scan of the documents.
    """
    spark = docs.sparkSession
    docs = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull()))
    wanted = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    kind = wanted.schema["i"].dataType
    item_type = to_arrow_type(kind)

    def scan(block: list[tuple]) -> DataFrame:
        held = spark.sparkContext.broadcast(block)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(held, length)
            for b in batches:
                ids, found = [], []
                for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for item in matcher.search(words(t)):
                        ids.append(doc)
                        found.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(found, item_type)], names=["doc_id", "item_id"])

        return docs.mapInArrow(task, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {kind.simpleString()}")

    out = None
    for block in _blocks(wanted, BLOCK_CHARS):
        out = scan(block) if out is None else out.unionByName(scan(block))
    return (scan([]) if out is None else out).distinct()
