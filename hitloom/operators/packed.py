"""Several values packed in one field: one row per value, with its place in the list.

A field is covered by arcs: known whole values, found by a multi-pattern
automaton; quoted literals; runs of value characters; and separators. Dynamic
programming picks the cover of least cost, so a known value keeps delimiters it
legitimately holds, and a quote that nothing closes counts as a separator
instead of swallowing the rest of the field.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE_CHARS = "A-Za-z0-9._:\\-"
BRACKETS = {"(": ")", "[": "]", "{": "}"}
#: Cost of an arc. A known value is cheaper than the plain run, which is cheaper than a stray quote.
KNOWN, QUOTED, RUN, SEPARATOR, STRAY = 1, 2, 2, 0, 1000
#: The dictionary goes to every task; beyond this many values it is refused (a million names take about 100 MB).
MAX_DICTIONARY = 1_000_000

_RUN = re.compile(f"[{VALUE_CHARS}]+")
_VALUE_CHAR = re.compile(f"[{VALUE_CHARS}]")
_QUOTED = {q: re.compile(f"{q}((?:[^{q}]|{q}{q})*){q}(?!{q})", re.DOTALL) for q in "\"'"}


class Segmenter:
    """Splits packed strings. ``dictionary``: known whole values; those with delimiters inside are kept whole."""

    def __init__(self, dictionary: Sequence[str] = ()):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for value in dictionary:
            if value and value == value.strip():
                self.automaton.add_word(value, len(value))
        self.known = len(self.automaton) > 0
        if self.known:
            self.automaton.make_automaton()

    def _known(self, s: str) -> dict[int, list[int]]:
        """Ends of the known values by their start; only those that don't begin or end inside a run."""
        found: dict[int, list[int]] = {}
        if self.known:
            n = len(s)
            for last, length in self.automaton.iter(s):
                i, j = last + 1 - length, last + 1
                if (i == 0 or not _VALUE_CHAR.match(s, i - 1)) and (j == n or not _VALUE_CHAR.match(s, j)):
                    found.setdefault(i, []).append(j)
        return found

    def cover(self, s: str) -> list[tuple[int, int, str | None]]:
        """The arcs ``(start, end, value)`` of the cheapest cover; separators have no value. Of equal covers, the one with the longer last arcs."""
        known, n = self._known(s), len(s)
        cost: list[int | None] = [None] * (n + 1)
        via: list[tuple[int, str | None] | None] = [None] * (n + 1)
        cost[0] = 0
        for i in range(n):
            if (c := cost[i]) is None:
                continue
            arcs: list[tuple[int, int, str | None]] = [(j, KNOWN, s[i:j]) for j in known.get(i, ())]
            ch = s[i]
            if m := _RUN.match(s, i):
                arcs.append((m.end(), RUN, m[0]))
            elif ch in _QUOTED:
                if m := _QUOTED[ch].match(s, i):
                    arcs.append((m.end(), QUOTED, m[1].replace(ch * 2, ch)))
                arcs.append((i + 1, STRAY, None))
            else:
                arcs.append((i + 1, SEPARATOR, None))
            for j, more, value in arcs:
                if cost[j] is None or c + more < cost[j]:
                    cost[j], via[j] = c + more, (i, value)
        out, j = [], n
        while j:
            i, value = via[j]
            out.append((i, j, value))
            j = i
        return out[::-1]

    def split(self, s: str | None) -> list[tuple[int, str]]:
        """``(place, value)`` of every value. Places count from 0 and empty entries between two separating signs take one."""
        if s is None or not (s := s.strip()):
            return []
        if BRACKETS.get(s[0]) == s[-1] and len(s) > 1:
            s = s[1:-1]
        out, place, signs = [], -1, 0
        for i, _, value in self.cover(s):
            if value is None:
                signs += not s[i].isspace()
            else:
                # Before the first value, each sign closes an empty entry; between two values, one sign or blank parts them.
                place += max(signs, 1) if place >= 0 else 1 + signs
                if value.strip():
                    out.append((place, value))
                signs = 0
        return out


_built: dict[int, Segmenter] = {}


def _segmenter(words: tuple[str, ...]) -> Segmenter:
    """One automaton per worker process and dictionary, not per task."""
    key = hash(words)
    if key not in _built:
        if len(_built) > 4:
            _built.clear()
        _built[key] = Segmenter(words)
    return _built[key]


def split_packed(df: DataFrame, key: str, fields: Sequence[str], dictionary: DataFrame | None = None) -> DataFrame:
    """``(row_id, field_name, item_pos, item_value)``: one row per value of the packed string columns ``fields``.

    Outside quotes a value consists of letters, digits and ``. _ : -``; all else separates, save inside a known value.
    Whitespace round a separating sign belongs to it, and whitespace alone separates once. Quotes enclose a value
    literally and are dropped, a doubled one inside stands for one; brackets round the whole list are dropped. An empty
    entry between two signs takes a place but gives no row; one after the last value does neither. Null and blank fields
    give no row; a quote that is never closed separates. Repeated rows of ``df`` give repeated rows.

    ``dictionary`` has one string column of known whole values, of at most ``MAX_DICTIONARY`` rows.
    """
    words: tuple[str, ...] = ()
    if dictionary is not None:
        words = tuple(r[0] for r in dictionary.where(F.col(dictionary.columns[0]).isNotNull()).distinct().limit(MAX_DICTIONARY + 1).collect())
        if len(words) > MAX_DICTIONARY:
            raise ValueError(f"the dictionary has more than {MAX_DICTIONARY} values")
    held = df.sparkSession.sparkContext.broadcast(words)
    names = list(fields)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = _segmenter(held.value)
        for b in batches:
            ids, kinds, places, values = [], [], [], []
            keys = b.column(0).to_pylist()
            for k, name in enumerate(names):
                for row, s in zip(keys, b.column(k + 1).to_pylist()):
                    for place, value in segmenter.split(s):
                        ids.append(row)
                        kinds.append(name)
                        places.append(place)
                        values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(kinds, pa.string()), pa.array(places, pa.int32()), pa.array(values, pa.string())], names=["row_id", "field_name", "item_pos", "item_value"])

    schema = T.StructType([T.StructField("row_id", df.schema[key].dataType), T.StructField("field_name", T.StringType()), T.StructField("item_pos", T.IntegerType()), T.StructField("item_value", T.StringType())])
    return df.select(F.col(key).alias("row_id"), *names).mapInArrow(task, schema)
