"""The general data-processing operators against plain loops, and their edge cases."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hitloom.operators import coverage, hotkeys, packed
from hitloom.sources import rejects


# Rows that fail to parse
def reason(head, hits):
    return rejects.parse_pair(rejects.LineParser(), head, hits)[-1]


GOOD = ("h\tACG", "F,R\ta,b\t1\t5,6\t2")


@pytest.mark.parametrize(
    ("head", "hits", "want"),
    [
        (*GOOD, None), (GOOD[0] + "\r", GOOD[1] + "\r", None), ('"h\tx ""q"""\tACG', GOOD[1], None), ('h"x\tACG\t', GOOD[1], None),
        ('"h\tACG', GOOD[1], "quoting"), ('"h"x\tACG', GOOD[1], "quoting"), ('"h" \tACG', GOOD[1], "quoting"), (GOOD[0], '"F,R\ta,b\t1\t5,6\t2', "quoting"), ("h", '"F', "quoting"),
        (None, GOOD[1], "column_count"), (GOOD[0], None, "column_count"), ("", GOOD[1], "column_count"), ("h", GOOD[1], "column_count"), ("h\tACG\t.\t.", GOOD[1], "column_count"), (GOOD[0], "F\ta\t1\t5", "column_count"), (GOOD[0], "F\ta\t1\t5\t1\t", "column_count"),
        (" \tACG", GOOD[1], "value"), ("h\t", GOOD[1], "value"), ("h\tACX", GOOD[1], "value"), ("h\tacgtn", "F\ta\t1\t5\t1", None), (GOOD[0], "F,X\ta,b\t1\t5,6\t2", "value"), (GOOD[0], "F,R\ta, \t1\t5,6\t2", "value"),
        (GOOD[0], "F,R\ta\t1\t5,6\t2", "value"), (GOOD[0], "F,R\ta,b\t1,1\t5,6\t2", "value"), (GOOD[0], "F,R\ta,b\t-1\t5,6\t2", "value"), (GOOD[0], "F,R\ta,b\t1\t5,٣\t2", "value"), (GOOD[0], "F,R\ta,b\t1\t5,6\t0", "value"),
        (GOOD[0], f"F\ta\t1\t{2**63}\t1", "value"), (GOOD[0], f"F\ta\t1\t{2**63 - 1}\t1", None), ("h\tACG\t...,.-x.", GOOD[1], None), ("h\tACG\t...", GOOD[1], "value"), ("h\tACG\t...,....", GOOD[1], "value"), ("h\tACG\t...,..a", GOOD[1], "value"),
        ("h\rx\tACG", GOOD[1], None), (GOOD[0], f"F,R\ta,b\t1\t5,6\t{10**30}", None), (GOOD[0], "F,R\ta,b\t1\t5,6\t" + "9" * 6000, None), (GOOD[0], "F\ta\t1\t" + "9" * 6000 + "\t1", "value"), (GOOD[0], "F\ta\t1\t" + "0" * 6000 + "7\t1", None), ("h" * 300_000 + "\tACG", GOOD[1], None),
    ],
)
def test_reasons(head, hits, want):
    assert reason(head, hits) == want


def test_parse_table(spark):
    rows = [(1, *GOOD, "x"), (1, *GOOD, "x"), (2, "h\tACG", None, "y"), (3, '"h\tACG', GOOD[1], None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "raw_id long, rec_head string, rec_hits string, reason string")
    got = Counter((r.raw_id, r.reason) for r in rejects.parse_records(df, "raw_id").collect())
    assert got == {(1, None): 2, (2, "column_count"): 1, (3, "quoting"): 1, (None, "column_count"): 1}
    valid, bad = rejects.split_rejects(df.where("raw_id is not null"), "raw_id")
    assert [tuple(r.positions) for r in valid.collect()] == [(5, 6)] * 2 and valid.first().mismatches == [1, 1]
    assert {r.raw_id for r in bad.collect()} == {2, 3}
    assert rejects.parse_records(df.limit(0), "raw_id").count() == 0


def test_rejects_of_any_key(spark):
    """Null and repeated keys: every row is in exactly one of the two results, with its own lines."""
    rows = [(None, "bad", "x"), (7, "a\tb", None), (7, '"open', "y"), (7, "h\tACG", "F\ta\t1\t5\t1"), (None, "h2\tACG", "F\ta\t1\t5\t1"), (8, None, None)]
    valid, bad = rejects.split_rejects(spark.createDataFrame(rows, "raw_id long, rec_head string, rec_hits string"), "raw_id")
    assert sorted((r.raw_id or 0, r.header) for r in valid.collect()) == [(0, "h2"), (7, "h")]
    assert sorted((r.raw_id or 0, r.reason, r.rec_head or "") for r in bad.collect()) == [(0, "column_count", "bad"), (7, "column_count", "a\tb"), (7, "quoting", '"open'), (8, "column_count", "")]


def test_breaks_beside_private_characters():
    parse = rejects.LineParser()
    assert parse('"a\r\nb\ue000\ue001\ue00a\ue00d"\tc\ue000\r\n') == ["a\r\nb\ue000\ue001\ue00a\ue00d", "c\ue000"]


def test_text_with_quoted_breaks(spark, tmp_path):
    p = tmp_path / "a.rec"
    p.write_bytes(b'h1\tACG\r\nF\ta\t1\t5\t1\r\n\r\n"h\n2"\tACG\nF\ta\t1\t5\t1\n"open\tACG\nF\ta\t1\t5\t1\nh4\tACG\n')
    valid, bad = rejects.load_text(spark, str(p))
    assert [(r.record_no, r.header) for r in valid.orderBy("record_no").collect()] == [(0, "h1"), (1, "h\n2")]
    assert [(r.record_no, r.reason) for r in bad.orderBy("record_no").collect()] == [(2, "quoting"), (3, "column_count")]


def test_long_quoted_fields(spark, tmp_path):
    long = "h" + "\nmore" * 301
    p = tmp_path / "a.rec"
    p.write_text(f'"{long}"\tACG\nF\ta\t1\t5\t1\nh2\tACG\nF\ta\t1\t5\t1\n"open\tACG\nF\ta\t1\t5\t1\nh3\tACG\nF\ta\t1\t5\t1\n"open\tACG\nF\ta\t1\t5\t1\n')
    valid, bad = rejects.load_text(spark, str(p))
    assert [(r.record_no, r.header) for r in valid.orderBy("record_no").collect()] == [(0, long), (1, "h2"), (3, "h3")]
    assert [(r.record_no, r.reason) for r in bad.orderBy("record_no").collect()] == [(2, "quoting"), (4, "quoting")]
    r = random.Random(6)
    for _ in range(2000):  # against joining line by line
        lines = "".join(r.choice('"""a\t\n\n') for _ in range(r.randrange(1, 25))).split("\n")
        want, i = [], 0
        while i < len(lines):
            last = next((j for j in range(i + 1, len(lines)) if rejects._opens_anew(lines[j])), len(lines))
            j = next((j for j in range(i, last) if not rejects._open_field("\n".join(lines[i : j + 1]))), i)
            want.append("\n".join(lines[i : j + 1]))
            i = j + 1
        assert list(rejects.logical_lines("\n".join(lines) + "\n")) == want
    assert len(list(rejects.logical_lines('"open\n' * 100_000))) == 100_000 and len(list(rejects.logical_lines('"a\n' + "x\n" * 300_000))) == 300_001


# Packed fields
def split_plain(s):
    """The grammar as a loop over characters, for fields whose quotes are closed."""
    if s is None or not (s := s.strip()):
        return []
    if len(s) > 1 and s[0] + s[-1] in ("()", "[]", "{}"):
        s = s[1:-1]
    out, place, signs, i = [], -1, 0, 0
    while i < len(s):
        if s[i] in "\"'":
            q, j, value = s[i], i + 1, ""
            while True:
                if s[j] == q and s[j + 1 : j + 2] == q:
                    value, j = value + q, j + 2
                elif s[j] == q:
                    break
                else:
                    value, j = value + s[j], j + 1
            i = j + 1
        elif m := re.compile(r"[A-Za-z0-9._:\-]+").match(s, i):
            value, i = m[0], m.end()
        else:
            signs += not s[i].isspace()
            i += 1
            continue
        place += max(1, signs) if place >= 0 else 1 + signs
        signs = 0
        if value.strip():
            out.append((place, value))
    return out


def test_packed_equals_the_loop():
    r, seg = random.Random(5), packed.Segmenter(["aa-1", "b.2", "zz"])
    for _ in range(3000):
        values = [r.choice(["aa-1", "b.2", "c:3", "zz9", '"x, y"', "'it''s'", '"a""b"', "", "F"]) for _ in range(r.randrange(1, 7))]
        s = "".join(v + r.choice([",", "; ", " | ", "  ", "\t", "、", "，", "/", ", ,"]) for v in values) + r.choice(["", "\r", " "])
        if r.random() < 0.2:
            s = r.choice(["({", "[["])[1:] + s
        if r.random() < 0.3:
            s = "[" + s + "]"
        assert seg.split(s) == split_plain(s), s


def test_packed_cases():
    split = packed.Segmenter(["big name, inc", "a,b"]).split
    assert packed.Segmenter().split("a||b, ,c,") == [(0, "a"), (2, "b"), (4, "c")]
    assert split("x,big name, inc;a,b") == [(0, "x"), (1, "big name, inc"), (2, "a,b")]  # delimiters inside known values
    assert split("xa,b") == [(0, "xa"), (1, "b")]  # no known value inside a run
    assert split("'open, b") == [(1, "open"), (2, "b")]  # never closed: it separates
    assert split(None) == split("") == split(" \r") == split(",") == split('""') == []
    assert split("(a)") == [(0, "a")] and split("a (b)") == [(0, "a"), (1, "b")] and split('"[a]"') == [(0, "[a]")]
    assert len(split(",".join(["abc"] * 200_000))) == 200_000


def test_packed_table(spark):
    df = spark.createDataFrame([(1, "a,b", None, 5), (1, "a,b", None, 5), (2, None, "", 6), (None, "c", " d", 7)], "id long, x string, y string, item_pos int")
    got = Counter((r.row_id, r.field_name, r.item_pos, r.item_value) for r in packed.split_packed(df, "id", ["x", "y"]).collect())
    assert got == {(1, "x", 0, "a"): 2, (1, "x", 1, "b"): 2, (None, "x", 0, "c"): 1, (None, "y", 0, "d"): 1}
    assert packed.split_packed(df.limit(0), "id", ["x"], df.select("x")).count() == 0


# Hot keys
def test_hot_keys(spark):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.5 else r.choice("abcdef"), r.choice([None, *range(-3000, 3000, 7)]), "n") for _ in range(20_000)] + [(None, 1, "n"), ("nulls", None, "n")]
    df = spark.createDataFrame(rows, "key string, value int, n string")
    w = hotkeys.weighted_values(df, F.col("key"), F.col("value"))
    by = defaultdict(list)
    for k, v, _ in rows:
        by[k].append(v)
    del by[None]
    got = {x.key: x for x in hotkeys.key_profile(w).collect()}
    assert set(got) == set(by)
    for k, values in by.items():
        c = Counter(v for v in values if v is not None)
        mode = min(c, key=lambda v: (-c[v], v)) if c else None
        assert (got[k].n_rows, got[k].n_values, got[k].n_distinct, got[k].mode) == (len(values), sum(c.values()), len(c), mode)
    for x in hotkeys.weighted_percentiles(w, [0, 25, 50, 99, 100]).collect():
        v = sorted(y for y in by[x.key] if y is not None)
        assert x.value == v[max(1, -(-x.percent * len(v) // 100)) - 1]
    assert [x.key for x in hotkeys.frequent_keys(w, 0.3, len(rows)).collect()] == ["hot"]
    assert hotkeys.key_profile(w.limit(0)).count() == 0


def test_percentiles_of_wide_values(spark):
    """Spans beyond a long, single values, ties, a key that holds most rows."""
    r = random.Random(2)
    rows = [("hot", r.choice([-(2**63), 2**63 - 1, r.randrange(-(2**62), 2**62), 7]), 1) for _ in range(400)] + [("one", 5, 3), ("none", None, 2), ("two", -4, 1), ("two", 2**40, 1)]
    got = {(x.key, x.percent): x.value for x in hotkeys.weighted_percentiles(spark.createDataFrame(rows, "key string, value long, n long"), [1, 50, 90, 100]).collect()}
    for key in ("hot", "one", "two"):
        v = sorted(y for k, y, n in rows if k == key for _ in range(n))
        assert {p: got[key, p] for p in (1, 50, 90, 100)} == {p: v[max(1, -(-p * len(v) // 100)) - 1] for p in (1, 50, 90, 100)}
    assert len(got) == 12
    assert hotkeys.weighted_percentiles(spark.createDataFrame([], "key string, value long, n long"), [50]).count() == 0


# Intervals
def blocks_plain(rows):
    by, out = defaultdict(list), set()
    for g, c, s, e in rows:
        if None not in (g, c, s, e) and s < e:
            by[g, c].append((s, e))
    for key, iv in by.items():
        merged = []
        for s, e in sorted(iv):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(*key, "block", s, e) for s, e in merged} | {(*key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("width", [1, 10, 64, None])
def test_blocks_and_gaps(spark, width):
    r = random.Random(width or 0)
    rows = [(r.choice(["hot", "hot", "a", "b", None]), r.choice(["c1", "c1", "c2"]), s := r.choice([None, *range(-300, 900)]), None if s is None else s + r.choice([-5, 0, 1, 10, 10, 20, 64, 200])) for _ in range(900)]
    rows += [("long", "c1", -10_000, 10_000), ("long", "c1", 10_000, 10_001), ("long", "c1", 10_002, 10_003)] + rows[:50]
    df = spark.createDataFrame(rows, "gene string, chrom string, s long, e long")
    got = [tuple(x) for x in coverage.blocks_and_gaps(df, ["gene", "chrom"], "s", "e", width).select("gene", "chrom", "kind", "start_pos", "end_pos").collect()]
    assert len(got) == len(set(got)) and set(got) == blocks_plain(rows)


def test_blocks_of_extremes(spark):
    df = spark.createDataFrame([("g", 0, 2**62), ("g", 5, 6)], "gene string, s long, e long")
    assert [tuple(x) for x in coverage.merge_blocks(df, ["gene"], "s", "e").collect()] == [("g", 0, 2**62)]
    # Long intervals over many shards, with others inside, at their ends, and one stray coordinate far away.
    r = random.Random(3)
    rows = [("g", a, a + r.choice([1, 3, 40, 400])) for a in (r.randrange(-300, 900) for _ in range(60))] + [("h", 0, 95), ("h", 20, 21), ("h", 95, 100), ("h", 130, 131), ("h", 2**61, 2**61 + 5)]
    covered = {}
    for g, a, z in rows[:-1]:
        covered.setdefault(g, set()).update(range(a, z))
    want = set()
    for g, xs in covered.items():
        for x in xs:
            if x - 1 not in xs:
                z = x
                while z in xs:
                    z += 1
                want.add((g, x, z))
    want.add(("h", 2**61, 2**61 + 5))
    got = coverage.merge_blocks(spark.createDataFrame(rows, "gene string, s long, e long"), ["gene"], "s", "e", 10)
    assert {tuple(x) for x in got.collect()} == want
    assert coverage.blocks_and_gaps(df.limit(0), ["gene"], "s", "e").count() == 0


def test_pairs_by_place(spark):
    df = spark.createDataFrame([([1, None, 9, 4], [3, 4, 9]), (None, [1]), ([], [])], "a array<long>, b array<long>")
    assert [x.p and [tuple(y) for y in x.p] for x in df.select(coverage.paired("a", "b").alias("p")).collect()] == [[(1, 3)], None, []]
