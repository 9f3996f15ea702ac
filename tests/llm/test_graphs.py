"""Connected groups, co-occurrence and frequent items against plain loops."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitloom.llm import components, cooccur, heavy


def groups_plain(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def found(spark, pairs, kind="long"):
    df = spark.createDataFrame(pairs, f"a {kind}, b {kind}").withColumn("group", F.lit("clash")).withColumn("lo", F.lit(1))
    rows = components.connected_groups(df).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.group for r in rows}


def test_shapes(spark):
    r = random.Random(1)
    chain = [(i, i + 1) for i in range(0, 40)]
    r.shuffle(chain)
    star = [(1000, i) for i in range(1001, 1100)]
    dense = [(r.randrange(2000, 2060), r.randrange(2000, 2060)) for _ in range(150)]
    odd = [(None, 5000), (5001, None), (5002, 5002), (3000, 3001), (3001, 3000), (3000, 3001)]
    pairs = chain + star + dense + odd
    assert found(spark, pairs) == groups_plain(pairs)
    assert found(spark, []) == {} and found(spark, [(None, None), (1, 1)]) == {}


def test_names_compare_by_code_point(spark):
    assert found(spark, [("b", "Ä"), ("B", "b"), ("z", "é")], "string") == {"b": "B", "Ä": "B", "B": "B", "z": "z", "é": "z"}


def test_hubs_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(components, "BROADCAST_EDGES", 0)
    monkeypatch.setattr(components, "HUB_SHARE", 0.1)
    r = random.Random(2)
    pairs = [(500, i) for i in range(200)] + [(r.randrange(600, 900), r.randrange(600, 900)) for _ in range(250)]
    assert found(spark, pairs) == groups_plain(pairs)


def test_rounds_are_deleted(spark):
    import os

    from hitloom.session import checkpoint_dir

    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert found(spark, [(i, i + 1) for i in range(30)]) == groups_plain([(i, i + 1) for i in range(30)])
    assert len([x for x in set(os.listdir(folder)) - before if len(x) == 32]) == 1


def test_records(spark):
    rows = [(1, [" a", "b\r"], 2), (1, [" a", "b\r"], 2), (2, ["b", "c", None, ""], 2), (3, ["x", "y"], 1), (4, ["x", "z"], None), (5, ["q", "q"], 2), (6, None, 2), (7, [], 3), (8, ["p", "o"], 5)]
    df = spark.createDataFrame(rows, "record_no long, ref_names array<string>, multi_count int")
    g = components.name_groups(df)
    assert {r.ref_name: r.group_ref for r in g.collect()} == {"a": "a", "b": "a", "c": "a", "o": "o", "p": "o"}
    assert sorted(tuple(r) for r in components.record_groups(df, g).collect()) == [(1, "a"), (2, "a"), (8, "o")]
    assert components.name_groups(df.limit(0)).count() == 0


def test_no_fixed_point_is_an_error(spark):
    with pytest.raises(RuntimeError):
        components.connected_groups(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"), max_rounds=1)


def test_cooccurrence(spark):
    r = random.Random(4)
    rows = [(r.randrange(150) if r.random() < 0.7 else 1, [r.choice([None, "", " hot", "hot", "a", "b\t", "c", "d", "e"]) for _ in range(r.randrange(0, 6))], "x") for _ in range(500)] + [(None, ["a", "b"], "x"), (9, None, "x")]
    df = spark.createDataFrame(rows, "record_no long, ref_names array<string>, items string")
    baskets = defaultdict(set)
    for k, names, _ in rows:
        if k is not None:
            baskets[k] |= {n.strip() for n in names or [] if n and n.strip()}
    baskets = {k: v for k, v in baskets.items() if v}
    single = Counter(x for v in baskets.values() for x in v)
    pairs = Counter(p for v in baskets.values() for p in itertools.combinations(sorted(v), 2))
    got = {(x.item_a, x.item_b): x for x in cooccur.cooccurrence(df).collect()}
    assert {k: x.n_ab for k, x in got.items()} == pairs
    for (a, b), x in got.items():
        lift = pairs[a, b] * len(baskets) / (single[a] * single[b])
        assert (x.n_a, x.n_b, x.n_baskets) == (single[a], single[b], len(baskets)) and x.lift == pytest.approx(lift) and x.pmi == pytest.approx(np.log2(lift))
    # A threshold that is met exactly counts.
    x = next(iter(got.values()))
    assert (x.item_a, x.item_b) in {(y.item_a, y.item_b) for y in cooccur.cooccurrence(df, min_count=x.n_ab, min_lift=x.lift * (1 - 1e-12)).collect()}
    assert cooccur.cooccurrence(df.limit(0)).count() == 0


def test_wide_baskets(spark, monkeypatch):
    """One basket whose pairs would not fit into a task at once, and the split of wide ones against all combinations."""
    wide = spark.range(3000).select(F.lit(1).alias("record_no"), F.array(F.format_string("i%05d", "id")).alias("ref_names"))
    out = cooccur.cooccurrence(wide).agg(F.count("*").alias("n"), F.min("n_ab").alias("low"), F.max("n_a").alias("top")).first()
    assert tuple(out) == (3000 * 2999 // 2, 1, 1)
    monkeypatch.setattr(cooccur, "WIDE", 4)
    monkeypatch.setattr(cooccur, "LEFT", 3)
    monkeypatch.setattr(cooccur, "BATCH", 5)
    lists = [sorted({f"x{(k * 7 + j) % 40:02d}" for j in range(k)}) for k in range(1, 30)]
    got = Counter(tuple(x) for x in cooccur.ordered_pairs(spark.createDataFrame([(x,) for x in lists], "items array<string>")).collect())
    assert got == Counter(p for x in lists for p in itertools.combinations(x, 2))


def test_threshold_in_whole_numbers(spark):
    rows = [(k, ["a", "b"]) for k in range(3)] + [(k, ["a"]) for k in range(3, 7)] + [(k, ["c"]) for k in range(7, 10)]
    df = spark.createDataFrame(rows, "record_no long, ref_names array<string>")
    for least, want in ((10 / 7, 0), (1.4285714285714286, 0), (1.428571428571428, 1), (1.4, 1)):  # the lift is 30 / 21
        assert cooccur.cooccurrence(df, min_lift=least).count() == want


def test_heavy_hitters(spark):
    r = random.Random(6)
    rows = [(r.choice(["top", None, f"v{r.randrange(20)}", f"w{r.randrange(5000)}"]), 1) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "value string, n int").repartition(5)
    exact = Counter(v for v, _ in rows if v is not None)
    for share in (0.2, 0.01, 0.0005):
        want = {v: n for v, n in exact.items() if n >= share * len(rows)}
        assert {x.value: x.n for x in heavy.heavy_hitters(df, F.col("value"), share).collect()} == want
    # A sketch far too small, and heaps that overflow: these are taken again, larger, so nothing is lost.
    want = {v: n for v, n in exact.items() if n >= 0.0005 * len(rows)}
    assert {x.value: x.n for x in heavy.heavy_hitters(df, F.col("value"), 0.0005, width=8, capacity=3).collect()} == want
    assert heavy.heavy_hitters(df.limit(0), F.col("value"), 0.1).count() == 0
    assert heavy.heavy_hitters(df.where("value is null"), F.col("value"), 0.1).count() == 0


def test_count_min_never_underestimates():
    rng = np.random.default_rng(1)
    sketch, true = heavy.CountMin(64), Counter()
    plain = 0
    for _ in range(30):
        h, n = np.unique(rng.zipf(1.3, 400).clip(0, 3000), return_counts=True)
        est = sketch.add(h.astype(np.int64), n)
        true.update(dict(zip(h.tolist(), n.tolist())))
        assert all(e >= true[k] for k, e in zip(h.tolist(), est.tolist()))
        plain += n.sum()
    keys = np.array(list(true), dtype=np.int64)
    est = sketch.estimate(keys)
    assert (est >= np.array([true[int(k)] for k in keys])).all() and est.max() <= plain
