"""Items that appear together: pair counts and their lift over chance."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_set
from ..session import cut_lineage

#: A basket of more items is wide: its pairs are made by several tasks, each from ``LEFT`` items on the left.
WIDE, LEFT = 256, 1024
#: Pairs that Python hands over at once.
BATCH = 1 << 16


def baskets(records: DataFrame, key: str = "record_no", items: str = "ref_names") -> DataFrame:
    """``(key, items)``: the distinct clean items of each key, sorted; keys without an item are left out.

    Rows that repeat a key are united. Items are deduplicated by key before the shuffle, so that no more than a basket's own
    distinct items is ever gathered, however many rows repeat its key. A null key is no basket.
    """
    rows = records.where(F.col(key).isNotNull()).select(F.col(key), F.explode(name_set(F.col(items))).alias("x"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("x")).alias("items"))


def ordered_pairs(baskets: DataFrame) -> DataFrame:
    """``(a, b)`` with ``a < b`` for every two items of each basket of ``(items)``.

    Pairs of a wide basket are made one left item after the other and never held together; its left items are spread over
    tasks, each of which gets the basket once.
    """
    narrow = F.flatten(F.transform("items", lambda a, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda z: F.struct(a.alias("a"), z.alias("b")))))
    # The size is tested in the expression itself, as filters that the optimizer derives from it may be evaluated first.
    few = baskets.select(F.explode(F.when(F.size("items").between(2, WIDE), narrow)).alias("e")).select("e.a", "e.b")
    wide = baskets.where(F.size("items") > WIDE).select("items", F.explode(F.sequence(F.lit(0), F.expr(f"cast((size(items) - 2) div {LEFT} as int)"))).alias("k"))
    many = wide.repartition(F.xxhash64("items"), "k").mapInArrow(_wide_pairs(LEFT), "a string, b string")
    return few.unionByName(many)


def _wide_pairs(step: int):
    """Pairs of the left items ``k * step`` to ``(k + 1) * step`` of each basket with those after them, in batches of at most ``BATCH`` rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ks = batch.column(0), batch.column(1).to_pylist()
            for row, k in enumerate(ks):
                items = lists[row].values
                for i in range(k * step, min((k + 1) * step, len(items) - 1)):
                    for at in range(i + 1, len(items), BATCH):
                        right = items.slice(at, BATCH)
                        yield pa.RecordBatch.from_arrays([pa.repeat(items[i], len(right)), right], names=["a", "b"])

    return task


def cooccurrence(records: DataFrame, key: str = "record_no", items: str = "ref_names", min_count: int = 1, min_lift: float = 0.0) -> DataFrame:
    """``(item_a, item_b, n_ab, n_a, n_b, n_baskets, lift, pmi)`` for every two items with ``item_a < item_b``.

    ``lift`` is ``n_ab * N / (n_a * n_b)`` over the N baskets with at least one item, ``pmi`` its binary logarithm.
    Pairs under ``min_count`` or ``min_lift`` are left out; the threshold is compared in whole numbers. A basket emits its
    ordered pairs, its single items and itself, all counted in one map-side combined aggregation; marginals are joined to the
    pairs that are left. Null or blank items and empty lists don't count; an empty table gives an empty result.
    """
    b = baskets(records, key, items)
    none = F.lit(None).cast("string")
    single = F.transform("items", lambda a: F.struct(a.alias("a"), none.alias("b")))
    alone = b.select(F.explode(F.concat(F.array(F.struct(none.alias("a"), none.alias("b"))), single)).alias("e")).select("e.a", "e.b")
    counted = cut_lineage(alone.unionByName(ordered_pairs(b)).groupBy("a", "b").agg(F.count("*").alias("n")))
    total = counted.where(F.col("a").isNull()).agg(F.sum("n")).first()[0] or 0
    one = counted.where(F.col("a").isNotNull() & F.col("b").isNull())
    pairs = counted.where(F.col("b").isNotNull() & (F.col("n") >= min_count))
    pairs = pairs.join(one.select("a", F.col("n").alias("n_a")), "a").join(one.select(F.col("a").alias("b"), F.col("n").alias("n_b")), "b")
    least = Fraction(str(min_lift))
    exact = lambda c: F.col(c).cast("decimal(15,0)")  # noqa: E731  up to 10**15 baskets
    enough = exact("n") * F.lit(total).cast("decimal(15,0)") * F.lit(least.denominator) >= exact("n_a") * exact("n_b") * F.lit(least.numerator)
    n_ab, n_a, n_b = (F.col(c).cast("double") for c in ("n", "n_a", "n_b"))
    lift = n_ab * F.lit(float(total)) / (n_a * n_b)
    return pairs.where(enough).select(
        F.col("a").alias("item_a"), F.col("b").alias("item_b"), F.col("n").alias("n_ab"), "n_a", "n_b", F.lit(total).cast("long").alias("n_baskets"), lift.alias("lift"), F.log2(lift).alias("pmi")
    )
