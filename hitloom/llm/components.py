"""Connected groups from pairwise matches: alternating large-star and small-star.

Edges are kept as ``(lo, hi)`` with ``lo < hi``. One round rewrites every edge
twice; both rewrites need, per node, only the smallest neighbour, which is a
map-side combined minimum, so no neighbour list is ever gathered.

* large-star: each neighbour of ``u`` above ``u`` is linked to the smallest of
  ``u`` and its neighbours;
* small-star: each neighbour of ``u`` below ``u``, and ``u``, is linked to the
  smallest of them.

At the fixed point every node but the smallest of its component has one edge,
to that smallest node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_set
from ..session import Written

#: A node with more than this share of all edges is a hub. At most 2 / HUB_SHARE nodes can be hubs, so their table may be broadcast.
HUB_SHARE = 0.002
#: Up to this many edges the smallest neighbours of all nodes, at most one row per end of an edge, are broadcast.
BROADCAST_EDGES = 20_000


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges(node, other)`` with ``m`` of ``least(node, m, n)``.

    The edges of hubs are joined map-side: their table has at most ``2 / HUB_SHARE`` rows, whatever the number of edges.
    All others are joined by shuffle, or, where ``total`` bounds the size of ``least``, map-side as well.
    """
    if total <= BROADCAST_EDGES:
        return edges.join(F.broadcast(least.select("node", "m")), "node")
    hub = F.col("n") > total * HUB_SHARE
    hubs = least.where(hub).select("node", F.col("m").alias("hub_m"))
    mixed = edges.join(F.broadcast(hubs), "node", "left")
    rest = mixed.where(F.col("hub_m").isNull()).drop("hub_m").join(least.where(~hub).select("node", "m"), "node")
    return rest.unionByName(mixed.where(F.col("hub_m").isNotNull()).withColumnRenamed("hub_m", "m"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """At most one edge per edge; repeats are left to the small star."""
    ends = F.array(F.struct(F.col("lo").alias("node"), F.col("hi").alias("other")), F.struct(F.col("hi").alias("node"), F.col("lo").alias("other")))
    both = edges.select(F.explode(ends).alias("x")).select("x.node", "x.other")
    least = both.groupBy("node").agg(F.min("other").alias("m"), F.count("*").alias("n"))
    least = least.select("node", F.least("node", "m").alias("m"), "n")
    up = edges.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
    return _with_least(up, least, total).select(F.col("m").alias("lo"), F.col("other").alias("hi"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
    least = down.groupBy("node").agg(F.min("other").alias("m"), F.count("*").alias("n"))
    moved = _with_least(down, least, total).where(F.col("other") != F.col("m")).select(F.col("m").alias("lo"), F.col("other").alias("hi"))
    return moved.unionByName(least.select(F.col("m").alias("lo"), F.col("node").alias("hi"))).distinct()


def _state() -> dict[str, Column]:
    """Number of edges and an order-free sum of their hashes; equal states mean equal edge sets."""
    return {"n": F.count("*"), "s": F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))}


def connected_groups(pairs: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """One row ``(node, group)`` for every node that is linked to another one; ``group`` is the smallest node of its component.

    ``pairs`` may hold repeats, either order, nulls (no link) and self pairs (no link); other columns are ignored.
    An empty table gives an empty result. Nodes compare by value; strings by code point.

    Raises ``RuntimeError`` if ``max_rounds`` rounds don't reach the fixed point (the number of rounds grows with the
    logarithm of the longest chain). Each round is written to the shared checkpoint folder and the one before it deleted, so
    the disk in use is that of two rounds, however many there are; the last one stays, as the result is read from it.
    """
    x, y = F.col(a), F.col(b)
    links = pairs.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"))
    held = Written(links.distinct(), **_state())
    for _ in range(max_rounds):
        n = held.metrics["n"]
        if not n:
            break
        held, before = Written(_small_star(_large_star(held.df, n), n), **_state()), held
        before.drop()  # the next round is written, so no task can ask for this one again
        if held.metrics == before.metrics:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    leaves = held.df.select(F.col("hi").alias("node"), F.col("lo").alias("group"))
    return leaves.unionByName(held.df.select(F.col("lo").alias("node"), F.col("lo").alias("group")).distinct())


def record_links(records: DataFrame, names: str = "ref_names", multi: str = "multi_count") -> DataFrame:
    """``(a, b)``: every record whose ``multi`` is 2 or more ties its distinct clean names to the smallest of them.

    A star per record joins the same names as all its pairs would, in one row per name instead of one per pair.
    Null or empty lists, null or blank names and a null ``multi`` give no link.
    """
    found = records.where(F.col(multi) >= 2).select(name_set(F.col(names)).alias("x")).where(F.size("x") >= 2)
    return found.distinct().select(F.element_at("x", 1).alias("a"), F.explode(F.slice("x", 2, F.size("x") - 1)).alias("b"))


def name_groups(records: DataFrame, names: str = "ref_names", multi: str = "multi_count") -> DataFrame:
    """``(group_ref, ref_name)`` for every name in a group of two or more."""
    return connected_groups(record_links(records, names, multi)).select(F.col("group").alias("group_ref"), F.col("node").alias("ref_name"))


def record_groups(records: DataFrame, groups: DataFrame, key: str = "record_no", names: str = "ref_names", multi: str = "multi_count") -> DataFrame:
    """``(key, group_ref)`` of every linking record: the group of its smallest name, which is that of all its names.

    Repeated records give one row. Records that link nothing have no group and no row.
    """
    first = records.where(F.col(multi) >= 2).select(F.col(key), name_set(F.col(names)).alias("x")).where(F.size("x") >= 2)
    first = first.select(F.col(key), F.element_at("x", 1).alias("ref_name")).distinct()
    return first.join(groups.select("ref_name", "group_ref"), "ref_name").select(key, "group_ref").distinct()
