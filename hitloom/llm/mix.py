"""Mixing sources to target weights with a capped number of repetitions."""

from __future__ import annotations

import base64
import importlib.util
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import clean
from ..session import cut_lineage, spread

#: Hexadecimal digits of the sampling order that the histogram per source has.
BUCKET_DIGITS = 3
#: Up to this many sources the cuts, one row a source, are broadcast.
BROADCAST_SOURCES = 100_000
# Fixed value: the pattern by which this vocabulary's texts are cut into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict[str, object] = {}


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed vocabulary ``name`` lies; the folder may be set by HITLOOM_TOKENIZERS."""
    folder = os.environ.get("HITLOOM_TOKENIZERS")
    if not folder and (spec := importlib.util.find_spec("public_tokenizers")):
        folder = os.path.dirname(spec.origin)
    return os.path.join(folder or "/opt/tokenizers", name)


def _encoding(path: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` without ``text``, with ``n_tokens``; 0 for null and empty texts. Whole texts are encoded."""
    where, others = path or vocabulary_path(), [c for c in df.columns if c != text]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(where)
        for b in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*others, "n_tokens"])

    schema = T.StructType([*(df.schema[c] for c in others), T.StructField("n_tokens", T.LongType())])
    return df.select(*others, text).mapInArrow(task, schema)


def source_name(c: Column) -> Column:
    """Sources by letters alone: case, outer blanks and ``-`` against ``_`` don't count; blank is null."""
    return F.lower(F.replace(clean(c), F.lit("-"), F.lit("_")))


def water_fill(sources: DataFrame, total: float | None = None) -> DataFrame:
    """``sources(src, w, k, size)`` with ``cap`` and ``wanted``, the tokens that each source contributes.

    Without ``total``, the largest mix in which every source that has tokens reaches its share exactly. With it, sources
    whose share of ``total`` is over their cap, ``k`` times their size, are clamped to it and their excess goes to the
    others in proportion to their weights, until none is over its cap; if all are clamped, the mix stays below ``total``.

    All sources that aren't clamped have the same contribution per weight, the *level*, and those are clamped whose cap per
    weight is below it. Clamping only ever raises the level, so it is all that a round hands on, and each is one aggregation.
    A null or negative weight or number of repetitions counts as 0.
    """
    zero = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))
    s = sources.withColumns({"w": zero(F.col("w")).cast("double"), "cap": (zero(F.col("k")) * zero(F.col("size"))).cast("double"), "size": zero(F.col("size")).cast("long")})
    s = cut_lineage(s)
    open_ = (F.col("w") > 0) & (F.col("cap") > 0)
    ratio = F.when(open_, F.col("cap") / F.col("w"))
    if total is None:
        level = s.agg(F.min(ratio)).first()[0] or 0.0
    else:
        level, clamped = 0.0, -1
        while True:
            over = ratio < F.lit(level * (1 - 1e-12))
            caps, weight, n = s.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(open_ & ~over, F.col("w"))), F.count(F.when(over, 1))).first()
            if n == clamped:
                break
            clamped, level = n, (float(total) - (caps or 0.0)) / weight if weight else math.inf
    # An infinite level times a weight is infinite, so that the cap is what is left.
    return s.withColumn("wanted", F.when(open_, F.least("cap", F.lit(level) * F.col("w"))).otherwise(0.0))


def _cuts(histogram: DataFrame, filled: DataFrame) -> DataFrame:
    """``(src, whole, cut, rest)``: whole repetitions, the bucket in which the fraction beyond them ends and the tokens that are left for it.

    ``histogram(src, bucket, tokens)``: a running sum over the buckets of each source, at most ``16**BUCKET_DIGITS``.
    """
    s = filled.where((F.col("size") > 0) & (F.col("wanted") > 0)).select("src", F.floor(F.col("wanted") / F.col("size") + 1e-12).alias("whole"), "size", "wanted")
    s = s.select("src", "whole", F.greatest(F.lit(0.0), F.col("wanted") - F.col("whole") * F.col("size")).alias("rest"))
    upto = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    h = histogram.withColumn("upto", F.sum("tokens").over(upto)).join(s, "src")
    after = F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before"))
    cut = h.groupBy("src", "whole", "rest").agg(F.min(F.when(F.col("upto") > F.col("rest"), after)).alias("c"), F.max(after).alias("last"))
    c = F.coalesce("c", "last")
    return cut.select("src", "whole", c["bucket"].alias("cut"), F.floor(F.col("rest") - c["before"]).alias("rest"))


def mix_sources(
    docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", total: float | None = None, times: float | None = None, seed: int = 7, path: str | None = None,
    characters: bool = False,
) -> DataFrame:
    """``(doc_id, source, n_tokens, repeats)``: the documents of the mix and how often each is used.

    ``targets`` has ``source`` (unique by letters), ``target_share`` and ``max_repeat``; ``total`` is the size of the mix in
    tokens, or ``times`` that size as a multiple of all tokens of these sources; by default the mix is the largest at which
    all shares are exact. Every document is used as often as its source's whole repetitions; the fraction beyond them goes to
    the documents first in a seeded order, up to the size wanted, so a source falls short by less than one document. No
    document is used more than ``max_repeat`` times. With ``characters`` sizes are characters, not tokens.

    Documents of no or another source, with a null or empty text or not chosen are left out. Rows that repeat an id are one
    document, in case they differ the one with the smallest source and number of tokens; rows without an id are one document
    if their texts are equal. Empty tables give an empty result.

    The order is a digest of the seed and the id (or the text's digest); sizes are added up by source and the order's first
    ``BUCKET_DIGITS`` digits, and only the one bucket of each source that holds the cut is sorted.
    """
    goal = targets.select(source_name(F.col("source")).alias("src"), F.col("target_share").alias("w"), F.col("max_repeat").alias("k")).where(F.col("src").isNotNull())
    rows = docs.select(F.col(doc_id).alias("doc_id"), source_name(F.col(source)).alias("src"), F.col(text).alias("text"))
    rows = rows.join(goal.select("src"), "src", "left_semi").withColumn("content", F.when(F.col("doc_id").isNull(), F.md5("text")))
    if characters:
        rows = rows.select("doc_id", "src", "content", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_tokens"))
    else:
        rows = count_tokens(spread(rows), "text", path)
    # Rows that repeat an id are one document. This also keeps the bucket of the cut small whatever is repeated.
    rows = rows.where(F.col("n_tokens") > 0).groupBy("doc_id", "content").agg(F.min(F.struct("src", "n_tokens")).alias("d")).select("doc_id", "content", "d.*")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("content"))))
    rows = cut_lineage(rows.select("doc_id", "src", "n_tokens", F.substring(order, 1, 15).alias("h"), F.substring(order, 1, BUCKET_DIGITS).alias("bucket")))
    histogram = cut_lineage(rows.groupBy("src", "bucket").agg(F.sum("n_tokens").alias("tokens")))
    sizes = histogram.groupBy("src").agg(F.sum("tokens").alias("size"))
    if times is not None:
        total = times * float(sizes.agg(F.sum("size")).first()[0] or 0)
    cuts = _cuts(histogram, water_fill(goal.join(sizes, "src", "left"), total))
    rows = rows.join(F.broadcast(cuts) if targets.count() <= BROADCAST_SOURCES else cuts, "src")
    at_cut = rows.where(F.col("bucket") == F.col("cut"))
    by = Window.partitionBy("src").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    at_cut = at_cut.withColumn("more", (F.sum("n_tokens").over(by) <= F.col("rest")).cast("int"))
    others = rows.where(F.col("bucket") != F.col("cut")).withColumn("more", (F.col("bucket") < F.col("cut")).cast("int"))
    chosen = at_cut.unionByName(others).withColumn("repeats", (F.col("whole") + F.col("more")).cast("int"))
    return chosen.where(F.col("repeats") > 0).select("doc_id", F.col("src").alias("source"), "n_tokens", "repeats")


def mix_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeat, n_docs, n_tokens, top_repeat, actual_share)`` for every source of ``targets``."""
    part = mix.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("top_repeat"))
    goal = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeat")
    zero = {"n_docs": 0, "n_tokens": 0, "top_repeat": 0}
    joined = goal.join(part, "source", "left").fillna(zero)
    # One row per source: the window over all of them is small.
    share = F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy())
    return joined.withColumn("actual_share", F.round(F.coalesce(share, F.lit(0.0)), 6))
