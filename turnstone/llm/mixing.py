"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Each source's target is its share by weight of the total, at most `cap` times its size; what is above is shared again by
weight until none is above. Every document of a source has target / size expected copies; documents stand in order of size
and hash, a prefix sum of expected copies runs along them, shifted by one random offset per source, and a document is taken
once for each integer it crosses. Order by size spreads the copies evenly over long and short documents.

The prefix sum is not a window over a source: documents are sorted by range over all tasks, counted per task and source,
and the counts (one row for each task and source) give each task its start.

Defined results: a null text has size 0 and is taken with size 0; a null source is a source, the last; repeated rows are
documents of their own; null ids are ordered by the text's hash; an empty table gives no rows; other columns are kept by
`mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ranked, words

WEIGHTS = (3, 1, 2)


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target: one row a source. The fixed point of sharing again: a level L with target =
    min(cap * size, L * weight); sources reach their caps in order of cap / weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sizes.withColumn("w", weight).withColumn("top", cap * F.col("source_size"))
    full = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = share * F.sum("source_size").over(Window.partitionBy())
    df = df.withColumn("level", (total - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("w").over(after))
    stop = F.min(F.when(F.col("top") / F.col("w") > F.col("level"), F.struct(F.col("top") / F.col("w"), "level"))).over(Window.partitionBy())
    return df.select("source", "source_size", F.least("top", F.coalesce(stop["level"] * F.col("w"), F.col("top"))).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """In [0, 1), of the source and the seed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(source, F.lit("\0")))), 1, 8), 16, 10).cast("double") / 4294967296.0


def copies(docs: DataFrame, seed: int = 7, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, h of every row; h tells rows of equal id apart by their text."""
    base = cut(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), text_hash(docs).alias("h")))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    goals = targets(sizes.select("source", "source_size"), share, cap)
    df = ranked(base, "source", [F.desc("size"), "h", "doc_id"])
    goals = goals.withColumnRenamed("source", "g")
    df = df.join(goals, F.col("source").eqNullSafe(F.col("g")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank, u = F.col("rank__"), offset(F.col("source"), seed)
    n = F.floor((rank + 1) * each + u) - F.floor(rank * each + u)
    return df.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), F.least(n, F.lit(int(cap))).cast("long").alias("copies"), "h")


def text_hash(docs: DataFrame) -> Column:
    return F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text")))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    out = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """docs with each row repeated as often as the mix takes it.

    Rows with equal id, text and source share their copies evenly, and one of them gets the rest."""
    key = ["doc_id", "h", "source"]
    n = cut(copies(docs, seed).groupBy(key).agg(F.sum("copies").alias("mix__t"), F.count("*").alias("mix__k")))
    n = n.select(*[F.col(c).alias(f"mix__{c}") for c in key], "mix__t", "mix__k")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), F.col("source"), text_hash(docs).alias("hash"))
    found = marked.join(n, marked["doc_id"].eqNullSafe(F.col("mix__doc_id")) & (F.col("hash") == F.col("mix__h")) & marked["source"].eqNullSafe(F.col("mix__source")))
    repeated = lambda df, count: df.filter(count > 0).select("row", F.explode(F.sequence(F.lit(1), count))).select("row.*")
    even = repeated(found, F.floor(F.col("mix__t") / F.col("mix__k")))
    left = F.pmod("mix__t", "mix__k")
    if n.filter(left > 0).isEmpty():
        return even
    rest = found.filter(left > 0).groupBy("mix__doc_id", "mix__h", "mix__source", "mix__t", "mix__k").agg(F.first("row").alias("row"))
    return even.unionByName(repeated(rest, left))
