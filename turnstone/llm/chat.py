"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that participant as assistant and the others as named
users; masks are the code-point ranges of the assistant's own words. A conversation is rendered in blocks of `block` turns,
so that no row holds an unbounded one; a block tells where it begins in the whole rendering. Conversations of one block are
grouped as they are; the turns of longer ones are placed by a sort over all tasks, so that a conversation with a large part of
all turns is spread over its blocks.

Defined results: a null role is the participant "unknown", a null text is empty, a null turn comes first; ties of turn are
ordered by role and text; repeated rows are turns of their own; rows with a null conv_id form one conversation; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_dir, ranked

OPEN, CLOSE, ASSISTANT, USER = "<|im_start|>", "<|im_end|>\n", "assistant", "user name="


def rotated(turns: DataFrame, block: int = 256) -> DataFrame:
    """conv_id, perspective, block, first_char, n_turns, rendered, mask ("start-end,..." in the block)."""
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    spark, out = turns.sparkSession, fresh_dir(turns.sparkSession, "chat")
    turns.groupBy(F.col("conv_id").alias("c")).count().filter(F.col("count") > block).select("c").write.parquet(out)
    long = spark.read.parquet(out)
    if long.isEmpty():
        return rendered(of_short(turns))
    is_long = F.col("conv_id").eqNullSafe(F.col("c"))
    return rendered(of_short(turns.join(long, is_long, "left_anti")).unionByName(of_long(turns.join(long, is_long, "left_semi"), block)))


def ordered_turns() -> Column:
    return F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")


def of_short(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, block, first_char, turns of conversations of one block."""
    whole = turns.groupBy("conv_id").agg(ordered_turns())
    speakers = F.explode(F.array_distinct(F.transform("turns", lambda x: x["role"]))).alias("perspective")
    return whole.select("conv_id", speakers, F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("first_char"), "turns")


def of_long(turns: DataFrame, block: int) -> DataFrame:
    """The same of conversations of many blocks. Where a block begins is summed over counts, without the texts."""
    placed = ranked(turns, "conv_id", [F.col("turn").asc_nulls_first(), "role", "text"])
    placed = placed.withColumn("block", F.floor(F.col("rank__") / block).cast("long"))
    own = placed.groupBy("conv_id", "block", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    as_user = len(OPEN) + len(USER) + 1 + len(CLOSE)
    every = own.groupBy("conv_id", "block").agg(F.sum(F.col("chars") + F.col("n") * (as_user + F.length("role"))).alias("chars"))
    speakers = own.select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    sizes = every.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = own.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "role", "n")
    sizes = sizes.join(own, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")) & (F.col("perspective") == F.col("role")), "left")
    chars = F.col("chars") + F.coalesce("n", F.lit(0)) * (len(ASSISTANT) - len(USER) - F.length("perspective"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "perspective", F.coalesce(F.sum(chars).over(before), F.lit(0)).alias("first_char"))
    blocks = placed.groupBy("conv_id", "block").agg(ordered_turns())
    return blocks.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select("conv_id", "perspective", "block", "first_char", "turns")


def rendered(blocks: DataFrame) -> DataFrame:
    own = lambda x: x["role"] == F.col("perspective")
    head = lambda x: F.concat(F.lit(OPEN), F.when(own(x), F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER), x["role"])), F.lit("\n"))
    pieces = F.transform("turns", lambda x: F.struct(F.length(head(x)).alias("h"), F.length(x["text"]).alias("n"), own(x).alias("own"), F.concat(head(x), x["text"], F.lit(CLOSE)).alias("s")))
    blocks = blocks.withColumn("pieces", pieces)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x["s"])).alias("at"), F.when(x["own"], F.concat(acc["out"], F.array(F.concat_ws("-", (acc["at"] + x["h"]).cast("string"), (acc["at"] + x["h"] + x["n"]).cast("string"))))).otherwise(acc["out"]).alias("out"))
    mask = F.array_join(F.aggregate("pieces", start, step, lambda acc: acc["out"]), ",")
    text = F.array_join(F.transform("pieces", lambda x: x["s"]), "")
    return blocks.select("conv_id", "perspective", "block", "first_char", F.size("turns").alias("n_turns"), text.alias("rendered"), mask.alias("mask"))


def op5_chat(spark, sf_dir: str) -> DataFrame:
    return rotated(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
