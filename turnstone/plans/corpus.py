"""The dialogue corpus from raw turns to encoded pairs: a few tables, each made once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import bpe, dialogue, pairs
from ..sources import stages


@dataclass(frozen=True)
class Config:
    min_turns: int = 2
    dominance: float = 0.80
    alternation: float = 0.15
    hard_gap: float = 3600
    soft_gap: float = 600
    train_until: str = "2012-04-27"
    val_until: str = "2012-08-07"
    frame: int = 8
    min_ctx: int = 3
    min_resp: int = 5
    max_resp: int = 40
    cap: int = 500
    max_train_pairs: int = 1_500_000
    strategy: str | None = "union"
    coherence: bool = True
    max_ctx_ids: int = 100
    vocab: int = 16_000


def dialogues(turns: DataFrame, c: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(kept turns, reason by id). Rules in order: dates, turns, speakers, dominance, alternation, gaps. Usable turns and reasons are made once, as tables."""
    dates = turns.groupBy("id").agg(F.count("ts").alias("n_dated"))
    clean = dialogue.usable(turns.filter("ts is not null")).withColumn("ord", F.struct("ts", "ord"))  # in time, and as given among equal times
    clean = stages.kept(clean, "usable")
    facts = dates.join(dialogue.shape(clean), "id", "left").join(dialogue.gaps(clean.select("id", "ts"), c.hard_gap, c.soft_gap).select("id", F.col("reason").alias("gap_reason")), "id", "left")
    shape = F.coalesce(dialogue.reason(c.min_turns, c.dominance, c.alternation), F.lit("too_few_turns"))
    reason = F.when(F.col("n_dated") < 2, "too_few_valid_dates").when(F.col("n").isNull(), "too_few_turns").when(shape != "kept", shape).otherwise(F.coalesce("gap_reason", F.lit("kept")))
    reasons = stages.kept(facts.select("id", reason.alias("reason")), "reasons")
    return clean.join(reasons.filter("reason = 'kept'").select("id"), "id", "left_semi"), reasons


def corpus(turns: DataFrame, c: Config = Config()) -> DataFrame:
    """split, id, pos, ctx, resp. Merged turns and kept pairs, which are read more than once, are made once, as tables."""
    kept, _ = dialogues(turns, c)
    splits = dialogue.split_by_first(kept, c.train_until, c.val_until).select("id", "split")
    merged = stages.kept(dialogue.merged(kept.select("id", "ord", "speaker", "text")), "merged")
    made = pairs.masked(pairs.framed(merged, c.frame), merged).join(splits, "id")
    made = stages.kept(made.filter(pairs.discard_reason(c.min_ctx, c.min_resp, c.max_resp, c.coherence) == "kept"), "pairs")
    train = pairs.capped(made.filter("split = 'train'"), c.cap)
    train = pairs.sampled(train.withColumn("key", F.concat_ws(":", "id", "pos")), "key", c.max_train_pairs).drop("key")
    out = train.unionByName(made.filter("split <> 'train'"))
    return out.filter(pairs.domain(c.strategy, F.col("ctx"), F.col("resp"))) if c.strategy else out


def encoded(made: DataFrame, model: bpe.Bpe, c: Config = Config()) -> DataFrame:
    """split, ctx, resp as ids: the context's last ids, the response's first between begin and end."""
    ids = bpe.encoded_all(made, model, ("ctx", "resp"), ("split",))
    return ids.select("split", A.tail(F.col("ctx"), c.max_ctx_ids).alias("ctx"), A.framed(F.col("resp"), c.max_resp).alias("resp"))
