"""Dialogues from turns: grouping, filters with a first failing reason, merging, gaps, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .scan import LIMIT, Scan


def grouped(turns: DataFrame) -> DataFrame:
    """turns (id, ord, speaker, text) -> id, turns array in order, n_turns, n_speakers. With ts, in order of time; undated turns are last."""
    place = [F.col("ts").isNull().alias("undated"), "ts"] if "ts" in turns.columns else []
    return turns.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*place, "ord", "speaker", "text"))).alias("turns"), F.count("*").alias("n_turns"), F.count_distinct("speaker").alias("n_speakers"))


def usable(turns: DataFrame) -> DataFrame:
    """Turns that are not by bots, actions, pastes, repetitive or empty once cleaned; speakers lower-cased, texts cleaned."""
    speaker, raw = F.lower(F.trim("speaker")), F.trim("text")
    kept = turns.filter(~speaker.isin(*fixed.BOTS) & ~raw.rlike(fixed.ACTION) & ~T.is_paste(raw))
    kept = kept.withColumn("speaker", speaker).withColumn("text", F.explode(F.array(T.clean(raw))))  # one row each; filters are not pushed below, so each text is cleaned once
    return kept.filter((F.col("text") != "") & ~T.is_repetitive(F.col("text")))


def shape(turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """id, n, n_speakers, dominance, alternation."""
    marked = Scan(turns.select("id", "ord", "speaker"), ["ord"], limit=limit).previous(before=F.col("speaker")).rows()
    marked = marked.select("id", "speaker", (F.col("before") != F.col("speaker")).cast("int").alias("changed"))
    by_speaker = marked.groupBy("id", "speaker").agg(F.count("*").alias("k"), F.sum("changed").alias("changed"))
    return by_speaker.groupBy("id").agg(
        F.sum("k").alias("n"), F.count("speaker").alias("n_speakers"), (F.max("k") / F.sum("k")).alias("dominance"),
        F.coalesce(F.try_divide(F.sum("changed"), F.sum("k") - 1), F.lit(0.0)).alias("alternation"),
    )


def reason(min_turns: int = 2, dominance: float = 0.80, alternation: float = 0.15) -> Column:
    """First failing rule over `shape`."""
    return (
        F.when(F.col("n") < min_turns, "too_few_turns").when(F.col("n_speakers") != 2, "not_dyadic")
        .when(F.col("dominance") > dominance, "speaker_dominance").when(F.col("alternation") < alternation, "low_alternation").otherwise("kept")
    )


def in_time(timed: DataFrame) -> list[str]:
    """Order by time, and by place among equal times where rows have one."""
    return ["ts", "ord"] if "ord" in timed.columns else ["ts"]


def gaps(timed: DataFrame, hard: float = 3600, soft: float = 600, limit: int = LIMIT) -> DataFrame:
    """timed (id, ts) -> id, n, max_gap and soft_ratio in seconds, reason by the temporal rules."""
    gap = F.expr("timestampdiff(MICROSECOND, before, ts)") / 1e6
    df = Scan(timed, in_time(timed), limit=limit).previous(before=F.col("ts")).rows().withColumn("gap", gap)
    df = df.groupBy("id").agg(F.count("*").alias("n"), F.max("gap").alias("max_gap"), F.avg((F.col("gap") > soft).cast("double")).alias("soft_ratio"))
    return df.withColumn("reason", F.when(F.col("n") < 2, "too_few_valid_dates").when(F.col("max_gap") > hard, "temporal_hard_ceiling").when(F.col("soft_ratio") > 0.3, "temporal_gap_ratio").otherwise("kept"))


def sessions(timed: DataFrame, gap_seconds: int, limit: int = LIMIT) -> DataFrame:
    """timed with a session number by id: a new one after each gap that is longer."""
    new = F.coalesce((F.expr("timestampdiff(SECOND, before, ts)") > gap_seconds).cast("int"), F.lit(1))
    return Scan(timed, in_time(timed), limit=limit).previous(before=F.col("ts")).running(session=new).rows().drop("before")


def islands(turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """turns with the number of the run of one speaker (case ignored) that each is in."""
    new = F.coalesce((F.lower("speaker") != F.col("before")).cast("int"), F.lit(1))
    return Scan(turns, ["ord"], limit=limit).previous(before=F.lower("speaker")).running(island=new).rows().drop("before")


def merged(turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row for each run of one speaker. An utterance is left out if all of it is one word of the run so far."""
    runs = islands(turns, limit).groupBy("id", "island").agg(F.array_sort(F.collect_list(F.struct("ord", "speaker", "text"))).alias("t"))

    def add(acc: Column, x: Column) -> Column:
        new = F.trim(x["text"])
        seen = F.array_contains(F.transform(F.split(acc, " "), F.trim), new)
        return F.when((new == "") | seen, acc).otherwise(F.concat_ws(" ", acc, new))

    first = F.element_at("t", 1)
    text = F.aggregate(F.slice("t", 2, 1 << 30), first["text"], add)
    return runs.select("id", first["ord"].alias("ord"), first["speaker"].alias("speaker"), text.alias("text"))


def split_by_first(timed: DataFrame, train_until: str, val_until: str) -> DataFrame:
    """id, first_ts, split; ids without a time are training data."""
    df = timed.groupBy("id").agg(F.min("ts").alias("first_ts"))
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return df.withColumn("split", F.when(F.col("first_ts").isNull() | (F.col("first_ts") < at(train_until)), "train").when(F.col("first_ts") < at(val_until), "val").otherwise("test"))


def leakage(splits: DataFrame) -> DataFrame:
    """pair, overlap: ids in two splits."""
    names = ("train", "val", "test")
    per = splits.groupBy("id").agg(F.collect_set("split").alias("s"))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    counts = per.agg(*[F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"{a}_{b}") for a, b in pairs])
    return counts.unpivot([], [f"{a}_{b}" for a, b in pairs], "pair", "overlap")
