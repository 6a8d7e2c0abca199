"""Context and response pairs: frames, discard reasons, caps, domain filter, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .scan import LIMIT, Scan


def framed(turns: DataFrame, frame: int = 8, limit: int = LIMIT) -> DataFrame:
    """id, pos, ctx, resp: each turn but the first with up to `frame` turns before it."""
    scan = Scan(turns.select("id", "ord", "text"), ["ord"], limit=limit).last(frame, "before", F.col("text")).running(place=F.lit(1))
    return scan.rows().select("id", (F.col("place") - 1).cast("long").alias("pos"), F.array_join("before", T.EOT).alias("ctx"), F.col("text").alias("resp")).filter("pos >= 1")


def masked(made: DataFrame, turns: DataFrame) -> DataFrame:
    """made (id, ctx, resp) with the names of the dialogue's speakers and of bots masked. Names are few in a dialogue."""
    names = turns.groupBy("id").agg(F.collect_set(F.lower("speaker")).alias("names"))
    hide = lambda c: T.mask_bots(T.mask_speakers(F.col(c), F.col("names")))
    return made.join(names, "id").withColumns({"ctx": hide("ctx"), "resp": hide("resp")}).drop("names")


def labelled(made: DataFrame, cap: int = 500, order: tuple[str, ...] = ("id", "pos"), **rules) -> DataFrame:
    """made with reason: the first failing rule; after all others, a pair whose response `cap` kept pairs before it have."""
    return labelled_again(made.withColumn("reason", discard_reason(**rules)), cap, order)


def labelled_again(df: DataFrame, cap: int, order: tuple[str, ...] = ("id", "pos")) -> DataFrame:
    """df (with reason) where kept pairs beyond the cap of their response get that label. No task gets more than `cap` pairs of a response from each
    other one: the cap's last pair is found first and joined back, a join that Spark splits where a response is frequent."""
    kept, place = F.col("reason") == "kept", F.struct(*order)
    full = df.filter(kept).select("resp", place.alias("place")).withColumn("rank", F.row_number().over(Window.partitionBy("resp").orderBy("place"))).filter(F.col("rank") <= cap)
    full = full.groupBy(F.col("resp").alias("full__")).agg(F.max("place").alias("last__"), F.count("*").alias("n__")).filter(F.col("n__") == cap)
    found = df.join(full, F.col("resp") == F.col("full__"), "left")
    return found.withColumn("reason", F.when(kept & (place > F.col("last__")), "diversity_cap").otherwise(F.col("reason"))).drop("full__", "last__", "n__")


def sentences(made: DataFrame) -> DataFrame:
    """sentence: each pair's context and response, trimmed, without empty ones."""
    return made.select(F.explode(F.array(F.trim("ctx"), F.trim("resp"))).alias("sentence")).filter("sentence <> ''")


def encoded_stats(made: DataFrame) -> DataFrame:
    """Counts over pairs of ids (ctx, resp): empty contexts, responses of sentinels alone, responses as long as the longest."""
    df = made.select(F.size("ctx").alias("c"), F.size("resp").alias("r"))
    by = df.groupBy("r").agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.count_if(F.col("c") == 0).alias("empty"))
    return by.agg(
        F.sum("n").alias("n_scanned"), F.sum("empty").alias("n_empty_ctx"), F.sum(F.when(F.col("r") <= 2, F.col("n")).otherwise(0)).alias("n_empty_resp"),
        F.round(F.sum("c") / F.sum("n"), 1).alias("ctx_mean"), F.round(F.sum(F.col("r") * F.col("n")) / F.sum("n"), 1).alias("resp_mean"), F.max_by("n", "r").alias("n_resp_at_cap"),
    )


def signals(made: DataFrame) -> DataFrame:
    """signal, n, pct: what fires the command filter, in contexts and responses."""
    fires = {"cmd_in_ctx": T.ascii_only(F.col("ctx")).rlike(T.command_pattern()), "path_in_ctx": F.col("ctx").contains("__path__"), "cmd_in_resp": T.ascii_only(F.col("resp")).rlike(T.command_pattern()), "path_in_resp": F.col("resp").contains("__path__")}
    row = made.agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in fires.items()])
    return row.unpivot(["total"], list(fires), "signal", "n").select("signal", "n", F.round(100.0 * F.col("n") / F.greatest("total", F.lit(1)), 1).alias("pct"))


def subsampled(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """A reproducible share of the rows, one at least; the limit is the feature."""
    return sampled(df, key, max(1, int(df.count() * share)), seed)


def discard_reason(min_ctx: int = 3, min_resp: int = 5, max_resp: int = 40, coherence: bool = True) -> Column:
    """First failing rule of a pair, or kept; the costly rules are last."""
    ctx, resp = F.col("ctx"), F.col("resp")
    out = (
        F.when(T.n_words(ctx) < min_ctx, "ctx_too_short").when(T.n_words(resp) < min_resp, "resp_too_short").when(T.n_words(resp) > max_resp, "resp_too_long")
        .when(~T.is_english(resp), "non_english").when(T.is_bot_response(resp), "bot_response").when(T.is_echo(ctx, resp), "echo_pair").when(T.is_placeholder_only(resp), "placeholder_only")
    )
    return (out.when(T.is_incoherent(ctx, resp), "incoherent_pair") if coherence else out).otherwise("kept")


def capped(pairs: DataFrame, cap: int = 500, resp: str = "resp", order: tuple[str, ...] = ("id", "pos")) -> DataFrame:
    """The first `cap` pairs of each response. This cap is the feature."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(resp).orderBy(*order))).filter(F.col("rank") <= cap).drop("rank")


def domain(strategy: str, ctx: Column, resp: Column) -> Column:
    command, question = T.is_command(ctx) | T.is_command(resp), T.is_question(ctx)
    kinds = {"command": command, "question": question, "union": command | question, "intersection": command & question}
    if strategy not in kinds:
        raise ValueError(f"unknown strategy {strategy!r}; one of {sorted(kinds)}")
    return kinds[strategy]


def domain_stats(pairs: DataFrame, by: str = "split") -> DataFrame:
    c, q = T.is_command(F.col("ctx")) | T.is_command(F.col("resp")), T.is_question(F.col("ctx"))
    df = pairs.select(by, c.alias("c"), q.alias("q"))
    return df.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("c") | F.col("q")).alias("kept"), F.count_if("c").alias("n_cmd"), F.count_if("q").alias("n_question"), F.count_if(F.col("c") & F.col("q")).alias("n_both"))


def sampled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A reproducible uniform sample of n rows; the limit is the feature."""
    return df.withColumn("h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))).orderBy("h").limit(n).drop("h")


def history(turns: DataFrame, frame: int = 8, limit: int = LIMIT) -> DataFrame:
    """id, ord, history: the last `frame` cleaned, non-empty utterances up to each turn."""
    scan = Scan(turns.select("id", "ord", T.clean(F.col("text")).alias("t")), ["ord"], limit=limit).last(frame, "last", F.col("t"), and_this=True)
    return scan.rows().select("id", "ord", F.array_join(F.filter("last", lambda x: x != ""), T.EOT).alias("history"))
