"""Corpus metrics: n-gram precision, BLEU, distinct, lengths, dominance, verdicts, ROUGE-L."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..sources import stages


def distinct_n(rows: DataFrame, array: str, n: int) -> DataFrame:
    """n_unique, n_total, ratio over all rows' n-grams."""
    grams = rows.select(F.explode(T.ngrams(F.col(array), n)).alias("g"))
    return grams.agg(F.count_distinct("g").alias("n_unique"), F.count("*").alias("n_total")).withColumn("ratio", F.col("n_unique") / F.greatest("n_total", F.lit(1)))


def clipped(rows: DataFrame, orders: tuple[int, ...] | int = (1, 2, 3, 4)) -> DataFrame:
    """rows (sample_id, hyp, ref) -> n, matched, total, precision of each order.

    One pass: grams of all orders and both sides are counted together by sample, so no sample is collected and nothing is joined."""
    orders = (orders,) if isinstance(orders, int) else orders
    tagged = lambda n, side: lambda g: F.struct(F.lit(n).cast("long").alias("n"), g.alias("g"), F.lit(side).alias("side"))
    grams = [F.transform(T.ngrams(F.col(c), n), tagged(n, side)) for n in orders for c, side in (("hyp", 1), ("ref", 0))]
    each = rows.select("sample_id", F.explode(F.concat(*grams)).alias("x")).select("sample_id", "x.*")
    both = each.groupBy("sample_id", "n", "g").agg(F.sum("side").alias("h"), F.sum(1 - F.col("side")).alias("r"))
    out = both.groupBy("n").agg(F.sum(F.least("h", "r")).alias("matched"), F.sum("h").alias("total"))
    every = rows.sparkSession.createDataFrame([(n,) for n in orders], "n long")
    out = every.join(out, "n", "left").select("n", F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("total", F.lit(0)).alias("total"))
    return out.withColumn("precision", F.coalesce(F.try_divide("matched", "total"), F.lit(0.0)))


def sizes(rows: DataFrame) -> DataFrame:
    return rows.agg(F.sum(F.size("hyp")).alias("h"), F.sum(F.size("ref")).alias("r"))


def bleu(rows: DataFrame) -> DataFrame:
    """bleu1, bleu2, bleu4 with one brevity penalty and a floor of 1e-9."""
    p = clipped(rows)
    p = p.agg(*[F.max(F.when(F.col("n") == n, F.greatest("precision", F.lit(1e-9)))).alias(f"p{n}") for n in (1, 2, 3, 4)], F.max(F.when(F.col("n") == 1, F.col("precision"))).alias("raw1"))
    bp = F.when(F.col("h") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.greatest("h", F.lit(1))))
    mean = lambda k: F.exp(sum((F.log(F.col(f"p{i}")) for i in range(1, k + 1)), F.lit(0.0)) / k)
    return p.join(sizes(rows)).select((bp * F.col("raw1")).alias("bleu1"), (bp * mean(2)).alias("bleu2"), (bp * mean(4)).alias("bleu4"))  # one row each


def tokens_13a(text: Column) -> Column:
    """Words by the 13a rules: signs apart, full stops and commas unless between digits, a hyphen after a digit."""
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, new in fixed.TOKENS_13A:
        text = F.regexp_replace(text, pattern, new)
    return T.tokens(text)


def bleu_13a(rows: DataFrame) -> DataFrame:
    """rows (sample_id, hyp, ref: texts) -> bleu1 .. bleu4, each a corpus BLEU of its own highest order, to 4 places.

    An order without a match counts as half, a quarter, ... of a match; one without any n-gram gives 0."""
    words = rows.select("sample_id", tokens_13a(F.col("hyp")).alias("hyp"), tokens_13a(F.col("ref")).alias("ref"))
    by = clipped(words).agg(*[F.max(F.when(F.col("n") == n, F.col(c))).alias(f"{c[0]}{n}") for n in (1, 2, 3, 4) for c in ("matched", "total")])
    bp = F.when(F.col("h") == 0, 0.0).when(F.col("h") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.greatest("h", F.lit(1))))
    out, logs, misses, whole = [], F.lit(0.0), F.lit(0), F.lit(True)
    for n in (1, 2, 3, 4):
        m, t = F.col(f"m{n}"), F.col(f"t{n}")
        misses = misses + (m == 0).cast("int")
        whole = whole & (t > 0)
        logs = logs + F.log(F.when(m > 0, m).otherwise(F.pow(F.lit(2.0), -misses)) / F.greatest(t, F.lit(1)))
        out.append(F.round(F.when(whole, bp * F.exp(logs / n)).otherwise(0.0), 4).alias(f"bleu{n}"))
    return by.join(sizes(words)).select(*out)  # one row each


def bleu_in_row(rows: DataFrame, n: int) -> DataFrame:
    """rows (hyp, ref) with `bleu`: clipped precision of the row's own n-grams; 0 where hyp has fewer than n.

    The n-grams are columns of their own, so that no lambda computes them again for each gram."""
    times = lambda a, g: F.size(a) - F.size(F.array_remove(a, g))
    hits = F.aggregate(F.array_distinct("h_grams"), F.lit(0), lambda acc, g: acc + F.least(times("h_grams", g), times("r_grams", g)))
    df = rows.withColumns({"h_grams": T.ngrams(F.col("hyp"), n), "r_grams": T.ngrams(F.col("ref"), n)})
    return df.withColumn("bleu", F.coalesce(F.try_divide(hits, F.size("h_grams")), F.lit(0.0))).drop("h_grams", "r_grams")


def length_percentiles(rows: DataFrame, length: str) -> DataFrame:
    """mean to 1 place and percentiles cut to integers."""
    return rows.agg(F.round(F.avg(length), 1).alias("mean"), *[F.floor(F.percentile(length, F.lit(p / 100))).cast("long").alias(f"p{p}") for p in (50, 75, 90, 95, 99)])


BUCKETS = ("0", "1-5", "6-10", "11-20", "21+")


def length_histogram(rows: DataFrame, length: str) -> DataFrame:
    """bucket, n; buckets without rows are kept."""
    x = F.col(length)
    bucket = F.when(x == 0, "0").when(x <= 5, "1-5").when(x <= 10, "6-10").when(x <= 20, "11-20").otherwise("21+")
    every = rows.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    return every.join(rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def top_responses(rows: DataFrame, resp: str, order: str, n: int = 20, counters: int = 100_000) -> DataFrame:
    """The n most frequent responses, the first seen first among equals. A top-k report.

    A task keeps at most `counters` counts of hashes (Misra and Gries): when they are full, all go down by one, and what a count can lack is
    the number of times that happened. Hashes and counts are shuffled instead of texts; only responses whose count can
    be the n-th largest or more are then counted exactly, by their text."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        lost = 0
        for batch in batches:
            for h, k in zip(*(x.to_pylist() for x in batch.column(0).value_counts().flatten())):
                held[h] = held.get(h, 0) + k
            if len(held) > counters:
                down = sorted(held.values(), reverse=True)[counters]
                lost += down
                held = {h: k - down for h, k in held.items() if k > down}
        yield pa.RecordBatch.from_arrays([pa.array([*held, None], pa.int64()), pa.array([*held.values(), lost], pa.int64())], names=["h", "n"])

    hashed = F.xxhash64(F.col(resp))
    sums = rows.select(hashed.alias("h")).mapInArrow(sketch, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = stages.kept(sums, "sketch")
    lost = found.filter("h is null").first()["n"] if not found.isEmpty() else 0
    least = found.filter("h is not null").orderBy(F.desc("n")).limit(n).agg(F.min("n")).first()[0] or 0
    able = found.filter("h is not null").filter(F.col("n") + lost >= least).select("h")  # exact for the rest: none can have as many as the n-th
    chosen = rows.withColumn("h", hashed).join(able, "h", "left_semi") if lost < least else rows
    return chosen.groupBy(resp).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(n)


def diversity(rows: DataFrame, resp: str, marks: tuple[int, int] = (100, 500)) -> DataFrame:
    per = rows.groupBy(resp).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_unique"), F.sum("n").alias("n_total"), F.round(F.count("*") / F.sum("n"), 4).alias("ratio"), *[F.count_if(F.col("n") > m).alias(f"over_{m}") for m in marks], F.max("n").alias("top"))


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """The element at n // 2 of the sorted values. From the other end it is the lower median, which percentile_disc gives
    from counts by value: no task sorts all values."""
    found = F.expr(f"-percentile_disc(0.5) within group (order by -`{value}`)")
    return rows.agg(found.cast("long").alias("upper_median"))


def rates(rows: DataFrame, ids: str, unk: int = 1) -> DataFrame:
    """n_samples, avg_resp_len, unk_rate, empty_rate over arrays of ids."""
    n = F.greatest(F.count("*"), F.lit(1))
    size, unknown = F.sum(F.size(ids)), F.sum(F.size(ids) - F.size(F.array_remove(ids, unk)))
    return rows.agg(F.count("*").alias("n_samples"), F.round(size / n, 2).alias("avg_resp_len"), F.round(unknown / F.greatest(size, F.lit(1)), 4).alias("unk_rate"), F.round(F.count_if(F.size(ids) == 0) / n, 4).alias("empty_rate"))


def collapse(rows: DataFrame, resp: str, limit: float = 0.20) -> DataFrame:
    """top1_fraction, collapse_flag: how large a share the most frequent response has; an empty one counts as <EMPTY>."""
    text = F.when(F.coalesce(F.col(resp), F.lit("")) == "", "<EMPTY>").otherwise(F.col(resp))
    top = rows.groupBy(text.alias("t")).agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("f"))
    return top.select(F.round(F.coalesce("f", F.lit(0.0)), 4).alias("top1_fraction"), (F.coalesce("f", F.lit(0.0)) > limit).alias("collapse_flag"))


def metric_table(tables: dict[str, DataFrame]) -> DataFrame:
    """metric and a column for each table (metric, value); a metric that a table lacks is null there."""
    out = None
    for name, df in tables.items():
        df = df.select("metric", F.col("value").alias(name))
        out = df if out is None else out.join(df, "metric", "full_outer")
    return out


def inference(rows: DataFrame, tokens: str, confidences: str, seconds: str, source: str, unk: int = 1) -> DataFrame:
    """rows with metrics of one answer each: speed, latency, mean confidence, unknown pieces of the input, lengths."""
    n, c = F.size(tokens), F.col(confidences)
    return rows.withColumns({
        "tokens_per_sec": F.round(n / F.greatest(F.col(seconds), F.lit(1e-6)), 1), "latency_ms": F.round(F.col(seconds) * 1000, 1),
        "avg_confidence": F.round(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.size(c), F.lit(1)), 4),
        "unk_in_input": F.size(source) - F.size(F.array_remove(source, unk)), "response_len": n, "input_tokens": F.size(source),
    })


def epoch_losses(batches: DataFrame) -> DataFrame:
    """batches (model, epoch, loss) -> mean_loss over finite losses and perplexity exp(min(mean, 20)); 0 and 1 without any."""
    finite = F.when(~F.isnan("loss") & (F.abs("loss") < float("inf")), F.col("loss"))
    mean = F.coalesce(F.avg(finite), F.lit(0.0))
    return batches.groupBy("model", "epoch").agg(mean.alias("mean_loss")).withColumn("perplexity", F.exp(F.least("mean_loss", F.lit(20.0))))


def exact_mean(x: Column) -> Column:
    """The mean of a group's doubles, whatever order they come in: sums of doubles depend on it, which would decide between equal means. Values are
    added as decimals if those of 18 places hold each of them; else, and for groups that these can't hold, it is the mean of doubles."""
    d = x.try_cast("decimal(38, 18)")
    exact = F.try_sum(d) / F.count(x).cast("decimal(18, 0)")
    return F.when(F.every(F.coalesce(d.cast("double") == x, x.isNull())), F.coalesce(exact.cast("double"), F.avg(x))).otherwise(F.avg(x))


def best_epochs(losses: DataFrame) -> DataFrame:
    """model, best_epoch, best_loss: the first epoch of the least loss. Epochs without a loss and losses without an epoch name none."""
    best = F.min(F.when(F.col("mean_loss").isNotNull() & F.col("epoch").isNotNull(), F.struct("mean_loss", "epoch")))
    return losses.groupBy("model").agg(best["epoch"].alias("best_epoch"), F.min("mean_loss").alias("best_loss"))


#: What is worth a flag in the statistics of a stage: metric, side of the limit that is flagged, limit, flag.
VALIDATIONS = (
    ("discard_pct", ">", 20.0, "high discard rate"), ("val_pct", "<", 3.0, "small validation split"), ("test_pct", "<", 3.0, "small test split"),
    ("coverage_pct", "<", 95.0, "low coverage"), ("n_empty_ctx", ">", 0.0, "empty contexts"), ("n_empty_resp", ">", 0.0, "near-empty responses"),
    ("diversity_ratio", "<", 0.3, "potential collapse"), ("at_cap_pct", ">", 5.0, "truncation bias"), ("over_100", ">", 50.0, "dominance risk"), ("over_500", ">", 0.0, "diversity filter"),
    ("eot_pct", "<", 55.0, "separators missing"),
)


def validations(stats: DataFrame) -> DataFrame:
    """stats (stage, metric, value) -> stage, metric, value, flag of each rule; the flag is ok where it holds, missing without a value."""
    spark = stats.sparkSession
    rules = spark.createDataFrame(VALIDATIONS, "metric string, side string, limit double, flag string")
    broken = F.when(F.col("side") == ">", F.col("value") > F.col("limit")).otherwise(F.col("value") < F.col("limit"))
    return stats.join(rules, "metric").select("stage", "metric", "value", F.when(F.col("value").isNull(), "missing").when(broken, F.col("flag")).otherwise("ok").alias("flag"))


def yield_verdict(pct: Column, least: float = 40.0, most: float = 85.0) -> Column:
    return F.when(pct < least, "low").when(pct > most, "high").otherwise("expected")


def verdict(bleu1: Column, val_loss: Column, train_loss: Column, top1: Column, empty: Column, vocab: Column) -> Column:
    """Flags in fixed order, comma-joined; a missing metric raises none; none: OK."""
    flag = lambda c, name: F.when(F.coalesce(c, F.lit(False)), F.lit(name))
    flags = F.array_compact(F.array(flag((F.coalesce(top1, F.lit(0.0)) > 0.20) | (F.coalesce(empty, F.lit(0.0)) > 0.30), "COLLAPSE"), flag((F.coalesce(bleu1, F.lit(1.0)) < 0.05) | F.coalesce(val_loss > 0.95 * F.log(vocab), F.lit(False)), "NOT_LEARNING"), flag(val_loss - train_loss > 0.5, "OVERFIT")))
    return F.when(F.size(flags) == 0, "OK").otherwise(F.array_join(flags, ","))


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of the table at a time: bit j of `row` is 0 where the row's length grows at b[j]."""
    where: dict = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for x in a:
        if at := row & where.get(x, 0):
            row = (row + at | row - at) & full
    return len(b) - row.bit_count()


def rouge_l(rows: DataFrame) -> DataFrame:
    """rows (sample_id, hyp, ref: arrays of words) -> sample_id, rouge_l: F1 of the longest common subsequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n = lcs(h or [], r or [])
                out.append(2 * n / (len(h) + len(r)) if n else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["sample_id", "rouge_l"])

    return rows.select("sample_id", "hyp", "ref").mapInArrow(run, f"sample_id {rows.schema['sample_id'].dataType.simpleString()}, rouge_l double")


def rouge_l_mean(rows: DataFrame) -> DataFrame:
    return rouge_l(rows).agg(F.coalesce(F.avg("rouge_l"), F.lit(0.0)).alias("rouge_l"), F.count("*").alias("n"))


def confidence(values: Column) -> Column:
    """struct: perplexity to 2 places and counts below .4, .6, .8 and from .8."""
    from ..functions.arrays import perplexity

    count = lambda f: F.size(F.filter(values, f)).cast("long")
    return F.struct(F.round(perplexity(values), 2).alias("perplexity"), count(lambda c: c < 0.4).alias("low"), count(lambda c: (c >= 0.4) & (c < 0.6)).alias("medium"), count(lambda c: (c >= 0.6) & (c < 0.8)).alias("good"), count(lambda c: c >= 0.8).alias("high"))
