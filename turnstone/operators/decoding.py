"""Decoding over a table of step distributions, and history rules; the network itself is a function given by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..sources import stages


def greedy(steps: DataFrame) -> DataFrame:
    """steps (sample_id, step, logits) -> sample_id, ids: the largest logit of each step up to the end id."""
    best = steps.select("sample_id", "step", (F.array_position("logits", F.array_max("logits")) - 1).cast("int").alias("id"))
    ended = F.min(F.when(F.col("id") == A.EOS, F.col("step"))).over(Window.partitionBy("sample_id"))
    kept = best.withColumn("end", ended).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.when(F.col("end").isNull() | (F.col("step") < F.col("end")), F.struct("step", "id")))).alias("s"))
    return kept.select("sample_id", F.transform("s", lambda x: x["id"]).alias("ids"))


def beams(candidates: DataFrame, width: int, penalty: float = 0.7) -> DataFrame:
    """candidates (sample_id, beam, logp, length): the best `width` of each sample by penalised score."""
    score = A.beam_score(F.col("logp"), F.col("length"), penalty)
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("score"), "beam"))
    return candidates.withColumn("score", score).withColumn("rank", rank).filter(F.col("rank") <= width)


def beam_search(scores: Callable[[DataFrame], DataFrame], samples: DataFrame, width: int = 5, steps: int = 40, penalty: float = 0.7) -> DataFrame:
    """sample_id, ids, score: the best finished sequence of each sample (sample_id).

    `scores` turns beams (sample_id, ids, logp) into candidates (sample_id, ids, logp, id, lp): the `width` best next ids of each. A
    beam that takes the end id is finished; its score is divided by length ** penalty with the end counted, but not after the first step.
    What is left after the last step is finished too. Of equal scores the smaller ids come first."""
    order = lambda s: Window.partitionBy("sample_id").orderBy(F.desc(s), "ids")
    active = samples.select("sample_id", F.array().cast("array<int>").alias("ids"), F.lit(0.0).alias("logp"))
    done = None
    for step in range(steps):
        made = scores(active).select("sample_id", F.col("ids").alias("before"), (F.col("logp") + F.col("lp")).alias("logp"), F.col("id").cast("int").alias("id"))
        n = F.size("before") + 1
        ended = made.filter(F.col("id") == A.EOS).select("sample_id", F.col("before").alias("ids"), (F.col("logp") if step == 0 else A.beam_score(F.col("logp"), n, penalty)).alias("score"))
        done = ended if done is None else done.unionByName(ended)
        going = made.filter(F.col("id") != A.EOS).select("sample_id", F.concat("before", F.array("id")).alias("ids"), "logp", A.beam_score(F.col("logp"), n, penalty).alias("score"))
        active = going.withColumn("rank", F.row_number().over(order("score"))).filter(F.col("rank") <= width).select("sample_id", "ids", "logp")
        active = stages.kept(active, "beams")  # else each step's plan would hold all steps before it
    done = done.unionByName(active.select("sample_id", "ids", A.beam_score(F.col("logp"), F.size("ids"), penalty).alias("score")))
    return done.withColumn("rank", F.row_number().over(order("score"))).filter("rank = 1").drop("rank")


def nucleus_ids(logits: list, draws: list, top_p: float, temperature: float, block: int) -> list[int]:
    ids: list[int] = []
    for scores, u in zip(logits, draws):
        x = np.array(scores, float)
        last = ids[len(ids) - block + 1 :] if len(ids) >= block - 1 > 0 else None
        stop = {ids[k + block - 1] for k in range(len(ids) - block + 1) if ids[k : k + block - 1] == last} if last else set()
        if stop and len(stop) < len(x):
            x[list(stop)] = -np.inf
        p = np.exp((x - x.max()) / max(temperature, 1e-8))
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        best = p[order]
        best[best.cumsum() - best > top_p] = 0.0
        drawn = int(order[min(np.searchsorted(best.cumsum() / best.sum(), u, side="right"), len(x) - 1)])
        if drawn == A.EOS:
            break
        ids.append(drawn)
    return ids


def top_p_decode(steps: DataFrame, top_p: float = 0.9, temperature: float = 0.8, block: int = 3) -> DataFrame:
    """steps (sample_id, step, logits, u) -> sample_id, ids.

    At each step ids that would repeat an n-gram are blocked (unless that is all), the rest go through temperature, softmax and
    nucleus; u in [0, 1) draws the id, most probable ones first. The end id ends a sequence and is not part of it. A sample's
    steps are few (its maximal length); samples are decoded in Arrow batches."""
    rows = steps.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("step", "logits", "u"))).alias("s"))
    rows = rows.select("sample_id", F.transform("s", lambda x: x["logits"]).alias("logits"), F.transform("s", lambda x: x["u"]).alias("u"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [nucleus_ids(x, u, top_p, temperature, block) for x, u in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["sample_id", "ids"])

    return rows.mapInArrow(run, f"sample_id {steps.schema['sample_id'].dataType.simpleString()}, ids array<int>")


def attention(query: Column, keys: Column, v: Column, mask: Column) -> Column:
    """Weights of additive attention: softmax over keys (already projected, as the query) of v . tanh(key + query); masked keys get 0."""
    energy = F.transform(keys, lambda k: A.dot(v, F.transform(F.zip_with(k, query, lambda a, b: a + b), F.tanh)))
    return A.softmax(F.zip_with(energy, mask, lambda e, m: F.when(m, float("-inf")).otherwise(e)))


def generated(rows: DataFrame, model: Callable[[list[list[int]]], list[list[int]]], key: str = "sample_id", ctx: str = "ctx") -> DataFrame:
    """key, hyp: any network as a function from batches of contexts to batches of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model(batch.column(1).to_pylist()), pa.list_(pa.int32()))], names=[key, "hyp"])

    return rows.select(key, ctx).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, hyp array<int>")


def early_stop(history: DataFrame, after: int = 5, patience: int = 4) -> DataFrame:
    """history (model, epoch, val_loss) with best_before, improved, since and stopped: epochs without gain, after a phase."""
    order = Window.partitionBy("model").orderBy("epoch")
    df = history.withColumn("best_before", F.min("val_loss").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("improved", F.col("best_before").isNull() | (F.col("val_loss") < F.col("best_before")))
    last = F.max(F.when(F.col("improved") | (F.col("epoch") <= after), F.col("epoch"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("since", F.col("epoch") - last).withColumn("stopped", F.col("since") >= patience)
