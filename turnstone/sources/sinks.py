"""Sinks: id pairs as JSON lines, metrics as a long table, sample files, attention tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import npy


def write_pairs(pairs: DataFrame, path: str) -> None:
    """One compact JSON object a line; each task commits its file whole."""
    pairs.select("ctx", "resp").write.mode("overwrite").json(path)


def write_vocab(vocab: DataFrame, path: str) -> None:
    vocab.orderBy("id").select("piece", "id").coalesce(1).write.mode("overwrite").json(path)


def long_metrics(row: DataFrame, section: str) -> DataFrame:
    """One row of metrics as section, metric, value."""
    cast = row.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in row.columns])
    return cast.unpivot([], cast.columns, "metric", "value").select(F.lit(section).alias("section"), "metric", "value")


def sample_lines(pairs: DataFrame, n: int = 200, seed: int = 42) -> DataFrame:
    """n numbered text blocks for reading."""
    h = F.md5(F.concat_ws(":", "id", F.col("pos").cast("string"), F.lit(str(seed))))
    from pyspark.sql import Window

    top = pairs.withColumn("h", h).orderBy("h").limit(n).withColumn("k", F.row_number().over(Window.orderBy("h")))
    return top.orderBy("k").select(F.concat(F.lit("── Pair "), F.lpad(F.col("k").cast("string"), 3, "0"), F.lit("\nCTX:  "), F.replace("ctx", F.lit("__eot__"), F.lit("|")), F.lit("\nRESP: "), F.col("resp"), F.lit("\n")).alias("value"))


def attention_long(rows: DataFrame) -> DataFrame:
    """sample_id, attn (array of arrays) -> sample_id, t, s, weight: what a heat map plots."""
    t = rows.select("sample_id", F.posexplode("attn").alias("t", "row"))
    return t.select("sample_id", "t", F.posexplode("row").alias("s", "weight"))


def write_idx2word(vocab: DataFrame, path: str) -> None:
    """One JSON object from ids to pieces; a vocabulary is small by its size parameter."""
    pairs = vocab.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "piece")))).alias("m"))
    pairs.select(F.to_json("m").alias("value")).write.mode("overwrite").text(path)


def markdown(table: DataFrame, title: str) -> DataFrame:
    """line, value: a heading and a table of a metric table's columns, metrics in order; missing values are dashes."""
    names = [c for c in table.columns if c != "metric"]
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in names]
    from pyspark.sql import Window

    rows = table.select(F.row_number().over(Window.orderBy("metric")).alias("k"), F.concat(F.lit("| "), F.concat_ws(" | ", "metric", *cells), F.lit(" |")).alias("value"))
    head = [f"## {title}", "", "| Metric | " + " | ".join(c.capitalize() for c in names) + " |", "|" + "---|" * (len(names) + 1)]
    top = table.sparkSession.createDataFrame(list(enumerate(head)), "line int, value string")
    return top.unionByName(rows.select((F.col("k") + len(head) - 1).cast("int").alias("line"), "value"))


def results_json(metrics: DataFrame) -> DataFrame:
    """value: one JSON object of all metrics (metric, value), names in order."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value"))))
    return metrics.agg(F.to_json(pairs).alias("value"))


def append_scalars(rows: DataFrame, path: str) -> None:
    """tag, step, value rows are added to the table; earlier ones stay."""
    rows.select("tag", "step", "value").write.mode("append").parquet(path)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """id, vec as a folder of .npy files, float32, rows in order of ids."""
    npy.write_npy(matrix, path)
