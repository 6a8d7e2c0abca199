"""Records of CSV files in many tasks: where quoted fields hold line breaks, a file is still split.

A split's lines can be told from records only with the parity of the quotes before it. So quotes are counted by split first, a row for each split adds them
up along its file, and each split then cuts its lines into records from the parity that it begins with. A record that goes on
beyond its split is stitched from its pieces, of which each split has two at most; all other records stay where they were read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import stages

WHOLE, HEAD, MIDDLE, TAIL = 0, 1, 2, 3  # of a record: all of it; its end, a split within it, its beginning
FILE_BITS = 44  # a record's number is its file's, then a place of at most the file's length


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where the split begins), at, value: lines by line feeds; bytes that are no UTF-8 become replacement characters."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.make_valid_utf8("value").alias("value"))


def quotes(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, ord, record: records with their line breaks, numbered in order of files and places (not densely)."""
    lines = lines_of(spark, path)
    splits = lines.groupBy("file", "block").agg(F.sum(quotes(F.col("value"))).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    number = F.dense_rank().over(Window.orderBy("file")) - 1
    out = stages.scratch(spark, "splits")
    splits.select("file", "block", before.alias("inside"), number.cast("long").alias("number")).write.parquet(out)
    dealt = lines.join(spark.read.parquet(out), ["file", "block"]).sortWithinPartitions("file", "block", "at")
    pieces = dealt.select("file", "block", "value", "inside", "number").mapInArrow(cut, "file string, number long, block long, line long, kind int, text string")
    ord_ = (F.shiftleft("number", FILE_BITS) + F.col("block") + F.col("line")).alias("ord")
    whole = pieces.filter(F.col("kind") == WHOLE).select("file", ord_, F.col("text").alias("record"))
    parts = pieces.filter(F.col("kind") != WHOLE)
    begun = F.sum((F.col("kind") == TAIL).cast("int")).over(Window.partitionBy("file").orderBy("block", "line"))
    stitched = parts.withColumn("begun", begun).groupBy("file", "number", "begun").agg(F.array_sort(F.collect_list(F.struct("block", "line", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    first = F.element_at("p", 1)
    return whole.unionByName(stitched.select("file", (F.shiftleft("number", FILE_BITS) + first["block"] + first["line"]).alias("ord"), text.alias("record")))


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of splits whose lines follow one another."""
    split, line, held, begun_here, inside = None, 0, [], True, False
    names = ["file", "number", "block", "line", "kind", "text"]

    def rest() -> list[tuple]:
        return [(split[0], split[1], split[2], first, TAIL if begun_here else MIDDLE, "\n".join(held))] if held else []

    first = 0
    for batch in batches:
        out = []
        for file, block, value, begins_inside, number in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, number, block) != split:
                out += rest()
                split, line, first, held, inside = (file, number, block), 0, 0, [], begins_inside
                begun_here = not inside
            held.append(value)
            inside ^= value.count('"') % 2 == 1
            line += 1
            if not inside:
                out.append((*split, first, WHOLE if begun_here else HEAD, "\n".join(held)))
                held, first, begun_here = [], line, True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names).cast(PIECES)
    if split and held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rest())], names=names).cast(PIECES)


PIECES = pa.schema([("file", pa.string()), ("number", pa.int64()), ("block", pa.int64()), ("line", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])


def parsed(found: DataFrame, names: list[str]) -> DataFrame:
    """file, ord and a string column for each name; records with another number of fields, empty ones and the files' first ones (headers) are left out."""
    fields = ", ".join(f"`{n}` string" for n in names)
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt__", "maxCharsPerColumn": "-1"}
    line = F.regexp_replace("record", "\r$", "")
    body = found.filter((F.col("ord").bitwiseAND(F.lit((1 << FILE_BITS) - 1)) != 0) & (line != ""))
    row = body.select("file", "ord", F.from_csv(line, f"{fields}, corrupt__ string", options).alias("r"))
    return row.filter("r.corrupt__ is null").select("file", "ord", *[F.col("r").getField(n).alias(n) for n in names])
