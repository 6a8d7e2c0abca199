"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What counts as a word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Of `likely`: bits for each key; bits of a bitmap; most bitmaps, which are 8 MB (Spark itself broadcasts up to 10 MB).
KEY_BITS, BITMAP_BITS, BITMAPS = 32, 1 << 15, 2048


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on local cores (tests), and
    an error on a cluster, where each executor would write to its own disk."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="turnstone-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Evaluates df once into the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df by way of a table in the shared folder. Unlike a checkpoint's, its size is known: a join broadcasts it if it is small."""
    out = fresh_dir(df.sparkSession, name)
    df.write.parquet(out)
    return df.sparkSession.read.parquet(out)


def likely(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """df with likely__: false only where `key` is no value of the column in keys; of other rows, at most 1 in 32 is true by chance, up to two million keys.

    So rows of large texts that a join by few keys does not concern need no shuffle, and an exact join takes the rest. Each key sets a bit by its
    hash; bitmaps are broadcast. They are at most `BITMAPS`: with more keys more rows are true by chance, and a join shuffles more."""
    n = BITMAP_BITS * max(1, min(BITMAPS, -(-keys.count() * KEY_BITS // BITMAP_BITS)))
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(n))
    place, at = F.shiftright(bit, 15), bit.bitwiseAND(F.lit(BITMAP_BITS - 1))
    maps = keys.groupBy(place.alias("map__")).agg(F.bitmap_construct_agg(at).alias("bits__"))
    byte = F.conv(F.hex(F.substring("bits__", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = df.withColumn("place__", place).join(F.broadcast(maps), F.col("place__") == F.col("map__"), "left")
    is_set = F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return found.select(*[F.col(f"`{c}`") for c in df.columns], is_set.alias("likely__"))


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def words(text: Column) -> Column:
    """array<string> of a text's words; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, group: str, order: list) -> DataFrame:
    """df with rank__: a row's place (from 0) within its group, by `order`.

    Not a window over the group, which would take a large one into one task: rows are sorted by range over all tasks and
    written, counted per task and group, and the counts (one row for each task and group) give each task its start."""
    spark, place = df.sparkSession, [group, *order]
    parts, out = int(spark.conf.get("spark.sql.shuffle.partitions")), fresh_dir(spark, "ranked")
    dealt = df.repartitionByRange(parts, *place).sortWithinPartitions(*place)
    dealt.withColumns({"part__": F.spark_partition_id(), "at__": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(out)
    dealt = spark.read.parquet(out)
    blocks = dealt.groupBy("part__", group).agg(F.count("*").alias("n"), F.min("at__").alias("lowest"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("part__").alias("part_"), F.col(group).alias("group_"), (ahead - F.col("lowest")).alias("shift_"))
    found = dealt.join(blocks, (F.col("part__") == F.col("part_")) & F.col(group).eqNullSafe(F.col("group_")))
    return found.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("at__") + F.col("shift_")).alias("rank__"))
