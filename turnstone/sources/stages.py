"""Stages kept on disk: made once, read again afterwards; listings of what a folder holds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir, on local cores alone else a temporary one."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="turnstone-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the session's Hadoop configuration."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def is_done(spark: SparkSession, path: str) -> bool:
    store, at = hadoop_path(spark, f"{path}/_SUCCESS")
    return store.exists(at)


def stage(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The stage's table, read if it was written whole before (the writer's _SUCCESS marks that), else made and written."""
    path = f"{folder}/{name}"
    if not is_done(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df by way of a table in the shared folder."""
    out = scratch(df.sparkSession, name)
    df.write.parquet(out)
    return df.sparkSession.read.parquet(out)


def observed(df: DataFrame, path: str, **facts: Column) -> dict:
    """Writes df and returns facts (aggregates by name) taken in the same pass. Spark takes each partition's once, from the attempt that succeeded."""
    seen = Observation()
    df.observe(seen, *[c.alias(k) for k, c in facts.items()]).write.mode("overwrite").parquet(path)
    return seen.get


def cleaned_up(spark: SparkSession, folder: str, names: Iterable[str]) -> list[str]:
    """Removes the named intermediate stages; the names that were there."""
    gone = []
    for name in names:
        store, at = hadoop_path(spark, f"{folder}/{name}")
        if store.exists(at) and store.delete(at, True):
            gone.append(name)
    return gone


def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """name, kind (best, last, step, other), step of the files of a folder; steps are those with a number in the name. In order: the best, the last,
    steps ascending, others by name."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    step = F.regexp_extract("name", r"step_?(\d+)", 1)
    kind = F.when(F.col("name").contains("best"), "best").when(F.col("name").contains("last"), "last").when(step != "", "step").otherwise("other")
    place = F.array_position(F.array(*map(F.lit, ("best", "last", "step", "other"))), F.col("kind"))
    return files.select("name", kind.alias("kind"), F.when(step != "", step).cast("long").alias("step")).distinct().orderBy(place, "step", "name")
