"""Streaming variants: session windows with a watermark, and cleaning of a stream of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def watched(path: str) -> str:
    """The path of a table, one file or a folder of files, as a stream takes both: a pattern that fits it alone (a plain path must be a folder)."""
    return f"{path[:-1]}[{path[-1]}]"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).parquet(watched(f"{folder}/{name}")).withColumn("ts", F.col("ts").cast("timestamp"))


def session_counts(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n: a session ends after a gap; rows later than the watermark are dropped."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def cleaned(turns: DataFrame, column: str = "text") -> DataFrame:
    """Stateless cleaning works on streams as on tables."""
    return turns.withColumn(column, T.clean(F.col(column)))


def replayed(spark: SparkSession, events: DataFrame, folder: str, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """All sessions of a finite stream, the open ones too, from a file sink.

    Events are written into the watched folder and run to their end; then an event far ahead, of no user, moves the watermark past
    every open session, and the stream is run on from its checkpoint."""
    source, sink = f"{folder}/in", f"{folder}/out"

    def run() -> None:
        stream = spark.readStream.schema(events.schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
        out = session_counts(stream, gap, late)
        out.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    events.write.mode("append").parquet(source)
    run()
    ahead = events.agg((F.max("ts") + F.expr("interval 3650 days")).cast(events.schema["ts"].dataType).alias("ts"))
    ahead.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields]).write.mode("append").parquet(source)
    run()
    return spark.read.parquet(sink).filter("user_id is not null")
