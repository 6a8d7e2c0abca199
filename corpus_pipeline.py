"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnstone.llm import mixing, quality, secrets, sentencepiece, shingles
from turnstone.llm.common import fresh_dir

STAGES = [
    ("quality", lambda spark, docs, sf_dir: quality.filtered(docs)),
    ("near_duplicates", lambda spark, docs, sf_dir: shingles.keep_one_per_component(docs)),
    ("secrets", lambda spark, docs, sf_dir: secrets.redacted(docs)),
    ("mixing", lambda spark, docs, sf_dir: mixing.mixed(docs)),
    ("sentencepiece", lambda spark, docs, sf_dir: sentencepiece.encoded(docs)),
]

#: SQL can't express the stages (shingle links, library tokens); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_dir(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
