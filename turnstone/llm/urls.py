"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

Rules are looked up by the host's suffixes; the longest rule whose path begins the url's path wins. The trees are trained
on the urls that rules label, over at most `sample` rows in order of a hash of the url (the one bounded sample of this
module), and judge the urls that no rule fits.

Defined results: a null url, or one without `://`, has empty host and path and is judged by the trees; repeated rows get
equal verdicts; an empty table gives no rows; where rules label no url or only one kind, the verdict without a rule is
allow.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
FEATURES = ("length", "depth", "digits", "entropy", "parameters", "host_labels", "host_length", "suffix_length", "hyphens", "secure", "suffix_share", "suffix_depth")


def parts(url: Column) -> tuple[Column, Column]:
    ok = url.contains("://")
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(ok, host).otherwise(""), F.when(ok, path).otherwise("")


def ruled(host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; both null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, start in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        rule, verdict = F.when(fits, at + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def with_features(df: DataFrame) -> DataFrame:
    """df (url, host, path) with the lexical features; suffix statistics are counted over all rows."""
    url = F.coalesce(F.col("url"), F.lit(""))
    count = lambda c: (F.length(url) - F.length(F.translate(url, c, ""))).cast("double")
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    letters = F.array_distinct(F.filter(F.split(url, ""), lambda c: c != ""))
    entropy = -F.aggregate(letters, F.lit(0.0), lambda acc, c: acc + F.when(F.length(c) > 0, (lambda p: p * F.log2(p))(F.greatest(F.lit(1e-9), (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n))).otherwise(0.0))
    df = df.withColumns({
        "suffix": F.element_at(F.split("host", r"\."), -1), "length": n, "digits": count("0123456789") / n, "entropy": entropy,
        "depth": (F.length("path") - F.length(F.translate("path", "/", ""))).cast("double"), "parameters": count("=&?"), "hyphens": count("-_"),
        "host_labels": F.size(F.split("host", r"\.")).cast("double"), "host_length": F.length("host").cast("double"), "secure": url.startswith("https").cast("double"),
    }).withColumn("suffix_length", F.length("suffix").cast("double"))
    whole = df.agg(F.count("*").alias("all_rows"))
    suffixes = df.groupBy("suffix").agg(F.count("*").alias("suffix_rows"), F.avg("depth").alias("suffix_depth"))
    total = whole.first()["all_rows"] or 1
    return df.join(suffixes, "suffix").withColumn("suffix_share", F.col("suffix_rows") / F.lit(float(total)))


def filtered(pages: DataFrame, sample: int = 20_000, trees: int = 8, depth: int = 4) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' probability of block; null where they can't be trained)."""
    host, path = parts(F.col("url"))
    df = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"))
    df = cut(with_features(df.withColumns({"rule": rule, "ruled": verdict})).select("page_id", "url", "host", "path", "rule", "ruled", *FEATURES))
    labelled = df.filter("ruled is not null").select(*FEATURES, (F.col("ruled") == "block").cast("double").alias("label"), F.xxhash64("url", "page_id").alias("h"))
    labelled = cut(labelled.orderBy("h", *FEATURES).limit(sample))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    if labelled.select("label").distinct().count() == 2:
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, cacheNodeIds=False).fit(assembler.transform(labelled))
        df = model.transform(assembler.transform(df)).withColumn("score", F.get(vector_to_array("probability"), 1))
    else:
        df = df.withColumn("score", F.lit(None).cast("double"))
    judged = F.coalesce(F.col("ruled"), F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return df.select("page_id", "host", "path", "rule", judged.alias("verdict"), "score")


def op8_urls(spark, sf_dir: str) -> DataFrame:
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"))
