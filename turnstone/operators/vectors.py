"""Embedding tables: norms, cosine, neighbours, duplicates, coverage, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A


def norm_stats(vectors: DataFrame, vec: str) -> DataFrame:
    n = A.norm(F.col(vec))
    df = vectors.select(n.alias("n"))
    some = F.when(F.col("n") > 1e-6, F.col("n"))
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.col("n") <= 1e-6).alias("n_zero"), F.round(F.avg(some), 6).alias("mean"), F.round(F.stddev_pop(some), 6).alias("std"), F.round(F.min(some), 6).alias("min"), F.round(F.max(some), 6).alias("max"), F.round(F.count(some) / F.count("*"), 6).alias("coverage"))


def non_finite(vectors: DataFrame, vec: str) -> DataFrame:
    x = vectors.select(F.explode(vec).alias("x")).select(F.col("x").cast("double").alias("x"))
    return x.agg(F.count_if(F.isnan("x")).alias("n_nan"), F.count_if(F.abs("x") == float("inf")).alias("n_inf"), F.count("*").alias("n_values"))


def nearest(vectors: DataFrame, query: list[float], key: str, vec: str, k: int = 5, but: object = None) -> DataFrame:
    """The k nearest by cosine to one stated vector, without the row of the key `but`: a top-k report."""
    q = F.array(*[F.lit(float(x)) for x in query])
    vectors = vectors if but is None else vectors.filter(F.col(key) != but)
    return vectors.select(key, F.round(A.cosine(F.col(vec), q), 6).alias("cosine")).orderBy(F.desc("cosine"), key).limit(k)


def centroids(vectors: DataFrame, by: str, vec: str) -> DataFrame:
    """by, centroid: element-wise means, summed with partial aggregation by element."""
    long = vectors.select(by, F.posexplode(vec).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return long.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def rounded_duplicates(vectors: DataFrame, vec: str, places: int = 3) -> DataFrame:
    key = F.transform(F.col(vec), lambda x: F.round(x.cast("double"), places))
    per = vectors.groupBy(F.xxhash64(key).alias("h"), key.alias("k")).count()
    return per.agg(F.count("*").alias("n_distinct"), F.sum("count").alias("n_rows"))


def matrix(vocab: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """vocab (id, piece) with its vector; zeros where there is none, and for the padding id 0."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return vocab.join(vectors, "piece", "left").select("id", "piece", F.when(F.col("id") == 0, zeros).otherwise(F.coalesce("vec", zeros)).alias("vec"))


def audit(vectors: DataFrame, vec: str, dim: int) -> DataFrame:
    """section, name, status rows: shape, non-finite, coverage."""
    df = vectors.agg(F.count_if(F.size(vec) != dim).alias("shape"), F.sum(F.size(F.filter(vec, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))).alias("finite"), F.avg((A.norm(F.col(vec)) > 1e-6).cast("double")).alias("c"))
    checks = [("A", "shape", F.col("shape") == 0), ("A", "finite", F.col("finite") == 0), ("A", "coverage", F.col("c") >= 0.999)]
    rows = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), F.when(c, "PASS").otherwise("FAIL").alias("status")) for s, n, c in checks])
    return df.select(F.explode(rows).alias("r")).select("r.*")


def status(ok, warn: bool = False):
    return F.when(ok, "PASS").otherwise("WARN" if warn else "FAIL")


def checks(row: DataFrame, section: str, rules: dict, warn: bool = False) -> DataFrame:
    """section, name, status of each rule over one row of facts."""
    rows = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(n).alias("name"), status(c, warn).alias("status")) for n, c in rules.items()])
    return row.select(F.explode(rows).alias("r")).select("r.*")


def audit_alignment(vocab: DataFrame, table: DataFrame, specials: tuple[str, ...], words: dict[str, int]) -> DataFrame:
    """Section B: vocabulary (piece, id) against matrix (id, vec): sizes, ids of special pieces and words, which rows are zero."""
    n = A.norm(F.col("vec"))
    facts = table.agg(
        F.count("*").alias("n_rows"), F.count_if((F.col("id") == 0) & (n >= 1e-6)).alias("pad"), F.count_if(F.col("id").between(1, 3) & (n <= 1e-6)).alias("marks"),
        F.count_if(F.col("id").between(4, len(specials) - 1) & (n <= 1e-6)).alias("tags"), F.avg(F.when(F.col("id") > 0, (n > 1e-6).cast("double"))).alias("filled"),
    )
    sizes = vocab.agg(F.count("*").alias("n_pieces"))
    rules = {"vocabulary size": F.col("n_pieces") == F.col("n_rows"), "pad row zero": F.col("pad") == 0, "sentinel rows": F.col("marks") == 0, "tag rows": F.col("tags") == 0, "filled rows": F.col("filled") >= 0.999}
    whole = checks(facts.join(sizes), "B", rules)  # one row each
    expected = table.sparkSession.createDataFrame([*((p, i) for i, p in enumerate(specials)), *words.items()], "piece string, expected long")
    ids = expected.join(vocab, "piece", "left").select(F.lit("B").alias("section"), F.concat(F.lit("id of "), "piece").alias("name"), status(F.coalesce(F.col("id") == F.col("expected"), F.lit(False))).alias("status"))
    return whole.unionByName(ids)


def audit_meaning(vocab: DataFrame, table: DataFrame, related: list[tuple[str, str, str]], apart: list[tuple[str, str]]) -> DataFrame:
    """Section G: sim(a, b) > sim(a, c) for stated words, skipped where one is missing; stated pairs below 0.95. Warnings only."""
    spark = table.sparkSession
    vec = vocab.join(table, "id").select("piece", "vec")
    named = lambda c: vec.select(F.col("piece").alias(c), F.col("vec").alias(f"v_{c}"))
    triples = spark.createDataFrame(related, "a string, b string, c string")
    for c in ("a", "b", "c"):
        triples = triples.join(named(c), c, "left")
    nearer = A.cosine(F.col("v_a"), F.col("v_b")) > A.cosine(F.col("v_a"), F.col("v_c"))
    missing = F.col("v_a").isNull() | F.col("v_b").isNull() | F.col("v_c").isNull()
    triples = triples.select(F.lit("G").alias("section"), F.concat_ws(" ", "a", "b", "c").alias("name"), F.when(missing, "SKIP").otherwise(status(nearer, True)).alias("status"))
    pairs = spark.createDataFrame(apart, "a string, b string")
    for c in ("a", "b"):
        pairs = pairs.join(named(c), c)
    return triples.unionByName(pairs.select(F.lit("G").alias("section"), F.concat_ws(" ", "a", "b").alias("name"), status(A.cosine(F.col("v_a"), F.col("v_b")) < 0.95, True).alias("status")))


def looked_up(batch: DataFrame, table: DataFrame, dim: int) -> DataFrame:
    """batch (row, at, id) with vec; the padding id 0 has zeros."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return batch.join(table.select("id", "vec"), "id", "left").select("row", "at", "id", F.when(F.col("id") == 0, zeros).otherwise(F.col("vec")).alias("vec"))


def audit_lookup(table: DataFrame, batch: DataFrame, dim: int) -> DataFrame:
    """Section H: what a batch of ids looks up: rows of the matrix, zeros for padding, one vector of the dimension for each id."""
    found = looked_up(batch, table, dim).join(table.select("id", F.col("vec").alias("row_vec")), "id", "left")
    gap = F.array_max(F.zip_with("vec", "row_vec", lambda a, b: F.abs(a - b)))
    facts = found.agg(
        F.count_if((F.col("id") == 0) & (A.norm(F.col("vec")) >= 1e-7)).alias("pad"), F.count_if((F.col("id") > 0) & F.coalesce(gap >= 1e-5, F.lit(True))).alias("other"),
        F.count_if(F.coalesce(F.size("vec"), F.lit(0)) != dim).alias("shape"), F.count_if((F.col("id") > 0) & F.coalesce(A.norm(F.col("vec")) <= 1e-6, F.lit(True))).alias("zero"),
    )
    return checks(facts, "H", {"padding is zero": F.col("pad") == 0, "rows of the matrix": F.col("other") == 0, "shape": F.col("shape") == 0, "no zero rows": F.col("zero") == 0})


def summary(statuses: DataFrame) -> DataFrame:
    """n_pass, n_warn, n_fail, n_skip, total and the exit code: 1 with a failure."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("PASS", "WARN", "FAIL", "SKIP")]
    return statuses.agg(*counts, F.count("*").alias("total")).withColumn("exit_code", (F.col("n_fail") > 0).cast("int"))
