"""CSV records over many splits, .npy files, sketches, subsequences, streams' sinks."""

import csv
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstone import catalog, catalog_reports  # noqa: F401
from turnstone.operators import metrics, pairs
from turnstone.sources import npy, records, stages
from turnstone.sources import turns as source
from turnstone.streaming import history


def test_records_of_many_splits_equal_the_whole_file_reader(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice('ab ,"\n\n\r') for _ in range(r.choice((1, 5, 60))))
    rows = [["1", f"{i}", "2008-01-01T00:00:00Z", "bob", "x" + (word() if i % 3 else "\n" * 700 if i % 50 == 0 else "plain")] for i in range(1200)]
    for name in ("a.csv", "b.csv"):
        with open(tmp_path / name, "w", newline="") as f:
            out = csv.writer(f, lineterminator="\n" if name == "a.csv" else "\r\n")
            out.writerow(["folder", "dialogueID", "date", "from", "text"])
            out.writerows(rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = records.lines_of(spark, str(tmp_path))
        assert lines.select("file", "block").distinct().count() > 20
        got = records.parsed(records.records(spark, str(tmp_path)), ["folder", "dialogueID", "date", "from", "text"]).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name in ("a.csv", "b.csv"):
        own = [x for x in got if x["file"].endswith(name)]
        assert [x["dialogueID"] for x in own] == [x[1] for x in rows]
        plain = lambda t: t.replace("\r\n", "\n").replace("\r", "\n").strip()
        assert [plain(x["text"]) for x in own] == [plain(x[4]) for x in rows]


def test_bad_bytes_and_malformed_records(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'folder,dialogueID,date,from,text\n3,1,2008-01-01,bob,caf\xe9 \xff ok\n3,1,too,many,fields,here\n3\n\n3,2,,al,"never closed\nto the end\n')
    got = source.read_turns(spark, str(tmp_path)).orderBy("ord").collect()
    assert got[0]["text"] == "caf� � ok" and [x["id"] for x in got][:1] == ["3/1"] and len(got) <= 2


@pytest.mark.parametrize("kind", ["<f4", ">f4", "<f8", ">i2"])
def test_npy_files_in_many_tasks(spark, tmp_path, kind):
    rows = np.arange(5000 * 3).reshape(5000, 3).astype(kind)
    np.save(tmp_path / "m.npy", rows)
    df = npy.read_npy(spark, str(tmp_path / "m.npy"), range_bytes=4000)
    assert df.select(F.spark_partition_id()).distinct().count() >= 5
    got = df.orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(5000)) and np.array_equal(np.array([r["vec"] for r in got]), rows.astype("f4"))


def test_npy_refusals_and_round_trip(spark, tmp_path):
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 2))))
    np.save(tmp_path / "s.npy", np.array(["a"]))
    (tmp_path / "x.npy").write_bytes(b"nothing")
    for name in ("f", "s", "x"):
        with open(tmp_path / f"{name}.npy", "rb") as f, pytest.raises(ValueError):
            npy.header(f)
    m = spark.range(1000).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vec"))
    npy.write_npy(m, str(tmp_path / "out"), rows=100)
    files = sorted((tmp_path / "out").glob("*.npy"))
    assert len(files) >= 4 and np.concatenate([np.load(f) for f in files])[:, 0].tolist() == list(range(1000))
    assert [(r["id"], r["vec"][0]) for r in source.read_matrix(spark, str(tmp_path / "out")).orderBy("id").collect()] == [(i, float(i)) for i in range(1000)]


def test_subsequences_by_bits():
    r = random.Random(1)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            now = [0]
            for j, y in enumerate(b):
                now.append(row[j] + 1 if x == y else max(row[j + 1], now[j]))
            row = now
        return row[-1]

    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.choice((0, 1, 7, 40)))] for _ in range(2))
        assert metrics.lcs(a, b) == slow(a, b)
    a, b = ([r.choice("abcdefghij") for _ in range(20_000)] for _ in range(2))
    began = time.time()
    assert 9_000 < metrics.lcs(a, b) < 20_000 and time.time() - began < 3


def test_most_frequent_by_sketches(spark):
    r = random.Random(2)
    rows = [(f"r{min(int(r.paretovariate(0.7)), 4000)}", i) for i in range(6000)]
    df = spark.createDataFrame(rows, "t string, i long").repartition(4)
    count, first = Counter(t for t, _ in rows), {}
    for t, i in rows:
        first.setdefault(t, i)
    want = sorted(((-n, first[t], t) for t, n in count.items()))[:20]
    for counters in (100_000, 600, 3):
        got = metrics.top_responses(df, "t", "i", 20, counters).collect()
        assert [(-x["n"], x["first_seen"], x["t"]) for x in got] == want, counters
    assert metrics.top_responses(df.limit(0), "t", "i").count() == 0


def test_caps_of_frequent_responses(spark):
    rows = [(f"d{i % 7}", i, "same" if i % 2 else f"r{i % 5}") for i in range(300)]
    df = spark.createDataFrame(rows, "id string, pos int, resp string").withColumn("reason", F.when(F.col("pos") % 9 == 0, "ctx_too_short").otherwise("kept"))
    seen, want = Counter(), {}
    for i, p, t in sorted(rows):
        reason = "ctx_too_short" if p % 9 == 0 else "kept"
        if reason == "kept":
            seen[t] += 1
            reason = "diversity_cap" if seen[t] > 20 else "kept"
        want[p] = reason
    assert {x["pos"]: x["reason"] for x in pairs.labelled_again(df, 20).collect()} == want


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.25)], "tag string, step long, value double")
    for n in (0, 1, 1, 0):
        history.append_batch(df, n, f"file://{tmp_path}/rows")
    assert spark.read.parquet(f"file://{tmp_path}/rows").count() == 4


def test_observed_facts_equal_counts(spark, tmp_path):
    df = spark.range(1000).repartition(5)
    assert stages.observed(df, f"file://{tmp_path}/x", n=F.count("*"), top=F.max("id")) == {"n": 1000, "top": 999} and spark.read.parquet(f"file://{tmp_path}/x").count() == 1000


def test_histories_expire(spark, tmp_path):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    parts = [[(1, 0, 0, "hello"), (1, 1, 1, "there"), (2, 0, 0, "other")], [(2, 1, 300, "much later")], [(1, 2, 301, "again"), (2, 2, 301, "soon")]]
    for part in parts:
        rows = [(i, o, start + datetime.timedelta(hours=h), t) for i, o, h, t in part]
        df = spark.createDataFrame(rows, "id long, ord long, ts timestamp, text string").coalesce(1)
        df.write.mode("append").parquet(f"{tmp_path}/in")
        found = history.rolling(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
        found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {(r["id"], r["ord"]): r["history"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got[1, 1] == "hello __eot__ there" and got[1, 2] == "again" and got[2, 2] in ("much later __eot__ soon", "other __eot__ much later __eot__ soon") and len(got) == 6
