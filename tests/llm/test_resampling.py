"""Resampling against a plain version that hashes every feature's text, and odd rows; the new queries against their SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from turnstone.llm import queries, resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target, percent=5):
    """(id, text) rows -> (id, n_features, weight, score, rank) of each row."""
    own, other = [features(t) for _, t in docs], Counter(b for t in target for b in features(t)[1])
    ours = Counter(b for _, f in own for b in f)
    s, t = sum(ours.values()), sum(other.values())
    gain = {b: math.floor(1000 * math.log((other[b] + 1) * (s + 10_000) / ((ours[b] + 1) * (t + 10_000)))) for b in ours}
    rows = []
    for (key, _), (n, f) in zip(docs, own):
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(str, (r[:5] for r in rows)))


def got(df):
    return sorted(str(list(r)) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    words = ["the", "Of", "a1", "é", "Ünï", "x" * 300, "y" * 1000] + [f"w{i}" for i in range(40)]
    texts = [r.choice((" ", "-", ". ")).join(r.choice(words[: r.choice((4, 47))]) for _ in range(r.choice((0, 1, 2, 19, 20, 60, 400)))) for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[40] + " z" * 30), (900, None), (901, "the " * 30_000), (902, "the " * 30_000)]
    return docs, texts[100:120] + [None, ""]


def test_equals_plain_version(spark, rows):
    docs, target = rows
    own = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, part int").repartition(3)
    other = spark.createDataFrame([(t,) for t in target], "text string")
    want = plain(docs, target, 30)
    assert sum("None]" not in x for x in want) > 30
    assert got(resampling.resampled(own, other, percent=30)) == want


def test_defined_results(spark, rows):
    docs, target = rows
    own = spark.createDataFrame(docs, "doc_id long, text string")
    other = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(resampling.resampled(own, other.limit(0))) == plain(docs, [])
    assert resampling.resampled(own.limit(0), other).count() == 0
    text = own.selectExpr("concat('k', doc_id) as doc_id", "text")
    assert {r["doc_id"] for r in resampling.weighed(text, other).collect()} >= {"k7", None}


def test_remainders_of_any_length():
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 255, 256, 257, 511, 5000):
        head, tail = r.bytes(9), r.bytes(n)
        crc = resampling.shifted(np.array([zlib.crc32(head)], np.uint32), np.array([n]))[0] ^ np.uint32(zlib.crc32(tail))
        assert crc == zlib.crc32(head + tail)


@pytest.mark.parametrize("name", ["op11_resampling", "op12_perplexity", "op13_collocations"])
def test_queries_equal_their_sql(spark, name):
    folder, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = queries.queries()[name](spark, folder)
    want = db.execute(f"select {', '.join(df.columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want)) and len(want) > 20
