"""Scans in blocks against scans by windows; one conversation has half of all turns."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from turnstone.operators import dialogue, pairs
from turnstone.operators.scan import Scan


@pytest.fixture(scope="module")
def turns(spark):
    r, start = random.Random(1), datetime.datetime(2024, 1, 1)
    ids = ["hot"] * 300 + [None] * 40 + [f"c{i}" for i in range(30) for _ in range(r.choice((1, 2, 9, 20)))]
    rows = [(i, k, start + datetime.timedelta(seconds=40 * k + r.choice((0, 0, 900))), r.choice(("a", "A", "b", "c")), r.choice(("one", "two words", "", None, f"three {k}"))) for k, i in enumerate(ids)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "id string, ord int, ts timestamp_ntz, speaker string, text string").repartition(5).cache()


def same(a, b):
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(a) == rows(b)


def test_blocks_equal_windows(spark, turns):
    for f in (
        lambda n: dialogue.shape(turns, limit=n), lambda n: dialogue.gaps(turns, limit=n), lambda n: dialogue.sessions(turns, 300, limit=n), lambda n: dialogue.islands(turns, limit=n),
        lambda n: dialogue.merged(turns, limit=n), lambda n: pairs.framed(turns, limit=n), lambda n: pairs.framed(turns, 200, limit=n), lambda n: pairs.history(turns, limit=n), lambda n: pairs.history(turns, 1, limit=n),
    ):
        same(f(1000), f(30))
    same(pairs.history(turns, limit=1000), pairs.history(turns, limit=0))


def test_a_large_group_is_spread(spark, turns):
    scan = Scan(turns.select("id", "ord", "text"), ["ord"], limit=100)
    sizes = [r["n"] for r in scan.blocks.filter("id = 'hot'").groupBy("part__").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 3 and sum(sizes) == 300 and max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
    assert scan.small.filter("id = 'hot'").isEmpty() and Scan(turns, ["ord"], limit=300).blocks is None
