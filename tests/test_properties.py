"""Properties of the text functions over generated strings."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnstone.functions import arrays as A
from turnstone.functions import text as T

LOOSE = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@LOOSE
@given(st.lists(st.text(max_size=60), min_size=1, max_size=40))
def test_clean_alphabet(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(T.clean(F.col("t")).alias("c")).collect():
        assert re.fullmatch(r"[a-z0-9 '\-_.]*", r["c"]) and "  " not in r["c"] and r["c"] == r["c"].strip()


@LOOSE
@given(st.lists(st.lists(st.integers(4, 99), max_size=60), min_size=1, max_size=20), st.integers(1, 50))
def test_slices(spark, arrays, n):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>")
    for r in df.select("i", A.tail(F.col("a"), n).alias("t"), A.framed(F.col("a"), n).alias("f")).collect():
        a = arrays[r["i"]]
        assert r["t"] == a[-n:] and r["f"] == [2, *a[:n], 3]


@LOOSE
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), min_size=1, max_size=20), st.integers(1, 4))
def test_ngrams(spark, arrays, n):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<string>")
    for r in df.select("i", T.ngrams(F.col("a"), n).alias("g")).collect():
        a = arrays[r["i"]]
        assert r["g"] == ["\x1f".join(a[i : i + n]) for i in range(len(a) - n + 1)]
