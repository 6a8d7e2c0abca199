"""The n-gram model against a plain one of dictionaries, and its defined results."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstone.llm import ngrams, packed


def plain(train, order):
    """word lists -> p(word, context), by the textbook's counts; tokens and distinct tokens."""
    texts = [["<s>", *t, "</s>"] for t in train]
    raw = {k: Counter(tuple(t[i : i + k]) for t in texts for i in range(len(t) - k + 1)) for k in range(1, order + 1)}
    counts = {order: raw[order]}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in raw[k + 1])
        if k > 1:
            counts[k].update({g: n for g, n in raw[k].items() if g[0] == "<s>"})
    d = {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if all(n) else 0
        d[k] = [0, *([i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)] if all(n) else [0.5, 1.0, 1.5])]
    after = {k: defaultdict(dict) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            after[k][g[:-1]][g[-1]] = n
    n_types = len(counts[1])

    def p(word, context):
        k = len(context) + 1
        lower = p(word, context[1:]) if context else 1 / (n_types + 1)
        found = after[k].get(context)
        if not found:
            return lower
        total = sum(found.values())
        left = sum(d[k][min(n, 3)] for n in found.values())
        n = found.get(word, 0)
        return (n - d[k][min(n, 3)] + left * lower) / total

    return p, sum(len(t) - 1 for t in texts), n_types


def some(seed, n):
    r = random.Random(seed)
    names = [f"w{i}" for i in range(60)] + ["é", "Ünï"]
    return [" ".join(r.choice(names[: r.choice((3, 10, 62))]) for _ in range(r.choice((0, 1, 2, 5, 40, 200)))) for _ in range(n)]


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_plain_model(spark, order):
    texts = some(order, 120)
    rows = [(i, t if i != 5 else None) for i, t in enumerate(texts)] + [(200, "never seen words here"), (201, "  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = docs.filter("doc_id < 100").select(F.col("text").cast("binary"))
    model = ngrams.learned(train, order, buffer=1000)
    got = {r["doc_id"]: r for r in ngrams.scored(docs, model).collect()}
    lists = {i: (t or "").split() for i, t in rows}
    p, n_tokens, n_types = plain([w for i, w in lists.items() if i < 100], order)
    assert (model.n_tokens, model.n_types) == (n_tokens, n_types)
    known = Counter(w for i, t in lists.items() if i < 100 for w in [*t, "</s>"])
    for i, t in lists.items():
        t = ["<s>", *t, "</s>"]
        want = sum(math.log10(p(t[j], tuple(t[max(0, j - order + 1) : j]))) for j in range(1, len(t)))
        base = sum(math.log10((known[w] + 1) / (n_tokens + n_types + 1)) for w in t[1:])
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(t) - 1, sum(w in known for w in t[1:]))
        assert got[i]["score"] == pytest.approx(want) and got[i]["base_score"] == pytest.approx(base)
    words = {*known, "none"}
    for context in (("<s>",), ("w0",), ("none",), ("w1", "w2"))[: 2 + order]:
        if len(context) < order:
            assert sum(p(w, context) for w in words) == pytest.approx(1)


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "A b"), (3, "x " * 50_000)], "doc_id long, text string")
    none = ngrams.learned(docs.limit(0).select(F.col("text").cast("binary")))
    assert [r["score"] for r in ngrams.scored(docs, none).collect()] == [0.0] * 4
    model = ngrams.learned(docs.select(F.col("text").cast("binary")))
    got = ngrams.scored(docs, model).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_tokens"], r["n_known"]) for r in got] == [(None, 3, 3), (1, 1, 1), (1, 1, 1), (3, 50_001, 50_001)] and got[1]["score"] == got[2]["score"]
    assert ngrams.scored(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        ngrams.mounted("hdfs://x/y")


def test_packed_round_trip():
    r = np.random.default_rng(1)
    arrays = [np.sort(r.integers(0, 1 << 63, 1000, dtype=np.uint64)), np.zeros(0, np.uint64), np.array([0, 255, 256, 1 << 40], np.uint64)]
    back = packed.unpacked(packed.packed(packed.steps(arrays[0]), *arrays[1:]))
    assert all((a == b).all() for a, b in zip(arrays, [np.cumsum(back[0], dtype=np.uint64), *back[1:]]))
