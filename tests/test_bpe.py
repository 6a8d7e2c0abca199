"""The learner of many merges a round against one of single merges, and the linear encoder."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from turnstone.functions import text as T
from turnstone.operators import bpe


def plain(words, size):
    """Counter of words -> pieces and merges, one merge at a time over all words."""
    texts = [(list(bpe.MARK + w), n) for w, n in words.items() if w not in bpe.SPECIALS]
    pieces = dict.fromkeys([*bpe.SPECIALS, *sorted({c for t, _ in texts for c in t})])
    merges = []
    while len(pieces) < size:
        count = Counter()
        for t, n in texts:
            for p in zip(t, t[1:]):
                count[p] += n
        if not count or (best := min((-n, a, b) for (a, b), n in count.items()))[0] > -2:
            break
        _, a, b = best
        merges.append((a, b))
        pieces[a + b] = None
        texts = [(bpe.merged(t, {(a, b): 0}), n) for t, n in texts]
    return list(pieces), list(dict.fromkeys(merges))


def slow(parts, rank):
    while found := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]:
        i = min(found)[1]
        parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
    return parts


def in_rounds(words, size, take):
    """The learner's rounds on a Counter of words, with at most `take` candidates."""
    texts = [(list(bpe.MARK + w), n) for w, n in words.items()]
    pieces, merges = dict.fromkeys([*bpe.SPECIALS, *sorted({c for t, _ in texts for c in t})]), []
    while len(pieces) < size:
        count, found = Counter(), Counter()
        for t, n in texts:
            for p in zip(t, t[1:]):
                count[p] += n
        top = sorted((-n, a, b) for (a, b), n in count.items() if n > 1)
        if not top:
            break
        least = 1 - top[take][0] if take < len(top) else 2
        chosen = {(a, b) for n, a, b in top if -n >= least} or {top[0][1:]}
        for t, n in texts:
            for x in bpe.runs(t, chosen):
                found[x] += n
        new = bpe.in_order([(list(x), n) for x, n in found.items()], chosen, least, top[0][1:], pieces, size)
        merges += new
        rank = {m: i for i, m in reversed(list(enumerate(new)))}
        texts = [(bpe.merged(t, rank, once=True), n) for t, n in texts]
    return list(pieces), list(dict.fromkeys(merges))


def test_rounds_equal_the_learner_of_single_merges():
    """Few letters, so that pieces are made in several ways and pairs tie."""
    for seed in range(120):
        r = random.Random(seed)
        letters = r.choice(("ab", "aab", "abc", "abcdefgh"))
        words = Counter("".join(r.choice(letters) for _ in range(r.choice((1, 3, 8, 14)))) for _ in range(r.choice((5, 60, 400))))
        words = Counter({w: n * r.choice((1, 1, 2, 9)) for w, n in words.items()})
        size, take = r.choice((40, 150, 600)), r.choice((1, 2, 5, 20, 200, 5000))
        assert in_rounds(words, size, take) == plain(words, size), (seed, take)


def test_learning_in_spark_equals_the_learner_of_single_merges(spark):
    r = random.Random(1)
    words = ["".join(r.choice("aab" if r.random() < 0.5 else "abcdeé") for _ in range(r.choice((1, 2, 4, 9)))) for _ in range(300)]
    texts = [(" ".join(r.choice(words[: r.choice((20, 300))]) for _ in range(30)),) for _ in range(60)]
    df = spark.createDataFrame(texts, "text string")
    counts = Counter(w for row in df.select(T.tokens(F.col("text")).alias("w")).collect() for w in row["w"])
    for candidates, fragments, size in ((20_000, 150_000, 400), (50, 100, 100)):
        got = bpe.learn(df, "text", size, candidates, fragments)
        assert (got.pieces, got.merges) == plain(counts, size)


def test_documents_equal_the_learner_of_single_merges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    counts = Counter(w for row in docs.select(T.tokens(F.col("text")).alias("w")).collect() for w in row["w"])
    got = bpe.learn(docs, "text", 400)
    assert (got.pieces, got.merges) == plain(counts, 400)


def test_merges_by_a_heap_equal_a_scan():
    r = random.Random(5)
    for _ in range(300):
        pairs, rank = ["a", "b", "c"], {}
        for _ in range(r.choice((2, 8, 20))):
            p = (r.choice(pairs), r.choice(pairs))
            rank.setdefault(p, len(rank))
            pairs.append("".join(p))
        word = [r.choice("abc") for _ in range(r.choice((0, 1, 2, 12, 40)))]
        assert bpe.merged(word, rank) == slow(word, rank)


def test_long_words_take_linear_time():
    model = bpe.Bpe([*bpe.SPECIALS, bpe.MARK, "a", "b", "ab", "abab"], [("a", "b"), ("ab", "ab")])
    began = time.time()
    assert len(model.encode("ab" * 100_000)) == 50_001
    assert time.time() - began < 5
