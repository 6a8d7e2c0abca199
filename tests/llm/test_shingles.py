"""The near-duplicate stage against brute-force Jaccard."""

import itertools

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from turnstone.llm import shingles


def slow_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_kept(rows):
    """Smallest id of each component of links with Jaccard of at least 4 / 5."""
    sets, root = [slow_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for (key, _), i in zip(rows, range(len(rows))):
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted(least.values())


def copies():
    """Texts with copies of 0 to 8 changed words, at either side of the bound, short texts, and a passage common to many."""
    rng = np.random.default_rng(4)
    word = lambda: f"w{rng.integers(0, 10**6)}"
    passage, out = [word() for _ in range(30)], ["", None, "a b", "A  b", "a b c", "one two three four five", "one two three four six"]
    for _ in range(12):
        base = [word() for _ in range(int(rng.integers(60, 160)))]
        for n in range(9):
            made = list(base)
            for at in rng.integers(0, len(base), n):
                made[at] = word()
            out.append(" ".join(made))
    return [*out, *(" ".join(passage + [word() for _ in range(int(rng.integers(2, 12)))]) for _ in range(60))]


def test_near_duplicates_equal_brute_force_jaccard(spark, monkeypatch):
    rows = list(enumerate(copies()))
    df, stage = spark.createDataFrame(rows, "doc_id long, text string"), dict(corpus_pipeline.STAGES)["near_duplicates"]
    want = slow_kept(rows)
    assert sorted(r["doc_id"] for r in stage(spark, df, "").collect()) == want
    for name, value in (("HOT", 3), ("BLOCK", 7), ("HELD", 1)):  # another order, stars, small blocks: the same links
        monkeypatch.setattr(shingles, name, value)
    assert sorted(r["doc_id"] for r in stage(spark, df, "").collect()) == want


def test_near_duplicates_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = slow_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in shingles.keep_one_per_component(docs).collect()) == want


def test_near_duplicates_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "x y z"), (4, "a b"), (4, "a b")], "doc_id long, text string").withColumns({"c": F.lit(1), "t": F.lit(2), "n": F.lit(3)})
    kept = shingles.keep_one_per_component(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4]
    assert shingles.keep_one_per_component(df.limit(0)).count() == 0


def test_pipeline_equals_brute_force_with_jaccard(spark):
    import hashlib

    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from test_llm import slow_mix, slow_redacted

    from turnstone.llm import quality, sentencepiece

    folder = "/root/testdata/sf0.001"
    verdict = {r["doc_id"]: r["kept"] for r in quality.op3_quality(spark, folder).collect()}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if verdict[r["doc_id"]]]
    kept = set(slow_kept([r[:2] for r in rows]))
    rows = [(r[0], slow_redacted(r[1]), r[2]) for r in rows if r[0] in kept]
    model = SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece.MODEL))
    want = []
    for i, n in slow_mix(rows).items():
        ids = model.encode(rows[i][1], add_bos=True, add_eos=True)
        want += [(rows[i][0], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())] * n
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(want)


def shuffled_bytes(spark):
    """By stage, of all stages so far."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    none = jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(jvm.double, 0), none)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_near_duplicates_shuffle_only_texts_that_are_likely_needed(spark):
    rng, threshold = np.random.default_rng(5), "spark.sql.autoBroadcastJoinThreshold"
    text = lambda: rng.bytes(16_000).hex(" ", 8)  # noqa: E731  2,000 random words
    rows = [(i, text()) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(4)] + [(2000 + i, rows[8 + i][1] + " x") for i in range(4)] + [(7, rows[7][1]), (None, rows[7][1]), (None, "a")]
    docs, before, old = spark.createDataFrame(rows, "doc_id long, text string"), shuffled_bytes(spark), spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")  # as with tables too large to broadcast
    try:
        got = [r["doc_id"] for r in shingles.keep_one_per_component(docs).collect()]
    finally:
        spark.conf.set(threshold, old)
    assert sorted(i for i in got if i is not None) == list(range(300)) and got.count(None) == 2
    moved = sum(n for k, n in shuffled_bytes(spark).items() if k not in before)
    assert 0 < moved < sum(len(t) for _, t in rows) / 4


def test_likely_misses_no_key(spark, monkeypatch):
    from turnstone.llm import common

    for most in (2048, 1):  # one bitmap for all keys: more by chance
        monkeypatch.setattr(common, "BITMAPS", most)
        keys = spark.range(0, 30_000, 3).select(F.col("id").cast("string").alias("k"))
        df = spark.range(30_000).select(F.when(F.col("id") > 0, F.col("id").cast("string")).alias("k"), F.lit(1).alias("a.b"))
        got = common.likely(df, "k", keys)
        assert got.columns == ["k", "a.b", "likely__"] and got.count() == 30_000
        found = {r["k"] for r in got.filter("likely__").collect()}
        assert {str(i) for i in range(3, 30_000, 3)} <= found
        assert len(found) < (10_000 + 20_000 / 16 if most > 1 else 20_000)
    assert common.likely(df, "k", keys.limit(0)).filter("likely__").count() == 0
