"""What SQL does not cover: decoding loops against plain loops, short items, vocabularies, masks, smoothing, stages, open sessions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from turnstone import catalog, catalog_reports  # noqa: F401  the second adds its queries to the first's
from turnstone.functions import text as T
from turnstone.operators import bpe, decoding, dialogue, metrics, pairs
from turnstone.plans import corpus
from turnstone.sources import stages
from turnstone.streaming import sessions


def test_short_benchmark_items_are_found(spark, tmp_path):
    docs = [(1, "one two three four five six seven"), (2, "x alone y"), (3, "preone two three four five sixth"), (4, "one two  three"), (5, "")]
    items = [(1, "alone"), (2, "one two three four five"), (3, "one two three four five six"), (4, "one two three four five six seven"), (5, "two three"), (6, "e t"), (7, "absent words of some length in all")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["item_id"]: r["n_docs"] for r in catalog.QUERIES["benchmark_contamination"](spark, str(tmp_path)).collect()}
    assert got == {i: sum(t in d for _, d in docs) for i, t in items}


def test_vocabulary_counts_every_word_and_does_not_depend_on_partitions(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["low", "lower", "lowest", "new", "newer", f"w{rng.randrange(999)}"]) for _ in range(20)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model = bpe.learn(df, "text", size=70)
    other = bpe.learn(df.repartition(7), "text", size=70)
    assert (model.pieces, model.merges) == (other.pieces, other.merges) and 60 < len(model.pieces) <= 70
    assert all(ok for _, _, ok in bpe.integrity(model))
    counts = {}
    for t in texts:
        for w in t.split():
            parts = [bpe.MARK, *w]
            for p in zip(parts, parts[1:]):
                counts[p] = counts.get(p, 0) + 1
    assert counts[model.merges[0]] == max(counts.values())  # over all words, rare ones too
    for t in texts[:5]:
        assert model.decode(model.encode(t)) == t
    assert bpe.learn(df.limit(0), "text", size=70).merges == []


def test_top_p_decode_equals_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(s, k, [rng.gauss(0, 2) for _ in range(6)], rng.random()) for s in range(20) for k in range(9)]
    got = {r["sample_id"]: r["ids"] for r in decoding.top_p_decode(spark.createDataFrame(rows, "sample_id int, step int, logits array<double>, u double"), block=2).collect()}
    for s in range(20):
        ids = []
        for _, _, x, u in (r for r in rows if r[0] == s):
            stop = {b for a, b in zip(ids, ids[1:]) if a == ids[-1]}
            x = [-math.inf if i in stop and len(stop) < 6 else v for i, v in enumerate(x)]
            w = [math.exp(v / 0.8) for v in x]
            order = sorted(range(6), key=lambda i: (-w[i], i))
            kept, ahead = [], 0.0
            for i in order:
                if ahead <= 0.9:
                    kept.append(i)
                ahead += w[i] / sum(w)
            at, mass = 0.0, sum(w[i] for i in kept)
            drawn = next(i for i in kept if (at := at + w[i] / mass) > u)
            if drawn == 3:
                break
            ids.append(drawn)
        assert got[s] == ids


def test_beam_search_equals_a_plain_loop(spark):
    rng = random.Random(5)
    table = {(s, last): [rng.gauss(0, 2) for _ in range(6)] for s in range(6) for last in range(-1, 6)}
    log = {k: [v - math.log(sum(map(math.exp, x))) for v in x] for k, x in table.items()}
    best = spark.createDataFrame([(s, last, i, lp[i]) for (s, last), lp in log.items() for i in sorted(range(6), key=lambda i: -lp[i])[:3]], "sample_id long, last int, id int, lp double")
    scores = lambda beams: beams.withColumn("last", F.coalesce(F.try_element_at("ids", F.lit(-1)), F.lit(-1))).join(best, ["sample_id", "last"])
    got = {r["sample_id"]: (r["ids"], r["score"]) for r in decoding.beam_search(scores, spark.range(6).withColumnRenamed("id", "sample_id"), width=3, steps=4).collect()}
    for s in range(6):
        active, done = [([], 0.0)], []
        for step in range(4):
            made = [(ids + [i], lp + log[s, ids[-1] if ids else -1][i]) for ids, lp in active for i in sorted(range(6), key=lambda i: -log[s, ids[-1] if ids else -1][i])[:3]]
            done += [(ids[:-1], lp / (1 if step == 0 else len(ids) ** 0.7)) for ids, lp in made if ids[-1] == 3]
            active = sorted(((ids, lp) for ids, lp in made if ids[-1] != 3), key=lambda b: -b[1] / len(b[0]) ** 0.7)[:3]
        done += [(ids, lp / len(ids) ** 0.7) for ids, lp in active]
        ids, score = max(done, key=lambda b: b[1])
        assert got[s][0] == ids and got[s][1] == pytest.approx(score)


def test_masking_of_speakers_and_bots(spark):
    turns = spark.createDataFrame([(1, 0, "bob_1", "hi averylongnick, ubottu's here"), (1, 1, "averylongnick", "bob_1: bob says ok bob_12"), (1, 2, "bob", "thanks bob")], "id long, ord long, speaker string, text string")
    rows = [tuple(r) for r in pairs.masked(pairs.framed(turns), turns).select("ctx", "resp").orderBy("pos").collect()]
    assert rows[0] == ("hi __user__, __user__ here", "__user__: bob says ok bob_12") and rows[1][1] == "thanks bob"


def test_the_plan_masks_and_orders_by_time(spark):
    rows = [("d", 2, "2010-01-01 00:00:30", "kim_22", "kim_22 please install the package with apt-get now"), ("d", 1, "2010-01-01 00:01:00", "ann", "how do i install the package that kim_22 named"), ("d", 3, "2010-01-01 00:00:00", "ann", "how do i get the network to work again")]
    turns = spark.createDataFrame(rows, "id string, ord long, t string, speaker string, text string").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    out = corpus.corpus(turns).orderBy("pos").collect()
    assert [r["resp"] for r in out] == ["__user__ please install the package with apt-get now", "how do i install the package that __user__ named"]


def test_bleu_13a_smoothing_and_brevity(spark):
    one = lambda h, r: metrics.bleu_13a(spark.createDataFrame([(1, h, r)], "sample_id int, hyp string, ref string")).first()
    assert tuple(one("a b c d e", "a b c d e")) == (1.0, 1.0, 1.0, 1.0)
    same = one("a x b y", "a b q r")  # unigrams 2 of 4; of bigrams, trigrams and 4-grams none
    assert same["bleu1"] == 0.5 and same["bleu2"] == pytest.approx(math.sqrt(0.5 * (1 / 2) / 3), abs=1e-4)
    assert same["bleu4"] == pytest.approx((0.5 * (1 / 2 / 3) * (1 / 4 / 2) * (1 / 8 / 1)) ** 0.25, abs=1e-4)
    short = one("a b c d", "a b c d e f g h")
    assert short["bleu1"] == pytest.approx(math.exp(1 - 2), abs=1e-4)
    assert tuple(one("", "a b")) == (0.0, 0.0, 0.0, 0.0)
    words = spark.createDataFrame([("It costs 3,000.50 (or so), isn't it? A-b 4-5",)], "t string").select(metrics.tokens_13a(F.col("t"))).first()[0]
    assert words == "It costs 3,000.50 ( or so ) , isn't it ? A-b 4 - 5".split()


def test_upper_median(spark):
    for values in ([1], [1, 2], [3, 1, 2], [4, 1, 3, 2], [5, 5, 1, 1]):
        assert metrics.upper_median(spark.createDataFrame([(v,) for v in values], "n int"), "n").first()[0] == sorted(values)[len(values) // 2]


def test_stages_that_were_not_written_whole_are_made_again(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "part-0.parquet").write_bytes(b"broken")
    assert stages.stage(spark, str(tmp_path), "a", make).count() == 3 and stages.stage(spark, str(tmp_path), "a", make).count() == 3 and len(made) == 1


def test_open_sessions_are_not_lost(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:30:00"), (1, "2024-01-01 03:00:00"), (2, "2024-01-01 02:59:00")]
    events = spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.col("t").cast("timestamp_ntz").alias("ts"))
    got = sorted((r["user_id"], r["n"]) for r in sessions.replayed(spark, events, str(tmp_path)).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_repetition_is_judged_on_the_cleaned_text(spark):
    assert spark.createDataFrame([("go! go? go stop it",)], "t string").select(T.is_repetitive(T.clean(F.col("t")))).first()[0]


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    rows = [(i, 0, "user", f"Text {i}") for i in range(20)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalog.QUERIES["stream_clean_text"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(i, 0, f"text {i}") for i in range(20)]


def test_corpus_plan_makes_each_stage_once(spark):
    turns = catalog_reports.scenes(spark, "/root/testdata/sf0.001")
    files = corpus.corpus(turns, catalog_reports.PLAN).inputFiles()
    assert files and all("/pairs-" in f for f in files)  # nothing is made again from turns
    plan = dialogue.usable(turns)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("__url__") == 1  # each text is cleaned once


def test_word_vectors_are_learned_in_many_tasks(spark, monkeypatch):
    from pyspark.ml.feature import Word2Vec

    seen, fit = [], Word2Vec.fit
    monkeypatch.setattr(Word2Vec, "fit", lambda self, df: seen.append(self.getNumPartitions()) or fit(self, df))
    words = [[f"{'ab'[i % 2]}{j % 5}" for j in range(i, i + 12)] for i in range(400)]  # two groups of words that never meet
    rows = spark.createDataFrame([(w,) for w in words], "w array<string>")
    vec = {r["piece"]: r["vec"] for r in bpe.word_vectors(rows, "w", dim=8, epochs=3).collect()}
    assert seen == [spark.sparkContext.defaultParallelism] and seen[0] > 1
    assert sorted(vec) == sorted(f"{g}{j}" for g in "ab" for j in range(5)) and all(len(v) == 8 and all(map(math.isfinite, v)) for v in vec.values())
    near = lambda a, b: sum(x * y for x, y in zip(vec[a], vec[b])) / math.hypot(*vec[a]) / math.hypot(*vec[b])
    assert near("a0", "a1") > near("a0", "b1")


def test_query_of_word_vectors_returns_what_was_learned(spark, tmp_path, monkeypatch):
    from pyspark.ml.feature import Word2Vec

    seen, fit = [], Word2Vec.fit
    monkeypatch.setattr(Word2Vec, "fit", lambda self, df: seen.append((self.getVectorSize(), self.getMaxIter())) or fit(self, df))
    groups = ("apple pear plum cherry grape", "wheel brake pedal chain saddle")  # words that never meet
    rows = [(i, 0, "user", " ".join((groups[i % 2].split() * 4)[i % 5 : i % 5 + 12])) for i in range(200)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    vec = {r["piece"]: r["vec"] for r in catalog.QUERIES["word2vec_vectors"](spark, str(tmp_path)).collect()}
    assert seen == [(300, 10)]
    assert sorted(vec) == sorted(bpe.MARK + w for g in groups for w in g.split()) and all(len(v) == 300 and all(map(math.isfinite, v)) for v in vec.values())
    near = lambda a, b: sum(x * y for x, y in zip(vec[a], vec[b])) / math.hypot(*vec[a]) / math.hypot(*vec[b])
    assert near("▁apple", "▁pear") > near("▁apple", "▁wheel") and near("▁wheel", "▁brake") > near("▁plum", "▁brake")
