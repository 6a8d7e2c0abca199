"""Operators on hand-built rows, with values reasoned from their rules, and every query against its SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from turnstone import catalog, catalog_reports  # noqa: F401  the second adds its queries to the first's
from turnstone.functions import arrays as A
from turnstone.functions import text as T
from turnstone.operators import bpe, decoding, dialogue, metrics, pairs, vectors
from turnstone.plans import corpus
from turnstone.sources import sinks
from turnstone.sources import turns as source

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(str(tuple(round(float(v), 5) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    want = db.execute(f"select {', '.join(chr(34) + c + chr(34) for c in got.columns)} from ({catalog.ORACLES[name]})").fetchall()
    assert plain(map(tuple, got.collect())) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() >= 0


def one(spark, f, *values):
    df = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], "i int, a string" + ", b string" * isinstance(values[0], tuple))
    args = [F.col("a"), F.col("b")][: 1 + isinstance(values[0], tuple)]
    return [r["x"] for r in df.select("i", f(*args).alias("x")).orderBy("i").collect()]


def test_clean(spark):
    cases = {
        "see http://x.org/a now": "see __url__ now", "read /etc/apt/x": "read __path__", "ping 10.0.0.1:80 ok": "ping __ip__ ok", "<nick> Hi": "hi", "bob: try it": "try it",
        "don't": "do not", "don't,": "don't", "wait...": "wait .", "end.": "end .", "'quoted' word": "quoted' word", "a\n\tb": "a b", "Ünï x": "n x", "": "", None: "",
    }
    assert one(spark, T.clean, *cases) == list(cases.values())


def test_predicates(spark):
    assert one(spark, T.is_paste, "x" * 9, "1234567890", "abc def ghi", "[[[]]]abcdefgh", "a:b:c:defghijklmn", "a:b:cdefghijklmno") == [False, True, False, True, True, False]
    assert one(spark, T.is_repetitive, "help help help", "help help help help", "a b a b", "a a a b", "") == [False, True, False, True, False]
    assert one(spark, T.is_placeholder_only, "__url__ __path__", "__url__ x") == [True, False]
    assert one(spark, T.is_bot_response, "ubuntu is nice", "has joined now", "it is ubuntu") == [True, True, False]
    assert one(spark, T.is_english, "hello", "привет мир", "ab") == [True, False, True]
    assert one(spark, T.is_echo, ("say hello there __eot__ x", "hello there"), ("hi", "hi")) == [True, False]
    assert one(spark, T.is_incoherent, ("kernel driver update fails badly __eot__ ok", "banana orange apple grape melon"), ("kernel driver update fails badly", "kernel orange apple grape melon"), ("kernel driver update fails", "banana orange apple grape melon")) == [True, False, False]
    assert one(spark, T.is_command, "run sudo now", "in __path__ there", "pseudo sudoku") == [True, True, False]
    assert one(spark, T.is_question, "how do i fix it", "how do i fix it __eot__ ok", "it just works here") == [True, True, False]
    assert one(spark, T.strip_ansi, "\x1b[31mred\x1b[0m\r") == ["red"]


def test_dates(spark):
    got = one(spark, T.parse_date, "2008-01-02T03:04:05.000Z", "2008-01-02T03:04:05Z", "2008-01-02 03:04:05", "2008-01-02T03:04:05.5Z", "2008-01-02", "2008", "junk", "")
    assert got[0] == got[1] == got[2] is not None and got[3].microsecond == 500_000 and got[4].hour == 0 and got[5:] == [None, None, None]


def test_masks(spark):
    df = spark.createDataFrame([("hi bob_1 and averylongnick and bob, see ubottu's", ["bob_1", "averylongnick", "bob"])], "t string, n array<string>")
    assert df.select(T.mask_bots(T.mask_speakers(F.col("t"), F.col("n"))).alias("x")).first()["x"] == "hi __user__ and __user__ and bob, see __user__"


def test_merge(spark):
    rows = [("d", 0, "A", "one two"), ("d", 1, "a", "two"), ("d", 2, "A", "three four"), ("d", 3, "B", "x"), ("d", 4, "A", "y")]
    out = dialogue.merged(spark.createDataFrame(rows, "id string, ord int, speaker string, text string")).orderBy("ord").collect()
    assert [(r["ord"], r["text"]) for r in out] == [(0, "one two three four"), (3, "x"), (4, "y")]


def test_reasons(spark):
    plan = {"one": "a", "three": "abc", "loud": "aaaaab", "flat": "aaaabbbb", "good": "abab"}
    rows = [(k, i, s, "t") for k, v in plan.items() for i, s in enumerate(v)]
    out = dialogue.shape(spark.createDataFrame(rows, "id string, ord int, speaker string, text string")).select("id", dialogue.reason().alias("r"))
    assert {r["id"]: r["r"] for r in out.collect()} == {"one": "too_few_turns", "three": "not_dyadic", "loud": "speaker_dominance", "flat": "low_alternation", "good": "kept"}


def test_frames_and_caps(spark):
    rows = [("d", i, "s", f"t{i}") for i in range(10)]
    out = {r["pos"]: r["ctx"] for r in pairs.framed(spark.createDataFrame(rows, "id string, ord int, speaker string, text string")).collect()}
    assert len(out) == 9 and out[1] == "t0" and out[9].split(T.EOT) == [f"t{i}" for i in range(1, 9)]
    same = spark.createDataFrame([("d", i, "r") for i in range(7)], "id string, pos int, resp string")
    assert pairs.capped(same, 3).count() == 3
    with pytest.raises(ValueError):
        pairs.domain("none", F.col("a"), F.col("b"))


def test_metrics(spark):
    rows = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "c"]), (2, [], ["x"])], "sample_id int, hyp array<string>, ref array<string>")
    assert tuple(metrics.clipped(rows, 1).first()) == (1, 1, 3, pytest.approx(1 / 3))
    assert metrics.rouge_l(rows).filter("sample_id = 1").first()["rouge_l"] == pytest.approx(2 * 1 / 5)
    assert metrics.upper_median(spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "n int"), "n").first()[0] == 3
    v = spark.range(1).select(metrics.verdict(F.lit(0.01), F.lit(9.6), F.lit(9.0), F.lit(0.3), F.lit(0.0), F.lit(16000)).alias("v")).first()["v"]
    assert v == "COLLAPSE,NOT_LEARNING,OVERFIT"
    c = spark.createDataFrame([([0.4, 0.6, 0.8, 0.0],), ([],)], "c array<double>").select(metrics.confidence(F.col("c")).alias("m")).collect()
    assert tuple(c[0]["m"])[1:] == (1, 1, 1, 1) and tuple(c[1]["m"]) == (0.0, 0, 0, 0, 0)


def test_arrays(spark):
    df = spark.createDataFrame([([5, 6, 7, 5, 6],)], "a array<int>")
    got = df.select(A.tail(F.col("a"), 2).alias("t"), A.tail(F.col("a"), 9).alias("u"), A.framed(F.col("a"), 2).alias("f"), A.padded(F.col("a"), F.lit(6)).alias("p"), A.blocked(F.col("a"), 3).alias("b")).first()
    assert (got["t"], got["u"], got["f"], got["p"], got["b"]) == ([5, 6], [5, 6, 7, 5, 6], [2, 5, 6, 3], [5, 6, 7, 5, 6, 0], [7])
    p = spark.createDataFrame([([0.5, 0.3, 0.15, 0.05],)], "p array<double>").select(A.nucleus(F.col("p"), 0.7).alias("x")).first()["x"]
    assert p == pytest.approx([0.625, 0.375, 0, 0])
    tf = {r["e"]: r["t"] for r in spark.range(1, 21).select(F.col("id").alias("e"), A.teacher_forcing(F.col("id")).alias("t")).collect()}
    assert [tf[e] for e in (1, 5, 6, 9, 12, 13, 20)] == pytest.approx([1, 1, 0.9, 0.7, 0.5, 0.5, 0.5])


def test_bpe(spark):
    df = spark.createDataFrame([("low lower lowest __eot__ newer wider",)] * 5, "text string")
    model = bpe.learn(df, "text", 60)
    assert model.pieces[:11] == list(bpe.SPECIALS) and all(ok for _, _, ok in bpe.integrity(model))
    assert model.decode(model.encode("lower __eot__ newest")) == "lower __eot__ newest"
    assert bpe.encoded(df.withColumn("k", F.lit(1)), model, "text", "k").first()["ids"] == model.encode("low lower lowest __eot__ newer wider")


def test_decoding(spark):
    steps = spark.createDataFrame([(1, 0, [0.0, 0.0, 0.0, 0.0, 9.0]), (1, 1, [0.0, 0.0, 0.0, 9.0, 0.0]), (1, 2, [9.0, 0.0, 0.0, 0.0, 0.0])], "sample_id int, step int, logits array<double>")
    assert decoding.greedy(steps).first()["ids"] == [4]
    c = spark.createDataFrame([(1, 0, -4.0, 2), (1, 1, -4.0, 8)], "sample_id int, beam int, logp double, length int")
    assert [r["beam"] for r in decoding.beams(c, 1).collect()] == [1]


def test_vectors(spark):
    v = spark.createDataFrame([("a", [3.0, 4.0])], "piece string, vec array<float>")
    m = vectors.matrix(spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "id int, piece string"), v, 2).orderBy("id").collect()
    assert [list(r["vec"]) for r in m] == [[0, 0], [3, 4], [0, 0]]
    assert vectors.non_finite(spark.createDataFrame([([float("nan"), float("inf"), 1.0],)], "v array<float>"), "v").first()[:2] == (1, 1)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('folder,dialogueID,date,from,to,text\n3,1,2008-01-01T00:00:00.000Z,bob,,"hi, ""you"""\n,2,bad,al,,hey\n3,1,2008-01-01T00:01:00.000Z,,,no speaker\n')
    rows = source.read_turns(spark, str(tmp_path), "largest").orderBy("id").collect()
    assert [(r["id"], r["text"], r["ts"] is None) for r in rows] == [("2", "hey", True), ("3/1", 'hi, "you"', False)]
    (tmp_path / "p.jsonl").write_text('{"ctx":[1,2,3],"resp":[2,5,3]}\n\n{bad\n{"ctx":[1]}\n{"ctx":[],"resp":[2]}\n{"src_ids":[4],"trg_ids":[2,3]}\n')
    kept, counts = source.read_pairs(spark, str(tmp_path / "p.jsonl"), max_ctx=2)
    assert sorted(r["ctx"] for r in kept.collect()) == [[2, 3], [4]]
    assert {r["reason"]: r["n"] for r in counts.collect()} == {"kept": 2, "malformed": 1, "missing_key": 1, "empty": 1}
    sinks.write_pairs(kept, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    (tmp_path / "v.json").write_text('{"word2idx": {"a": 0, "b": 1}}')
    assert source.read_vocab(spark, str(tmp_path / "v.json")).count() == 2
    assert source.read_json(spark, str(tmp_path / "none.json")) is None
    with pytest.raises(FileNotFoundError):
        source.largest_csv(spark, str(tmp_path / "out"))


def test_corpus_plan(spark):
    import datetime

    start = datetime.datetime(2010, 1, 1)
    say = ["how do i install the kernel driver package today", "please try sudo apt-get install driver package now friend", "thanks that kernel driver package works great today"]
    rows = [(f"d{d}", i, start + datetime.timedelta(days=700 * d, seconds=60 * i), "ab"[i % 2], say[i]) for d in range(2) for i in range(3)]
    turns = spark.createDataFrame(rows, "id string, ord int, ts timestamp_ntz, speaker string, text string")
    out = corpus.corpus(turns).collect()
    assert {(r["split"], r["id"], r["pos"]) for r in out} == {("train", "d0", 1), ("train", "d0", 2), ("train", "d1", 1), ("train", "d1", 2)}
    model = bpe.learn(turns, "text", 100)
    ids = corpus.encoded(corpus.corpus(turns), model).collect()
    assert all(r["resp"][0] == 2 and r["resp"][-1] == 3 for r in ids) and len(ids) == 4


def test_word_boundaries_are_those_of_sql(spark, tmp_path):
    texts = ["doña is", "canón ls", "éhow do you", "how do youé", "ls", "élsé ubottué", "an è1.2.3.4é b", "xñexample.com", "what isß", "plain words"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.QUERIES["question_signals"](spark, str(tmp_path)).select("pattern", "n").collect()
    assert plain(got) == plain(c.execute(f"select pattern, n from ({catalog.ORACLES['question_signals']})").fetchall())
    x = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", T.clean(F.col("text")), T.is_command(F.col("text")), T.mask_bots(F.col("text")))
    assert plain(x.collect()) == plain(c.execute(f"select doc_id, {catalog.sql_clean('text')}, {catalog.CMD('text')}, regexp_replace(text, {catalog.quoted(catalog_reports.HIDE_BOTS)}, '__user__', 'g') from documents").fetchall())


def epoch_batches(spark, path, rows, parts):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, user_id long, day int, value double").repartition(parts)
    df.withColumn("ts", F.expr("make_timestamp_ntz(2024, 1, day, 1, 0, 0)")).drop("day").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_best_epoch_equals_sql_on_odd_losses(spark, tmp_path):
    nan, inf = math.nan, math.inf
    epochs = {
        (1, 3): [None, None], (1, 4): [2.0, None, 4.0], (2, 3): [None], (3, 1): [nan, 1.0], (3, 2): [5.0], (4, 1): [nan], (5, 1): [inf, 1.0], (5, 2): [7.5], (6, None): [1.0], (6, 2): [2.0],
        (None, 1): [3.0], (None, 2): [2.5], (7, 1): [1e-25, 3e-25], (7, 2): [1e-25], (8, 1): [1e25, 3e25], (8, 2): [1.5e25], (9, 1): [1e19, 9e19, 9e19], (9, 2): [8e19], (10, 1): [-inf], (10, 2): [0.0],
    }
    folder = epoch_batches(spark, tmp_path, [(m, d, v) for (m, d), values in epochs.items() for v in values], 3)
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    got = catalog.QUERIES["best_epoch"](spark, folder)
    assert plain(map(tuple, got.collect())) == plain(c.execute(catalog.ORACLES["best_epoch"]).fetchall())


@pytest.mark.parametrize("parts", (1, 3, 8))
def test_best_epoch_is_the_first_of_equal_means_in_any_order(spark, tmp_path, parts):
    rows = []
    for m in range(100):  # the second epoch's losses lie in pairs around the first's only one
        steps = [(m * 37 + i * 101) % 900 for i in range(20)]
        rows += [(m, 1, (1000 + m) / 100)] + [(m, 2, (1000 + m + sign * k) / 100) for k in steps for sign in (1, -1)]
    got = catalog.QUERIES["best_epoch"](spark, epoch_batches(spark, tmp_path, rows, parts)).collect()
    assert sorted(map(tuple, got)) == [(m, 1, (1000 + m) / 100) for m in range(100)]
