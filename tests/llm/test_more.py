"""Posteriors, alignments, verdicts and odd columns against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstone.llm import common, licenses, quality, sentencepiece, simhash, urls


def slow_em(votes, iterations=20, tolerance=1e-4):
    """votes: array (rows, rules) of -1, 0, 1 -> posterior of each row, by the textbook loop."""
    n_rules = votes.shape[1]
    prior, up, down = 0.8, np.full(n_rules, math.log(0.7 / 0.4)), np.full(n_rules, math.log(0.05 / 0.3))
    old = None
    for _ in range(iterations + 1):
        odds = math.log(prior / (1 - prior)) + ((votes == 1) * up + (votes == -1) * down).sum(1)
        p = 1 / (1 + np.exp(-odds))
        now = np.concatenate(([math.log(prior / (1 - prior))], up, down))
        if old is not None and np.abs(now - old).max() < tolerance or _ == iterations:
            return p
        old = now
        good, bad = p.sum(), (1 - p).sum()
        few = 1e-4 * (good + bad)
        prior = (good + few) / (good + bad + 2 * few)
        for r in range(n_rules):
            share = {v: ((p[votes[:, r] == v].sum() + 1) / (good + 3), ((1 - p)[votes[:, r] == v].sum() + 1) / (bad + 3)) for v in (-1, 1)}
            up[r], down[r] = max(0.0, math.log(share[1][0] / share[1][1])), min(0.0, math.log(share[-1][0] / share[-1][1]))


def test_posteriors_and_verdicts_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    votes = common.cut(quality.voted(quality.measured(docs.select("doc_id", "text"))).drop("text"))
    rows = quality.judged(votes, quality.fitted(votes)).collect()
    passed = [r for r in rows if not r["q_base_failed"]]
    want = slow_em(np.array([[r[f"v_{name}"] for name in quality.RULES] for r in passed]))
    assert [r["q_posterior"] for r in passed] == pytest.approx(want.tolist(), abs=1e-6)
    assert [r["q_kept"] for r in passed] == (want >= 0.5).tolist() and not any(r["q_kept"] for r in rows if r["q_base_failed"])


def test_a_corpus_that_is_mostly_junk_is_modelled(spark):
    rng = random.Random(2)
    good = [(i, "\n".join(" ".join(rng.choice("abcdefghij") * rng.randint(3, 7) + str(rng.randrange(999)) for _ in range(12)) + "." for _ in range(6))) for i in range(40)]
    junk = [(100 + i, " ".join(rng.choice(["##$$", "||", "<>", "%%&", "BUY!!!"]) for _ in range(30))) for i in range(400)]
    df = spark.createDataFrame(good + junk, "doc_id long, text string")
    kept = {r["doc_id"] for r in quality.filtered(df).collect()}
    assert len(kept & set(range(40))) >= 36 and not [i for i in kept if i >= 100]


def test_quality_keeps_columns_of_any_name(spark):
    text = " ".join(f"word{i} and more" for i in range(40))
    df = spark.createDataFrame([(1, text, 7, 99, "r", True)], "doc_id long, text string, q_words int, v_length int, row string, q_base_failed boolean")
    out = quality.filtered(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] in ([(1, text, 7, 99, "r", True)], [])
    assert out.count() == 1


def longest(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(best[j] + 1 if x == y else max(best[j + 1], new[j]))
        best = new
    return best[-1]


def test_banded_alignment_equals_brute_force():
    """Within the band the matched words are those of the longest common subsequence, and the span is where they are."""
    rng = random.Random(7)
    for _ in range(60):
        template = [rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(30)]
        copy = [w if rng.random() > 0.1 else "x" for w in template]
        for _ in range(rng.randint(0, 3)):
            copy.insert(rng.randrange(len(copy)), "y")
        before = [f"p{i}" for i in range(rng.randint(0, 20))]
        n, first, last = licenses.aligned(template, [*before, *copy, "q", "q"], len(before))
        assert n == longest(template, copy)
        assert len(before) <= first <= last < len(before) + len(copy) and longest(template, [*before, *copy][first : last + 1]) == n


def test_scan_equals_a_search_of_all_places():
    """Every planted copy of a template with few changed words is reported with its coverage and place, and nothing else."""
    rng = random.Random(9)
    templates = {k: v for k, v in licenses.TEMPLATES.items() if not any(k != o and v.rstrip(".").lower() in w.lower() or v.lower()[:60] == w.lower()[:60] and k != o for o, w in licenses.TEMPLATES.items())}
    tokens, index = licenses.index_of(templates)
    for name in sorted(templates):
        words = templates[name].split()
        filler = lambda: " ".join(f"filler{rng.randrange(10**6)}" for _ in range(rng.randint(1, 30)))
        text = f"{filler()} {templates[name]} {filler()}"
        assert [(f[0], f[1]) for f in licenses.scan(text, tokens, index)] == [(name, 1.0)], name
        if len(words) > 20:
            changed = list(words)
            for at in rng.sample(range(2, len(words) - 2), 2):
                changed[at] = "CHANGED"
            (found,) = licenses.scan(f"{filler()} {' '.join(changed)} {filler()}", tokens, index)
            assert found[0] == name and found[1] == pytest.approx(longest(tokens[name], licenses.TOKEN.findall(" ".join(changed).lower())) / len(tokens[name]))


def test_short_templates_and_ties(spark):
    docs = spark.createDataFrame([(1, "all rights go mit", 5), (2, "nothing", 6), (2, "nothing", 6), (None, "MIT mit", 7)], "doc_id long, text string, license int")
    rows = sorted((r["doc_id"] or 0, r["license"] or "", r["start"] or 0) for r in licenses.scanned(docs, {"one": "MIT", "two": "rights go", "none": "", "same": "mit"}).collect())
    assert rows == [(0, "one", 0), (0, "one", 4), (0, "same", 0), (0, "same", 4), (1, "one", 14), (1, "same", 14), (1, "two", 4), (2, "", 0), (2, "", 0)]


def test_url_verdicts_of_the_trees_equal_a_walk_of_them(spark, monkeypatch):
    """The verdict without a rule is that of the summed trees, walked here node by node over the same features."""
    models = []
    fit = urls.GBTClassifier.fit
    monkeypatch.setattr(urls.GBTClassifier, "fit", lambda self, df: models.append(fit(self, df)) or models[-1])
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r for r in urls.filtered(pages).collect()}
    model, weights = models[0], models[0].treeWeights
    host, path = urls.parts(F.col("url"))
    rows = urls.with_features(pages.select("page_id", "url", host.alias("host"), path.alias("path"))).collect()

    def walk(node, x):
        while node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
        return node.prediction()

    for r in rows[:60]:
        x = [r[f] for f in urls.FEATURES]
        margin = sum(w * walk(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t.rootNode(), x) for t, w in zip(model.trees, weights))
        got = found[r["page_id"]]
        assert got["score"] == pytest.approx(1 / (1 + math.exp(-2 * margin)), abs=1e-6)
        if got["rule"] is None:
            assert got["verdict"] == ("block" if margin > 0 else "allow")


def test_urls_odd_rows(spark):
    rows = [(None, "http://a.org/x", 1), (1, "http://a.org/x", 2), (1, "http://a.org/x", 2), (2, None, 3), (3, "http://b.com/de/1", 4)]
    out = urls.filtered(spark.createDataFrame(rows, "page_id long, url string, suffix int")).collect()
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in out) == [(0, "allow"), (1, "allow"), (1, "allow"), (2, out[[r["page_id"] for r in out].index(2)]["verdict"]), (3, "block")]


def test_sentencepiece_long_chunks_are_not_kept():
    import public_tokenizers

    path = public_tokenizers.path(sentencepiece.MODEL)
    table = sentencepiece.ChunkTable(path, table_chars=40, long_chunk=10)
    for text in ("a " + "x" * 50 + " b", "aaaa bbbb cccc dddd eeee ffff gggg hhhh iiii jjjj", "x" * 50, "a b"):
        assert table.encode(text).tolist() == table.model.encode(text, add_bos=True, add_eos=True)
        assert not [c for c in table.ids if len(c) > 10]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(type("Session", (), {"sparkContext": Context()}))


def test_trie_walk_within_a_wide_budget_equals_brute_force():
    rng = np.random.default_rng(4)
    for budget in (0, 4, 24):
        keys = np.unique(np.concatenate([rng.integers(0, 2**64, 120, dtype=np.uint64), rng.integers(0, 2**20, 40).astype(np.uint64)]))
        got = {(min(i, j), max(i, j)) for a, b in simhash.walk(keys, [(0, len(keys), 0, len(keys), 0, budget)], budget, leaf=4) for i, j in zip(a.tolist(), b.tolist())}
        want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if int(keys[i] ^ keys[j]).bit_count() <= budget}
        assert got == want
        half = len(keys) // 3
        cross = {(i, j) for a, b in simhash.walk(keys, [(0, half, half, len(keys), 0, budget)], budget, leaf=4) for i, j in zip(a.tolist(), b.tolist())}
        assert cross == {(i, j) for i, j in want if i < half <= j}


def test_a_second_attempt_replaces_the_first(tmp_path):
    """A store whose rename does not overwrite."""
    from pyarrow import fs

    from turnstone.llm import media

    store, moves = fs.LocalFileSystem(), []

    class Once:
        def get_file_info(self, name):
            return store.get_file_info(name)

        def delete_file(self, name):
            store.delete_file(name)

        def move(self, a, b):
            assert store.get_file_info(b).type == fs.FileType.NotFound
            moves.append((a, b))
            store.move(a, b)

    for text in ("first", "second"):
        (tmp_path / "x.tmp").write_text(text)
        media.placed(Once(), str(tmp_path / "x.tmp"), str(tmp_path / "x.zip"))
    assert (tmp_path / "x.zip").read_text() == "second" and len(moves) == 2
