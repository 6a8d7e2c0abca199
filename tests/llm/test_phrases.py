"""Phrase mining against a plain version that counts every phrase, and its parts."""

import random
import re
from collections import Counter, defaultdict

import pytest

from turnstone.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top, least):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        phrase = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        hidden = {p[i : i + k] for p, b in phrase.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * b >= 80 * c[p[i : i + k]]}
        found = []
        for p, a in phrase.items():
            if p not in hidden:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def got(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def some(seed, n):
    r = random.Random(seed)
    names = ["the", "THE", "of", "a", "é", "x"] + [f"w{i}" for i in range(25)]
    fixed = ["new york city hall", "in the end, of course", "a a a a a", "x the x the"]
    texts = [" ".join(r.choice(fixed) if r.random() < 0.15 else r.choice(names[: r.choice((4, 12, 31))]) + r.choice(("", "", "", ".", "\t", "\n", ",")) for _ in range(r.choice((0, 1, 8, 60)))) for _ in range(n)]
    return [(t if r.random() > 0.02 else None, r.choice(("en", "en", "de", None))) for t in texts]


@pytest.mark.parametrize(("seed", "top", "block"), [(1, 2000, 500_000), (2, 7, 300)])
def test_equals_plain_version(spark, seed, top, block):
    rows = some(seed, 400)
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    assert got(phrases.collocations(docs, top=top, least=10, block_words=block)) == plain(rows, top, 10)


def test_salted_pivots_count_the_same(spark):
    """One pair is a third of all words, so that its pivot is salted over cells."""
    r = random.Random(3)
    rows = [(" ".join("hot pair " + r.choice("abcdefgh") for _ in range(200)), "en") for _ in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert max(w["f"] for w in phrases.counted(docs, 30, block_words=5000)[1].collect()) > 2 * 10_000
    assert got(phrases.collocations(docs, block_words=5000)) == plain(rows, 2000, 30)


def test_defined_results(spark):
    docs = spark.createDataFrame([(None, None), ("", "en"), ("One Two. " * 40, None), ("one two " * 50_000, "de")], "text string, lang string")
    assert got(phrases.collocations(docs)) == plain([tuple(r) for r in docs.collect()], 2000, 30)
    assert phrases.collocations(docs.limit(0)).count() == 0
