"""Planted keys of each encoding are secrets; identifiers and words are not."""

import re

import numpy as np
from pyspark.sql import functions as F

from turnstone.llm import secrets

PLANTED = {"HEX": (32, 40), "BASE32": (24, 32), "base32": (24, 32), "BASE36": (24, 32), "base36": (20, 32), "base62": (20, 40), "base64": (24, 40), "hex": (20, 28)}


def test_planted_keys_of_each_encoding(spark):
    rng = np.random.default_rng(8)
    rows = [(name, "".join(rng.choice(list(secrets.ALPHABETS[name][1]), n))) for name, lengths in PLANTED.items() for n in lengths for _ in range(25)]
    rows += [("mixed", "".join(rng.choice(list(secrets.UPPER + secrets.LOWER), 32))) for _ in range(25)]
    words = ["the_quick_brown_fox_jumps_over_the_lazy_dog", "InternationalizationAndLocalizationSettings", "donaudampfschifffahrtsgesellschaft", "telecommunications", "A" * 40, "=" * 5 + "-" * 40, "12345678901234567890"]
    rows += [("word", w) for w in words for _ in range(10)]
    df = spark.createDataFrame([(i, k, f"x {v} y") for i, (k, v) in enumerate(rows)], "doc_id long, kind string, text string")
    marked = secrets.scanned(df)
    caught = {r["kind"]: r["share"] for r in secrets.with_spans(marked, secrets.thresholds(marked)).groupBy("kind").agg(F.avg((F.size("s_spans") > 0).cast("double")).alias("share")).collect()}
    assert caught.pop("word") == 0
    assert min(caught.values()) >= 0.85, caught


def prose(spark, n):
    """Texts of the corpus without secrets, as ground for planted ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'").select(F.substring("text", 1, 400).alias("text"))
    clean = docs.filter(~F.col("text").rlike("[A-Za-z0-9+/_-]{16,}"))
    return [r["text"] for r in clean.limit(n).collect()]


def identifier(rng, words):
    parts = [w for w in rng.choice(words, 6) if w.isascii() and w.isalpha()]
    style = rng.integers(0, 4)
    made = ("".join(p.capitalize() for p in parts), "_".join(parts).lower(), "_".join(parts).upper(), "".join(parts).lower())[style]
    return (made + "Abcdefghijklmnop"[: max(0, 15 - len(made))])[: int(rng.integers(16, 60))] + str(rng.integers(1, 999))


def test_false_discoveries_are_bounded_at_each_length(spark):
    """Planted keys among many ordinary identifiers: of what is called secret, few are identifiers, short ones included."""
    rng = np.random.default_rng(12)
    texts = prose(spark, 300)
    words = [w.strip(".,;!?") for t in texts for w in t.split() if 2 < len(w.strip(".,;!?")) < 12]
    rows = []
    for i in range(900):
        key = i % 3 == 0
        n = int(rng.integers(20, 60))
        value = "".join(rng.choice(list(secrets.ALPHABETS["base62"][1]), n)) if key else identifier(rng, words)
        rows.append((i, key, len(value), f"{texts[i % len(texts)]} {value} end"))
    df = spark.createDataFrame(rows, "doc_id long, planted boolean, n int, text string")
    marked = secrets.scanned(df)
    out = secrets.with_spans(marked, secrets.thresholds(marked)).select("planted", "n", (F.size("s_random") > 0).alias("found")).collect()
    assert sum(r["found"] for r in out if r["planted"]) >= 0.85 * sum(r["planted"] for r in out)
    for least, most in ((16, 32), (32, 64)):
        called = [r["planted"] for r in out if r["found"] and least <= r["n"] < most]
        assert called and sum(not x for x in called) <= 0.1 * len(called), (least, len(called), sum(called))


def test_identifiers_alone_are_no_secrets(spark):
    rng = np.random.default_rng(13)
    texts = prose(spark, 200)
    words = [w.strip(".,;!?") for t in texts for w in t.split() if 2 < len(w.strip(".,;!?")) < 12]
    rows = [(i, f"{texts[i % len(texts)]} {identifier(rng, words)} end") for i in range(400)] + [(1000, "TheQuickBrownFoxJumpsOver13LazyDogsAgain")]
    marked = secrets.scanned(spark.createDataFrame(rows, "doc_id long, text string"))
    out = secrets.with_spans(marked, secrets.thresholds(marked)).select("doc_id", (F.size("s_random") > 0).alias("found")).collect()
    assert sum(r["found"] for r in out) <= 4 and not any(r["found"] for r in out if r["doc_id"] == 1000)


def slow_p(value):
    """Combined p-value of randomness, by numpy and the error function."""
    from math import erfc, sqrt

    body = value.rstrip("=").replace("-", "+").replace("_", "/")
    letters = next(x for p, x in secrets.ALPHABETS.values() if not p or re.fullmatch(p, body))
    codes = np.array([letters.index(c) for c in body], float)
    n, size = len(codes), len(letters)
    counts = np.bincount(codes.astype(int), minlength=size)
    chi = ((counts - n / size) ** 2 / (n / size)).sum()
    z = (chi - (size - 1)) / sqrt(2 * (size - 1))
    mid, kind = codes - (size - 1) / 2, ["".join(str(k) for k, x in enumerate(secrets.KINDS) if c in x) for c in body]
    share = [sum(c in x for c in letters) / size for x in secrets.KINDS]
    change, both = sum(p * (1 - p) for p in share), sum(p * (1 - p) ** 2 for p in share)
    runs = (sum(a != b for a, b in zip(kind, kind[1:])) - (n - 1) * change) / sqrt((n - 1) * change * (1 - change) + 2 * (n - 2) * (both - change**2))
    serial = (mid[1:] * mid[:-1]).sum() / ((size * size - 1) / 12 * sqrt(n - 1))
    return min(1.0, 3 * min(1.0 if z <= 0 else erfc(z / sqrt(2)) / 2, erfc(abs(runs) / sqrt(2)), erfc(abs(serial) / sqrt(2))))


def test_spans_equal_brute_force(spark):
    """p-values against numpy; the secrets against Benjamini-Hochberg over the same table of p-values."""
    rng = np.random.default_rng(14)
    texts = prose(spark, 150)
    words = [w.strip(".,;!?") for t in texts for w in t.split() if 2 < len(w.strip(".,;!?")) < 12]
    rows = [(i, "".join(rng.choice(list(secrets.ALPHABETS["base62"][1]), int(rng.integers(16, 50)))) if i % 2 else identifier(rng, words)) for i in range(150)]
    df = spark.createDataFrame([(i, v, f"{texts[i]} {v} end") for i, v in rows], "doc_id long, value string, text string")
    marked = secrets.cut(secrets.scanned(df))
    got = {r["doc_id"]: r for r in secrets.with_spans(marked, secrets.thresholds(marked)).collect()}
    for i, v in rows:
        for c in got[i]["s_candidates"]:
            if c["p"] > 0 and c["end"] - c["start"] == len(v):
                assert abs(c["p"] - max(3e-30, slow_p(v))) <= 1e-5 + 1e-3 * c["p"]
    bin_of = lambda p: min(secrets.BINS, int(np.floor(-4 * np.log10(max(p, 1e-30)))))
    candidates = [(i, c["stratum"], bin_of(c["p"]), c["p"], c["start"], c["end"]) for i, r in got.items() for c in r["s_candidates"] if c["p"] > 0]
    ordinary = [(c["stratum"], bin_of(c["p"])) for r in [*got.values(), *secrets.of_common_words(spark).collect()] for c in r["s_ordinary"] if c["p"] > 0]
    want = set()
    for k in {c[1] for c in candidates}:
        mine, null = sorted((c for c in candidates if c[1] == k), key=lambda c: c[2]), [b for s, b in ordinary if s == k]
        p = [(1 + sum(b <= c[2] for b in null)) / (1 + len(null)) for c in mine]
        last = max((c[2] for x, c in zip(p, mine) if x * len(mine) <= 0.05 * sum(d[2] <= c[2] for d in mine)), default=-1)
        want |= {(c[0], c[4], c[5]) for c in mine if c[2] <= last and c[3] > secrets.FLOOR}
    assert {(i, c["start"], c["end"]) for i, r in got.items() for c in r["s_random"]} == want and want


def test_redaction_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a token=abcdefgh12 b", 1, 2, "x", 9)], "doc_id long, text string, s_raw int, s_spans int, row string, n_chars int")
    out = secrets.redacted(df)
    assert out.columns == df.columns and tuple(out.first()) == (1, "a [REDACTED] b", 1, 2, "x", 14)
