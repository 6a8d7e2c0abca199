"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the table of vote patterns and their
counts, which has at most 3 ** len(RULES) rows whatever the corpus, estimates how often each rule votes good and bad on good
and on bad documents, and the share of good ones; a document's posterior probability decides. Abstentions say nothing of the
class. The base rule (too few words, too much repetition) rejects before that.

Defined results: a null or empty text has no words and fails the base rule; repeated rows get equal verdicts; windows of
eight words count as repeated by a 64-bit and a 32-bit hash of their words; an empty table gives no rows; other columns are
kept by `filtered` whatever their names (`measured` puts its own in place of columns with the prefix q_).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_dir, words

WINDOW = 8
SPACES = " \t\n\x0b\f\r"
#: Characters by class: each becomes the class's own, so that one pass over a text serves all counts.
CLASSES = {"U": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#": "#*$%&|<>", "!": "!?", ".": ".,;:-_+=/\\\"'`~^@()[]{}", " ": SPACES}


def three(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).otherwise(0)


#: Rules over the columns of `measured`.
RULES = {
    "length": lambda c: three(c("n_words") >= 50, c("n_words") < 25),
    "word_length": lambda c: three((c("word_chars") >= 3 * c("n_words")) & (c("word_chars") <= 10 * c("n_words")), (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 16 * c("n_words"))),
    "symbols": lambda c: three(50 * c("n_symbols") <= c("n_words"), 5 * c("n_symbols") > c("n_words")),
    "marks_share": lambda c: three(25 * c("n_punct") <= c("word_chars"), 14 * c("n_punct") > c("word_chars")),
    "symbol_runs": lambda c: three(50 * c("n_runs") <= c("n_words"), 4 * c("n_runs") > c("n_words")),
    "bare_symbols": lambda c: three(50 * c("n_bare") <= c("n_words"), 5 * c("n_bare") > c("n_words")),
    "lines": lambda c: three((c("n_dup_lines") == 0) & (c("n_lines") >= 2), (4 * c("n_dup_lines") > c("n_lines")) & (c("n_lines") >= 3)),
    "repetition": lambda c: three(50 * c("n_repeat_words") <= c("n_words"), 5 * c("n_repeat_words") > c("n_words")),
    "variety": lambda c: three(2 * c("n_distinct") >= c("n_words"), 5 * c("n_distinct") < c("n_words")),
    "shouting": lambda c: three(5 * c("n_upper") <= c("word_chars"), 2 * c("n_upper") > c("word_chars")),
    "marks": lambda c: three(10 * c("n_marks") <= c("n_words"), c("n_marks") > c("n_words")),
}


def classified(text: Column) -> Column:
    return F.translate(text, "".join(CLASSES.values()), "".join(k * len(v) for k, v in CLASSES.items()))


def times(marks: str) -> Column:
    """How often the marks are in the classified text."""
    gone = F.length("q_class") - F.length(F.replace("q_class", F.lit(marks), F.lit("")))
    return F.floor(gone / len(marks)).cast("long")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts that rules use, under names with the prefix q_."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    m = F.size("q_words") - (WINDOW - 1)
    df = docs.withColumns({"q_words": words(F.col(text_col)), "q_lines": lines, "q_class": classified(text)})
    df = df.withColumn("q_hashes", F.when(m > 1, F.transform(F.sequence(F.lit(1), m), lambda i: F.xxhash64(F.slice("q_words", i, WINDOW)))))
    repeats = F.size(F.array_distinct("q_hashes")) < F.size("q_hashes")
    pairs = F.array_sort(F.transform("q_hashes", lambda h, i: F.struct(h.alias("h"), F.hash(F.slice("q_words", i + 1, WINDOW)).alias("g"), i.alias("i"))))
    df = df.withColumn("q_pairs", F.when(repeats, pairs))
    at = lambda j: F.get("q_pairs", j)
    same = lambda j, k: F.coalesce((at(j)["h"] == at(k)["h"]) & (at(j)["g"] == at(k)["g"]), F.lit(False))
    starts = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size("q_pairs") - 1), lambda j: same(j, j - 1) | same(j, j + 1)), lambda j: at(j)["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(starts, zero, lambda acc, s: F.struct((s + WINDOW).alias("end"), (acc["n"] + WINDOW - F.greatest(F.lit(0), acc["end"] - s)).alias("n")), lambda acc: acc["n"])
    return df.withColumns({
        "q_n_words": F.size("q_words").cast("long"),
        "q_word_chars": F.length("q_class").cast("long") - times(" "),
        "q_n_symbols": times("#"),
        "q_n_punct": times("#") + times("!") + times("."),
        "q_n_runs": times("##"),
        "q_n_bare": times(" # "),
        "q_n_lines": F.size("q_lines").cast("long"),
        "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        "q_n_repeat_words": F.when(F.col("q_pairs").isNotNull(), covered).otherwise(0).cast("long"),
        "q_n_distinct": F.size(F.array_distinct("q_words")).cast("long"),
        "q_n_upper": times("U"),
        "q_n_marks": times("!"),
    }).drop("q_words", "q_lines", "q_class", "q_hashes", "q_pairs")


def voted(df: DataFrame) -> DataFrame:
    column = lambda name: F.col(f"q_{name}")
    base = (column("n_words") < 20) | (100 * column("n_repeat_words") > 30 * column("n_words"))
    return df.withColumns({f"v_{name}": rule(column) for name, rule in RULES.items()} | {"q_base_failed": base})


VOTES = (1, 0, -1)


def log_odds(model: list[float]) -> Column:
    """Of being good, from a row's votes. The model is one array literal (see `fitted`), so that every iteration has the same plan."""
    weights = F.lit(model)
    return sum((F.get(weights, F.col(f"v_{r}") + (3 * i + 2)) for i, r in enumerate(RULES)), F.get(weights, F.lit(0)))


def posterior(model: list[float]) -> Column:
    return 1 / (1 + F.exp(-log_odds(model)))


def weights(good: dict[int, float], bad: dict[int, float]) -> list[float]:
    """Log-likelihood ratios of the votes -1, 0 and 1, from how often good and bad documents get them.

    A vote never counts against its own meaning, and an abstention for nothing: whether a rule speaks is not held to depend on
    the class, only how it votes then."""
    share = lambda of, v: (of[v] + 1) / (sum(of.values()) + 3)  # noqa: E731  one pseudo-vote a cell
    ratio = {v: math.log(share(good, v) / share(bad, v)) for v in VOTES}
    return [min(0.0, ratio[-1]), 0.0, max(0.0, ratio[1])]


def fitted(votes: DataFrame, iterations: int = 20, tolerance: float = 1e-4) -> list[float]:
    """[log-odds of the prior, weights of the first rule's votes -1, 0 and 1, of the second's, ...], by
    expectation-maximisation over all rows that pass the base rule.

    Each iteration sums posteriors by rule and vote: 33 rows reach the driver. Of the share of good documents, one document
    in ten thousand of each kind is taken for granted, so that its odds are finite; else it is what the votes say."""
    names = [f"v_{name}" for name in RULES]
    patterns = cut(votes.filter(~F.col("q_base_failed")).groupBy(*names).agg(F.count("*").alias("n")).coalesce(1))
    cells = F.explode(F.array(*[F.col(v) + (3 * i + 2) for i, v in enumerate(names)])).alias("cell")
    model = [math.log(4.0)] + [math.log(0.05 / 0.3), 0.0, math.log(0.7 / 0.4)] * len(RULES)
    for _ in range(iterations):
        each = patterns.select("n", posterior(model).alias("p"), cells)
        got = {r["cell"]: (r["g"], r["b"]) for r in each.groupBy("cell").agg(F.sum(F.col("p") * F.col("n")).alias("g"), F.sum((1 - F.col("p")) * F.col("n")).alias("b")).collect()}
        if not got:
            break
        sums = lambda i, side: {v: got.get(3 * i + 2 + v, (0.0, 0.0))[side] for v in VOTES}
        good, bad = sum(sums(0, 0).values()), sum(sums(0, 1).values())
        few = 1e-4 * (good + bad)
        new = [math.log((good + few) / (bad + few))]
        for i in range(len(RULES)):
            new += weights(sums(i, 0), sums(i, 1))
        moved = max(abs(a - b) for a, b in zip(new, model))
        model = new
        if moved < tolerance:
            break
    return model


def judged(votes: DataFrame, model: list[float], least: float = 0.5) -> DataFrame:
    return votes.withColumn("q_posterior", posterior(model)).withColumn("q_kept", ~F.col("q_base_failed") & (F.col("q_posterior") >= least))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    votes = cut(voted(measured(docs)).drop("text"))
    out = judged(votes, fitted(votes))
    return out.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in COUNTS], F.col("q_kept").alias("kept"), F.col("q_posterior").alias("posterior"))


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever their names.

    Rows are written once with their votes (in Parquet, in the shared folder), so that texts are counted only once."""
    spark, out = docs.sparkSession, fresh_dir(docs.sparkSession, "votes")
    votes = voted(measured(docs.select(F.struct("*").alias("row")), "row.text")).select("row", "q_base_failed", *[f"v_{name}" for name in RULES])
    votes.write.parquet(out)
    votes = spark.read.parquet(out)
    return judged(votes, fitted(votes)).filter("q_kept").select("row.*")
