"""Secret scans in DataFrame functions only: base patterns and a randomness test battery.

Base kinds are found by pattern. Other candidates are long runs of code characters; the encoding with the smallest alphabet
that holds a candidate (hex, base32 and base36 in either case, base62, base64) is assumed, and three tests are made of the hypothesis that its characters are
uniformly random: chi-squared over the alphabet, the number of runs of one kind of character (upper case, lower case, digit,
sign), and the serial correlation of neighbours. Their p-values are combined (three times the smallest).

A candidate is called secret for looking more random than ordinary identifiers of its length do. Their distribution is estimated
from the corpus: every document gives one identifier made of its own words, in one of five usual styles and of a length
drawn by hash (`ordinary`), which is tested in the same way; `COMMON` such identifiers of common words are added, so that a small corpus has
enough. The share of them that look at least as random as a candidate is the candidate's
p-value under the hypothesis "ordinary"; within each stratum of lengths (two for each doubling) the Benjamini-Hochberg procedure at level q picks the
secrets, so that the expected share of ordinary identifiers among what is called secret is at most q at each length. Short strings, on
which the tests have little power, need more evidence that way. A candidate whose randomness is rejected outright (`FLOOR`) is
none in any case. p-values are counted in bins, so the limits come from a table of at most strata x bins rows, and one
number a stratum reaches the driver.

Defined results: a null or empty text has no spans; repeated rows get equal spans; positions are code points; an empty table
gives no rows; a text without words gives no ordinary identifier. `redacted` keeps other columns whatever their names, null texts stay null; `scanned` puts its own in
place of columns with the prefix s_.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_dir

#: Base kinds: pattern, least length, group whose length counts.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    "access": (r"AKIA[A-Z0-9]{12,}", 16, 0),
    "hex": (r"[0-9a-f]{32,}", 32, 0),
}
CANDIDATE, LEAST, PLAIN = r"[A-Za-z0-9+/_-]{16,}={0,2}", 16, 24
#: Encodings of keys from the smallest alphabet; the first whose characters hold a candidate is taken.
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {
    "hex": ("^[0-9a-f]+$", DIGITS + "abcdef"),
    "HEX": ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    "BASE32": ("^[A-Z2-7]+$", UPPER + "234567"),
    "base32": ("^[a-z2-7]+$", LOWER + "234567"),
    "BASE36": ("^[A-Z0-9]+$", UPPER + DIGITS),
    "base36": ("^[a-z0-9]+$", LOWER + DIGITS),
    "base62": ("^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    "base64": ("", UPPER + LOWER + DIGITS + "+/"),
}
BINS = 120
#: Strata of lengths go on to 91 characters and more; a candidate with a smaller p-value of randomness is structured.
LAST, FLOOR = 13, 1e-3
COMMON = 3000
#: Common words for identifiers.
WORDS = (
    "account", "action", "address", "application", "array", "background", "block", "buffer", "button", "cache", "channel", "client", "column", "config", "connection",
    "content", "context", "counter", "current", "data", "default", "delete", "device", "document", "element", "error", "event", "factory", "field", "file", "filter",
    "format", "group", "handler", "header", "height", "image", "index", "input", "instance", "item", "language", "length", "level", "list", "load", "local", "manager",
    "message", "method", "module", "name", "network", "number", "object", "option", "output", "page", "parent", "path", "process", "project", "query", "reader",
    "record", "request", "response", "result", "row", "schema", "server", "service", "session", "source", "state", "status", "string", "system", "table", "target",
    "template", "test", "time", "type", "update", "user", "value", "version", "view", "width", "window", "writer",
)


def found(text: Column, pattern: str, least: int, group: int) -> Column:
    """array<struct<start, end, value>> of the pattern's leftmost matches; those whose group is short are dropped.

    The gaps between matches and the matches, in turn, give the positions."""
    kind = "array<struct<start:int,end:int,value:string>>"
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = (acc["at"] + F.length(x["gap"])).cast("int")
        b = (a + F.coalesce(F.length(x["all"]), F.lit(0))).cast("int")
        span = F.struct(a.alias("start"), b.alias("end"), x["part"].alias("value"))
        return F.struct(b.alias("at"), F.when(F.length(x["part"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(kind))


def tail(z: Column) -> Column:
    """Two-sided normal p-value; Abramowitz and Stegun 7.1.26."""
    x = F.abs(z) / 1.4142135623730951
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-30), poly * F.exp(-x * x)))


KINDS = (UPPER, LOWER, DIGITS, "+/")


def changes(letters: str) -> tuple[float, float]:
    """How likely two neighbours of a uniformly random string over the letters are of different kinds, and three are twice."""
    share = [sum(c in kind for c in letters) / len(letters) for kind in KINDS]
    return sum(p * (1 - p) for p in share), sum(p * (1 - p) ** 2 for p in share)


def p_value(value: Column) -> Column:
    """Combined p-value of a candidate's randomness; 0 for digits alone, letters of one case, and letters of both cases of
    fewer than `PLAIN` characters: on these the tests can't tell a word from a key."""
    encoding = lambda letters: F.struct(F.lit(letters).alias("letters"), *[F.lit(x).alias(k) for k, x in zip(("change", "both"), changes(letters))])

    def known(body: Column) -> Column:
        out = encoding(ALPHABETS["base64"][1])
        for pattern, letters in reversed([x for x in ALPHABETS.values() if x[0]]):
            out = F.when(body.rlike(pattern), encoding(letters)).otherwise(out)
        return out

    parts = lambda text: F.filter(F.split(text, ""), lambda c: c != "")
    as_kinds = "".join(KINDS), "".join(str(i) * len(k) for i, k in enumerate(KINDS))
    sum_of = lambda array, f: F.aggregate(array, F.lit(0.0), lambda acc, x: acc + f(x))
    neighbours = lambda array: F.zip_with(F.slice(array, 2, 1 << 30), F.slice(array, F.lit(1), F.size(array) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def split(x: Column) -> Column:
        codes = F.transform(parts(x["body"]), lambda c: F.instr(x["of"]["letters"], c) - 1)
        return F.struct(x["body"].alias("body"), x["of"].alias("of"), F.length(x["body"]).cast("double").alias("n"), F.length(x["of"]["letters"]).cast("double").alias("size"), codes.alias("codes"), parts(F.translate(x["body"], *as_kinds)).alias("kinds"))

    def scores(x: Column) -> Column:
        """Normal scores of the three tests; the first counts on its upper side alone."""
        n, size, of = x["n"], x["size"], x["of"]
        squares = sum_of(F.array_distinct(parts(x["body"])), lambda c: F.pow(n - F.length(F.replace(x["body"], c, F.lit(""))), F.lit(2.0)))
        chi = (squares * size / n - n - (size - 1)) / F.sqrt(2 * (size - 1))
        turns = sum_of(neighbours(x["kinds"]), lambda y: (y["a"] != y["b"]).cast("double"))
        spread = (n - 1) * of["change"] * (1 - of["change"]) + 2 * (n - 2) * (of["both"] - of["change"] * of["change"])
        runs = (turns - (n - 1) * of["change"]) / F.sqrt(F.greatest(spread, F.lit(1e-9)))
        middle = (size - 1) / 2
        product = sum_of(neighbours(x["codes"]), lambda y: (y["a"] - middle) * (y["b"] - middle))
        return F.array(F.greatest(F.lit(0.0), chi), runs, product / (((size * size - 1) / 12) * F.sqrt(n - 1)))

    def combined(body: Column) -> Column:
        letters = body.rlike("[A-Za-z]") & (body.rlike("[0-9]") | (body.rlike("[A-Z]") & body.rlike("[a-z]") & (F.length(body) >= PLAIN)))
        ps = F.transform(bound(bound(F.struct(body.alias("body"), known(body).alias("of")), split), scores), lambda z, i: tail(z) * F.when(i == 0, 0.5).otherwise(1.0))
        return F.when(letters, F.least(F.lit(1.0), 3 * F.array_min(ps))).otherwise(0.0)

    return bound(F.translate(F.regexp_replace(value, "=+$", ""), "-_", "+/"), combined)


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated only once however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def stratum(n: Column) -> Column:
    return F.least(F.lit(LAST), F.floor(2 * F.log2(n)).cast("int"))


def binned(p: Column) -> Column:
    """Bins of a p-value, the most random first."""
    return F.least(F.lit(BINS), F.floor(-4 * F.log10(F.greatest(p, F.lit(1e-30))))).cast("int")


def ordinary(text: Column) -> Column:
    """An identifier of words that stand near each other in the text, a place, style and length drawn by its hash; null without words."""
    draw = lambda k, n: F.pmod(F.xxhash64(text, F.lit(k)), n)
    near = F.substring(text, (1 + draw(1, F.greatest(F.length(text) - 240, F.lit(1)))).cast("int"), F.lit(240))
    plain = F.regexp_extract_all(near, F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,15}(?![A-Za-z0-9+/_=-])"), F.lit(0))

    def styled(x: Column) -> Column:
        camel = F.array_join(F.transform(x["words"], F.initcap), "")
        snake = F.lower(F.array_join(x["words"], "_"))
        style = draw(2, F.lit(5))
        number = F.when(style == 4, "").otherwise((1 + draw(3, F.lit(999))).cast("string"))
        body = F.when((style == 0) | (style == 4), camel).when(style == 1, snake).when(style == 2, F.upper(snake)).otherwise(F.replace(snake, F.lit("_"), F.lit("")))
        u = draw(4, F.lit(1 << 20)) / F.lit(float(1 << 20))
        n = F.floor(F.pow(F.lit(2.0), 4 + 3 * u)).cast("int")
        whole = F.repeat(body, F.ceil(n / F.greatest(F.length(body), F.lit(1))).cast("int"))
        return F.concat(F.substring(whole, F.lit(1), n - F.length(number)), number)

    return bound(F.struct(plain.alias("words")), lambda x: F.when(F.size(x["words"]) > 0, styled(x)))


VALUES = "array<struct<start:int,end:int,value:string>>"


def rated(values: Column) -> Column:
    return F.transform(values, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), p_value(c["value"]).alias("p"), stratum(F.length(c["value"])).alias("stratum")))


def unplaced(value: Column) -> Column:
    """An ordinary identifier as a value without a place."""
    return F.transform(F.array_compact(F.array(value)), lambda v: F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), v.alias("value")))


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with s_assign, s_access, s_hex: base spans; s_candidates: array<struct<start,end,p,stratum>> off the base spans, and
    s_ordinary: the same of an ordinary identifier."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumns({f"s_{k}": found(text, *v) for k, v in BASE.items()} | {"s_raw": found(text, CANDIDATE, LEAST, 0), "s_made": ordinary(text)})
    base = F.concat(*[F.col(f"s_{k}") for k in BASE])
    apart = F.filter("s_raw", lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    df = df.withColumn("s_rated", rated(F.concat(F.when(F.size("s_raw") > 0, apart).otherwise(F.array().cast(VALUES)), unplaced(F.col("s_made")))))
    return df.withColumns({"s_candidates": F.filter("s_rated", lambda c: c["end"] > 0), "s_ordinary": F.filter("s_rated", lambda c: c["end"] == 0)}).drop("s_raw", "s_made", "s_rated")


def of_common_words(spark) -> DataFrame:
    """s_ordinary of COMMON identifiers."""
    words = F.transform(F.array_sort(F.transform(F.lit(list(WORDS)), lambda w: F.struct(F.xxhash64(w, F.col("id")).alias("h"), w.alias("w")))), lambda x: x["w"])
    return spark.range(COMMON).select(rated(unplaced(bound(F.array_join(F.slice(words, 1, 30), " "), ordinary))).alias("s_ordinary"))


def thresholds(marked: DataFrame, q: float = 0.05) -> dict[int, int]:
    """By stratum, the last bin (see `binned`) of which candidates are secrets; a stratum without any is left out."""
    ordinaries = marked.select("s_ordinary").unionByName(of_common_words(marked.sparkSession))
    exploded = lambda df, name, n, o: df.select(F.explode(name).alias("c")).filter("c.p > 0").select(F.col("c.stratum").alias("stratum"), binned(F.col("c.p")).alias("bin"), F.lit(n).alias("n"), F.lit(o).alias("o"))
    bins = exploded(marked, "s_candidates", 1, 0).unionByName(exploded(ordinaries, "s_ordinary", 0, 1))
    bins = bins.groupBy("stratum", "bin").agg(F.sum("n").alias("n"), F.sum("o").alias("o"))
    whole = Window.partitionBy("stratum")  # at most BINS + 1 rows
    up_to = lambda c: F.sum(c).over(whole.orderBy("bin"))
    p = (1 + up_to("o")) / (1 + F.sum("o").over(whole))
    found_ = bins.withColumn("ok", (F.col("n") > 0) & (p * F.sum("n").over(whole) <= q * up_to("n")))
    rows = found_.filter("ok").groupBy("stratum").agg(F.max("bin").alias("bin")).collect()
    return {r["stratum"]: r["bin"] for r in rows}  # strata are lengths' logarithms: LAST at most


def with_spans(marked: DataFrame, edges: dict[int, int]) -> DataFrame:
    """marked with s_base and s_spans: array<struct<start,rank,end,kind>> by start, then kind as listed."""
    def of(name: str, rank: int, kind: str) -> Column:
        return F.transform(name, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    limits = F.lit([edges.get(k, -1) for k in range(LAST + 1)])
    kept = F.filter("s_candidates", lambda c: (c["p"] > FLOOR) & (binned(c["p"]) <= F.get(limits, c["stratum"])))
    df = marked.withColumn("s_random", kept)
    base = [of(f"s_{k}", i, k) for i, k in enumerate(BASE)]
    return df.withColumns({"s_base": F.array_sort(F.concat(*base)), "s_spans": F.array_sort(F.concat(*base, of("s_random", len(BASE), "random")))})


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = cut(scanned(docs).drop("text"))
    df = with_spans(marked, thresholds(marked))
    return df.select("doc_id", *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in BASE], F.sha2(joined("s_base"), 256).alias("base_sha256"), joined("s_spans").alias("spans"))


def redacted(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """docs with each secret's span replaced by the mark (overlapping spans by one), and n_chars, if there, to match.

    Rows are written once with their spans (in Parquet, in the shared folder), so that texts are scanned only once."""
    spark, out = docs.sparkSession, fresh_dir(docs.sparkSession, "scanned")
    scanned(docs.select(F.struct("*").alias("row")), "row.text").write.parquet(out)
    marked = spark.read.parquet(out)
    df = with_spans(marked, thresholds(marked))
    text = F.col("row.text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= acc["at"], F.concat(acc["out"], text.substr(acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), gap.alias("out"))

    new = F.aggregate("s_spans", start, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    df = df.select("row", F.when(F.size("s_spans") > 0, new).otherwise(text).alias("redacted"), (F.size("s_spans") > 0).alias("any"))
    values = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(F.col("any"), F.length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(values["n_chars"])
    return df.select(*[v.alias(c) for c, v in values.items()])
