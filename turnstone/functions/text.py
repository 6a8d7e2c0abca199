"""Column functions over utterances."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

EOT = " __eot__ "
#: A word boundary of ASCII words, as in SQL. Java's own takes letters of all scripts for words': it has none in "doña", SQL has one after "do".
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def ascii_only(text: Column) -> Column:
    """The text with a sign for each other character, so that word boundaries are those of ASCII words. Cheaper than EDGE in patterns that only ask."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "\u00a4")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(tokens(text))


def clean(text: Column) -> Column:
    """Masks urls, paths and addresses, strips nicks, lowers, expands contractions, keeps plain characters only."""
    t = F.coalesce(text, F.lit(""))
    for pattern, mask in ((f"(?i){fixed.URL}", " __url__ "), (fixed.PATH, " __path__ "), (fixed.IPV4, " __ip__ "), (fixed.NICK, "")):
        t = F.regexp_replace(t, pattern.replace(r"\b", EDGE), mask)
    t = F.regexp_replace(F.lower(t), fixed.ADDRESS, "")
    table = F.create_map(*map(F.lit, chain.from_iterable(fixed.CONTRACTIONS.items())))
    t = F.array_join(F.transform(tokens(t), lambda w: F.coalesce(table[w], w)), " ")
    for pattern, new in fixed.CLEANUP:
        t = F.regexp_replace(t, pattern, new)
    return F.trim(F.array_join(F.filter(F.transform(tokens(t), lambda w: F.regexp_replace(w, "^'+", "")), lambda w: w != ""), " "))


def count_of(text: Column, pattern: str) -> Column:
    """How many characters of the class are in the text."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def is_paste(text: Column) -> Column:
    n = F.length(text)
    special = n - F.length(F.translate(text, fixed.PASTE_SPECIAL, ""))
    colons = n - F.length(F.translate(text, ":", ""))
    return (n >= 10) & ((count_of(text, r"\p{L}") / n < 0.30) | (special / n > 0.15) | ((colons >= 3) & (n < 200)))


def is_repetitive(text: Column) -> Column:
    """More than half of at least four words are one word. Equal words are neighbours once sorted: the longest run counts."""
    w = F.sort_array(tokens(F.lower(text)))
    none = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"), (acc["n"] + 1).alias("n"))

    return F.coalesce(F.aggregate(w, none, step, lambda acc: (acc["n"] >= 4) & (2 * acc["best"] > acc["n"])), F.lit(False))


def ascii_ratio(text: Column) -> Column:
    t = F.regexp_replace(text, "__url__|__path__|__cmd__|__number__", " ")
    return F.try_divide(count_of(t, "[A-Za-z]"), count_of(t, r"\p{L}"))


def is_english(text: Column) -> Column:
    t = F.regexp_replace(text, "__url__|__path__|__cmd__|__number__", " ")
    return (count_of(t, r"\p{L}") < 3) | F.coalesce(ascii_ratio(text) >= 0.80, F.lit(True))


def is_placeholder_only(text: Column) -> Column:
    return text.rlike(fixed.PLACEHOLDERS)


def is_bot_response(text: Column) -> Column:
    out = F.lit(False)
    for p in fixed.BOT_PREFIXES:
        out = out | text.startswith(p)
    return out


def is_echo(ctx: Column, resp: Column) -> Column:
    flat = F.lower(F.trim(F.regexp_replace(F.regexp_replace(ctx, "__eot__|__user__", " "), r"\s{2,}", " ")))
    return (F.length(resp) >= 6) & flat.contains(F.lower(resp))


def content_words(text: Column) -> Column:
    stop = F.array(*map(F.lit, fixed.STOPWORDS))
    return F.array_distinct(F.filter(tokens(text), lambda w: w.rlike("^[a-z]{4,}$") & ~F.array_contains(stop, w)))


def is_incoherent(ctx: Column, resp: Column, least: int = 5) -> Column:
    """The latest context turn with enough content words shares none with a response that has enough."""
    turns = F.filter(F.transform(F.reverse(F.split(ctx, EOT)), content_words), lambda w: F.size(w) >= least)
    last, own = F.try_element_at(turns, F.lit(1)), content_words(resp)
    return F.coalesce((F.size(own) >= least) & ~F.arrays_overlap(last, own), F.lit(False))


def command_pattern() -> str:
    return r"(?i)\b(" + "|".join(fixed.COMMANDS) + r")\b"


def is_command(text: Column) -> Column:
    return ascii_only(text).rlike(command_pattern()) | text.contains("__path__")


def last_substantive(ctx: Column, lookback: int = 3, least: int = 4) -> Column:
    turns = F.split(ctx, EOT)
    recent = F.reverse(F.slice(turns, F.greatest(F.size(turns) - lookback + 1, F.lit(1)), F.lit(lookback)))
    return F.coalesce(F.try_element_at(F.filter(recent, lambda t: n_words(t) >= least), F.lit(1)), F.element_at(turns, -1))


def is_question(ctx: Column) -> Column:
    return ascii_only(last_substantive(ctx)).rlike("|".join(fixed.QUESTIONS.values()))


def parse_date(text: Column) -> Column:
    """timestamp_ntz of the four accepted forms; null for others."""
    fraction = "".join(f"[.{'S' * n}]" for n in range(6, 0, -1))
    kinds = (f"yyyy-MM-dd'T'HH:mm:ss{fraction}'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(k)) for k in kinds]).cast("timestamp_ntz")


def mask_speakers(text: Column, names: Column) -> Column:
    """Names with a digit or special sign, or of more than nine characters, become __user__; longest first."""
    odd = F.filter(names, lambda n: n.rlike(fixed.SPEAKER_SPECIAL) | (F.length(n) > 9))
    order = F.transform(F.sort_array(F.transform(F.array_distinct(odd), lambda n: F.struct(F.length(n).alias("l"), n.alias("n"))), asc=False), lambda x: x["n"])
    return F.aggregate(order, text, lambda acc, n: F.regexp_replace(acc, F.concat(F.lit(rf"{EDGE}\Q"), n, F.lit(rf"\E{EDGE}")), F.lit("__user__")))


def mask_bots(text: Column) -> Column:
    names = "|".join(sorted(fixed.BOTS, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?i)(?<!\w)(?:{names})(?:'s)?(?!\w)", "__user__")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1b\[[0-9;]*[A-Za-z]|\x1b\][^\x07]*\x07|\r", "")


def ngrams(array: Column, n: int) -> Column:
    """array of n-grams joined by a unit separator; [] where there are fewer than n."""
    grams = F.transform(F.sequence(F.lit(1), F.size(array) - n + 1), lambda i: F.array_join(F.slice(array, i, n), "\x1f"))
    return F.when(F.size(array) >= n, grams).otherwise(F.array().cast("array<string>"))
