"""Column functions over id arrays, distributions and vectors."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD, UNK, SOS, EOS = 0, 1, 2, 3


def tail(a: Column, n: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n))


def framed(a: Column, n: int) -> Column:
    """The first n ids between begin and end."""
    return F.concat(F.array(F.lit(SOS)), F.slice(a, 1, n), F.array(F.lit(EOS)))


def padded(a: Column, width: Column) -> Column:
    return F.concat(a, F.array_repeat(F.lit(PAD), F.greatest(F.lit(0), width - F.size(a)).cast("int")))


def without(a: Column, ids: tuple[int, ...]) -> Column:
    return F.filter(a, lambda x: ~x.isin(*ids))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when((norm(a) < 1e-9) | (norm(b) < 1e-9), 0.0).otherwise(F.try_divide(dot(a, b), n))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated only once however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def shares(a: Column) -> Column:
    """a divided by its sum."""
    return bound(F.struct(a.alias("a"), total(a).alias("t")), lambda x: F.transform(x["a"], lambda y: y / x["t"]))


def softmax(a: Column, temperature: float = 1.0) -> Column:
    return shares(bound(F.struct(a.alias("a"), F.array_max(a).alias("top")), lambda x: F.transform(x["a"], lambda y: F.exp((y - x["top"]) / temperature))))


def nucleus(p: Column, top_p: float = 0.9) -> Column:
    """p renormalised over the most probable ids, up to the one whose predecessors reach top_p; others are 0."""

    def kept(p: Column) -> Column:
        ahead = lambda x, i: total(F.transform(p, lambda y, j: F.when((y > x) | ((y == x) & (j < i)), y).otherwise(0.0)))
        return F.transform(p, lambda x, i: F.when(ahead(x, i) > top_p, 0.0).otherwise(x))

    return shares(bound(p, kept))


def blocked(ids: Column, n: int) -> Column:
    """ids that would repeat an n-gram of the sequence."""
    m = F.size(ids)
    last = F.slice(ids, F.greatest(m - n + 2, F.lit(1)), F.lit(n - 1))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), m - n + 1)), lambda i: F.slice(ids, i, n - 1) == last)
    return F.when(m >= n, F.array_distinct(F.transform(at, lambda i: F.get(ids, i + n - 2)))).otherwise(F.array().cast("array<int>"))


def beam_score(logp: Column, length: Column, penalty: float = 0.7) -> Column:
    return logp / F.pow(F.greatest(length, F.lit(1)), F.lit(penalty))


def perplexity(confidences: Column) -> Column:
    logs = F.transform(confidences, lambda c: F.log(F.greatest(c, F.lit(1e-10))))
    return F.when(F.size(confidences) > 0, F.exp(-total(logs) / F.size(confidences))).otherwise(0.0)


def teacher_forcing(epoch: Column, first_end: int = 5, second_end: int = 12, high: float = 0.9, low: float = 0.5) -> Column:
    """1 in the first phase, linear from high to low in the second, low after."""
    slope = (high - low) / (second_end - first_end - 1)
    return F.when(epoch <= first_end, 1.0).when(epoch <= second_end, high - (epoch - first_end - 1) * slope).otherwise(low)


def warmup_cosine(step: Column, warmup: int, steps: int, floor: float = 0.0) -> Column:
    progress = F.least(F.lit(1.0), (step - warmup) / max(1, steps - warmup))
    return F.when(step < warmup, step / max(1, warmup)).otherwise(floor + (1 - floor) * 0.5 * (1 + F.cos(math.pi * progress)))
