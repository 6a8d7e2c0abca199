"""Perplexity by an interpolated modified Kneser-Ney n-gram model, counted in Spark and kept as sorted hash arrays.

Counting: tasks read training texts and count n-grams of the highest order in large buffers; counts are dealt by the n-gram's hash, so
that no word, however frequent, is one task's burden. A task adds up a range of hashes, writes it as sorted arrays into the shared
folder and passes on, one row of arrays for each task of the next order, its n-grams without their first word (whose number of distinct first
words is the lower order's count) and the sums of its contexts. So all orders are counted in one chain of shuffles; what
reaches the driver is a row of counts of counts an order, from which the discounts follow.

Scoring: workers map the arrays into memory, a file a range of hashes, and look up each batch's distinct n-grams in ascending order; nothing is
shuffled or held whole, and pages are shared by a machine's workers. The shared folder must be one that workers can map (a mounted path).

The model: p(w | c) = (n(cw) - D) / n(c.) + g(c) p(w | c without its first word), with D by count (1, 2, 3 and more), down to a uniform
distribution over the V training tokens and one for all unknown ones. Lower orders count distinct first words; n-grams that begin a
text, which have none, count occurrences. Discounts that can't be computed (a small corpus lacks counts of 1 to 4) are 0.5, 1 and 1.5. Words
are known by 64-bit hashes; two n-grams of one hash would be taken for one.

Defined results: a null or empty text is its end token alone; a null id is that of an empty text, in training; repeated rows count
and are scored each; an empty table gives no rows; without training texts all scores are 0; other columns are not read.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir
from .packed import packed, steps, unpacked

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
#: A word's hash is a polynomial of its bytes' random values in BASE, modulo 2^64, mixed with its length.
VALUES, BASE = np.random.default_rng(20_240_229).integers(0, 1 << 64, 256, dtype=np.uint64), 0x5851F42D4C957F2D
BEGIN, END = 1, 2  # hashes of no word but by chance
NGRAMS, CONTEXTS, STATS = 0, 1, 2
ROW = "part int, level int, kind int, data binary, stats array<long>"
ARROW = pa.schema([("part", pa.int32()), ("level", pa.int32()), ("kind", pa.int32()), ("data", pa.binary()), ("stats", pa.list_(pa.int64()))])
N_STATS = 10  # n-grams of adjusted count 1, 2, 3, 4; 3 and more; keys; sum of adjusted counts; occurrences; keys that occur; rows


class Powers:
    """BASE and its inverse to the powers 0, 1, 2, ..., as far as a batch needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 22)
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64)))) for b in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up, self.down


def tokens(texts: list[bytes | None], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """All texts' hashes one after another, each text's begin and end included; where each text starts, and the end.

    All bytes are hashed at once: a word's value is a difference of prefix sums, divided by the power of its place."""
    data = np.frombuffer(b"\n".join([x or b"" for x in texts]).translate(LOWER), np.uint8)
    inner = ~SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inner, [False]))))
    first, last = edges[::2], edges[1::2]
    up, down = powers.to(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(VALUES[data] * up[: len(data)])))
    hashes = mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    at = np.cumsum([0, *[len(x or b"") + 1 for x in texts]])
    sizes = np.diff(np.searchsorted(first, at))
    starts = np.concatenate(([0], np.cumsum(sizes + 2)))
    out, inside = np.empty(starts[-1], np.uint64), np.ones(starts[-1], bool)
    out[starts[:-1]], out[starts[1:] - 1] = BEGIN, END
    inside[starts[:-1]] = inside[starts[1:] - 1] = False
    out[inside] = hashes
    return out, starts


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of n-grams from their prefixes' hashes and last words."""
    return mixed(prefix * np.uint64(0x9E3779B97F4A7C15) + word)


def key_of(columns: list[np.ndarray]) -> np.ndarray:
    out = columns[0]
    for c in columns[1:]:
        out = longer(out, c)
    return out


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """Range of hashes, ascending with the hash."""
    return (((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def added(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys ascending, a place of each, and the sums of values by key."""
    if not len(key):
        return key, np.zeros(0, np.int64), [v[:0] for v in values]
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], order[first], [np.add.reduceat(v[order], first) for v in values]


def ngram_rows(level: int, columns: list[np.ndarray], raw: np.ndarray, adjusted: np.ndarray, parts: int) -> list[dict]:
    """One row for each part, its n-grams in order of (the leading bits of) their first words."""
    part, bits = part_of(key_of(columns), parts), np.uint64(parts.bit_length())
    order = np.argsort((part.astype(np.uint64) << (np.uint64(64) - bits)) | (columns[0] >> bits))
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    columns, raw, adjusted = [c[order] for c in columns], raw[order], adjusted[order]
    return [{"part": p, "level": level, "kind": NGRAMS, "data": packed(steps(columns[0][a:b]), *[c[a:b] for c in columns[1:]], raw[a:b], adjusted[a:b])} for p, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]


def counted(train: DataFrame, order: int, parts: int, buffer: int) -> DataFrame:
    """Rows of n-grams of the highest order with their counts in a buffer, and those of lower orders that begin a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, size = Powers(), [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for level in range(2, order + 1):
                columns = [np.concatenate([x[level][i] for x in held]) for i in range(level)]
                _, at, (n,) = added(key_of(columns), np.ones(len(columns[0]), np.uint64))
                if rows := ngram_rows(level, [c[at] for c in columns], n, n, parts):
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

        for texts in slices(batches, 0):
            all_words, starts = tokens(texts, powers)
            last = np.repeat(starts[1:], np.diff(starts))
            found = {}
            for level in range(2, order + 1):  # all n-grams of the highest order; of lower ones those at the beginning
                at = np.flatnonzero(np.arange(len(all_words)) + level <= last) if level == order else starts[:-1][np.diff(starts) >= level]
                found[level] = [all_words[at + i] for i in range(level)]
            held.append(found)
            size += len(all_words)
            if size >= buffer:
                yield from flushed()
                held, size = [], 0
        if held:
            yield from flushed()

    return train.mapInArrow(run, ROW)


def slices(batches: Iterator[pa.RecordBatch], column: int, chars: int = 3_000_000) -> Iterator[list[bytes | None]]:
    """A column's values, some `chars` bytes at a time."""
    held, size = [], 0
    for batch in batches:
        for x in batch.column(column):
            held.append(x.as_py())
            size += len(held[-1] or b"")
            if size >= chars:
                yield held
                held, size = [], 0
    if held:
        yield held


def reduced(dealt: DataFrame, level: int, top: int, parts: int, folder: str) -> DataFrame:
    """Adds up each part's n-grams, writes its arrays, and passes on what the next order needs and the rows of lower orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, contexts, part = [], [], None
        for batch in batches:
            own = [r == level and k != STATS for r, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            if not all(own):
                yield batch.filter(pa.array([not x for x in own]))
            for r in batch.filter(pa.array(own)).to_pylist():
                data = unpacked(r["data"])
                data[0] = np.cumsum(data[0], dtype=np.uint64)
                (grams if r["kind"] == NGRAMS else contexts).append(data)
                part = r["part"]
        if part is None:
            return
        columns = [np.concatenate(x) for x in zip(*grams)] if grams else [np.zeros(0, np.uint64)] * (level + 2)
        key, at, (raw, adjusted) = added(key_of(columns[:level]), *columns[level:])
        words = [c[at] for c in columns[:level]]
        arrays = {"key": key, "adjusted": adjusted, "raw": raw}
        if contexts:
            own_key, _, sums = added(*[np.concatenate(x) for x in zip(*contexts)])
            every = np.union1d(key, own_key)
            arrays = {k: spread(every, key, v) for k, v in arrays.items()} | {f"context{i}": spread(every, own_key, v) for i, v in enumerate(sums)} | {"key": every}
        if level > 1:
            del arrays["raw"]
        store(f"{folder}/{level}-{part}", arrays)
        rows = [{"part": 0, "level": level, "kind": STATS, "stats": [*[int((adjusted == i).sum()) for i in (1, 2, 3, 4)], int((adjusted >= 3).sum()), len(key), int(adjusted.sum()), int(raw.sum()), int((raw > 0).sum()), 1]}]
        if level > 1:
            rest = words[1:]
            _, at, (raw, adjusted_) = added(key_of(rest), raw, np.ones(len(raw), np.uint64))
            rows += ngram_rows(level - 1, [c[at] for c in rest], raw, adjusted_, parts)
            context, _, sums = added(key_of(words[:-1]), adjusted, *[(adjusted == i).astype(np.uint64) for i in (1, 2)], (adjusted >= 3).astype(np.uint64))
            ends = np.searchsorted(part_of(context, parts), np.arange(parts + 1))
            rows += [{"part": p, "level": level - 1, "kind": CONTEXTS, "data": packed(steps(context[a:b]), *[s[a:b] for s in sums])} for p, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_pylist(rows[i : i + 256], schema=ARROW)

    return dealt.mapInArrow(run, ROW)


def spread(every: np.ndarray, key: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(every), np.uint64)
    out[np.searchsorted(every, key)] = values
    return out


def store(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of arrays, in the narrowest types that hold them; a task that runs again replaces it by the same."""
    arrays = {k: a if k == "key" else a.astype(np.min_scalar_type(int(a.max(initial=0)))) for k, a in arrays.items()}
    at, head = 1024, {}
    for k, a in arrays.items():
        head[k] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 8) * 8
    with open(own := f"{path}.{uuid.uuid4().hex}", "wb") as f:
        f.write(json.dumps(head).encode().ljust(1024))
        for a in arrays.values():
            f.write(a.tobytes() + bytes(-a.nbytes % 8))
    os.replace(own, path)


def mapped(path: str) -> dict[str, np.ndarray]:
    raw = np.memmap(path, np.uint8, "r")
    return {k: raw[at : at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, n, at) in json.loads(raw[:1024].tobytes()).items()}


def discounts(n: list[int]) -> list[float]:
    """Of counts 0, 1, 2 and more than 2, from the numbers of n-grams with counts 1 to 4."""
    if not all(n):
        return [0.0, 0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [0.0, *[min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.0), float(i)) for i in (1, 2, 3)]]


@dataclass
class Model:
    """A few numbers an order; the arrays are in the folder."""

    folder: str
    order: int
    parts: int
    discounts: list[list[float]]  # by order, from 1
    n_tokens: int
    n_types: int
    base: tuple[float, float]  # sum of the unigrams' counts; what they leave to the uniform distribution


def mounted(folder: str) -> str:
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"workers map the model's arrays: {folder} must be a mounted path")
    return url.path


def learned(train: DataFrame, order: int = 2, buffer: int = 1 << 22) -> Model:
    """train: one column, text as binary."""
    if order < 2:
        raise ValueError("the order must be 2 or more")
    spark = train.sparkSession
    parts, folder = int(spark.conf.get("spark.sql.shuffle.partitions")), mounted(fresh_dir(spark, "ngrams"))
    os.makedirs(folder)
    rows = counted(train, order, parts, buffer)
    for level in range(order, 0, -1):
        rows = reduced(rows.repartitionById(parts, F.col("part")), level, order, parts, folder)
    sums = rows.filter(F.col("kind") == STATS).groupBy("level").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(N_STATS)]).collect()
    by = {r["level"]: list(r)[1:] for r in sums}
    by = {level: by.get(level, [0] * N_STATS) for level in range(1, order + 1)}
    each = [discounts(by[level][:4]) for level in by]
    one, two, _, _, more, _, total, n_tokens, n_types, _ = by[1]
    left = each[0][1] * one + each[0][2] * two + each[0][3] * more
    return Model(folder, order, parts, each, n_tokens, n_types, (float(total), float(left)))


class Arrays:
    """The mapped arrays of a model; a part's file is mapped when it is first asked for."""

    def __init__(self, model: Model):
        self.model, self.open = model, {}

    def look_up(self, level: int, key: np.ndarray, names: list[str]) -> list[np.ndarray]:
        """Values of each key, 0 where it is not found. Distinct keys are looked up in ascending order."""
        asked, back = np.unique(key, return_inverse=True)
        out = [np.zeros(len(asked), np.uint64) for _ in names]
        ends = np.searchsorted(part_of(asked, self.model.parts), np.arange(self.model.parts + 1))
        for part in np.flatnonzero(np.diff(ends)).tolist():
            a, b = ends[part], ends[part + 1]
            if (level, part) not in self.open:
                path = f"{self.model.folder}/{level}-{part}"
                self.open[level, part] = mapped(path) if os.path.exists(path) else {"key": np.zeros(0, np.uint64)}
            found = self.open[level, part]
            if not len(found["key"]):
                continue
            at = np.minimum(np.searchsorted(found["key"], asked[a:b]), len(found["key"]) - 1)
            hit = found["key"][at] == asked[a:b]
            for o, name in zip(out, names):
                if name in found:
                    o[a:b][hit] = found[name][at[hit]]
        return [o[back] for o in out]

    def scores(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: known tokens, base score, score (log10)."""
        m = self.model
        contexts = [f"context{i}" for i in range(4)]
        inner = np.ones(len(words), bool)
        inner[starts[:-1]] = False  # the begin is no token
        place = np.arange(len(words)) - np.repeat(starts[:-1], np.diff(starts))
        raw, count, *sums = self.look_up(1, words, ["raw", "adjusted", *contexts])
        uniform = 1.0 / (m.n_types + 1)
        p = (discounted(count, m.discounts[0]) + m.base[1] * uniform) / m.base[0] if m.base[0] else np.full(len(words), uniform)
        key = words
        for level in range(2, m.order + 1):
            key = np.concatenate((key[:1], longer(key[:-1], words[1:])))
            ask = np.flatnonzero(place >= level - 1)
            d = m.discounts[level - 1]
            total, one, two, more = [s[ask - 1].astype(float) for s in sums]
            count, *found = self.look_up(level, key[ask], ["adjusted", *contexts * (level < m.order)])
            seen = total > 0
            at = ask[seen]
            p[at] = (discounted(count, d) + (d[1] * one + d[2] * two + d[3] * more) * p[ask])[seen] / total[seen]
            sums = [np.zeros(len(words), np.uint64) for _ in found]
            for s, f in zip(sums, found):
                s[ask] = f
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[inner]
        each = lambda v: np.bincount(doc, v[inner], len(starts) - 1)
        base = np.log10((raw + 1.0) / (m.n_tokens + m.n_types + 1.0))
        return each((raw > 0).astype(float)).astype(np.int64), each(base), each(np.log10(p))


def discounted(count: np.ndarray, d: list[float]) -> np.ndarray:
    return np.maximum(count - np.array(d)[np.minimum(count, 3).astype(np.int64)], 0.0)


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, n_tokens, n_known, base_score, score."""
    fields = [docs.schema[c] for c in keep]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    names = [*keep, "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, powers = Arrays(model), Powers()
        for batch in batches:
            done = 0
            for texts in slices(iter([batch]), batch.num_columns - 1):
                all_words, starts = tokens(texts, powers)
                found = arrays.scores(all_words, starts)
                own = batch.slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(np.diff(starts) - 1), *map(pa.array, found)], names=names)

    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("text__"))
    return chosen.mapInArrow(run, f"{kinds}, n_tokens long, n_known long, base_score double, score double")


def held_out(key: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def op12_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    model = learned(docs.filter("not held_out").select(F.col("text").cast("binary")))
    found = scored(docs, model, ("doc_id", "held_out"))
    score = lambda c: F.round(c, 6).alias(c)  # noqa: E731  sums of logarithms don't depend on their order this far
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), score("base_score"), score("score"))
