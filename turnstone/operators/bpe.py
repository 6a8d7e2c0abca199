"""Byte-pair vocabulary: words are counted in Spark, merges learned exactly in few rounds over the counted words, texts encoded in Arrow batches.

Merges never cross words, so the distinct words with their counts are all that learning needs. They stay in Spark. A round counts neighbouring pieces over
all words and takes as candidates all pairs with a count of `t` or more, for the least t such that they are at most `candidates`
and that words cut wherever a pair is no candidate make at most `fragments` different fragments; these, with their counts, reach the driver, which merges
one pair at a time in them. What it can't see are neighbours whose first pair, in the round's pieces, is no candidate: of each such kind there are
fewer than t, and a pair of pieces that were made in several ways has several kinds. While the best pair's count is above what all others can
have, it is the one that a learner of single merges over all words would take; then the words are rewritten and the next round begins. The first merge of a
round is always right, so each makes progress; most rounds make hundreds or thousands. Pairs of equal count are taken in order of their text.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import stages

SPECIALS = ("<pad>", "<unk>", "<s>", "</s>", "__url__", "__path__", "__ip__", "__cmd__", "__number__", "__eot__", "__user__")
MARK = "▁"


def merged(parts: list[str], rank: dict[tuple[str, str], int], once: bool = False) -> list[str]:
    """parts with the merges done: the least rank first, from the left, by a heap over a linked list. once: each rank has
    its turn once, in order, as in learning; else a pair that a later merge makes is merged as any other."""
    n = len(parts)
    parts, after, before = list(parts), [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if not parts[i] or j < 0 or rank.get((parts[i], parts[j])) != r:
            continue
        parts[i] += parts[j]
        parts[j] = ""
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
        for x, y in ((before[i], i), (i, k)):
            if x >= 0 and y >= 0 and (found := rank.get((parts[x], parts[y]))) is not None and not (once and found <= r):
                heapq.heappush(heap, (found, x))
    return [p for p in parts if p]


@dataclass
class Bpe:
    pieces: list[str]
    merges: list[tuple[str, str]]
    ids: dict[str, int] = field(init=False)
    rank: dict[tuple[str, str], int] = field(init=False)
    known: dict[str, list[int]] = field(init=False, default_factory=dict)

    def __post_init__(self):
        self.ids, self.rank = {p: i for i, p in enumerate(self.pieces)}, {m: i for i, m in enumerate(self.merges)}

    def word(self, word: str) -> list[int]:
        if word in self.known:
            return self.known[word]
        if word in SPECIALS:
            return [self.ids[word]]
        parts = merged(list(MARK + word), self.rank)
        out = [self.ids.get(p, 1) for p in parts]
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[word] = out
        return out

    def encode(self, text: str) -> list[int]:
        return [i for w in text.split() for i in self.word(w)]

    def decode(self, ids: list[int]) -> str:
        out = "".join(f" {p} " if p in SPECIALS else p for p in (self.pieces[i] for i in ids if i > 3))
        return " ".join(out.replace(MARK, " ").split())


def learn(texts: DataFrame, column: str, size: int = 16_000, candidates: int = 20_000, fragments: int = 150_000) -> Bpe:
    spark, folder = texts.sparkSession, stages.scratch(texts.sparkSession, "bpe")
    words = texts.select(F.explode(T.tokens(F.col(column))).alias("w")).filter(~F.col("w").isin(*SPECIALS)).groupBy("w").agg(F.count("*").alias("n"))
    letters = F.filter(F.split("w", ""), lambda c: c != "")
    words.select(F.concat(F.array(F.lit(MARK)), letters).alias("parts"), "n").write.parquet(f"{folder}/0")
    words = spark.read.parquet(f"{folder}/0")
    pieces = dict.fromkeys([*SPECIALS, *sorted(r["c"] for r in words.select(F.explode("parts").alias("c")).distinct().collect())])
    merges, k, take = [], 0, 256
    while len(pieces) < size:
        each = words.select("n", F.explode(F.zip_with(F.expr("slice(parts, 1, size(parts) - 1)"), F.expr("slice(parts, 2, size(parts))"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
        top = each.groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).filter("n >= 2").orderBy(F.desc("n"), "a", "b").limit(candidates + 1).collect()
        if not top:
            break
        counts = [r["n"] for r in top]
        while True:
            least = counts[take] + 1 if take < len(counts) else 2 if len(counts) <= candidates else counts[-1] + 1
            chosen = {(r["a"], r["b"]) for r in top if r["n"] >= least} or {(top[0]["a"], top[0]["b"])}
            found = cut_up(words, chosen).limit(fragments + 1).collect()
            if len(found) <= fragments or take == 1:
                break
            take = max(1, take // 2)
        new = in_order([(r["parts"], r["n"]) for r in found], chosen, least, (top[0]["a"], top[0]["b"]), pieces, size)
        merges += new
        take = min(candidates, take * 2 if len(found) < fragments // 2 else take)
        k += 1
        rewritten(words, new).write.parquet(f"{folder}/{k}")
        words = spark.read.parquet(f"{folder}/{k}")
    stages.cleaned_up(spark, folder, map(str, range(k + 1)))
    return Bpe(list(pieces), list(dict.fromkeys(merges)))


def in_order(found: list[tuple[list[str], int]], chosen: set[tuple[str, str]], least: int, first: tuple[str, str], pieces: dict[str, None], size: int) -> list[tuple[str, str]]:
    """The merges, one at a time, that the fragments (parts, n) prove; pieces gets what they make. An index from pair to fragments keeps
    the counts, so that a merge touches those that hold it alone."""
    texts, times = [list(p) for p, _ in found], [n for _, n in found]
    count: dict[tuple[str, str], int] = defaultdict(int)
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for i, t in enumerate(texts):
        for p in zip(t, t[1:]):
            count[p] += times[i]
            where[p].add(i)
    starts: dict[str, set[str]] = {}  # the round's pieces that a piece can begin with, where it isn't itself alone
    ends: dict[str, set[str]] = {}
    kinds_before = kinds_after = 1
    heap = [(-n, *p) for p, n in count.items()]
    heapq.heapify(heap)
    unsure: list[tuple[int, str, str]] = []  # pairs of several kinds, by the negative of what they can have

    def unseen(a: str, b: str) -> int:
        """What the pair can have besides its count."""
        if a not in ends and b not in starts:
            return 0 if (a, b) in chosen else least - 1
        return sum((x, y) not in chosen for x in ends.get(a, {a}) for y in starts.get(b, {b})) * (least - 1)

    near: dict[str, set[tuple[str, str]]] = defaultdict(set)
    for p in count:
        near[p[0]].add(p)
        near[p[1]].add(p)
    out: list[tuple[str, str]] = []
    done: set[tuple[str, str]] = set()
    while heap and len(pieces) < size:
        n, a, b = heap[0]
        if count[a, b] != -n:
            heapq.heappop(heap)
            continue
        if not out:
            a, b = first
        else:
            while unsure and (unsure[0][1:] == (a, b) or count[unsure[0][1:]] + unseen(*unsure[0][1:]) != -unsure[0][0]):
                heapq.heappop(unsure)
            if -n <= max(-unsure[0][0] if unsure else 0, kinds_before * kinds_after * (least - 1), 1) or (a, b) in done:
                break
        done.add((a, b))
        new = a + b
        known = set(near[new])  # pairs of the same piece made in another way
        starts[new] = starts.get(new, {new} if new in pieces else set()) | starts.get(a, {a})
        ends[new] = ends.get(new, {new} if new in pieces else set()) | ends.get(b, {b})
        kinds_before, kinds_after = max(kinds_before, len(ends[new])), max(kinds_after, len(starts[new]))
        out.append((a, b))
        pieces[new] = None
        touched = set()
        for i in where.pop((a, b), ()):
            t, m = texts[i], times[i]
            for p in zip(t, t[1:]):
                count[p] -= m
                touched.add(p)
            for p in set(zip(t, t[1:])):
                where[p].discard(i)
            joined, j = [], 0
            while j < len(t):
                pair = j + 1 < len(t) and t[j] == a and t[j + 1] == b
                joined.append(new if pair else t[j])
                j += 1 + pair
            texts[i] = joined
            for p in zip(joined, joined[1:]):
                count[p] += m
                where[p].add(i)
                touched.add(p)
        for p in touched | known:
            near[p[0]].add(p)
            near[p[1]].add(p)
            if count[p] > 0:
                heapq.heappush(heap, (-count[p], *p))
                if more := unseen(*p):
                    heapq.heappush(unsure, (-count[p] - more, *p))
    return out


def runs(parts: list[str], chosen: set[tuple[str, str]]) -> Iterator[tuple[str, ...]]:
    """The longest runs of two parts or more in which all neighbours are chosen pairs."""
    begin = 0
    for i in range(1, len(parts) + 1):
        if i == len(parts) or (parts[i - 1], parts[i]) not in chosen:
            if i - begin > 1:
                yield tuple(parts[begin:i])
            begin = i


def cut_up(words: DataFrame, chosen: set[tuple[str, str]]) -> DataFrame:
    """parts, n: the different runs of words (parts, n) with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[str, ...], int] = defaultdict(int)
            for parts, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for found in runs(parts, chosen):
                    out[found] += n
            yield pa.RecordBatch.from_arrays([pa.array(map(list, out), pa.list_(pa.string())), pa.array(out.values(), pa.int64())], names=["parts", "n"])

    return words.mapInArrow(run, "parts array<string>, n long").groupBy("parts").agg(F.sum("n").alias("n"))


def rewritten(words: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """words (parts, n) with the merges done one after another; words of one part have no more pairs and go."""
    rank = {}
    for i, m in enumerate(merges):
        rank.setdefault(m, i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [merged(parts, rank, once=True) for parts in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), batch.column(1)], names=["parts", "n"])

    return words.mapInArrow(run, "parts array<string>, n long").filter(F.size("parts") > 1)


def encoded_all(rows: DataFrame, model: Bpe, columns: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """keep, and the ids of each text column, under its name. Each task has a table of the words that it has segmented."""
    pieces, merges = model.pieces, model.merges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bpe(pieces, merges)
        for batch in batches:
            ids = [pa.array([own.encode(t or "") for t in batch.column(len(keep) + i).to_pylist()], pa.list_(pa.int32())) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *ids], names=[*keep, *columns])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + [f"`{c}` array<int>" for c in columns]
    return rows.select(*keep, *columns).mapInArrow(run, ", ".join(kinds))


def encoded(rows: DataFrame, model: Bpe, column: str, key: str) -> DataFrame:
    """key, ids."""
    return encoded_all(rows, model, (column,), (key,)).withColumnRenamed(column, "ids")


def integrity(model: Bpe, tags: tuple[str, ...] = SPECIALS) -> list[tuple[str, int, bool]]:
    """(tag, id, whether it is a single piece in its place)."""
    return [(s, i, model.pieces[i] == s and (i < 4 or model.encode(s) == [i])) for i, s in enumerate(tags)]


def word_vectors(rows: DataFrame, column: str, dim: int = 300, min_count: int = 3, window: int = 5, epochs: int = 10, seed: int = 42, parts: int | None = None) -> DataFrame:
    """piece, vec by skip-gram over arrays of pieces. Each epoch learns in `parts` partitions (as many as cores; the learner's own default is one, a
    single task) and merges by piece what they learned. Rows, which are read for the vocabulary and for learning, are made once, as a table."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    parts = parts or rows.sparkSession.sparkContext.defaultParallelism
    rows = stages.kept(rows.select(column), "words")
    model = Word2Vec(vectorSize=dim, minCount=min_count, windowSize=window, maxIter=epochs, seed=seed, numPartitions=parts, inputCol=column, outputCol="v").fit(rows)
    return model.getVectors().select(F.col("word").alias("piece"), vector_to_array("vector", "float32").alias("vec"))
