"""Phrase collocations, by partitioning over pivots: n-grams are mined where their rarest word is.

1. Documents are written as blocks of a language: words numbered within the block, with their counts, and the sequence of numbers with breaks at
   punctuation. Words are counted over all blocks; those with the least count get places by descending count.
2. Each block learns the places of its frequent words (a join by word, gathered by block; infrequent words become breaks, as
   no frequent phrase has one), and each occurrence of a word becomes the pivot of a fragment: up to three words to the left that are more frequent, up to
   three to the right that are at least as frequent. So each occurrence of an n-gram is in one fragment, that of its rarest word's first
   occurrence in it. Equal fragments of a block are added up and routed to the pivot's cell.
3. A cell adds up its fragments' n-grams around the pivot, growing them word by word from those that are frequent; it emits pivot-owned n-grams alone. A
   pivot with more than a cell's share of occurrences is salted by its fragment, and its parts' counts are summed afterwards.
4. Phrases are cut, scored, freed of those that lie inside a longer one nearly as often, and ranked in each language.

Defined results: a null or empty text has no words; a null language is `und`; repeated rows count each; a very long text is a block of its own;
an empty table gives no rows; phrases that tie in all are ranked by their bytes; other columns are not read. Block numbers come from the place of rows in their partition, and blocks are written before anything else is done.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ranked, written
from .packed import packed, unpacked

#: Capital letters made small, separators of pieces made a line feed, tabs made spaces.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))
LONGEST = 4
SIDE = LONGEST - 1
BLOCK = "block long, lang string, sequence binary, words array<string>, counts array<long>"
BLOCK_ARROW = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("sequence", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


class Numbers(dict):
    """Words' numbers from 2 in order of appearance; 0 is a break, 1 an empty string."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


class Block:
    def __init__(self):
        self.numbers, self.parts, self.size = Numbers({b"\n": 0, b"": 1}), [], 0

    def add(self, text: bytes) -> None:
        split = text.translate(FOLDED).replace(b"\n", b" \n ").split(b" ")
        found = np.fromiter(map(self.numbers.__getitem__, split), np.int64, len(split))
        self.parts += [found[found != 1], np.zeros(1, np.int64)]
        self.size += len(split)

    def row(self, number: int, lang: str) -> dict:
        sequence = np.concatenate(self.parts)
        counts = np.bincount(sequence, minlength=len(self.numbers))[2:]
        return {"block": number, "lang": lang, "sequence": packed(sequence), "words": [w.decode("utf-8", "replace") for w in self.numbers][2:], "counts": counts}


def blocks(docs: DataFrame, text: str, lang: str, block_words: int) -> DataFrame:
    """Documents as blocks of some block_words words of one language. A text is never split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, {}
        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = held.setdefault(name, Block())
                block.add(x.as_py() or b"")
                if block.size >= block_words:
                    yield pa.RecordBatch.from_pylist([held.pop(name).row(number, name)], schema=BLOCK_ARROW)
                    number += 1
        for name, block in held.items():
            yield pa.RecordBatch.from_pylist([block.row(number, name)], schema=BLOCK_ARROW)
            number += 1

    chosen = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    return chosen.mapInArrow(run, BLOCK)


def fragments_of(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[n, 7] and where in the sequence they are: pivots in the middle, up to three more frequent words before them, up to three at least as frequent after them, 0 for none."""
    n = len(place)
    out = np.zeros((n, 2 * SIDE + 1), np.int64)
    out[:, SIDE] = place
    wide = np.concatenate((np.zeros(SIDE, np.int64), place, np.zeros(SIDE, np.int64)))
    for sign, limit in ((-1, place), (1, place + 1)):
        going = place > 0
        for i in range(1, SIDE + 1):
            near = wide[SIDE + sign * i : SIDE + sign * i + n]
            going &= (near > 0) & (near < limit)
            out[:, SIDE + sign * i] = near * going
    at = np.flatnonzero((out[:, SIDE - 1] > 0) | (out[:, SIDE + 1] > 0))
    return out[at], at


def gathered(rows: np.ndarray, times: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in order (of `first`, then of their columns), their sums of times, and each given row's distinct row."""
    keys = [rows[:, i] for i in range(rows.shape[1])][::-1]
    order = np.lexsort([*keys, *([first] if first is not None else [])])
    rows, times = rows[order], times[order]
    new = np.concatenate(([True], (rows[1:] != rows[:-1]).any(1))) if len(rows) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return rows[at], np.add.reduceat(times, at) if len(at) else times, back


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def routed(placed: DataFrame, cells: int) -> DataFrame:
    """From blocks (sequence) with the places and salts of their frequent words (found): cell, data, fragments by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sequence, found in zip(batch.column(0), batch.column(1)):
                sequence = unpacked(sequence.as_py())[0].astype(np.int64)
                numbers, places, salts = (found.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
                size = max(sequence.max(initial=0), numbers.max(initial=0)) + 1
                to_place, to_salt = np.zeros(size, np.int64), np.ones(size, np.int64)
                to_place[numbers], to_salt[numbers] = places, salts
                rows, at = fragments_of(to_place[sequence])
                if not len(rows):
                    continue
                pivot, salt = rows[:, SIDE], to_salt[sequence[at]]
                own = mixed(rows[:, SIDE - 1] * 3 + rows[:, SIDE - 2] * 5 + rows[:, SIDE + 1] * 7 + rows[:, SIDE + 2] * 11) % salt.astype(np.uint64)
                cell = ((mixed(pivot) + own * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(cells)).astype(np.int64)
                rows, times, back = gathered(rows, np.ones(len(rows), np.int64), cell)
                of, salted = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.uint64)
                of[back], salted[back] = cell, salt > 1
                ends = np.searchsorted(of, np.arange(cells + 1))
                made = [(c, packed(*rows[a:b].T.astype(np.uint64), times[a:b].astype(np.uint64), salted[a:b])) for c, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
                for i in range(0, len(made), 256):
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in made[i : i + 256]], pa.int32()), pa.array([d for _, d in made[i : i + 256]], pa.binary())], names=["cell", "data"])

    return placed.select("sequence", "found").mapInArrow(run, "cell int, data binary")


def grown(rows: np.ndarray, times: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, counts) of all n-grams around the pivots of fragments with a count of `least`. What is longer holds what is shorter, so
    fragments whose shorter n-gram is infrequent are not looked at further."""
    alive = {(0, 0): np.ones(len(rows), bool)}
    for length in range(2, LONGEST + 1):
        for left in range(length):
            right = length - 1 - left
            ok = np.logical_and.reduce([alive[k] for k in ((left - 1, right), (left, right - 1)) if k in alive])
            ok = ok & (rows[:, SIDE - left] > 0) & (rows[:, SIDE + right] > 0)
            at = np.flatnonzero(ok)
            grams, n, back = gathered(rows[at, SIDE - left : SIDE + right + 1], times[at])
            alive[left, right] = ok
            ok[at] = n[back] >= least
            yield grams[n >= least], n[n >= least]


def mined(dealt: DataFrame, least: int) -> DataFrame:
    """ids, n from cells' fragments that follow one another. Salted pivots' counts are parts of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held)]
            rows, times, salted = np.stack(columns[:-2], 1).astype(np.int64), columns[-2].astype(np.int64), columns[-1] > 0
            for which, lowest in ((~salted, least), (salted, 1)):
                if not which.any():
                    continue
                for grams, n in grown(rows[which], times[which], lowest):
                    for a in range(0, len(grams), 50_000):
                        g = grams[a : a + 50_000]
                        ids = pa.FixedSizeListArray.from_arrays(pa.array(g.ravel()), g.shape[1]).cast(pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(n[a : a + 50_000])], names=["ids", "n"])

        for batch in batches:
            for c, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if c != cell and held:
                    yield from done()
                    held = []
                cell = c
                held.append(unpacked(data.as_py()))
        if held:
            yield from done()

    return dealt.mapInArrow(run, "ids array<long>, n long")


def frequent(made: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """words (place, lang, word, f) with a count of `least`, places from 1 by descending count; sizes (lang, total) of all words."""
    sizes = made.groupBy("lang").agg(F.sum(F.expr("aggregate(counts, 0L, (a, x) -> a + x)")).alias("total"))
    each = made.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f"))
    kept = written(each.filter(F.col("f") >= least).withColumn("all", F.lit(0)), "words")
    placed = ranked(kept, "all", [F.desc("f"), "lang", "word"])
    return written(placed.select((F.col("rank__") + 1).alias("place"), "lang", "word", "f"), "places"), sizes


def counted(docs: DataFrame, least: int = 30, text: str = "text", lang: str = "lang", block_words: int = 500_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ngrams (ids: places of two to four words, n), words and sizes as of `frequent`."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = written(blocks(docs, text, lang, block_words), "blocks")
    words, sizes = frequent(made, least)
    total = words.agg(F.sum("f")).first()[0] or 0
    share = max(10_000, total // (8 * parts))
    each = made.select("block", "lang", F.posexplode("words").alias("at", "word"))
    known = words.select("place", F.col("lang").alias("l"), F.col("word").alias("w"), F.ceil(F.col("f") / share).cast("long").alias("salts"))
    found = each.join(known, (F.col("lang") == F.col("l")) & (F.col("word") == F.col("w")))
    found = found.groupBy("block").agg(F.collect_list(F.struct((F.col("at") + 2).cast("long").alias("number"), "place", "salts")).alias("found"))
    placed = made.select(F.col("block").alias("b"), "sequence").join(found, F.col("b") == F.col("block"))
    dealt = routed(placed, 4 * parts).repartitionById(parts, F.col("cell") % parts).sortWithinPartitions("cell")
    ngrams = mined(dealt, least).groupBy("ids").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return written(ngrams, "ngrams"), words, sizes


def scored(ngrams: DataFrame, words: DataFrame) -> DataFrame:
    """ids, a, l, r, score of phrases by their lowest cut, without those inside a longer one that is at least 80% as frequent."""
    parts = F.explode(F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda k: F.struct(k.alias("k"), F.slice("ids", F.lit(1), k).alias("first"), F.slice("ids", k + 1, F.size("ids")).alias("rest"))))
    counts = ngrams.select(F.col("ids").alias("part"), F.col("n").alias("f")).unionByName(words.select(F.array("place").alias("part"), "f"))
    cuts = ngrams.select("ids", F.col("n").alias("a"), parts.alias("cut")).select("ids", "a", "cut.*")
    cuts = cuts.join(counts.select(F.col("part").alias("first"), F.col("f").alias("l")), "first").join(counts.select(F.col("part").alias("rest"), F.col("f").alias("r")), "rest")
    score = F.expr("(cast(a as decimal(19, 0)) * cast(2000000 as decimal(7, 0))) div (cast(l as decimal(19, 0)) + r)")
    lowest = cuts.select("ids", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("ids").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))
    inside = lambda size: F.transform(F.sequence(F.lit(1), F.size("ids") - size + 1), lambda i: F.slice("ids", i, F.lit(size)))
    longer = ngrams.filter(F.size("ids") > 2).select("n", F.explode(F.when(F.size("ids") == 3, inside(2)).otherwise(F.concat(inside(2), inside(3)))).alias("sub"))
    most = longer.groupBy("sub").agg(F.max("n").alias("most"))
    kept = lowest.join(most, F.col("ids") == F.col("sub"), "left").filter("most is null or cast(most as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * 80")
    return kept.select("ids", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, top: int = 2000, least: int = 30, text: str = "text", lang: str = "lang", block_words: int = 500_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language (the limit is the feature)."""
    ngrams, words, sizes = counted(docs, least, text, lang, block_words)
    found = scored(ngrams, words)
    langs = words.select(F.col("place").alias("first"), "lang")
    found = found.withColumn("first", F.element_at("ids", 1)).join(langs, "first").drop("first")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    found = found.withColumn("near", F.rank().over(best)).filter(F.col("near") <= top)  # ties in full: only phrases tell them apart
    spelled = found.select("ids", F.posexplode("ids").alias("i", "place")).join(words.select("place", "word"), "place").groupBy("ids")
    spelled = spelled.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    found = found.join(spelled, "ids").join(sizes.withColumnRenamed("total", "n"), "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return found.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
