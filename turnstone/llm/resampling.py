"""Importance resampling towards a target corpus, by inverted postings dealt over tasks by bucket.

Features are runs of one to three words, hashed into buckets. Documents are read once, in blocks; of each block the postings
(bucket, document, count) are sorted by bucket and cut into ranges of buckets. A task gets a range of all blocks' postings
and, ahead of them, the counts of its buckets in both corpora, so that it computes its buckets' gains by itself; then it goes
through the postings one block at a time and emits what they contribute to each document. Contributions are summed by document,
and documents are drawn by the largest Gumbel-perturbed weights.

A bucket has one posting a document at most, and ranges are salted by block where there are more tasks than ranges, so that a
frequent word is no task's burden; a task holds the counts of its range and one block's postings. The CRC-32 of a run is put
together from those of its words: the remainder is linear, and that of a text with n more bytes is looked up by n.

Defined results: a null or empty text has no features, weight 0; repeated rows are documents of their own, with equal scores, drawn in any
order among themselves; a null id is hashed as an empty one and ranks first among ties; empty tables give no rows, and an empty
target all the same gains; other columns are not read. Block numbers come from the place of rows in their partition, so documents must be read from
a source that gives a partition the same rows when it is read again, as files do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ranked, written
from .packed import packed, steps, unpacked

#: Bytes as they are in words: capital letters made small, what separates words made a space.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
COUNTS, POSTINGS, DOCUMENTS = 0, 1, 2
SHIFTS = 256  # lengths whose shift of the remainder is in the table
ROW = "part int, kind int, block long, data binary, total long, ids array<{id}>, n_words array<long>, n_features array<long>"


def shift_table() -> np.ndarray:
    """[n, k, v]: what byte k of a CRC-32 with value v becomes in the CRC-32 after n more bytes, without these bytes' own part."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> np.uint32(1)) ^ np.uint32(0xEDB88320), one >> np.uint32(1))
    at = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    out = [at]
    for _ in range(SHIFTS - 1):
        at = (at >> np.uint32(8)) ^ one[at & np.uint32(255)]
        out.append(at)
    return np.stack(out)


TABLE = shift_table()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The CRC-32s of texts after n more bytes each, to be combined with these bytes' CRC-32 by exclusive or."""
    m = np.minimum(n, SHIFTS - 1)
    out = TABLE[m, 0, crc & 255] ^ TABLE[m, 1, crc >> 8 & 255] ^ TABLE[m, 2, crc >> 16 & 255] ^ TABLE[m, 3, crc >> 24]
    if len(long := np.flatnonzero(n > m)):
        out[long] = shifted(out[long], n[long] - m[long])
    return out


class Words(dict):
    """CRC-32 and length (from bit 32) of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = crc32(word) | len(word) << 32
        return out


def features(texts: list[bytes | None], words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each feature its bucket and its text's index; of each text the number of words."""
    split = [t.translate(FOLDED).split() if t else [] for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    value = np.fromiter((words[w] for s in split for w in s), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(split)), sizes)
    crc, length = (value & 0xFFFFFFFF).astype(np.uint32), value >> 32
    spaced = shifted(np.full(len(crc), crc32(b" "), np.uint32), length) ^ crc  # of each word after a space
    runs, found, of = crc, [crc], [doc]
    for n in range(1, 3):
        runs = shifted(runs[:-1], length[n:] + 1) ^ spaced[n:]
        same = doc[n:] == doc[: len(doc) - n]
        found.append(runs[same])
        of.append(doc[n:][same])
    return np.concatenate(found) % np.uint32(buckets), np.concatenate(of), sizes


def postings(texts: DataFrame, key: str | None, parts: int, ranges: int, buckets: int, id_type: str, block_words: int = 1_000_000) -> DataFrame:
    """Rows for the tasks of all ranges: with a key (documents) postings and counts, without (target) counts alone."""
    salts = parts // ranges
    chosen = texts.select((F.lit(0).cast(id_type) if key is None else F.col(f"`{key}`")).alias("id__"), F.col("text").cast("binary").alias("text__"))
    ids_type = to_arrow_type(chosen.schema["id__"].dataType)
    bounds = [buckets * r // ranges for r in range(ranges + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, words, counts, total, seq = TaskContext.get().partitionId(), Words(), np.zeros(buckets, np.int64), 0, 0
        arrow = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("data", pa.binary()), ("total", pa.int64()), ("ids", pa.list_(ids_type)), ("n_words", pa.list_(pa.int64())), ("n_features", pa.list_(pa.int64()))])

        def rows(made: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(made, schema=arrow)

        for ids, texts in blocks(batches, block_words):
            bucket, doc, sizes = features(texts, words, buckets)
            counts += np.bincount(bucket, minlength=buckets)
            total += len(bucket)
            if key is None:
                continue
            block, n = task << 32 | seq, len(texts)
            seq += 1
            found, times = np.unique(bucket.astype(np.int64) * n + doc, return_counts=True)
            ends = np.searchsorted(found, np.array(bounds) * n)
            made = [{"part": r + ranges * (block % salts), "kind": POSTINGS, "block": block, "total": n, "data": packed(steps(found[a:b] - bounds[r] * n), times[a:b])} for r, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
            made.append({"part": block % parts, "kind": DOCUMENTS, "block": block, "ids": ids, "n_words": sizes, "n_features": np.bincount(doc, minlength=n)})
            yield rows(made)
        sign = 1 if key else -1  # the target's counts have negative totals
        yield rows([{"part": p, "kind": COUNTS, "block": -1, "total": sign * total, "data": packed(counts[bounds[p % ranges] : bounds[p % ranges + 1]])} for p in range(salts * ranges)])

    return chosen.mapInArrow(run, ROW.format(id=id_type))


def blocks(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of rows that follow one another, of some block_words words by six bytes a word; a longer text is a block of its own."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = t.as_py()
            ids.append(i)
            texts.append(t)
            size += len(t or b"")
            if size >= 6 * block_words or len(texts) >= 100_000:
                yield ids, texts
                ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def contributions(dealt: DataFrame, ranges: int, buckets: int, schema: str) -> DataFrame:
    """From tasks' sorted rows: documents as they are, and for each block of postings what it adds to its documents' weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = theirs = gains = None
        totals = [0, 0]
        for batch in batches:
            for row in map(lambda i: batch.slice(i, 1), range(batch.num_rows)):
                part, kind = row.column(0)[0].as_py(), row.column(1)[0].as_py()
                if kind == DOCUMENTS:
                    yield row
                    continue
                data, total = unpacked(row.column(3)[0].as_py()), row.column(4)[0].as_py()
                if kind == COUNTS:
                    if ours is None:
                        ours, theirs = np.zeros(len(data[0])), np.zeros(len(data[0]))
                    into = theirs if total < 0 else ours
                    into += data[0]
                    totals[total < 0] += abs(total)
                    continue
                if gains is None:
                    top, low = (theirs + 1.0) * (totals[0] + float(buckets)), (ours + 1.0) * (totals[1] + float(buckets))
                    gains = np.array([math.floor(1000 * math.log(x)) for x in (top / low).tolist()], np.int64)
                at, times = np.cumsum(data[0]).astype(np.int64), data[1].astype(np.int64)
                n = total
                weight = np.zeros(n, np.int64)
                np.add.at(weight, at % n, gains[at // n] * times)
                out = row.set_column(3, "data", pa.array([packed((weight << 1 ^ weight >> 63).astype(np.uint64))], pa.binary()))
                yield out

    return dealt.mapInArrow(run, schema)


def summed(found: DataFrame, key: str, id_type: str, schema: str) -> DataFrame:
    """key, n_words, n_features, weight from rows of a block that follow one another, the documents' own row last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = None
        for batch in batches:
            for row in map(lambda i: batch.slice(i, 1), range(batch.num_rows)):
                if row.column(1)[0].as_py() == POSTINGS:
                    own = unpacked(row.column(3)[0].as_py())[0].astype(np.int64)
                    own = own >> 1 ^ -(own & 1)
                    weight = own if weight is None else weight + own
                    continue
                columns = [row.column(i).flatten() for i in (5, 6, 7)]
                none = np.zeros(len(columns[0]), np.int64)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(none if weight is None else weight)], names=[key, "n_words", "n_features", "weight"])
                weight = None

    return found.mapInArrow(run, f"`{key}` {id_type}, n_words long, n_features long, weight long")


def weighed(docs: DataFrame, target: DataFrame, key: str = "doc_id", buckets: int = 10_000, ranges: int = 128) -> DataFrame:
    """key, n_words, n_features, weight of every row of docs (key, text), for a target (text)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(ranges, parts, buckets)
    id_type = docs.schema[key].dataType.simpleString()
    both = postings(docs, key, parts, ranges, buckets, id_type).unionAll(postings(target, None, parts, ranges, buckets, id_type))
    dealt = both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind", "block")
    found = contributions(dealt, ranges, buckets, ROW.format(id=id_type))
    by_block = found.repartition(parts, "block").sortWithinPartitions("block", "kind")
    return summed(by_block, key, id_type, ROW.format(id=id_type))


def noise(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) for a u in (0, 1) of the key and the seed."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = 10_000) -> DataFrame:
    """key, n_features, weight, score, rank of every row; rank is null unless the row is among the `percent` of rows with
    least_words words that have the highest scores. Places come from a range sort and counts by task."""
    scored = weighed(docs, target, key, buckets).withColumn("score", F.col("weight") + noise(F.col(f"`{key}`"), seed))
    kept = written(scored.withColumn("able", F.col("n_words") >= least_words), "weights")
    able = kept.filter("able")
    drawn = percent * able.count() // 100
    place = ranked(able, "able", [F.desc("score"), F.col(f"`{key}`").asc_nulls_first()])
    place = place.withColumn("rank", F.when(F.col("rank__") < drawn, F.col("rank__") + 1))
    columns = [F.col(f"`{key}`"), "n_features", "weight", "score"]
    return place.select(*columns, "rank").unionByName(kept.filter("not able").select(*columns, F.lit(None).cast("long").alias("rank")))


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
