"""Near-duplicates by five-word shingles: texts with Jaccard similarity of at least 0.8 are linked by SimHash tries.

At that similarity fingerprints of 64 bits differ in about 10 bits, too many for the leading blocks of `simhash`: within such a
budget a trie of all keys is nearly all pairs. So there is a trie for each anchor instead, which holds the fingerprints of the
texts that share it; node pairs are walked as in `simhash`, with a budget of `BUDGET` bits, and what is left is
checked on the whole sets of shingles in the same task. Anchors are a set's first shingles in one order for all texts: by hash,
those that more than `HOT` sets of the corpus share last. Two sets of that similarity share one among the first n - ceil(0.8 n) + 1 of
each; of these, `ANCHORS` are taken of the `SKETCH` smallest, so that long texts cost no more than short ones.

What this misses: a link of similarity 0.8 shares none of 12 anchors with a probability below 1e-8 (never, where
sets have at most 40 shingles), and differs in more than 24 bits with one of 3e-6, were its bits independent. Every link that is kept
is exact.

Large anchors: the sets of one are first compared with one of them (a star, which is linear); then only sets of different
components are still to be compared, in blocks of at most `BLOCK`. Tasks emit a spanning forest of checked links.

Defined results: words and case are as in `simhash`; a text of fewer than five words is one shingle, one without words (or a
null text) an empty set; sets and shingles are told apart by 64-bit hashes; rows without an id stay, as do other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, likely, written
from .simhash import BITS, SEED, connected, walk

WIDTH = 5
ANCHORS, SKETCH, BUDGET = 12, 40, 24
HOT, BLOCK, PIVOTS = 32, 1000, 3
#: Sets that a task holds at once, in bytes, before it compares them (those of one pair of blocks at least).
HELD = 32 << 20


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - width + 1)
    starts, stops = np.concatenate(([0], ends[:-1]))[:n].tolist(), (ends - 1).tolist()
    stops = stops[width - 1 :] or stops[-1:]
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), dtype="<u8", count=n))


def set_fingerprint(s: np.ndarray) -> int:
    """SimHash of a set: a bit is 1 if set in over half of the hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(s), 1 << 16):
        counts += np.unpackbits(s[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * counts > len(s)).astype(np.uint64)).sum(dtype=np.uint64))


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, t: key of the text, c: key of its set, n: size of the set, fp: its fingerprint, sketch) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(2)]
            longs = lambda values: pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())
            columns = [batch.column(0), batch.column(1), longs([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets]), pa.array(map(len, sets), pa.int32())]
            columns += [longs([set_fingerprint(s) for s in sets]), pa.array([s[:SKETCH].view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "c", "n", "fp", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key(F.col("text")).alias("t"), "text").mapInArrow(run, f"doc_id {kind}, t string, c long, n int, fp long, sketch array<long>")


def classes_of(rows: DataFrame) -> DataFrame:
    """(c, t, n, fp, sketch, first_id): one row for each distinct set."""
    return rows.groupBy("c").agg(F.min("t").alias("t"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("first_id"))


def anchored(classes: DataFrame) -> DataFrame:
    """(c, n, fp, anchors) of each set with any."""
    each = classes.filter("n > 0").select("c", F.explode("sketch").alias("s"))
    common = cut(each.groupBy("s").agg(F.count("*").alias("size")).filter(F.col("size") > HOT))
    late = each.join(common.select("s"), "s").groupBy("c").agg(F.collect_list("s").alias("late"))  # at most SKETCH
    held = classes.filter("n > 0").join(late, "c", "left")
    late = F.coalesce(F.col("late"), F.expr("array()").cast("array<long>"))
    # the sketch is in order of the unsigned hash; both parts keep it
    ordered = F.concat(F.filter("sketch", lambda s: ~F.array_contains(late, s)), F.filter("sketch", lambda s: F.array_contains(late, s)))
    first = F.least(F.lit(ANCHORS), F.floor(F.col("n") / 5).cast("int") + 1)
    return cut(held.select("c", "n", "fp", F.slice(ordered, F.lit(1), first).alias("anchors")))


def postings_of(held: DataFrame) -> DataFrame:
    """(s, c, n, fp, size) of the anchors that more than one set has; size is how many have it."""
    each = held.select("c", "n", "fp", F.explode("anchors").alias("s"))
    shared = each.groupBy("s").agg(F.count("*").alias("size")).filter("size > 1")
    return cut(each.join(shared, "s").select("s", "c", "n", "fp", "size"))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, set: its sorted shingles as bytes) of the wanted (t, c), one row for each t. Only texts that are likely wanted are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=["c", "set"])

    wanted = written(wanted, "wanted")
    texts = likely(docs.select(text_key(F.col("text")).alias("t"), "text"), "t", wanted).filter("likely__").drop("likely__")
    texts = texts.join(wanted, "t").dropDuplicates(["t"])
    return texts.select("c", "text").mapInArrow(run, "c long, set binary")


def wanted(pairs: DataFrame, classes: DataFrame, *names: str) -> DataFrame:
    ends = pairs.select(F.explode(F.array(*names)).alias("c")).distinct()
    return classes.select("t", "c").join(ends, "c").select("t", "c")


def near(a: str, b: str) -> Column:
    return F.least(a, b) * 5 >= F.greatest(a, b) * 4


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many of `one` are in each of the others; all are sorted and not empty."""
    joined = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, joined), len(one) - 1)
    return np.add.reduceat((one[at] == joined).astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


def similar(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which others have a Jaccard similarity of at least 4 / 5: an overlap of o of a and b shingles, with 9 o >= 4 (a + b)."""
    return 9 * overlaps(one, others) >= 4 * (len(one) + np.array([len(o) for o in others]))


def starred(docs: DataFrame, classes: DataFrame, postings: DataFrame) -> DataFrame:
    """(u, v): checked links of the sets of large anchors with one set of each, of few for anchors that meet in the same sets."""
    large = postings.filter(F.col("size") > HOT).select("s", "c", "n", "fp")
    pivot = F.min_by(F.struct(F.col("c").alias("v"), F.col("n").alias("m"), F.col("fp").alias("by")), F.xxhash64("c", F.pmod("s", F.lit(PIVOTS))))
    pairs = large.join(large.groupBy("s").agg(pivot.alias("p")).select("s", "p.*"), "s")
    pairs = pairs.filter(near("n", "m") & (F.col("c") != F.col("v")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("by"))) <= BUDGET))
    pairs = cut(pairs.select(F.col("c").alias("u"), "v").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(i)] for i in (2, 3))
            ok = pa.array([bool(similar(x, [y])[0]) for x, y in zip(a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["u", "v"])

    if pairs.isEmpty():
        return pairs
    sets = cut(sets_of(docs, wanted(pairs, classes, "u", "v")))
    first, second = sets.select(F.col("c").alias("u"), F.col("set").alias("su")), sets.select(F.col("c").alias("v"), F.col("set").alias("sv"))
    return cut(pairs.join(second, "v").join(first, "u").select("u", "v", "su", "sv").mapInArrow(run, "u long, v long"))


def dealt(postings: DataFrame, roots: DataFrame, anchors: DataFrame) -> DataFrame:
    """(s, lo, hi, side, c, n, fp, anchors, root): sets of different components that share an anchor, by pairs of blocks.

    An anchor of up to BLOCK sets is one block. Of a larger one, the sets of its largest component need not be compared with each
    other, so their blocks (after the others') meet only the others'."""
    held = postings.join(roots.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    counted = held.groupBy("s", "root").agg(F.count("*").alias("k"))
    most = counted.groupBy("s").agg(F.max(F.struct("k", "root")).alias("most"), F.sum("k").alias("all"))
    mixed = most.filter(F.col("most.k") < F.col("all")).select("s", F.col("most.root").alias("major"), F.col("most.k").alias("k"), "all")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    split = F.col("all") > BLOCK
    mixed = mixed.withColumns({"m": F.when(split, blocks(F.col("all") - F.col("k"))).otherwise(1), "more": F.when(split, blocks(F.col("k"))).otherwise(0)})
    held = held.join(mixed, "s")
    in_major = (F.col("more") > 0) & (F.col("root") == F.col("major"))
    salt = F.xxhash64("c")
    block = F.when(in_major, F.col("m") + F.pmod(salt, F.greatest(F.col("more"), F.lit(1)))).otherwise(F.pmod(salt, F.col("m"))).cast("int")
    last = F.when(in_major, F.col("m")).otherwise(F.col("m") + F.col("more")) - 1
    held = held.withColumns({"b": block, "last": last}).join(anchors, "c").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return held.select("s", F.least("b", "p").alias("lo"), F.greatest("b", "p").alias("hi"), (F.col("b") > F.col("p")).cast("int").alias("side"), "c", "n", "fp", "anchors", "root")


#: Columns of what a task gets, in order; a set's bytes follow where there are any.
DEALT = ("s", "lo", "hi", "side", "c", "n", "fp", "root", "anchors")


def grouped(df: DataFrame, *more: str) -> DataFrame:
    unsigned = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))
    return df.select(*DEALT, *more).repartition("s", "lo", "hi").sortWithinPartitions("s", "lo", "hi", "side", unsigned, "c")


def whole_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of some whole tasks (s, lo, hi) at a time, in order."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        rest.append(batch)
        if sum(len(b) for b in rest) < 20_000 and sum(b.nbytes for b in rest) < HELD:
            continue
        joined = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
        key = np.stack([joined.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
        before = np.flatnonzero(np.any(key != key[-1], axis=1))
        if len(before):
            yield joined.slice(0, before[-1] + 1)
            joined = joined.slice(before[-1] + 1)
        rest = [joined]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def candidates(rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs within the budget that are of different components and near sizes, by the walk of each task's trie.

    A pair that shares several anchors counts at the smallest hash of them alone."""
    s, lo, hi, side, c, n, fp, root = (rows.column(i).to_numpy().astype(np.int64) for i in range(8))
    keys = fp.view(np.uint64)
    anchors = np.full((len(rows), ANCHORS), np.iinfo(np.int64).min)
    lengths = np.diff(rows.column(8).offsets.to_numpy())
    anchors[np.arange(ANCHORS) < lengths[:, None]] = rows.column(8).flatten().to_numpy()
    task = np.flatnonzero((s[1:] != s[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
    starts, stops = np.concatenate(([0], task)), np.concatenate((task, [len(rows)]))
    second = np.concatenate(([0], np.cumsum(side)))
    mids = stops - (second[stops] - second[starts])
    own = lo[starts] == hi[starts]
    nodes = np.stack([starts, np.where(own, stops, mids), np.where(own, starts, mids), stops, np.zeros_like(starts), np.full_like(starts, BUDGET)], 1)
    nodes = nodes[(nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3])]
    for i, j in walk(keys, nodes, BUDGET):
        ok = (root[i] != root[j]) & (c[i] != c[j]) & (np.minimum(n[i], n[j]) * 5 >= np.maximum(n[i], n[j]) * 4)
        i, j = i[ok], j[ok]
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            x = anchors[a]
            both = (x[:, :, None] == anchors[b][:, None, :]).any(2) & (np.arange(ANCHORS) < lengths[a][:, None])
            ok = np.where(both, x, np.iinfo(np.int64).max).min(1) == s[a]
            if ok.any():
                yield a[ok], b[ok]


def found_in_tasks(docs: DataFrame, classes: DataFrame, tasks: DataFrame) -> DataFrame:
    """(u, v): a spanning forest of each task's checked links."""

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_tasks(batches):
            met = np.zeros(len(rows), bool)
            for i, j in candidates(rows):
                met[i] = met[j] = True
            yield rows.filter(pa.array(met))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_tasks(batches):
            sets, c = [np.frombuffer(x.as_buffer(), "<u8") for x in rows.column(9)], rows.column(4).to_numpy()
            parent = dict.fromkeys(c.tolist())

            def top(x: int) -> int:
                while parent[x] is not None:
                    if parent[parent[x]] is not None:
                        parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            out: list[tuple[int, int]] = []
            for i, j in candidates(rows):
                order = np.argsort(i, kind="stable")
                for js in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
                    u, mine = int(c[i[js[0]]]), sets[i[js[0]]]
                    others = [k for k in j[js].tolist() if top(int(c[k])) != top(u)]
                    for k, ok in zip(others, similar(mine, [sets[k] for k in others]) if others else []):
                        a, b = top(u), top(int(c[k]))
                        if ok and a != b:
                            parent[max(a, b)] = min(a, b)
                            out.append((u, int(c[k])))
            ends = np.array(out, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])

    kinds = "s long, lo int, hi int, side int, c long, n int, fp long, root long, anchors array<long>"
    some = cut(grouped(tasks).mapInArrow(flagged, kinds))
    if some.isEmpty():
        return some.select(F.col("c").alias("u"), F.col("c").alias("v"))
    sets = sets_of(docs, wanted(some, classes, "c"))
    return cut(grouped(some.join(sets, "c"), "set").mapInArrow(checked, "u long, v long"))


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v): similar pairs of sets that connect all that are connected by such pairs."""
    held = anchored(classes)
    postings = postings_of(held)
    stars = starred(docs, classes, postings)
    return stars.unionByName(found_in_tasks(docs, classes, dealt(postings, connected(stars), held.select("c", "anchors"))))


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every row."""
    rows = cut(marked(docs))
    classes = cut(classes_of(rows))
    found = classes.select("c", "first_id").join(connected(links(docs, classes)).withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    found = cut(found)
    least = cut(found.groupBy("root").agg(F.min("first_id").alias("component_id")))  # written, so that a skewed root is split
    return rows.select("doc_id", "c").join(found.select("c", "root").join(least, "root").select("c", "component_id"), "c").select("doc_id", "component_id")


def keep_one_per_component(docs: DataFrame) -> DataFrame:
    """The rows of docs whose id is their component's smallest; of rows with equal ids, one stays. Rows without an id stay.

    The ids that go are joined, not those that stay, which are many more, and only with rows that likely go; the others' texts are not shuffled.
    Only rows with an id of several are compared by it, so that texts of the others need no sort."""
    found = cut(components(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("first"), F.count("*").alias("n")).filter("first = 0 or n > 1"))
    gone = written(found.select("doc_id"), "gone")
    flagged = likely(docs, "doc_id", gone)
    kept = flagged.filter("not likely__").select(docs.columns).unionByName(flagged.filter("likely__").join(gone, "doc_id", "left_anti").select(docs.columns))
    repeated = found.filter("first = 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    same = likely(docs, "doc_id", repeated).filter("likely__").join(repeated, "doc_id", "left_semi")
    return kept.unionByName(same.dropDuplicates(["doc_id"]).select(docs.columns))
