"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are distinct 64-bit keys of a binary trie. The join walks pairs of trie nodes together, adds up the bits in
which their paths differ, and drops a pair of nodes once more than the budget differ. Two keys with at most k differing
bits agree on at least e of k+e blocks, so a trie is walked for every choice of e blocks as the leading ones, from the nodes
below these: such nodes are the unit of distribution. e grows with the number of keys (1 up to some 80 million, then 5 tries;
2 up to some 20 billion, then 15), so that nodes stay small; any e finds the same links. A node with more keys than
`node_limit` is first opened further, as node pairs in a table, so that no task holds an unbounded node. Tasks emit a spanning forest of their links, which keeps every link's
effect on components without listing all pairs of a dense group.

Defined results: a null text counts as empty; a text without words has fingerprint zero; repeated rows share a class; a
null doc_id gets a fingerprint and its class's smallest non-null id (null if there is none); empty tables give no rows;
other columns of the input are ignored by `components` and kept by `keep_one_per_component`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BITS, SEED = 64, 42


def text_fingerprint(text: str | None, width: int = 4) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends - 1).tolist()
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - width + 1)
    stops = stops[width - 1 :] or stops[-1:]
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n], stops)), dtype="<u8", count=n)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * counts > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([text_fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def walk(keys: np.ndarray, groups: list[tuple[int, int, int, int, int, int]], total: int, leaf: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs (i, j) that differ in at most the budget.

    keys: uint64, sorted within each node. groups: (a_lo, a_hi, b_lo, b_hi, depth, budget); a node joined with itself has
    a == b, and budget is what is left of `total`. A sorted range is a trie node, and its children are found by bisection on the next bit.
    """
    stack = [np.array(groups, dtype=np.int64).reshape(-1, 6)]
    while stack:
        front = stack.pop()
        if len(front) > 20_000:
            stack += [front[20_000:], front[:20_000]]
            continue
        al, ah, bl, bh, depth, budget = front.T
        small = ((ah - al) * (bh - bl) <= leaf) | (depth >= BITS)
        if small.any():
            yield from leaves(keys, front[small], total)
        front = front[~small]
        if not len(front):
            continue
        al, ah, bl, bh, depth, budget = front.T
        am, bm = first_one(keys, al, ah, depth), first_one(keys, bl, bh, depth)
        same = (al == bl) & (ah == bh)
        children = [
            np.stack([al, am, bl, bm, depth + 1, budget], 1),
            np.stack([am, ah, bm, bh, depth + 1, budget], 1),
            np.stack([al, am, bm, bh, depth + 1, budget - 1], 1),
            np.stack([am, ah, bl, bm, depth + 1, budget - 1], 1)[~same],
        ]
        below = np.concatenate(children)
        below = below[(below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 5] >= 0)]
        if len(below):
            stack.append(below)


def first_one(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    lo, hi, shift = lo.copy(), hi.copy(), (BITS - 1 - depth).astype(np.uint64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        one = ((keys[np.minimum(mid, len(keys) - 1)] >> shift) & np.uint64(1)).astype(bool)
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def leaves(keys: np.ndarray, nodes: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, int(sizes.sum()), 2_000_000)[1:])
    for part in np.split(np.arange(len(nodes)), np.unique(cuts)):
        if not len(part):
            continue
        n, s = nodes[part], sizes[part]
        at = np.repeat(np.arange(len(n)), s)
        k = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
        wide = (n[:, 3] - n[:, 2])[at]
        i, j = n[at, 0] + k // wide, n[at, 2] + k % wide
        ok = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
        ok &= (i < j) | (n[at, 0] != n[at, 2])
        if ok.any():
            yield i[ok], j[ok]


def forest(keys: np.ndarray, groups: list[tuple[int, int, int, int, int, int]], total: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within the given node pairs."""
    parent = np.arange(len(keys))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in walk(keys, groups, total):
        while True:  # flatten, so that links within a component drop out at once
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        apart = parent[i] != parent[j]
        for x, y in zip(i[apart].tolist(), j[apart].tolist()):
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((x, y))
    return out


def layouts(budget: int, exact: int) -> list[list[tuple[int, int, int]]]:
    """For every choice of leading blocks: (place in the fingerprint, place in the key, width) of each block, from the right."""
    n = budget + exact
    cuts = [BITS * i // n for i in range(n + 1)]
    out = []
    for lead in combinations(range(n), exact):
        at, moves = BITS, []
        for i in [*lead, *(i for i in range(n) if i not in lead)]:
            width = cuts[i + 1] - cuts[i]
            at -= width
            moves.append((cuts[i], at, width))
        out.append(moves)
    return out


def arranged(fp, moves: list[tuple[int, int, int]]):
    """fp with its blocks moved."""
    key = F.lit(0).cast("long")
    for source, target, width in moves:
        key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, source).bitwiseAND(F.lit((1 << width) - 1)), target))
    return key


def restored(keys: np.ndarray, moves: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(len(keys), np.uint64)
    for source, target, width in moves:
        out |= ((keys >> np.uint64(target)) & np.uint64((1 << width) - 1)) << np.uint64(source)
    return out


def prefix(key, depth: int):
    """The first `depth` bits as a long."""
    return F.shiftrightunsigned(key, BITS - depth)


def links(classes: DataFrame, budget: int = 4, node_limit: int = 50_000, exact: int | None = None) -> DataFrame:
    """(u, v): a spanning forest of the pairs of distinct `fp` within the budget, from each trie node pair."""
    if exact is None:
        n, exact = classes.count(), 1
        while n >> (exact * BITS // (budget + exact)) > 20_000:
            exact += 1
    orders = layouts(budget, exact)
    first = min(sum(width for _, _, width in moves[:exact]) for moves in orders)
    keyed = classes.select(F.explode(F.array(*[F.struct(F.lit(i).alias("rot"), arranged(F.col("fp"), m).alias("key")) for i, m in enumerate(orders)])).alias("x")).select("x.*")
    keyed = keyed.withColumn("a", prefix(F.col("key"), first))
    sizes = keyed.groupBy("rot", "a").count()
    large = cut(sizes.filter(F.col("count") > node_limit).select("rot", "a"))
    tasks = keyed.select("rot", "key", F.lit(first).alias("depth"), F.col("a"), F.col("a").alias("b"), F.lit(budget).alias("left"), F.lit(0).alias("side"))
    if not large.isEmpty():
        tasks = tasks.join(large, ["rot", "a"], "left_anti").select(tasks.columns)
        hot = keyed.join(large, ["rot", "a"]).select("rot", "key")
        pairs, depth = large.select("rot", "a", F.col("a").alias("b"), F.lit(budget).alias("left")), first
        step = 4
        while depth < BITS and not pairs.isEmpty():
            step = min(step, BITS - depth)
            depth += step
            node = prefix(F.col("key"), depth) if depth < BITS else F.col("key")
            counted = hot.groupBy("rot", node.alias("p")).agg(F.count("*").alias("n"))
            nibble = F.explode(F.sequence(F.lit(0), F.lit((1 << step) - 1)))
            grown = pairs.select("*", nibble.alias("x")).select("*", nibble.alias("y"))
            grown = grown.filter((F.col("a") != F.col("b")) | (F.col("x") <= F.col("y"))).select("rot", (F.shiftleft("a", step) + F.col("x")).alias("a"), (F.shiftleft("b", step) + F.col("y")).alias("b"), (F.col("left") - F.bit_count(F.col("x").bitwiseXOR(F.col("y")))).alias("left")).filter("left >= 0")
            grown = grown.join(counted.select("rot", F.col("p").alias("a"), F.col("n").alias("na")), ["rot", "a"]).join(counted.select("rot", F.col("p").alias("b"), F.col("n").alias("nb")), ["rot", "b"])
            grown = cut(grown)
            done = grown if depth >= BITS else grown.filter(F.col("na") + F.col("nb") <= node_limit)
            for side, name in ((0, "a"), (1, "b")):
                part = done if side == 0 else done.filter("a <> b")
                rows = hot.withColumn("p", node).join(part.withColumn("p", F.col(name)), ["rot", "p"])
                tasks = tasks.unionByName(rows.select("rot", "key", F.lit(depth).alias("depth"), "a", "b", F.col("left").cast("int").alias("left"), F.lit(side).alias("side")))
            pairs = grown.filter(F.col("na") + F.col("nb") > node_limit).select("rot", "a", "b", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def joined(rows: np.ndarray) -> pa.RecordBatch:
            keys, rot = np.ascontiguousarray(rows[:, 1]).view(np.uint64), rows[:, 0]
            task = np.flatnonzero(np.any(rows[1:, [0, 2, 3, 4]] != rows[:-1, [0, 2, 3, 4]], axis=1)) + 1
            side = np.flatnonzero(rows[1:, 6] != rows[:-1, 6]) + 1
            lo = np.concatenate(([0], task))
            hi = np.concatenate((task, [len(rows)]))
            mid = np.concatenate((side, [len(rows)]))[np.searchsorted(side, lo, side="right")]
            mid = np.where((mid < hi) & (rows[lo, 3] != rows[lo, 4]), mid, hi)
            own = rows[lo, 3] == rows[lo, 4]
            node_pairs = np.stack([lo, np.where(own, hi, mid), np.where(own, lo, mid), hi, rows[lo, 2], rows[lo, 5]], 1)
            node_pairs = node_pairs[(node_pairs[:, 0] < node_pairs[:, 1]) & (node_pairs[:, 2] < node_pairs[:, 3]) & (hi - lo > 1)]
            found = np.array(forest(keys, node_pairs.tolist(), budget), dtype=np.int64).reshape(-1, 2)
            u, v, of = keys[found[:, 0]], keys[found[:, 1]], rot[found[:, 0]]
            for i in np.unique(of):
                u[of == i], v[of == i] = restored(u[of == i], orders[i]), restored(v[of == i], orders[i])
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(7)], 1))
            if sum(map(len, held)) >= 100_000:
                rows = np.concatenate(held)
                last = np.flatnonzero(np.any(rows[:, [0, 2, 3, 4]] != rows[-1, [0, 2, 3, 4]], axis=1))
                stop = last[-1] + 1 if len(last) else 0
                held = [rows[stop:]]
                if stop:
                    yield joined(rows[:stop])
        if held and len(rows := np.concatenate(held)):
            yield joined(rows)

    order = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    return (
        tasks.select("rot", "key", "depth", "a", "b", "left", "side")
        .repartition("rot", "depth", "a", "b")
        .sortWithinPartitions("rot", "depth", "a", "b", "side", order)
        .mapInArrow(run, "u long, v long")
    )


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node reachable. Alternating large and small stars."""
    state, edges = None, cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def components(docs: DataFrame, width: int = 4, budget: int = 4, node_limit: int = 50_000) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    marked = cut(fingerprints(docs, width))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected(links(classes, budget, node_limit)).withColumnRenamed("node", "fp")
    classes = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = cut(classes.groupBy("root").agg(F.min("first_id").alias("component_id")))  # written, so that a skewed root is split
    return marked.join(classes.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one_per_component(docs: DataFrame, width: int = 4, budget: int = 4) -> DataFrame:
    """The rows of docs whose id is their component's smallest; of rows with equal ids, one stays. Rows without an id stay."""
    found = components(docs, width, budget).filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.dropDuplicates(["doc_id"]).filter("doc_id is not null").join(found, "doc_id", "left_semi").select(docs.columns)
    return kept.unionByName(docs.filter("doc_id is null"))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
