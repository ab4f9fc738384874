"""SimHash near-duplicates, found with BK-trees.

A document's fingerprint sums the hashes of its word shingles bit by bit. Distinct fingerprints are dealt
to shards by *routes* (some of their bits), and every shard builds BK-trees, one per route, whose edges
carry the Hamming distance to the parent: a search with radius ``r`` at distance ``d`` follows only the
edges from ``d - r`` to ``d + r``. Links become components, smallest id first.

A tree is not broadcast to all fingerprints: that costs a pass over the corpus per tree. Instead the
routes send each fingerprint to the trees that can hold a neighbour.

Rows with a null text count as empty texts; texts without words have the fingerprint zero, linked like any
other. Null ids keep their rows and are no one's smallest id unless a component has no other. Repeated
rows are kept. An empty table gives an empty table. Other columns are left out of the result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdeck.llm.common import components, in_batches, mixed, pieces_of, raw_text, stored

#: Fingerprints a route may have before it is split, and fingerprints dealt to one task.
TREE_SIZE = 4096
SHARD_ROWS = 60_000


def shingle_hashes(text: bytes, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words, A-Z in lower case, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(starts))


def majority(hashes: np.ndarray, bits: int) -> bytes:
    """Little-endian fingerprint: a bit is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return bytes(bits // 8)
    columns = [hashes] + [mixed(hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(1, bits // 64)]
    wide = np.stack(columns, axis=1) if bits > 64 else hashes.reshape(-1, 1)
    total = np.zeros(bits, np.int64)
    for at in range(0, len(wide), 65_025):
        part = np.ascontiguousarray(wide[at : at + 65_025]).view(np.uint8)
        ones = np.unpackbits(part, axis=1, bitorder="little")
        full = len(ones) // 255 * 255
        # Sums of up to 255 bits fit a byte, which numpy adds many at a time.
        total += ones[:full].reshape(-1, 255, bits).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += ones[full:].sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(wide), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, shingle: int, bits: int = 64, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp binary, node long)``; ``node`` names the fingerprint."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.binary()), ("node", pa.int64())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [majority(shingle_hashes(t, shingle), bits) for t in batch.column(1).to_pylist()]
        if bits == 64:
            nodes = np.frombuffer(b"".join(fps), np.int64)
        else:
            nodes = np.array([xxhash.xxh64_intdigest(f) for f in fps], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary()), pa.array(nodes)], schema=schema)

    given = docs.select(F.col(doc).cast("long").alias("doc_id"), raw_text(text).alias("text"))
    return given.mapInArrow(in_batches(work), "doc_id long, fp binary, node long")


class Routes:
    """Bit masks such that fingerprints that shall meet agree on all bits of at least one mask."""

    def __init__(self, masks: np.ndarray, radius: int, exact: bool) -> None:
        self.masks, self.radius, self.exact = masks, radius, exact
        self.bits = masks.shape[1] * 64

    @classmethod
    def pigeonhole(cls, radius: int) -> Routes:
        """64 bits in ``radius + 2`` blocks, two of which agree for any pair within the radius."""
        blocks = np.array_split(np.arange(64), radius + 2)
        masks = [sum(1 << int(b) for b in np.concatenate(c)) for c in combinations(blocks, 2)]
        return cls(np.array(masks, np.uint64).reshape(-1, 1), radius, True)

    @classmethod
    def sampled(cls, bits: int, radius: int, tables: int, width: int, seed: int = 11) -> Routes:
        """``tables`` masks of ``width`` random bits: a pair that differs in a share ``p`` of the bits
        agrees on one with probability ``1 - (1 - (1 - p) ** width) ** tables``."""
        rng = np.random.default_rng(seed)
        masks = np.zeros((tables, bits // 64), np.uint64)
        for t in range(tables):
            for b in rng.choice(bits, width, replace=False):
                masks[t, b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return cls(masks, radius, False)

    def keys(self, words: np.ndarray, mask: np.ndarray) -> np.ndarray:
        key = np.full(len(words), mixed(mask.astype(np.uint64)).sum(dtype=np.uint64), np.uint64)
        for w in range(words.shape[1]):
            key = mixed(key ^ (words[:, w] & mask[w]))
        return key


def _words(column: pa.Array | pa.ChunkedArray, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, bits // 64)


ROUTED = pa.schema([("route", pa.int64()), ("mask", pa.int64()), ("fp", pa.binary())])


def _routed(distinct: DataFrame, routes: Routes) -> DataFrame:
    """One row for each mask of each fingerprint."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column(0).cast(pa.binary())
        words, n = _words(fps, routes.bits), len(routes.masks)
        keys = np.concatenate([routes.keys(words, m) for m in routes.masks]).view(np.int64)
        masks = np.repeat(routes.masks[:, 0].view(np.int64), len(words))
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(masks), pa.concat_arrays([fps] * n)], schema=ROUTED)

    return distinct.select("fp").mapInArrow(in_batches(work), "route long, mask long, fp binary")


def _refined(hot: DataFrame, routes: Routes) -> DataFrame:
    """Longer routes: the bits outside the mask in ``radius + 1`` blocks, one of which agrees."""
    parts = routes.radius + 1

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column(2).cast(pa.binary())
        words, masks = _words(fps, 64)[:, 0], batch.column(1).to_numpy().view(np.uint64)
        longer = np.zeros((parts, len(masks)), np.uint64)
        for mask in np.unique(masks):
            free = [b for b in range(64) if not int(mask) >> b & 1]
            for k, block in enumerate(np.array_split(np.array(free, np.int64), parts)):
                longer[k, masks == mask] = np.uint64(int(mask) | sum(1 << int(b) for b in block))
        longer = longer.reshape(-1)
        keys = mixed(mixed(np.tile(words, parts) & longer) ^ mixed(longer))
        return pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(longer.view(np.int64)), pa.concat_arrays([fps] * parts)], schema=ROUTED
        )

    return hot.select("route", "mask", "fp").mapInArrow(in_batches(work), "route long, mask long, fp binary")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees over fingerprints ``words``, one tree for each value of ``group``; fingerprints of one
    group are distinct."""

    def __init__(self, words: np.ndarray, group: np.ndarray) -> None:
        self.words, self.span = words, words.shape[1] * 64 + 1
        _, first, inverse = np.unique(group, return_index=True, return_inverse=True)
        self.root = first[inverse]
        keys, children = [], []
        items = np.flatnonzero(self.root != np.arange(len(words)))
        at = self.root[items]
        while len(items):
            key = at * self.span + distances(words[items], words[at])
            edges, lead, back = np.unique(key, return_index=True, return_inverse=True)
            keys.append(edges)
            children.append(items[lead])
            at = items[lead][back]  # the first to arrive becomes the child, the others go on from it
            rest = items != at
            items, at = items[rest], at[rest]
        self.keys = np.concatenate([*keys, np.zeros(0, np.int64)])
        order = np.argsort(self.keys)
        self.keys, self.children = self.keys[order], np.concatenate([*children, np.zeros(0, np.int64)])[order]

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """``(query, node)`` indices within ``radius``, in the query's own tree."""
        found = []
        q, node = queries, self.root[queries]
        while len(q):
            d = distances(self.words[q], self.words[node])
            hit = (d <= radius) & (q != node)
            found.append((q[hit], node[hit]))
            low = np.searchsorted(self.keys, node * self.span + np.maximum(d - radius, 0))
            high = np.searchsorted(self.keys, node * self.span + np.minimum(d + radius, self.span - 1), "right")
            n = high - low
            q = np.repeat(q, n)
            node = self.children[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(q))]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def links(self, radius: int, step: int = 1024) -> np.ndarray:
        """Label of each fingerprint: the first one that links lead to. Pairs are folded into labels a
        block of queries at a time, never held all at once."""
        label = np.arange(len(self.words))
        order = np.argsort(self.root, kind="stable")
        sizes = np.bincount(self.root, minlength=len(self.words))[self.root[order]]
        blocks = np.flatnonzero(np.diff(np.cumsum(np.minimum(sizes, TREE_SIZE)) // (step * TREE_SIZE // 2), prepend=-1))
        for part in np.split(order, blocks[1:]):
            a, b = self.near(part, radius)
            while len(a):
                ra, rb = label[a], label[b]
                apart = ra != rb
                if not apart.any():
                    break
                a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
                np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
                while not np.array_equal(label, label[label]):
                    label = label[label]
        return label


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _tree_links(dealt: DataFrame, routes: Routes, shards: int) -> DataFrame:
    """Links of each shard, as edges from a fingerprint to the first of its local component."""

    def work(group: pa.Table) -> pa.Table:
        words = _words(group.column("fp"), routes.bits)
        forest = Forest(words, group.column("tree").to_numpy())
        label = forest.links(routes.radius)
        linked = np.flatnonzero(label != np.arange(len(label)))
        if routes.bits == 64:
            names = words[:, 0].view(np.int64)
        else:
            names = np.array([xxhash.xxh64_intdigest(f) for f in group.column("fp").to_pylist()], np.uint64).view(np.int64)
        return pa.Table.from_arrays([pa.array(names[linked]), pa.array(names[label[linked]])], schema=LINKS)

    keyed = dealt.select("tree", "fp", F.pmod(F.xxhash64("tree"), F.lit(shards)).alias("shard"))
    return keyed.groupBy("shard").applyInArrow(work, "a long, b long")


def linked(fps: DataFrame, routes: Routes, name: str = "simhash", tree_size: int = TREE_SIZE) -> DataFrame:
    """Edges ``(a, b)`` between ``node`` names whose fingerprints are within the radius.

    Routes with more than ``tree_size`` fingerprints are split. Exact routes get longer until they have
    few fingerprints: any pair still agrees on one, so no link is lost. Sampled routes are dealt to parts
    with a tree for each pair of parts, so that any two fingerprints of the route meet.
    """
    rows = stored(_routed(fps.select("fp").distinct(), routes), f"{name}-routes")
    edges = None
    while True:
        n = rows.count()
        shards = pieces_of(n, SHARD_ROWS)
        crowded = rows.groupBy("route").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tree_size)
        tagged = rows.join(crowded, "route", "left")
        if routes.exact:
            part = _tree_links(tagged.filter("n is null").withColumn("tree", F.col("route")), routes, shards)
            edges = part if edges is None else edges.union(part)
            if n <= tree_size:
                return edges
            hot = tagged.filter("n is not null")
            rows = stored(_refined(hot, routes).distinct(), f"{name}-routes")
            if rows.limit(1).count() == 0:
                return edges
        else:
            trees = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / tree_size)
            own = F.pmod(F.xxhash64("fp", "route"), trees)
            spread = F.transform(F.sequence(F.lit(0).cast("long"), trees - 1), lambda k: F.struct(F.least(own, k), F.greatest(own, k)))
            dealt = tagged.withColumn("part", F.explode(spread)).withColumn("tree", F.xxhash64("route", "part"))
            return _tree_links(dealt, routes, shards)


def near_duplicates(
    docs: DataFrame, routes: Routes, shingle: int, doc: str = "doc_id", text: str = "text", name: str = "simhash"
) -> DataFrame:
    """``(doc_id, fp binary, node long, component_id long)``: one row per document, with the smallest id
    that links lead to; ``node`` is the fingerprint itself where it has 64 bits."""
    fps = stored(fingerprints(docs, shingle, routes.bits, doc, text), f"{name}-fps")
    # The edges are computed once inside: components() stores them.
    roots = components(linked(fps, routes, name), name)
    first = fps.groupBy("node").agg(F.min("doc_id").alias("first"))
    named = first.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = named.join(smallest, "root").select("node", "component_id")
    return fps.join(placed, "node").select("doc_id", "fp", "node", "component_id")


def keep_first(docs: DataFrame, routes: Routes, shingle: int, doc: str = "doc_id", text: str = "text", name: str = "dedup") -> DataFrame:
    """``docs`` with all their columns, one row of each component: that with the smallest id (null last),
    of several the one with the smallest text hash, of equal rows any one.

    The winners are found on narrow rows; texts are shuffled once, to meet them."""
    given = docs.withColumn("_place", F.xxhash64(doc, text))
    fps = stored(fingerprints(given.withColumn("_id", F.col("_place")), shingle, routes.bits, "_id", text), f"{name}-fps")
    ids = stored(given.select(F.col("_place"), F.col(doc).cast("long").alias("_doc")).distinct(), f"{name}-ids")
    named = fps.select("node", F.col("doc_id").alias("_place")).distinct().join(ids, "_place")
    roots = components(linked(fps, routes, name), name)
    grouped = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = F.min(F.struct(F.col("_doc").isNull().alias("none"), "_doc", "_place"))
    winners = grouped.groupBy("root").agg(least.alias("least")).select("least._place")
    kept = given.join(winners, "_place", "left_semi")
    return kept.dropDuplicates(["_place"]).drop("_place").select(*docs.columns)
