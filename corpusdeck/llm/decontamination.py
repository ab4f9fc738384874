"""Benchmark decontamination by SimHash of item-sized windows.

For each size of benchmark items, the windows of that many words slide over a document. A window's SimHash
(of its five-word shingles) is looked up in a multi-index: fingerprints are cut into blocks, and two that
differ in at most ``RADIUS`` bits differ in at most ``RADIUS // BLOCKS`` bits of some block, so probing
each block's values that near finds every item within the radius. Items found are verified by exact
weighted-shingle similarity: the sum of the smaller over the sum of the larger shingle counts. A document
shorter than an item is compared with it as a whole.

A window as similar as asked for shares most of its shingles with its item, so only windows with that many
shingles of some item of their size are fingerprinted; that bound loses none.

Words are runs of letters, digits and underscores, in lower case. A null text, of a document or an item,
has no words, and is never part of a leak. Items of fewer than five words have one shingle, all their words.
Null ids are passed on. Repeated rows are all reported. Empty tables give an empty table. Other columns are
passed on by :func:`keep_clean` only.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdeck.llm.common import gram_hashes, hashes_of, in_batches
from corpusdeck.llm.simhash import majority

SHINGLE = 5
RADIUS, BLOCKS = 20, 8
#: Items of one pass over the documents: what is broadcast has at most so many rows and bytes of text.
ITEMS, ITEM_BYTES = 20_000, 16_000_000
WORD = re.compile(r"\w+")
#: Values of a byte within each distance.
NEAR = [sum(1 << b for b in c) for n in range(RADIUS // BLOCKS + 1) for c in combinations(range(8), n)]


def words_of(text: str) -> list[bytes]:
    return " ".join(WORD.findall(text.lower())).encode().split()


def shingles(words: list[bytes]) -> Counter:
    if len(words) < SHINGLE:
        return Counter([tuple(words)]) if words else Counter()
    return Counter(zip(*(words[k:] for k in range(SHINGLE)), strict=False))


def similarity(a: Counter, b: Counter) -> float:
    return (a & b).total() / max(1, (a | b).total())


class Items:
    """Benchmark items by size, with their fingerprints in a multi-index."""

    def __init__(self, items: list[tuple[int | None, str]], least: float) -> None:
        self.least, self.ids = least, [i for i, _ in items]
        words = [words_of(t) for _, t in items]
        self.shingles = [shingles(w) for w in words]
        self.by_size: dict[int, list[dict[int, list[int]]]] = {}
        grams: dict[int, list[tuple[np.ndarray, int]]] = {}
        self.sizes = [len(w) for w in words]
        self.prints = np.zeros(len(items), np.uint64)
        for k, w in enumerate(words):
            if not w:
                continue
            own = gram_hashes(hashes_of(w), min(SHINGLE, len(w)))
            grams.setdefault(min(SHINGLE, len(w)), []).append((own, k))
            fp = majority(own, 64)
            self.prints[k] = np.frombuffer(fp, np.uint64)[0]
            tables = self.by_size.setdefault(len(w), [{} for _ in range(BLOCKS)])
            for block, value in enumerate(fp):
                tables[block].setdefault(value, []).append(k)
        # For each shingle length: the hashes in order, the items of each, and a table over their first bits
        # that most others miss.
        self.grams, self.holders, self.first = {}, {}, {n: np.zeros(1 << 22, bool) for n in grams}
        for n, parts in grams.items():
            values = np.concatenate([g for g, _ in parts])
            holder = np.repeat([k for _, k in parts], [len(g) for g, _ in parts])
            pairs = np.unique(np.stack([values, holder.astype(np.uint64)]), axis=1)
            self.grams[n], starts = np.unique(pairs[0], return_index=True)
            self.holders[n] = np.split(pairs[1].astype(np.int64), starts[1:])
        for n, g in self.grams.items():
            self.first[n][(g >> np.uint64(42)).astype(np.int64)] = True

    def places(self, grams: np.ndarray, n: int) -> dict[int, list[int]]:
        """Where the shingles of each item stand."""
        at = np.flatnonzero(self.first[n][(grams >> np.uint64(42)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.grams[n], grams[at]), len(self.grams[n]) - 1)
        known = self.grams[n][number] == grams[at]
        out: dict[int, list[int]] = {}
        for place, k in zip(at[known].tolist(), number[known].tolist(), strict=True):
            for item in self.holders[n][k].tolist():
                out.setdefault(item, []).append(place)
        return out

    def candidates(self, fp: bytes, size: int) -> list[int]:
        """Items of ``size`` words within the radius."""
        tables, found = self.by_size[size], set()
        for block, value in enumerate(fp):
            for flip in NEAR:
                found.update(tables[block].get(value ^ flip, ()))
        near = np.fromiter(found, np.int64, len(found))
        return near[np.bitwise_count(self.prints[near] ^ np.frombuffer(fp, np.uint64)[0]) <= RADIUS].tolist()

    def leaks(self, text: str) -> list[tuple[int, float, int, int]]:
        """``(item, similarity, first word, words)``: of each item found its most similar window, the first
        of equals."""
        words = words_of(text)
        if not words or not self.by_size:
            return []
        hashes, best, whole = hashes_of(words), {}, None
        for n in self.grams:
            grams = gram_hashes(hashes, n)
            done: set[tuple[int, int]] = set()
            for item, places in self.places(grams, n).items():
                size = self.sizes[item]
                span = size - n + 1
                if span > len(grams):
                    # A document shorter than the item is its one window.
                    if len(places) >= (span + len(grams)) * self.least / (1 + self.least) - 1e-9:
                        whole = whole or shingles(words)
                        s = similarity(whole, self.shingles[item])
                        if s >= self.least:
                            best[item] = (s, 0, len(words))
                    continue
                # similarity s needs s / (1 + s) of both windows' shingles in common
                least = max(1, int(np.ceil(2 * span * self.least / (1 + self.least) - 1e-9)))
                if len(places) < least:
                    continue
                flags = np.zeros(len(grams) + 1, np.int64)
                flags[np.array(places) + 1] = 1
                upto = np.cumsum(flags)
                for start in np.flatnonzero(upto[span:] - upto[:-span] >= least).tolist():
                    if (size, start) in done:
                        continue
                    done.add((size, start))
                    near = self.candidates(majority(grams[start : start + span], 64), size)
                    own = shingles(words[start : start + size]) if near else None
                    for k in near:
                        s = similarity(own, self.shingles[k])
                        if s >= self.least and s > best.get(k, (0,))[0]:
                            best[k] = (s, start, size)
        return [(k, *found) for k, found in sorted(best.items())]


_KEPT: dict[str, Items] = {}


def passes(benchmark: DataFrame, least: float, item: str, text: str) -> Iterator[Callable[[], Items]]:
    """Items in parts of bounded size, each broadcast for one pass over the documents."""
    context = benchmark.sparkSession.sparkContext

    def part(items: list[tuple[int | None, str]]) -> Callable[[], Items]:
        sent, key = context.broadcast(items), uuid.uuid4().hex

        def get() -> Items:
            if key not in _KEPT:
                _KEPT.clear()
                _KEPT[key] = Items(sent.value, least)
            return _KEPT[key]

        return get

    held: list[tuple[int | None, str]] = []
    size = 0
    for row in benchmark.select(F.col(item).cast("long"), F.col(text)).filter(F.col(text).isNotNull()).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1])
        if len(held) >= ITEMS or size >= ITEM_BYTES:
            yield part(held)
            held, size = [], 0
    if held:
        yield part(held)


LEAKS = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.8, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row for each document and item of which it holds a window at least ``least`` similar."""
    given = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = docs.sparkSession.createDataFrame([], LEAKS)
    for get in passes(benchmark, least, item, item_text):

        def work(batch: pa.RecordBatch, get: Callable[[], Items] = get) -> pa.RecordBatch:
            items = get()
            rows = [
                (d, items.ids[k], s, at, n)
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for k, s, at, n in items.leaks(t)
            ]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        found = found.union(given.mapInArrow(in_batches(work), LEAKS))
    return found


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.8, text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``docs`` with all their columns, without the documents that hold a leak."""
    at = docs.columns.index(text)
    for get in passes(benchmark, least, item, item_text):

        def work(batch: pa.RecordBatch, get: Callable[[], Items] = get) -> pa.RecordBatch:
            items = get()
            return batch.filter(pa.array([not items.leaks(t or "") for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(in_batches(work), docs.schema)
    return docs
