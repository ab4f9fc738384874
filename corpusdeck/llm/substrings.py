"""Removal of repeated word windows, found with compressed FM-indexes.

A window is ``window`` consecutive words of one document. A word goes if some window that covers it also
starts in a document with a smaller id. Windows are judged on the input.

1. Documents are dealt to blocks of bounded size. Every window has an *anchor*, its smallest run of a few
   words by hash; equal windows have equal anchors, and neighbouring windows mostly share one. Each block
   sends its distinct anchors to hash ranges, which send back those met more than once.
2. Blocks cut out the segments (windows with the same repeated anchor), each distinct one once with the
   places where it stands, and send them to the shard of the anchor. An anchor with very many distinct
   segments, such as a line in a third of all documents, is dealt by whole windows instead.
3. A shard builds an FM-index (Burrows-Wheeler transform in a wavelet matrix) over its distinct segments,
   and streams them through it by backward search: the interval of each window gives all its places,
   hence the smallest document that has it. Places with a larger id go back to their block as word
   intervals.

Hashes only choose candidates and routes: a window is removed because its words are found in the index.

A null text has no words. A null id comes after all ids: such a document can lose words to others and
takes none from them. Documents with equal ids take nothing from each other. Repeated rows are all kept
and treated alike. An empty table gives an empty table. Other columns are passed on in ``row``.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from corpusdeck.llm.common import gram_hashes, hashes_of, pieces_of, raw_text, volume

BLOCK_BYTES = 6_000_000
#: Distinct segments of one anchor that go to one shard; beyond, its windows are dealt one by one.
CROWD = 2048
LAST = np.iinfo(np.int64).max


class Block:
    """Windows and anchors of the documents of one block."""

    def __init__(self, texts: list[bytes], window: int) -> None:
        gram = max(1, window * 2 // 5)
        self.window, self.words = window, [t.split() for t in texts]
        sizes = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        hashes = np.concatenate([*map(hashes_of, self.words), np.zeros(0, np.uint64)])
        self.whole = gram_hashes(hashes, window)
        grams, span = gram_hashes(hashes, gram), window - gram + 1
        n = max(0, len(hashes) - window + 1)
        # The smallest of `span` grams from each window's start, by doubling; the first one of equals.
        best, width = np.arange(len(grams)), 1
        while width < span:
            step = min(width, span - width)
            left, right = best[: len(best) - step], best[step:]
            best = np.where(grams[right] < grams[left], right, left)
            width += step
        best = best[:n]
        doc = np.repeat(np.arange(len(texts)), sizes)
        inside = doc[:n] == doc[window - 1 :] if n else np.zeros(0, bool)
        starts = np.flatnonzero(inside)
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (best[starts[1:]] != best[starts[:-1]]) | (starts[1:] != starts[:-1] + 1)
        #: Segments: first and last window, document, anchor.
        self.lead = starts[fresh]
        self.tail = starts[np.concatenate([fresh[1:], [True]])] if len(starts) else starts
        self.doc, self.anchor = doc[self.lead], grams[best[self.lead]]

    def text(self, doc: int, start: int, end: int) -> bytes:
        return b" ".join(self.words[doc][start:end])


def _key(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


ANCHORS = "bucket long, block long, anchors binary, sizes binary"


def _anchors(window: int, buckets: int):
    """Distinct anchors of a block, with the number of their distinct segments."""

    def run(group: pa.Table) -> pa.Table:
        block = Block(group.column("text").to_pylist(), window)
        shape = block.whole[block.lead] ^ (block.whole[block.tail] * np.uint64(3)) if len(block.lead) else block.anchor
        order = np.lexsort((shape, block.anchor))
        anchor, shape = block.anchor[order], shape[order]
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        other = new.copy()
        other[1:] |= shape[1:] != shape[:-1]
        at = np.flatnonzero(new)
        kinds = np.minimum(np.add.reduceat(other, at, dtype=np.int64) if len(at) else at, 65_535).astype(np.uint16)
        values = anchor[at]
        bucket = ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(cuts[1:], len(values))
        rows = [(values[a:b].tobytes(), kinds[a:b].tobytes()) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
        return pa.table(
            {
                "bucket": pa.array(bucket[cuts]),
                "block": pa.array(np.full(len(cuts), _key(group, "block")[0])),
                "anchors": pa.array([r[0] for r in rows], pa.binary()),
                "sizes": pa.array([r[1] for r in rows], pa.binary()),
            }
        )

    return run


def _repeated(group: pa.Table) -> pa.Table:
    """Of the anchors of one hash range: for each block those that other blocks have too."""
    lists = [np.frombuffer(x, np.uint64) for x in group.column("anchors").to_pylist()]
    kinds = np.concatenate([np.frombuffer(x, np.uint16) for x in group.column("sizes").to_pylist()])
    values, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    crowded = np.bincount(inverse, kinds, len(values)) > CROWD
    twice, crowd, at, out = (counts > 1)[inverse], crowded[inverse], 0, []
    for got in lists:
        own = slice(at, at := at + len(got))
        few, many = got[twice[own] & ~crowd[own]], got[crowd[own]]
        out.append((few.tobytes(), many.tobytes()))
    return pa.table(
        {
            "block": group.column("block"),
            "few": pa.array([x[0] for x in out], pa.binary()),
            "many": pa.array([x[1] for x in out], pa.binary()),
        }
    ).filter(pa.array([bool(x[0] or x[1]) for x in out]))


SEGMENTS = "route long, block long, words binary, rows binary, docs binary, starts binary"


def _segments(window: int):
    """Distinct segments of a block that may stand elsewhere too, and where they stand in it."""

    def run(group: pa.Table, back: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({n: pa.array([], pa.int64() if n in ("route", "block") else pa.binary()) for n in _names(SEGMENTS)})
        block = Block(group.column("text").to_pylist(), window)
        row, doc = _key(group, "row_key"), _key(group, "doc")
        few = np.frombuffer(b"".join(back.column("few").to_pylist()), np.uint64)
        many = np.frombuffer(b"".join(back.column("many").to_pylist()), np.uint64)
        _, inverse, counts = np.unique(block.anchor, return_inverse=True, return_counts=True)
        crowded = np.isin(block.anchor, many)
        wanted = crowded | np.isin(block.anchor, few) | (counts > 1)[inverse]
        found: dict[bytes, tuple[int, list[int], list[int]]] = {}
        whole = block.whole.view(np.int64)
        columns = (block.lead, block.tail, block.doc, block.anchor.view(np.int64), crowded)
        for lead, tail, d, anchor, crowd in zip(*(c[wanted].tolist() for c in columns), strict=True):
            start = lead - int(block.first[d])
            size = tail - lead
            spans = [(start + k, start + k + window) for k in range(size + 1)] if crowd else [(start, start + size + window)]
            for a, b in spans:
                words = block.text(d, a, b)
                if (entry := found.get(words)) is None:
                    route = int(whole[lead + a - start]) if crowd else anchor
                    entry = found[words] = (route, [], [])
                entry[1].append(d)
                entry[2].append(a)
        return pa.table(
            {
                "route": pa.array([e[0] for e in found.values()], pa.int64()),
                "block": pa.array(np.full(len(found), _key(group, "block")[0])),
                "words": pa.array(list(found), pa.binary()),
                "rows": pa.array([row[e[1]].tobytes() for e in found.values()], pa.binary()),
                "docs": pa.array([doc[e[1]].tobytes() for e in found.values()], pa.binary()),
                "starts": pa.array([np.array(e[2], np.int32).tobytes() for e in found.values()], pa.binary()),
            }
        )

    return run


class WaveletMatrix:
    """Symbols below ``2 ** levels``; ``rank`` counts a symbol before a position, for whole arrays."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.bitwise_count(words).astype(np.int64)
            self.bits.append(words)
            self.before.append((np.cumsum(ones) - ones).astype(np.int32))
            self.zeros.append(int(len(bit) - ones.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.start = self.walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[k][word] + np.bitwise_count(self.bits[k][word] & mask)
            at = np.where(symbol >> level & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.walk(symbol, at) - self.start[symbol]


def sorted_suffixes(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling, and each suffix's rank: equal for suffixes that share at least their
    first ``depth`` symbols."""
    n, rank, width = len(symbols), symbols.astype(np.int64), 1
    most = max(n, int(rank.max(initial=0)) + 1) + 2
    order = np.argsort(rank, kind="stable")
    while width < depth:
        step = min(width, depth - width)
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * most + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        width += step
        if rank[order[-1]] == n - 1:
            break
    return order, rank


class FMIndex:
    """Over sequences of symbols from 1, laid end to end with the symbol 0 after each. Suffixes are
    sorted by their first ``depth`` symbols, which is all that patterns up to that length need."""

    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        self.sigma = int(symbols.max(initial=0)) + 1
        order, _ = sorted_suffixes(symbols, depth)
        self.suffix = order
        self.wavelets = WaveletMatrix(symbols[order - 1].astype(np.int64), self.sigma)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=self.sigma))])

    def intervals(self, symbols: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the patterns ``symbols[at : at + length]``, by backward search. A pattern
        left with one suffix is its own only place and is not followed further."""
        last = symbols[at + length - 1]
        low, high = self.below[last].copy(), self.below[last + 1].copy()
        open_ = np.flatnonzero(high - low > 1)
        for step in range(length - 2, -1, -1):
            c = symbols[at[open_] + step]
            low[open_] = self.below[c] + self.wavelets.rank(c, low[open_])
            high[open_] = self.below[c] + self.wavelets.rank(c, high[open_])
            open_ = open_[(high - low)[open_] > 1]
        return low, high


REMOVED = "block long, rows binary, starts binary, ends binary"


def _first_documents(segments: list[bytes], owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each distinct segment the smallest document with that window, and the offset
    of each segment's windows. ``owner``: the smallest document of each segment."""
    ids: dict[bytes, int] = {}
    split = [s.split() for s in segments]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    symbols = np.zeros(int(sizes.sum()) + len(split), np.int64)
    at = np.cumsum(sizes + 1) - sizes - 1
    for words, start in zip(split, at.tolist(), strict=True):
        symbols[start : start + len(words)] = [ids.setdefault(w, len(ids) + 1) for w in words]
    windows = sizes - window + 1
    offset = np.concatenate([[0], np.cumsum(windows)])
    segment = np.repeat(np.arange(len(split)), windows)
    place = np.arange(offset[-1]) - offset[segment] + at[segment]
    index = FMIndex(symbols, window)
    low, high = index.intervals(symbols, place, window)
    first = owner[segment]
    many = np.flatnonzero(high - low > 1)
    if len(many):
        # Intervals of patterns of one length are equal or disjoint.
        lows, back = np.unique(low[many], return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[back] = high[many]
        holder = np.repeat(owner, sizes + 1)[index.suffix]
        bounds = np.stack([lows, highs], axis=1).reshape(-1)
        first[many] = np.minimum.reduceat(np.append(holder, LAST), bounds)[::2][back]
    return first, offset


def _removals(window: int):
    def run(group: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = {}
        which = [numbers.setdefault(w, len(numbers)) for w in group.column("words").to_pylist()]
        docs = [np.frombuffer(x, np.int64) for x in group.column("docs").to_pylist()]
        owner = np.full(len(numbers), LAST)
        np.minimum.at(owner, which, np.fromiter((d.min() for d in docs), np.int64, len(docs)))
        first, offset = _first_documents(list(numbers), owner, window)
        out: dict[int, tuple[list[int], list[int], list[int]]] = {}
        places = zip(
            which, docs, group.column("block").to_pylist(), group.column("rows").to_pylist(), group.column("starts").to_pylist(), strict=True
        )
        for number, ids, block, rows, starts in places:
            windows = first[offset[number] : offset[number + 1]]
            if windows.min() >= ids.max():
                continue
            rows, starts = np.frombuffer(rows, np.int64).tolist(), np.frombuffer(starts, np.int32).tolist()
            into = out.setdefault(block, ([], [], []))
            flat = len(windows) if windows.max() == windows.min() else 0
            for doc, row, start in zip(ids.tolist(), rows, starts, strict=True):
                if flat:
                    runs = [(0, flat)] if windows[0] < doc else []
                else:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], windows < doc, [0]])))
                    runs = edge.reshape(-1, 2).tolist()
                for a, b in runs:
                    into[0].append(row)
                    into[1].append(start + a)
                    into[2].append(start + b + window - 1)
        kept = {b: x for b, x in out.items() if x[0]}
        return pa.table(
            {
                "block": pa.array(list(kept), pa.int64()),
                "rows": pa.array([np.array(x[0], np.int64).tobytes() for x in kept.values()], pa.binary()),
                "starts": pa.array([np.array(x[1], np.int32).tobytes() for x in kept.values()], pa.binary()),
                "ends": pa.array([np.array(x[2], np.int32).tobytes() for x in kept.values()], pa.binary()),
            }
        )

    return run


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _applied(group: pa.Table, back: pa.Table) -> pa.Table:
    """Take the intervals out of the texts of a block."""
    rows = np.frombuffer(b"".join(back.column("rows").to_pylist()), np.int64)
    starts = np.frombuffer(b"".join(back.column("starts").to_pylist()), np.int32)
    ends = np.frombuffer(b"".join(back.column("ends").to_pylist()), np.int32)
    order = np.argsort(rows, kind="stable")
    rows, starts, ends = rows[order], starts[order], ends[order]
    keys = _key(group, "row_key") if group.num_rows else np.zeros(0, np.int64)
    low, high = np.searchsorted(rows, keys), np.searchsorted(rows, keys, "right")
    kept, counts, removed, spans = [], [], [], []
    for text, a, b in zip(group.column("text").to_pylist(), low.tolist(), high.tolist(), strict=True):
        words = text.split()
        counts.append(len(words))
        if a == b:
            removed.append(0)
            spans.append([])
            kept.append(b" ".join(words))
            continue
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, starts[a:b], 1)
        np.add.at(depth, ends[a:b], -1)
        stays = np.cumsum(depth[:-1]) == 0
        kept.append(b" ".join(compress(words, stays.tolist())))
        removed.append(len(words) - int(stays.sum()))
        spans.append(np.flatnonzero(np.diff(np.concatenate([[0], ~stays, [0]]))).tolist())
    return pa.table(
        {
            "row": group.column("row"),
            "text": group.column("text").cast(pa.string()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            "n_words": pa.array(counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.int64())),
        }
    )


def dedup_substrings(docs: DataFrame, window: int = 13, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``row`` (struct of all other columns), ``text``, ``kept`` (the words that stay,
    joined by one space), ``n_words``, ``n_removed``, ``spans`` (start and end of each removed run of words,
    flat)."""
    _, size = volume(docs, text)
    blocks = pieces_of(size, BLOCK_BYTES)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    given = docs.select(
        F.pmod(F.xxhash64(doc, F.monotonically_increasing_id()), F.lit(blocks)).alias("block"),
        F.xxhash64(doc, text).alias("row_key"),
        F.coalesce(F.col(doc).cast("long"), F.lit(int(LAST))).alias("doc"),
        raw_text(text).alias("text"),
        F.struct(*others).alias("row"),
    )
    # One exchange of the texts serves the three passes over the blocks, as all read the same columns.
    given = given.repartition("block")
    anchors = given.groupBy("block").applyInArrow(_anchors(window, blocks), ANCHORS)
    shared = anchors.groupBy("bucket").applyInArrow(_repeated, "block long, few binary, many binary")
    segments = given.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_segments(window), SEGMENTS)
    dealt = segments.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(blocks)))
    removed = dealt.groupBy("shard").applyInArrow(_removals(window), REMOVED)
    schema = StructType([given.schema["row"]])
    for name, kind in (("text", StringType()), ("kept", StringType()), ("n_words", LongType()), ("n_removed", LongType())):
        schema.add(name, kind)
    schema.add("spans", ArrayType(LongType()))
    return given.groupBy("block").cogroup(removed.groupBy("block")).applyInArrow(_applied, schema)
