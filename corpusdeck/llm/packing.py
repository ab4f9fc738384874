"""Bounded-space online packing of token ids into sequences.

Every partition keeps a fixed number of open windows. A piece of a document goes into the window that it
fills best; where none has room, the fullest window is topped up with a cut of the piece and emitted.
Documents longer than a window are cut at its length first. The windows still open at the end of the
partitions are merged, best fit first, many partitions at a time.

A null text is empty: such a document has the end id only. Null ids and repeated rows are packed like
others. An empty table gives an empty table. Other columns are left out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdeck.llm.common import raw_text, stored
from corpusdeck.llm.tokens import encoder

LENGTH = 2048
#: Open windows of a partition, ids below which a piece is not cut to top a window up, partitions
#: whose leftovers are merged together.
OPEN = 64
LEAST_CUT = 8
MERGED = 128


class Windows:
    """The open windows of a partition; ``place`` gives ``(window, offset)`` for each part of a piece."""

    def __init__(self, length: int = LENGTH, open_: int = OPEN) -> None:
        self.length, self.limit = length, open_
        self.fills: list[tuple[int, int]] = []  # (ids in it, window), in order
        self.count = 0
        self.closed: list[int] = []

    def _put(self, at: int, size: int) -> tuple[int, int]:
        fill, window = self.fills.pop(at)
        if fill + size < self.length:
            insort(self.fills, (fill + size, window))
        else:
            self.closed.append(window)
        return window, fill

    def place(self, size: int) -> list[tuple[int, int, int]]:
        """``(window, offset, ids)`` in the order of the piece's ids."""
        out = []
        while size:
            room = bisect_left(self.fills, (self.length - size + 1, -1))
            if room:
                window, offset = self._put(room - 1, size)
                return [*out, (window, offset, size)]
            if len(self.fills) < self.limit:
                insort(self.fills, (0, self.count))
                self.count += 1
                continue
            gap = self.length - self.fills[-1][0]
            if gap >= LEAST_CUT and size - gap >= LEAST_CUT:
                window, offset = self._put(len(self.fills) - 1, gap)
                out.append((window, offset, gap))
                size -= gap
            else:
                self.closed.append(self.fills.pop()[1])
        return out


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, window long, offset long, ids binary"
)


def _packed(kind: str, path: str, end: int, with_ids: bool):
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, windows = TaskContext.get().partitionId(), Windows()
        encode = encoder(kind, path).encode
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids += tail
                total, at = len(ids) // 4, 0
                while at < total:
                    for window, offset, size in windows.place(min(LENGTH, total - at)):
                        own = ids[4 * at : 4 * (at + size)]
                        rows.append((doc, at, size, zlib.crc32(own), total, part, window, offset, own if with_ids else None))
                        at += size
            if rows:
                kinds = [pa.int64()] * 8 + [pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def _merge(group: pa.Table) -> pa.Table:
    """Leftover windows of some partitions into as few as best fit needs, largest first."""
    rows = sorted(zip(*(group.column(n).to_pylist() for n in ("fill", "part", "window")), strict=True), reverse=True)
    bins: list[tuple[int, int]] = []
    first: list[tuple[int, int]] = []
    out = []
    for fill, part, window in rows:
        room = bisect_left(bins, (LENGTH - fill + 1, -1))
        used, number = bins.pop(room - 1) if room else (0, len(first))
        if number == len(first):
            first.append((part, window))
        insort(bins, (used + fill, number))
        out.append((part, window, *first[number], used))
    names = ("part", "window", "into_part", "into_window", "base")
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)})


def pack(
    docs: DataFrame, path: str, kind: str = "blank_free", end: int = 1, doc: str = "doc_id", text: str = "text", with_ids: bool = True
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids`` (little-
    endian unsigned 32-bit integers, null unless ``with_ids``). ``sequence_id`` is unique, ``offset`` is
    gapless from 0 in each sequence; what is missing to ``LENGTH`` is padding."""
    given = docs.select(F.col(doc).cast("long").alias("doc_id"), raw_text(text).alias("text"))
    pieces = stored(given.mapInArrow(_packed(kind, path, end, with_ids), PIECES), "packed")
    fills = pieces.groupBy("part", "window").agg(F.sum("length").alias("fill"))
    left = fills.filter(F.col("fill") < LENGTH).withColumn("group", F.floor(F.col("part") / MERGED))
    merged = left.groupBy("group").applyInArrow(
        _merge, "part long, window long, into_part long, into_window long, base long"
    )
    placed = pieces.join(merged, ["part", "window"], "left")
    sequence = F.shiftleft(F.coalesce("into_part", "part"), 32) + F.coalesce("into_window", "window")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        sequence.alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"), "ids",
    )
