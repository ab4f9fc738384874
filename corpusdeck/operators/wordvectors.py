"""Vectors of the words of a shard of documents.

A shard's distinct words leave it in buckets, meet their vectors there, and the vectors of a bucket come back as one
row. Vectors that :func:`~corpusdeck.operators.embeddings.train_embeddings` gave travel as the whole numbers they come
from, in less than half of the bytes; others as they are. A word's vector goes once to a shard, so shards are large, and
their texts are gone through a slice at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdeck.operators.terms import (
    LEAST_SHARDS,
    SHARD_CHARS,
    by_shard,
    coded_words,
    free_memory,
    in_buckets,
    lines,
    squeezed,
    unsqueezed,
)

#: Characters of the texts of a shard whose vectors have 32 dimensions, about; shards at least; characters of a slice.
VECTOR_SHARD_CHARS = 20_000_000
LEAST_VECTOR_SHARDS = 24
SLICE_CHARS = 500_000


def vector_shard_count(chars: int | None, size: int) -> int:
    return max(LEAST_VECTOR_SHARDS, -(-(chars or 0) // max(VECTOR_SHARD_CHARS * 32 // size, SHARD_CHARS)))


def units(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of whole numbers at length one, and the squares of their lengths; squares are added one by one, so the same
    numbers give the same vector anywhere. A zero row stays."""
    vector = sums.astype(float)
    squares = np.zeros(len(sums))
    for j in range(sums.shape[1]):
        squares += vector[:, j] * vector[:, j]
    return np.divide(vector, np.sqrt(squares)[:, None], out=vector, where=squares[:, None] > 0), squares


def _cut(lengths: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Of the rows ``begin`` those at which slices of about ``SLICE_CHARS`` begin (with the end)."""
    before = np.cumsum(lengths) - lengths
    return np.append(begin[np.flatnonzero(np.diff(before[begin] // SLICE_CHARS, prepend=-1))], len(lengths))


def _lengths(joined: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(pc.binary_length(joined), 0).to_numpy().astype(np.int64)


def shard_vocabulary(table: pa.Table) -> pa.Array:
    """The distinct words of a shard in byte order."""
    cuts = _cut(_lengths(table["_words"]), np.arange(table.num_rows))
    found = [coded_words(table["_words"].slice(a, b - a))[0] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    words = pc.unique(pa.chunked_array(found, pa.string()))
    return words.take(pc.sort_indices(words))


def document_slices(table: pa.Table, doc: str) -> Iterator[pa.Table]:
    """The rows of a shard in slices, those of a document in one."""
    code = table[doc].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    order = np.argsort(code, kind="stable")
    cuts = _cut(_lengths(table["_words"])[order], np.flatnonzero(np.diff(code[order], prepend=-1)))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield table.take(pa.array(order[a:b]))


@dataclass
class Packing:
    """How the vectors of a shard are packed."""

    buckets: int
    size: int
    whole: bool

    def unpacked(self, table: pa.Table, own: pa.Table) -> ShardVectors:
        """Of the rows of a shard and of the vectors that came back to it."""
        vocab = shard_vocabulary(table)
        order, starts = in_buckets(vocab, self.buckets)
        known = np.zeros(len(vocab), bool)
        # Whole numbers are kept in four bytes as long as they fit, and become vectors a slice at a time.
        matrix = np.zeros((len(vocab), self.size), np.int32 if self.whole else float)
        for i in range(own.num_rows):
            bucket, found, data = (own[c][i].as_py() for c in ("_bucket", "found", "data"))
            run = order[starts[bucket] : starts[bucket + 1]]
            at = run[np.unpackbits(np.frombuffer(found, np.uint8), count=len(run)).astype(bool)]
            known[at] = True
            if self.whole:
                numbers = unsqueezed(data)
                numbers = (numbers >> 1) ^ -(numbers & 1)
                if matrix.dtype == np.int32 and np.abs(numbers).max(initial=0) >= 1 << 31:
                    matrix = matrix.astype(np.int64)
            else:
                numbers = np.frombuffer(data, "<f8")
            matrix[at] = numbers.reshape(len(at), self.size)
        free_memory()
        return ShardVectors(vocab, matrix, known)


@dataclass
class ShardVectors:
    """``matrix`` has vectors, or the whole numbers that they have the direction of."""

    vocab: pa.Array
    matrix: np.ndarray
    known: np.ndarray

    def rows(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of some of the shard's words, zero where there is none, and which have one."""
        at = pc.index_in(words, value_set=self.vocab).to_numpy()
        found = self.matrix[at]
        return units(found)[0] if found.dtype.kind == "i" else found, self.known[at]


def word_vectors_of_shards(words: DataFrame, vectors: DataFrame, shards: int, size: int) -> tuple[DataFrame, Packing]:
    """The vectors of the words of each shard, ``(_shard, _bucket, found, data)``, placed by shard, and how they are packed.

    ``words`` are those of :func:`~corpusdeck.operators.terms.sharded_words`; ``vectors`` has one row for a word. A
    column ``sums`` of whole numbers stands for the unit vector of their direction."""
    whole = "sums" in vectors.columns
    value = "sums" if whole else "vector"
    buckets = max(LEAST_SHARDS, shards)

    def listed(table: pa.Table) -> pa.Table:
        free_memory()
        vocab = shard_vocabulary(table)
        order, starts = in_buckets(vocab, buckets)
        columns = [
            np.arange(buckets, dtype=np.int32),
            np.full(buckets, table["_shard"][0].as_py(), np.int32),
            lines(vocab.take(pa.array(order)), starts),
        ]
        return pa.table(columns, names=["_bucket", "_shard", "words"]).filter(pa.array(np.diff(starts) > 0))

    asked = words.groupBy("_shard").applyInArrow(listed, "_bucket int, _shard int, words string").repartition(buckets, "_bucket")
    bucket = F.pmod(F.crc32("word"), F.lit(buckets)).cast("int").alias("_bucket")
    kind = "array<bigint>" if whole else "array<double>"
    held = vectors.filter("word is not null").select(bucket, "word", F.col(value).cast(kind).alias(value)).repartition(buckets, "_bucket")

    def sent(asked: pa.Table, held: pa.Table) -> pa.Table:
        free_memory()
        lists = pc.split_pattern(asked["words"].combine_chunks(), "\n")
        at = pc.fill_null(pc.index_in(pc.list_flatten(lists), value_set=held["word"].combine_chunks()), -1).to_numpy()
        starts = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
        matrix = pc.list_flatten(held[value].combine_chunks()).to_numpy(zero_copy_only=False).reshape(-1, size)
        found, data = [], []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            own = at[a:b]
            found.append(np.packbits(own >= 0).tobytes())
            numbers = matrix[own[own >= 0]].ravel()
            # The sign goes to the lowest bit, so small numbers stay short.
            data.append(squeezed((numbers << 1) ^ (numbers >> 63)) if whole else numbers.astype("<f8").tobytes())
        columns = [asked["_shard"], asked["_bucket"], pa.array(found, pa.binary()), pa.array(data, pa.binary())]
        return pa.table(columns, names=["_shard", "_bucket", "found", "data"])

    both = asked.groupBy("_bucket").cogroup(held.groupBy("_bucket"))
    return by_shard(both.applyInArrow(sent, "_shard int, _bucket int, found binary, data binary"), shards), Packing(buckets, size, whole)
