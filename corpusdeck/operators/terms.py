"""Documents in shards whose terms are numbered, so that term figures travel as numbers.

A shard holds all rows of its documents, about ``SHARD_CHARS`` characters of text. Its terms are numbered in
their order as UTF-8 bytes, which depends on nothing but the shard's texts: a second pass over the same shard
finds the same numbers. Only a shard's distinct terms leave it, not a row for each document; they leave in
buckets, a row for each, and figures come back in the same order.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterable
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdeck.functions.text import drop_words, word_tokens

#: Characters of the texts of a shard, about; shards at least.
SHARD_CHARS = 8_000_000
LEAST_SHARDS = 48


def shard_count(chars: int | None) -> int:
    return max(LEAST_SHARDS, -(-(chars or 0) // SHARD_CHARS))


def bucket_count(shards: int) -> int:
    """A bucket holds about as many terms as the distinct terms of two shards."""
    return max(LEAST_SHARDS, -(-shards // 2))


def by_shard(df: DataFrame, shards: int) -> DataFrame:
    """Placed by ``_shard``. The number of partitions is given, so tasks are not merged by the size of texts that
    fan out, and tables placed like this are grouped together without another shuffle."""
    return df.repartition(shards, "_shard")


def sharded_words(df: DataFrame, shards: int, stops: Iterable[str], doc: str, text: str) -> DataFrame:
    """``(_shard, doc, _words)``: the lower-cased words of two or more characters without stop words, joined by a
    blank. They are found once and placed; every pass over the shards reads the same shuffle."""
    words = F.array_join(drop_words(word_tokens(F.lower(text), 2), stops), " ")
    return by_shard(df.select(F.pmod(F.xxhash64(doc), F.lit(shards)).cast("int").alias("_shard"), doc, words.alias("_words")), shards)


@dataclass
class ShardTerms:
    """``heads[j][t]`` is the number of word ``j`` of term ``t`` in ``vocab``, -1 after its last word. Document
    ``docs[owner[i]]`` has term ``term[i]`` ``tf[i]`` times, in the order of both; ``found[t]`` documents have term
    ``t``."""

    vocab: pa.Array
    heads: list[np.ndarray]
    docs: pa.Array
    owner: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    found: np.ndarray

    @property
    def size(self) -> int:
        return len(self.heads[0])

    def bucketed(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms in the order of buckets, which follow from all words of a term, and where each bucket begins
        (with the end)."""
        own = np.array([zlib.crc32(w.encode()) + 1 for w in self.vocab.to_pylist()] + [0], np.uint64)
        mixed = np.zeros(self.size, np.uint64)
        for head in self.heads:
            mixed = (mixed + own[head]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        bucket = (mixed % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        return np.argsort(bucket, kind="stable"), np.append(0, ends)

    def keywords(self, at: np.ndarray) -> pa.Array:
        """Terms as text, words joined by a blank."""
        out = self.vocab.take(pa.array(self.heads[0][at]))
        for head in self.heads[1:]:
            own = head[at]
            longer = pc.binary_join_element_wise(out, self.vocab.take(pa.array(np.maximum(own, 0))), " ")
            out = pc.if_else(pa.array(own >= 0), longer, out)
        return out


def packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """``values`` as unsigned 32-bit integers, a binary for each run that begins at ``starts`` (with the end)."""
    data, offsets = values.astype("<u4"), (4 * starts).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpacked(binaries: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(binaries.to_pylist()), "<u4")


def free_memory() -> None:
    """Gives memory that is free back to the system. A Python worker serves one stage after another, and keeps what the
    largest group of an earlier one took."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in few bytes: their lowest bytes, then the next ones, compressed."""
    values = np.ascontiguousarray(values, "<u8")
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + len(values).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if width else b"")


def unsqueezed(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    values = np.zeros((n, 8), np.uint8)
    if width:
        planes = pa.decompress(data[9:], width * n, codec="zstd", asbytes=True)
        values[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return values.view("<u8").ravel().astype(np.int64)


def in_buckets(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Words in the order of their buckets, and where each bucket begins (with the end). Spark's ``crc32`` gives the
    same buckets."""
    bucket = np.array([zlib.crc32(w.encode()) % buckets for w in words.to_pylist()], np.int64)
    return np.argsort(bucket, kind="stable"), np.append(0, np.cumsum(np.bincount(bucket, minlength=buckets)))


def lines(words: pa.Array, starts: np.ndarray) -> pa.Array:
    """The words of each run that begins at ``starts`` (with the end) as lines; no word has a line end."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words), "\n")


def coded_words(joined: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of rows of words joined by a blank the vocabulary in byte order, and each word's number and row."""
    joined = joined.combine_chunks()
    words = pc.split_pattern(pc.if_else(pc.equal(joined, ""), pa.scalar(None, joined.type), joined), " ")
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(words).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    number = place[coded.indices.to_numpy()]
    return coded.dictionary.take(pa.array(order)), number, np.repeat(np.arange(len(lengths)), lengths)


def flat_words(table: pa.Table, doc: str) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """Of rows ``(doc, _words)`` the vocabulary in byte order, each word's number and row, and each row's document
    as a number with the documents; a repeated or null id is one document."""
    docs = table[doc].combine_chunks().dictionary_encode(null_encoding="encode")
    return *coded_words(table["_words"]), docs


def shard_terms(table: pa.Table, n: int, doc: str) -> ShardTerms:
    """The 1..n-grams of the rows ``(doc, _words)`` of one shard."""
    vocab, number, row, docs = flat_words(table, doc)
    owners = docs.indices.to_numpy().astype(np.int64)
    columns, owner = [[] for _ in range(n)], []
    for k in range(1, n + 1):
        # Starts of the runs of k words that stay in one row.
        last = max(len(number) - (k - 1), 0)
        start = np.flatnonzero(row[:last] == row[k - 1 : k - 1 + last])
        for j in range(n):
            columns[j].append(number[start + j] if j < k else np.full(len(start), -1))
        owner.append(owners[row[start]])
    columns, owner = [np.concatenate(c) for c in columns], np.concatenate(owner)
    # A blank sorts before any character of a word: order by words is order by bytes.
    base = len(vocab) + 1
    codes = base**n
    if codes * max(len(docs.dictionary), 1) < 1 << 62:
        # Document and words are one number: what is sorted are plain numbers.
        code = columns[0] + 1
        for column in columns[1:]:
            code = code * base + column + 1
        pairs, tf = np.unique(owner * codes + code, return_counts=True)
        owner, code = np.divmod(pairs, codes)
        order = np.argsort(code)
        ordered = code[order]
        first = np.flatnonzero(np.diff(ordered, prepend=-1))
        rest, heads = ordered[first], []
        found = np.diff(np.append(first, len(ordered)))
        term = np.empty(len(code), np.int64)
        term[order] = np.repeat(np.arange(len(first)), found)
        for _ in range(n):
            rest, word = np.divmod(rest, base)
            heads.insert(0, word - 1)
        return ShardTerms(vocab, heads, docs.dictionary, owner, term, tf, found)
    known, first, term = np.unique(columns[0], return_index=True, return_inverse=True)
    for column in columns[1:]:
        known, first, term = np.unique(term * base + column + 1, return_index=True, return_inverse=True)
    pairs, tf = np.unique(owner * max(len(known), 1) + term, return_counts=True)
    owner, term = np.divmod(pairs, max(len(known), 1))
    return ShardTerms(vocab, [c[first] for c in columns], docs.dictionary, owner, term, tf, np.bincount(term, minlength=len(known)))


def best_rows(owner: np.ndarray, order: np.ndarray, top_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ``order``, sorted by owner first: where each owner's begin (with the end), and the rows and ranks of
    its first ``top_n``."""
    own = owner[order]
    starts = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))
    rank = np.arange(len(own)) - np.repeat(starts[:-1], np.diff(starts)) + 1
    kept = np.flatnonzero(rank <= top_n)
    return starts, kept, rank[kept]


def summed_rows(matrix: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of rows ``at`` of ``matrix``, a block at a time."""
    total = np.zeros(matrix.shape[1])
    for k in range(0, len(at), 4_096):
        total += matrix[at[k : k + 4_096]].sum(axis=0)
    return total
