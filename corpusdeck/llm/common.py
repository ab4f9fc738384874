"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusdeck.session import scratch_root, stored

__all__ = ["scratch_root", "stored"]

#: Words a worker remembers between batches; beyond, words are worked out again.
CACHE_WORDS = 400_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def raw_text(text: str = "text") -> Column:
    """UTF-8 bytes of a text; a null text counts as an empty one."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def fold(doc: str, parts: int) -> Column:
    """``crc32(doc as text) mod parts``; null for a null id."""
    return F.crc32(F.col(doc).cast("string").cast("binary")) % parts


def volume(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of text of ``df``, by one aggregation."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def pieces_of(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


_MEMORY: dict[str, Any] = {}


def worker_memory(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker remembers from task to task, under one name at a time: workers live on through
    all stages of a job, and the next stage's memory takes the place of the last one's."""
    if name not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[name] = make()
    return _MEMORY[name]


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash; misses are worked out, and kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = got
        return got


def hashes_of(words: list[bytes]) -> np.ndarray:
    known = worker_memory("hashes", WordHashes)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a fixed bijection of multiply and shift steps)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive values of ``h``."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0x100000001B3 * 2 + 1)
        out ^= out >> np.uint64(33)
        out += h[k : len(h) - n + 1 + k]
    return mixed(out)


def in_batches(
    work: Callable[[pa.RecordBatch], pa.RecordBatch | None],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on each non-empty batch, for ``mapInArrow``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out

    return run


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """``(node, root)``: the smallest node reachable over ``edges (a, b)``, for every node in them.

    Each round takes the smallest label among a node and its neighbours, then follows the label's own
    label once, so that paths halve. Only aggregates and joins on single nodes: a node with very many
    edges is combined before the shuffle, and the planner splits its side of the join. Every round is
    written to the shared folder.
    """
    edges = edges.filter("a is not null and b is not null and a <> b")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, f"{name}-edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), f"{name}-labels")
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("seen"))
        best = labels.join(near, labels.node == near.a).select("node", "root", F.least("root", "seen").alias("low"))
        far = labels.select(F.col("node").alias("low"), F.col("root").alias("lower"))
        step = best.join(far, "low", "left").select(
            "node", F.least("low", F.coalesce("lower", "low")).alias("root"), F.col("root").alias("was")
        )
        step = stored(step, f"{name}-labels")
        labels = step.select("node", "root")
        if step.filter("root <> was").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
