"""Nearest neighbours by collision counting over query-centred windows.

Vectors lie in shards of bounded size. A shard keeps each of ``PROJECTIONS`` random projections as one
sorted array. A query's window on an array is centred on its own projection; virtual rehashing widens all
windows together, as if all buckets of a larger radius were joined, and only what is new in a window is
counted. Vectors that collide with the query in more than ``THRESHOLD`` of the arrays are verified by
their exact distance. A search ends when the k-th best verified distance is no more than the radius: any
vector nearer than that collides in an array with probability 0.82, so that it passes the threshold
almost surely.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows with a
null id. Vectors of another length than the query are not compared with it. A row with the query's id is
the query's own. Repeated rows of other ids count each; a repeated query row is one query. Ties go to
smaller ids. An empty table gives an empty table. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusdeck.session import scratch_path

PROJECTIONS = 40
THRESHOLD = 26
#: Window width in radii, and what a radius grows by.
WIDTH, GROWTH = 2.719, 1.25
SHARD = 8192
#: Queries that are broadcast at once, and values in them.
QUERIES, VALUES = 4096, 4_000_000


def usable(vector: str) -> Column:
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & whole & F.exists(v, lambda x: x != 0)


class Shard:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        rng = np.random.default_rng(3)
        self.lines = rng.normal(size=(vectors.shape[1], PROJECTIONS))
        places = vectors @ self.lines
        self.order = np.ascontiguousarray(np.argsort(places, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(places.T, self.order, axis=1)
        # The first radius lies well below the distances between some of the vectors.
        some = vectors[rng.integers(0, len(vectors), 64)] - vectors[rng.integers(0, len(vectors), 64)]
        spread = np.sqrt((some**2).sum(axis=1))
        self.least = max(float(np.median(spread)) / 20, float(np.abs(places).max()) * 1e-9, 1e-300)

    def nearest(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``k`` nearest found, nearest first, ties to smaller ids."""
        n, radius = len(self.ids), self.least
        centre = query @ self.lines
        counts = np.zeros(n, np.int16)
        seen = self.ids == own
        low = np.array([np.searchsorted(s, c) for s, c in zip(self.sorted, centre, strict=True)])
        high = low.copy()
        found, dist = np.zeros(0, np.int64), np.zeros(0)
        while True:
            half = WIDTH * radius / 2
            fresh = []
            for j in range(PROJECTIONS):
                a = np.searchsorted(self.sorted[j, : low[j]], centre[j] - half)
                b = high[j] + np.searchsorted(self.sorted[j, high[j] :], centre[j] + half, "right")
                fresh += [self.order[j, a : low[j]], self.order[j, high[j] : b]]
                low[j], high[j] = a, b
            counts += np.bincount(np.concatenate(fresh), minlength=n).astype(np.int16)
            new = np.flatnonzero((counts > THRESHOLD) & ~seen)
            if len(new):
                seen[new] = True
                found = np.concatenate([found, new])
                dist = np.concatenate([dist, np.sqrt(((self.vectors[new] - query) ** 2).sum(axis=1))])
            if len(dist) >= k and np.partition(dist, k - 1)[k - 1] <= radius or seen.all():
                break
            radius *= GROWTH
        best = np.lexsort((self.ids[found], dist))[:k]
        return self.ids[found[best]], dist[best]


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a batch, by length."""
    ids = batch.column(0).to_numpy()
    lists = batch.column(1)
    sizes = lists.value_lengths().to_numpy()
    values = lists.flatten().to_numpy().astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield ids[at], values[starts[at][:, None] + np.arange(size)]


FOUND = "query_id long, vec_id long, score double"


def _search(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, v in sent.value:
            asked.setdefault(len(v), []).append((i, np.array(v)))
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def search(size: int) -> None:
            ids, rows = (np.concatenate(x) for x in zip(*held.pop(size), strict=True))
            for at in range(0, len(ids), SHARD):
                shard = Shard(ids[at : at + SHARD], rows[at : at + SHARD])
                for number, (own, query) in enumerate(asked[size]):
                    got = shard.nearest(own, query, k)
                    if (old := best.get((size, number))) is not None:
                        got = tuple(np.concatenate(x) for x in zip(old, got, strict=True))
                        keep = np.lexsort(got)[:k]
                        got = (got[0][keep], got[1][keep])
                    best[size, number] = got

        for batch in batches:
            for ids, rows in _vectors(batch) if batch.num_rows else ():
                if (size := rows.shape[1]) in asked:
                    held.setdefault(size, []).append((ids, rows))
                    if sum(len(i) for i, _ in held[size]) >= SHARD:
                        search(size)
        for size in list(held):
            search(size)
        if best:
            names = [np.full(len(got[0]), asked[size][number][0]) for (size, number), got in best.items()]
            columns = [names, [g[0] for g in best.values()], [g[1] for g in best.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, FOUND)


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 10, vec: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each query row the ``k`` nearest of all other rows.

    Queries go out in blocks of bounded size, each searched in every shard; a partition sends ``k`` rows
    of each query on, whatever number of shards it holds."""
    spark = vectors.sparkSession
    given = vectors.filter(F.col(vec).isNotNull() & usable(vector))
    pairs = given.select(F.col(vec).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    asked = given.filter(is_query).select(F.col(vec).cast("long"), F.col(vector).cast("array<double>")).distinct()
    path, block, values, none = scratch_path(spark, "neighbours"), [], 0, True

    def send() -> None:
        _search(pairs, block, k).write.mode("append").parquet(path)

    for row in asked.toLocalIterator():
        block.append((row[0], row[1]))
        values += len(row[1])
        if len(block) >= QUERIES or values >= VALUES:
            send()
            block, values, none = [], 0, False
    if block or none:
        send()
    found = spark.read.schema(FOUND).parquet(path)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
