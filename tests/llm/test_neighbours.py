import numpy as np
from corpusdeck.llm import neighbours
from corpusdeck.llm.queries import QUERIES
from pyspark.sql import functions as F


def brute(ids, vectors, asked, k=10):
    out = {}
    for i in asked:
        q = vectors[np.flatnonzero(ids == i)[0]]
        d = np.sqrt(((vectors - q) ** 2).sum(axis=1))
        d[ids == i] = np.inf
        best = [b for b in np.lexsort((ids, d))[:k] if np.isfinite(d[b])]
        out[i] = [(int(ids[b]), float(d[b])) for b in best]
    return out


def ranked(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


def test_query_recall(spark):
    folder = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, vectors = np.array([r["vec_id"] for r in table]), np.array([r["embedding"] for r in table], float)
    want = brute(ids, vectors, ids[ids % 100 == 0].tolist())
    got = ranked(QUERIES["op2_collision_counting_neighbours"](spark, folder).collect())
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
    exact = {(q, i): s for q, w in want.items() for i, s in w}
    assert all(abs(s - exact[q, i]) < 1e-12 for q, g in got.items() for i, s in g if (q, i) in exact)


def test_scattered_vectors_in_small_shards(spark, monkeypatch):
    """Points without clusters are the hard case."""
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    rng = np.random.default_rng(1)
    ids, vectors = np.arange(3000), rng.normal(size=(3000, 24))
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    got = ranked(neighbours.nearest_neighbours(table, F.col("vec_id") % 100 == 0).collect())
    assert recall(got, brute(ids, vectors, ids[ids % 100 == 0].tolist())) >= 0.95


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 1.0], None), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1),
            (6, None, 1), (7, [], 1), (8, [1.0, None], 1), (None, [1.0, 2.0], 1), (9, [1.0, 1.0, 1.0], 1), (10, [5.0, 5.0], 1), (10, [5.0, 5.0], 1), (100, [0.0, 0.0], 1), (200, [1.0, 1.0, 0.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = ranked(neighbours.nearest_neighbours(table, F.col("vec_id") % 100 == 0).collect())
    far = float(np.sqrt(41.0))
    assert got == {0: [(1, 1.0), (2, 1.0), (10, far), (10, far)], 200: [(9, 1.0)]}
    assert neighbours.nearest_neighbours(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_many_ties_go_to_smaller_ids(spark):
    rows = [(k, [1.0, 2.0] if k else [1.0, 2.5]) for k in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = ranked(neighbours.nearest_neighbours(table, F.col("vec_id") == 0).collect())
    assert got == {0: [(k, 0.5) for k in range(1, 11)]}
