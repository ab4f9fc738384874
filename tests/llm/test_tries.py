import hashlib
import random
import zlib

import numpy as np
import pytest
from corpusdeck.llm import tries
from corpusdeck.llm.queries import QUERIES


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    name = {p: min(m) for p, m in nodes.items()}
    kids = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, m in nodes.items():
        cost = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += cost
    rows = []
    for p, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        rows.append((name[p], len(p), name[p[:-1]] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def made(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def trie(spark, rows, most=tries.MOST):
    turns, convs = tries.rebuilt(tries.turns_of(made(spark, rows)))
    return tries.prefix_trie(turns, convs, most)


def test_query_as_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op12_centroid_prefix_trie"](spark, sf)) == brute(rebuilt(rows))


def test_large_components_are_split_by_joins(spark):
    rnd = random.Random(4)
    rows = []
    for c in range(60):
        n = 70 if c == 7 else rnd.randrange(1, 7)
        rows += [(c, t, rnd.choice("ab"), rnd.choice(["x", "yé", ""])) for t in range(n)]
    want = brute(rebuilt(rows))
    assert len(want) > 100
    for most in (4, 40):
        assert rows_of(trie(spark, rows, most)) == want


def test_a_long_conversation_shared_by_many(spark):
    rows = [(5 * c, t, "u", f"turn {t}") for c in range(40) for t in range(30)] + [(1, 0, "u", "else")]
    assert rows_of(trie(spark, rows, 5)) == brute(rebuilt(rows))


def test_odd_rows(spark):
    rows = [
        (None, 1, "a", "b"), (0, None, "a", "first"), (0, 1, None, None), (0, 1, "", ""), (0, 2, "a", "b"), (0, 2, "a", "b"), (0, None, "z", "null too"),
        (3, 0, "a", "b"), (11, 0, "no base", "x"), (11, 1, "no base", "y"), (-3, 0, "neg", "x"), (1, 1, "a", "é" * 50_000), (1, 1, "a", "é" * 50_000),
    ]
    # In SQL -3 % 5 is -3, and -3 - -3 is 0.
    own = rebuilt([r for r in rows if r[0] != -3])
    h = zlib.crc32(b"-3") % 9
    base = rebuilt([(0, *r[1:]) for r in rows if r[0] == 0])[0]
    own[-3] = base[:h] + [("neg", "x")][h:]
    frame = made(spark, rows).selectExpr("*", "'x' as depth", "1 as part", "2 as node")
    turns, convs = tries.rebuilt(tries.turns_of(frame))
    assert rows_of(tries.prefix_trie(turns, convs)) == brute(own)
    turns, convs = tries.rebuilt(tries.turns_of(made(spark, [])))
    assert tries.prefix_trie(turns, convs).count() == 0


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums_over_ranges(spark, uncoalesced):
    rnd = random.Random(3)
    rows = [(7 if k % 3 else rnd.randrange(9), k, rnd.randrange(2**32)) for k in range(3_000)]
    frame = spark.createDataFrame(rows, "g long, k long, v long").repartition(3)
    from pyspark.sql import functions as F

    got = tries.running(frame, "g", [F.col("k")], ["v"], "test").collect()
    want, count, total = {}, {}, {}
    for g, k, v in sorted(rows):
        count[g], total[g] = count.get(g, 0) + 1, total.get(g, 0) + v
        want[g, k] = (count[g], total[g])
    assert {(r["g"], r["k"]): (r["at"], r["v"]) for r in got} == want


def test_members_of_one_node_in_many_ranges(spark, uncoalesced, monkeypatch):
    monkeypatch.setattr(tries, "IDS", 7)
    ends = spark.createDataFrame([(c % 2 * 3, c % 2, 10 * c) for c in range(500)], "node long, depth long, conv_id long")
    got = {(r["node"], r["depth"]): r["ends_sha256"] for r in tries.member_digests(ends).collect()}
    want = {(3 * k, k): hashlib.sha256(",".join(str(10 * c) for c in range(500) if c % 2 == k).encode()).hexdigest() for k in (0, 1)}
    assert got == want


@pytest.mark.parametrize("shape", ["random", "chain", "star", "forest", "one"])
def test_forest_totals(shape):
    rnd = random.Random(len(shape))
    n = 1 if shape == "one" else 400
    up = {"random": lambda k: rnd.randrange(k), "chain": lambda k: k - 1, "star": lambda k: 0, "forest": lambda k: rnd.randrange(max(0, k - 5), k) if k % 7 else -1, "one": None}
    parent = np.array([-1] + [up[shape](k) for k in range(1, n)])
    names = np.array(rnd.sample(range(n), n))  # the order of nodes says nothing of their depth
    moved = np.empty(n, np.int64)
    moved[names] = np.where(parent >= 0, names[parent], -1)
    depth = np.zeros(n, np.int64)
    for k in range(n):
        at = moved[k]
        while at >= 0:
            depth[k] += 1
            at = moved[at]
    values = np.array([[rnd.randrange(100), 1] for _ in range(n)])
    want = values.copy()
    for k in range(n):
        at = moved[k]
        while at >= 0:
            want[at] += values[k]
            at = moved[at]
    assert (tries.forest_totals(moved, depth, values) == want).all()
