import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from corpusdeck.llm import simhash
from corpusdeck.llm.queries import QUERIES


def fingerprint(text, size=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or [" ".join(words)] * bool(words)
    bits = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if bits[b] * 2 > len(grams))


def brute(rows):
    prints = np.array([fingerprint(t) for _, t in rows], np.uint64)
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[k]) <= 2):
            a, b = find(k), find(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        root = find(k)
        if doc is not None:
            least[root] = min(least.get(root, doc), doc)
    return sorted(((d, f"{int(prints[k]):016x}", least.get(find(k))) for k, (d, _) in enumerate(rows)), key=repr)


def test_query_is_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op6_simhash_bk_trees"](spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == brute([tuple(r) for r in docs])


@pytest.mark.parametrize("tree_size", [simhash.TREE_SIZE, 2])
def test_odd_rows(spark, odd, tree_size, monkeypatch):
    """Also with routes that have to be split: no link is lost."""
    monkeypatch.setattr(simhash.linked, "__defaults__", ("simhash", tree_size))
    got = simhash.near_duplicates(odd, simhash.Routes.pigeonhole(2), 3).collect()
    want = brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert sorted(((r["doc_id"], f"{r['node'] % 2**64:016x}", r["component_id"]) for r in got), key=repr) == want


def test_empty_table(none):
    assert simhash.near_duplicates(none, simhash.Routes.pigeonhole(2), 3).count() == 0


def test_pigeonhole_masks_meet():
    rng = np.random.default_rng(0)
    routes = simhash.Routes.pigeonhole(2)
    a = rng.integers(0, 2**63, 2000, np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (2, 2000)).astype(np.uint64)
    b = a ^ flips[0] ^ flips[1]
    assert np.any([(a ^ b) & m == 0 for m in routes.masks[:, 0]], axis=0).all()


def test_forest_finds_all_within_radius():
    rng = np.random.default_rng(1)
    words = np.unique(rng.integers(0, 2**12, 400, np.uint64)).reshape(-1, 1)
    group = rng.integers(0, 3, len(words))
    a, b = simhash.Forest(words, group).near(np.arange(len(words)), 2)
    want = {
        (i, j)
        for i in range(len(words))
        for j in range(len(words))
        if i != j and group[i] == group[j] and int(words[i, 0] ^ words[j, 0]).bit_count() <= 2
    }
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_wide_fingerprints_link_similar_texts(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"v{k}" for k in range(3000)]
    rows, same = [], {}
    for k in range(40):
        words = rng.choice(vocabulary, 300).tolist()
        rows.append((3 * k, " ".join(words)))
        for c in (1, 2):
            near = list(words)
            for at in rng.choice(300, 3, replace=False):
                near[at] = "changed"
            rows.append((3 * k + c, " ".join(near)))
            same[3 * k + c] = 3 * k
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    routes = simhash.Routes.sampled(256, 38, 32, 20)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, routes, 5).collect()}
    assert sum(got[d] == s for d, s in same.items()) >= 0.95 * len(same)
    assert all(got[3 * k] == 3 * k for k in range(40))
    kept = simhash.keep_first(docs, routes, 5)
    assert kept.columns == docs.columns and {3 * k for k in range(40)} <= {r["doc_id"] for r in kept.collect()}


def test_keep_first_keeps_columns_and_one_row(odd):
    kept = simhash.keep_first(odd, simhash.Routes.sampled(256, 38, 32, 20), 5)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 6, 8, 8]
