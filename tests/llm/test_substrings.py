import hashlib
import re

import numpy as np
import pytest
from corpusdeck.llm import substrings
from corpusdeck.llm.queries import ORACLES, QUERIES
from oracle_check import compare, connect


def brute(rows, window):
    first, last = {}, 2**63 - 1
    split = [(last if d is None else d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for (d, w), (doc, _) in zip(split, rows, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < d:
                gone.update(range(k, k + window))
        out.append((doc, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def test_query_equals_sql(spark):
    said = compare(spark, connect("0.001"), "0.001", QUERIES["op10_fm_index_substrings"], ORACLES["op10_fm_index_substrings"])
    assert said.startswith("ok"), said


def test_query_is_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, n, r, hashlib.sha256(k.encode()).hexdigest()) for d, n, r, k in brute(docs, 13)]
    got = QUERIES["op10_fm_index_substrings"](spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("block_bytes,crowd", [(substrings.BLOCK_BYTES, substrings.CROWD), (3000, 1), (3000, 0)])
@pytest.mark.parametrize("window", [13, 3, 1])
def test_odd_rows(odd, block_bytes, crowd, window, monkeypatch):
    """In one block and in many, with anchors sent whole and by windows."""
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block_bytes)
    docs = odd.filter("text is null or length(text) < 10000")
    got = substrings.dedup_substrings(docs, window).select("row.doc_id", "n_words", "n_removed", "kept").collect()
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], window)
    assert sorted(map(tuple, got), key=repr) == want


def test_long_text_and_columns(odd):
    got = substrings.dedup_substrings(odd)
    assert got.select("row.*").columns == [c for c in odd.columns if c != "text"]
    assert {r["n_words"] for r in got.filter("row.doc_id = 8").collect()} == {40_060, 4}


def test_empty_table(none):
    assert substrings.dedup_substrings(none).count() == 0


def test_index_finds_every_pattern():
    rng = np.random.default_rng(0)
    symbols = np.append(rng.integers(1, 4, 500), 0)
    index = substrings.FMIndex(symbols, 4)
    at = np.array([k for k in range(497) if 0 not in symbols[k : k + 4]])
    low, high = index.intervals(symbols, at, 4)
    for k, a, b in zip(at, low, high, strict=True):
        places = {j for j in range(498) if np.array_equal(symbols[j : j + 4], symbols[k : k + 4])}
        assert {*index.suffix[a:b].tolist()} == places or b - a == 1 and k in index.suffix[a:b]


def test_wavelet_rank():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 11, 300)
    matrix = substrings.WaveletMatrix(symbols, 11)
    c, at = rng.integers(0, 11, 200), rng.integers(0, 301, 200)
    assert matrix.rank(c, at).tolist() == [int((symbols[:a] == x).sum()) for x, a in zip(c, at, strict=True)]
