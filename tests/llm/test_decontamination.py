import re
from collections import Counter

import numpy as np
from corpusdeck.llm import decontamination
from corpusdeck.llm.queries import QUERIES


def grams(words):
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def brute(docs, items, least=0.8):
    out = {}
    split = [(i, re.findall(r"\w+", t.lower())) for i, t in items if t]
    for d, text in docs:
        words = re.findall(r"\w+", (text or "").lower())
        have = set(grams(words))
        for i, own in split:
            want = grams(own)
            if len(own) >= 5 and not have & set(want):
                continue
            for k in range(len(words) - len(own) + 1):
                a = grams(words[k : k + len(own)])
                s = (a & want).total() / (a | want).total()
                if s >= least and s > out.get((d, i), (0,))[0]:
                    out[d, i] = (s, k, len(own))
    return sorted((d, i, *v) for (d, i), v in out.items())


def test_query_is_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(docs, items)
    assert want and sorted(map(tuple, QUERIES["op9_simhash_windows"](spark, sf).collect())) == want


def planted():
    rng = np.random.default_rng(4)
    vocabulary = [f"v{k}" for k in range(900)]
    items = [(k, " ".join(rng.choice(vocabulary, int(rng.integers(2, 70))))) for k in range(80)]
    docs = []
    for k, (_, text) in enumerate(items):
        words = text.split()
        kind = k % 4
        if kind == 1:
            words = [w.upper() + "!" for w in words]
        elif kind == 2 and len(words) > 12:
            words[0] = words[-1] = "edge"
        elif kind == 3:
            words[len(words) // 2] = "middle"
        around = rng.choice(vocabulary, 200).tolist()
        docs.append((k, " ".join(around[:90] + words + around[90:])))
    return docs, items


def test_edited_passages(spark):
    docs, items = planted()
    found = decontamination.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    want = brute(docs, items)
    assert len(want) > 60 and sorted(map(tuple, found.collect())) == want


def test_passes_of_bounded_size(spark, monkeypatch):
    docs, items = planted()
    monkeypatch.setattr(decontamination, "ITEMS", 30)
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    items_df = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert sorted(map(tuple, decontamination.find_leaks(docs_df, items_df).collect())) == want
    kept = decontamination.keep_clean(docs_df, items_df)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {w[0] for w in want}


def test_odd_rows(spark, odd, none):
    base = next(r["text"] for r in odd.collect() if r["doc_id"] == 1)
    items = spark.createDataFrame([(1, base, "x"), (1, base, "x"), (2, None, None), (None, "one two", None), (3, "", "x")], "item_id long, text string, lang string")
    got = decontamination.find_leaks(odd, items).collect()
    assert sorted(str((r["doc_id"], r["item_id"])) for r in got) == sorted(
        map(str, [(d, 1) for d in (1, 2, 2, None, 8, 9)] * 2 + [(6, None), (7, None)])
    )
    kept = decontamination.keep_clean(odd, items)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "5", "8", "None"]
    assert decontamination.find_leaks(none, items).count() == 0
    assert decontamination.find_leaks(odd, items.limit(0)).count() == 0
    assert decontamination.keep_clean(odd, items.limit(0)).count() == odd.count()


def test_probes_guarantee_the_radius():
    rng = np.random.default_rng(5)
    items = decontamination.Items([(k, " ".join(map(str, rng.integers(0, 500, 30)))) for k in range(50)], 0.8)
    for k in range(50):
        bits = sum(1 << int(b) for b in rng.choice(64, decontamination.RADIUS, replace=False))
        assert k in items.candidates((int(items.prints[k]) ^ bits).to_bytes(8, "little"), 30)
