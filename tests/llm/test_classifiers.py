import zlib

import numpy as np
import pytest
from corpusdeck.llm import quality, subwords, toxicity
from corpusdeck.llm.queries import QUERIES

SMALL = subwords.Settings(buckets=1 << 14, rows=200, epochs=8, lower=True)


def held_out(doc, parts, held):
    return zlib.crc32(str(doc).encode()) % parts == held


@pytest.mark.parametrize(
    "name,label,parts,held,least", [("op4_subword_quality", "quality", 5, 0, 0.97), ("op8_subword_toxicity", "toxic", 4, 2, 0.95)]
)
def test_held_out_accuracy(spark, name, label, parts, held, least):
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES[name](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()
    assert len(got) == len(docs)
    for r in got.values():
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == held_out(r["doc_id"], parts, held)
    labels = [(r["doc_id"], r[label]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    own = [(got[d]["predicted"], v) for d, v in labels if d in got and got[d]["held_out"] and v is not None]
    assert sum(p == v for p, v in own) / len(own) >= least


def test_misspellings_share_grams():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aeioulmnrst"), 6)) for _ in range(300)]
    texts, labels = [], []
    for k in range(300):
        text = rng.choice(words, 60).tolist()
        if k % 2:
            text[rng.integers(60)] = "dreadfulness"
        texts.append(" ".join(text).encode())
        labels.append(k % 2)
    model = toxicity.train(texts, np.array(labels), SMALL)
    known = subwords.WordMargins(model.margins(), SMALL)

    def score(text):
        margins = toxicity.window_margins(*subwords.parts_of(known, subwords.tokens(text.encode())))
        return subwords.sigmoid(margins.max() + model.offset())

    clean = " ".join(rng.choice(words, 4000))
    assert score(clean) < 0.3
    assert score(clean + " dreadfullness " + clean) > 0.3


def test_windows_cover_all_words():
    for n in range(1, 60):
        covered = np.zeros(n, bool)
        for a in toxicity.window_starts(n):
            covered[a : a + toxicity.WIDTH] = True
        assert covered.all()


def test_whole_sums_are_those_of_features():
    rng = np.random.default_rng(0)
    margins = rng.normal(size=SMALL.buckets).astype(np.float32)
    known = subwords.WordMargins(margins, SMALL)
    for word in ("a", "straße", "x" * 5000, "Aé漢😀" * 9000, "b" * 17_000):
        got, count = subwords.parts_of(known, [b"a", word.encode(), b"a"])
        own = subwords.features(word.encode(), SMALL)
        assert count[1] == len(own) and abs(got[1] - margins[own].sum(dtype=np.float64)) < 1e-3
        assert got[0] == got[2]


def test_a_word_of_millions_of_characters(monkeypatch):
    monkeypatch.setattr(subwords, "BLOCK", 1 << 16)
    known = subwords.WordMargins(np.full(SMALL.buckets, 0.001, np.float32), SMALL)
    word = b"QUJD" * 1_500_000
    got, count = subwords.parts_of(known, [word])
    assert count[0] == 1 + sum(len(word) + 2 - n + 1 for n in (3, 4, 5))
    assert abs(got[0] / count[0] - 0.001) < 1e-6 and not known


def plain_words(text):
    words = text.encode().split()
    return ["=" if k and w == words[k - 1] else w.decode() for k, w in enumerate(words)]


def plain_margins(text, margins, s):
    """Margin and number of the features of each word, one n-gram at a time."""
    out = []
    for w in plain_words(text):
        marked = f"<{w.lower() if s.lower else w}>"
        grams = [marked] + [marked[k : k + n] for n in (3, 4, 5) for k in range(len(marked) - n + 1)]
        out.append((sum(float(margins[zlib.crc32(g.encode()) % s.buckets]) for g in grams), len(grams)))
    return out


def plain_quality(sums):
    return sum(m for m, _ in sums) / max(1, sum(n for _, n in sums))


def plain_toxicity(sums):
    last = max(0, len(sums) - 6)
    windows = [sums[a : a + 6] for a in [*range(0, last, 2), last]]
    return max(sum(m for m, _ in w) / max(1, sum(n for _, n in w)) for w in windows) if sums else 0.0


@pytest.mark.parametrize("module,score,plain", [(quality, quality.score_quality, plain_quality), (toxicity, toxicity.score_toxicity, plain_toxicity)])
def test_every_score_is_that_of_plain_python(spark, monkeypatch, module, score, plain):
    """All texts of the small tables, and one with a word beyond the size kept whole."""
    folder, kept = "/root/testdata/sf0.001", []
    own = module.train
    monkeypatch.setattr(module, "train", lambda *a: kept.append(own(*a)) or kept[-1])
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**9, "plain words " + "aGk9é" * 5000 + " and more")], docs.schema))
    got = {r["doc_id"]: r["score"] for r in score(docs, spark.read.parquet(f"{folder}/labels.parquet"), settings=SMALL).collect()}
    margins, offset = kept[0].margins(), kept[0].offset()
    assert np.abs(margins).max() > 0
    for r in docs.collect():
        want = 1 / (1 + np.exp(-(plain(plain_margins(r["text"] or "", margins, SMALL)) + offset)))
        assert abs(got[r["doc_id"]] - want) < 1e-3


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_odd_rows(spark, odd, none, score):
    labels = spark.createDataFrame(
        [(1, 1, "z"), (2, 1, None), (6, 0, "z"), (7, 0, "z"), (None, 1, None), (3, None, "z"), (8, 7, "z"), (9, 0, "z")],
        "doc_id long, label int, text string",
    )
    got = score(odd, labels, label="label", settings=SMALL).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd.collect())
    assert all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4, 5)}) == 1
    assert len({r["score"] for r in got if r["doc_id"] == 2}) == 1
    assert score(none, labels, label="label", settings=SMALL).count() == 0
    unlearned = score(odd, labels.limit(0), label="label", settings=SMALL).collect()
    assert {r["score"] for r in unlearned} == {0.5}


def test_keep_clean_keeps_rows_and_columns(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    kept = toxicity.keep_clean(odd, labels, settings=SMALL, threshold=0.6)
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
