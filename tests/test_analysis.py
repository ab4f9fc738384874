import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusdeck import defaults
from corpusdeck.functions.lexicon import Lexicon
from corpusdeck.operators import entities as en
from corpusdeck.operators import filters as fl
from corpusdeck.operators import keywords as kw
from corpusdeck.operators import nearest as nr
from corpusdeck.operators.facets import facet_map, facet_scores
from corpusdeck.operators.embeddings import train_embeddings
from corpusdeck.operators.patterns import keyword_documents, mine_patterns
from corpusdeck.operators.sentiment import chunk_rows, chunk_sentiment, polarity_scorer, roll_up_chunks
from corpusdeck.operators.skew import attach_by_key, lookup
from corpusdeck.operators.terms import in_buckets, sharded_words, squeezed
from corpusdeck.operators.wordvectors import word_vectors_of_shards
from corpusdeck.plans.analysis import AnalysisConfig, analyze_documents


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


# Lexicons


def test_default_gate_counts_the_repeated_entry_twice(spark):
    assert len(defaults.GATE) == 54 and len(set(defaults.GATE)) == 53
    gate = Lexicon.words(defaults.GATE)
    df = docs(spark, "A COLLECTION", "collection of silk prints", "nothing", "")
    scores = [r.s for r in df.select("doc_id", gate.score(F.col("text")).alias("s")).orderBy("doc_id").collect()]
    assert scores == [2, 3, 0, 0]
    assert [r.doc_id for r in fl.relevance_gate(df, gate).collect()] == [1]


def test_default_lexicon_sizes():
    assert sum(len(k) for o in defaults.FACETS.values() for k in o.values()) == 96
    assert sum(map(len, defaults.ACCESSORIES.values())) == 33
    assert sum(map(len, defaults.PATTERNS.values())) == 45


def test_substring_matching(spark):
    terms = Lexicon.words(["hat"])
    df = docs(spark, "THAT", "ha t")
    assert [r.m for r in df.select(terms.matches(F.col("text")).alias("m")).collect()] == [["hat"], []]


def test_lexicon_from_table_and_bound(spark):
    rows = [("f", "o2", "b", 2), ("f", "o1", "a", 1)]
    lex = Lexicon.from_df(spark.createDataFrame(rows, "facet string, option string, keyword string, ord int"))
    assert lex.keywords == ["a", "b"] and lex.groups == ("f",)
    with pytest.raises(ValueError):
        Lexicon.words(str(i) for i in range(6_000))


def test_sentence_filter_keeps_leading_blanks(spark):
    got = docs(spark, "One dress. two. Three SHIRT").select(
        fl.sentence_filter(F.col("text"), Lexicon.words(defaults.SENTENCE)).alias("o")
    )
    assert got.first().o == "One dress.  Three SHIRT"


# Facets and patterns


def test_facets_drop_absent_options_but_keep_facets(spark):
    lex = Lexicon.facets({"a": {"x": ["one", "two"], "y": ["zzz"]}, "b": {"z": ["qqq"]}})
    df = docs(spark, "ONE and two", "nothing", "")
    row = facet_map(df, lex).orderBy("doc_id").collect()
    assert row[0].facets["a"]["x"].asDict() == {"score": 2, "confidence": 1.0, "mentions": ["one", "two"]}
    assert "y" not in row[0].facets["a"] and row[0].facets["b"] == {}
    assert row[1].facets == row[2].facets == {"a": {}, "b": {}}
    long = [(r.doc_id, r.facet, r.option, r.score) for r in facet_scores(df, lex).collect()]
    assert long == [(0, "a", "x", 2)]


def test_mine_patterns_keeps_empty_categories(spark):
    lex = Lexicon.categories({"c": ["silk", "cotton"], "empty": ["zzz"]})
    got = {r.category: r.keywords for r in mine_patterns(docs(spark, "Silk", "more COTTON silk"), lex).collect()}
    assert got == {"c": ["cotton", "silk"], "empty": []}
    none = {r.category: r.keywords for r in mine_patterns(docs(spark, "x").limit(0), lex).collect()}
    assert none == {"c": [], "empty": []}
    counts = {r.keyword: r.documents for r in keyword_documents(docs(spark, "Silk silk", "silk"), lex).collect()}
    assert counts == {"silk": 2, "cotton": 0, "zzz": 0}


# Sentiment


def scored(spark, *chunks):
    return spark.createDataFrame([(1, l, s) for l, s in chunks], "doc_id int, label string, score double")


def test_sentiment_tie_goes_to_positive(spark):
    s = roll_up_chunks(scored(spark, ("POSITIVE", 0.5), ("NEGATIVE", 0.5))).first().sentiment
    assert (s.overall_sentiment, s.confidence, s.error) == ("POSITIVE", 0.25, None)


def test_sentiment_confidence_is_over_all_chunks_and_case_folds(spark):
    s = roll_up_chunks(scored(spark, ("negative", 0.9), ("neutral", 0.3), ("NEGATIVE", 0.6))).first().sentiment
    assert s.overall_sentiment == "NEGATIVE" and s.confidence == pytest.approx(0.5)
    assert s.detailed_scores == pytest.approx({"POSITIVE": 0.0, "NEGATIVE": 1.5, "NEUTRAL": 0.3})


def test_unknown_label_or_missing_text_is_an_error(spark):
    s = roll_up_chunks(scored(spark, ("HAPPY", 0.5))).first().sentiment
    assert s.overall_sentiment is None and s.error
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    got = {r.doc_id: r.sentiment for r in chunk_sentiment(df, polarity_scorer(["a"], ["b"])).collect()}
    assert got[1].error and got[2].overall_sentiment == "NEUTRAL" and got[2].confidence == 0.5


def test_both_sentiment_forms_agree(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["good", "bad", "x", "y"]) for _ in range(rng.randint(0, 400))) for _ in range(40)]
    df = docs(spark, *texts)
    scorer = polarity_scorer(["good"], ["bad"])
    local = chunk_sentiment(df, scorer, model="m").select("doc_id", "sentiment")
    rows = chunk_rows(df).withColumn("_s", F.element_at(scorer(F.array("chunk")), 1)).select("doc_id", "_s.*")
    assert sorted(local.collect()) == sorted(roll_up_chunks(rows.repartition(5), model="m").collect())


# Keywords


def brute_keywords(texts, top_n):
    import re

    grams = []
    for t in texts:
        w = re.findall(r"\w{2,}", t.lower())
        grams.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    df = Counter(g for c in grams for g in c)
    out = []
    for i, c in enumerate(grams):
        weights = {g: n * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in c.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        for rank, (g, w) in enumerate(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:top_n], 1):
            out.append((i, rank, g, round(w / norm, 9)))
    return out


def test_keywords_against_brute_force(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "éta", "x1"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(50)]
    got = kw.keyword_extract(docs(spark, *texts), (), 5)
    rows = sorted((r.doc_id, r.rank, r.keyword, round(r.score, 9)) for r in got.collect())
    assert rows == brute_keywords(texts, 5)


def test_keyword_shards_send_terms_and_no_documents(spark):
    rng = random.Random(11)
    words = ["alpha", "Beta", "be", "éta", "x1", "日本"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(40)] + [None, ""]
    rows = [(None if i % 20 == 7 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = {}
    for i, t in rows:
        found = (t or "").lower().split()
        for g in found + [f"{a} {b}" for a, b in zip(found, found[1:])]:
            own.setdefault(i, Counter())[g] += 1
    spread = Counter(g for c in own.values() for g in c)
    want = set()
    for i, c in own.items():
        weights = {g: tf * (math.log((1 + len(rows)) / (1 + spread[g])) + 1) for g, tf in c.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        best = sorted(weights.items(), key=lambda x: (-round(x[1], 12), x[0].encode()))[:6]
        want |= {(i, rank, g, round(w / norm, 9)) for rank, (g, w) in enumerate(best, 1)}
    got = kw.keyword_extract(df, (), 6)
    assert {(r.doc_id, r.rank, r.keyword, round(r.score, 9)) for r in got.collect()} == want
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", got._jdf.queryExecution().executedPlan().toString())
    assert keys and not any("doc_id" in k for k in keys), keys


def test_stop_words_go_before_bigrams(spark):
    got = kw.ngram_candidates(docs(spark, "silk of the Moon a x"), ["of", "the"]).first().candidates
    assert got == ["silk", "moon", "silk moon"]


def test_attach_by_key_salts_hot_keys_and_loses_nothing(spark):
    facts = spark.range(3_000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k")
    )
    weights = facts.groupBy("k").agg(F.count("*").alias("n"))
    joined = attach_by_key(facts, weights, "k", "n", F.col("id"), floor=50)
    assert joined.count() == 3_000 and joined.select("id").distinct().count() == 3_000
    assert {r.n for r in joined.filter("k = 'hot'").select("n").distinct().collect()} == {1_000}


def test_lookup_beyond_the_bound_gives_the_same_rows(spark):
    facts = spark.range(1_000).select("id", (F.col("id") % 50).cast("string").alias("k"))
    table = spark.range(0, 40).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v"))
    small = lookup(facts, table, "k", F.col("id"))
    large = lookup(facts, table, "k", F.col("id"), max_rows=5)
    assert sorted(small.select("id", "k", "v").collect()) == sorted(large.select("id", "k", "v").collect())


def vectors(spark, n=200, d=8, seed=3):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d)).round(1)
    m[10:20] = m[0]
    return m, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")


def brute_topk(m, queries, k):
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)
    sims = np.round(unit @ unit.T, 9)
    return [(q, rank, int(v)) for q in queries for rank, v in enumerate(np.lexsort((np.arange(len(m)), -sims[q]))[:k], 1)]


def test_cosine_topk_against_brute_force(spark):
    m, df = vectors(spark)
    m = m.astype("float32").astype("float64")
    queries = df.filter("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    for few in (7, 6):
        got = nr.cosine_topk(queries, df.repartition(5), 6, few=few)
        assert sorted((r.query_id, r.rank, r.vec_id) for r in got.collect()) == brute_topk(m, range(7), 6)


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_cells_leave_out_only_items_that_cannot_be_found(spark, monkeypatch, spread):
    monkeypatch.setattr(nr, "QUERIES", 9)
    rng = np.random.default_rng(5)
    m = (rng.normal(size=(12, 6))[rng.integers(0, 12, 400)] + spread * rng.normal(size=(400, 6))).astype("float32")
    m[:150] = m[0]  # one vector holds a third of all rows
    m[150:153] = 0
    rows = [(i, v.tolist(), "x") for i, v in enumerate(m)] + [(999, None, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell string").repartition(4)
    index = nr.cosine_cells(df, cells=30, block=11)
    assert index.total == 400
    queries = df.filter("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    best, tally = nr.nearest_in_cells(queries, index, 5)
    want = brute_topk(m.astype("float64"), range(0, 400, 3), 5)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in best.collect()) == want
    scored = {r.query_id: r.scored for r in tally.collect()}
    assert set(scored) == set(range(0, 400, 3)) and all(5 <= n <= 400 for n in scored.values())
    if spread < 1:
        assert sum(scored.values()) < 0.6 * 400 * len(scored)


def test_groups_of_queries_meet_spans_of_blocks(spark, monkeypatch):
    for name, value in (("SPAN", 60), ("GROUP", 16), ("PARTS", 3)):
        monkeypatch.setattr(nr, name, value)
    rng = np.random.default_rng(6)
    m = rng.normal(size=(300, 6)).astype("float32")
    # Rows of one id are an item each, and a query each.
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(7, m[7].tolist()), (8, m[9].tolist()), (999, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    best, _ = nr.nearest_in_cells(df.withColumnRenamed("vec_id", "query_id"), nr.cosine_cells(df, cells=20, block=11), 5)
    plan = best._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert any(k.startswith("span") for k in keys) and not any(k.startswith("block") for k in keys), keys
    ids = np.array([i for i, v in rows if v])
    unit = nr.unit_rows(np.array([v for _, v in rows if v], dtype="float64"))
    sims = np.round(unit @ unit.T, 9)
    want = []
    for q in np.unique(ids):
        pairs = sorted((-s, int(i)) for row in sims[ids == q] for s, i in zip(row, ids))[:5]
        want += [(int(q), rank, i) for rank, (_, i) in enumerate(pairs, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in best.collect()) == sorted(want)


def test_cells_of_odd_tables(spark):
    _, df = vectors(spark, n=3)
    queries = df.withColumnRenamed("vec_id", "query_id")
    assert nr.nearest_in_cells(queries, nr.cosine_cells(df.limit(0)), 5)[0].count() == 0
    assert nr.nearest_in_cells(queries.limit(0), nr.cosine_cells(df), 5)[0].count() == 0
    assert nr.nearest_in_cells(queries, nr.cosine_cells(df), 5)[0].count() == 9
    zeros = df.selectExpr("vec_id", "transform(embedding, x -> float(0)) as embedding")
    got = nr.nearest_in_cells(queries, nr.cosine_cells(zeros), 2)[0].collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == [(q, v, 0.0) for q in range(3) for v in range(2)]
    assert nr.cosine_topk(queries.limit(0), df, 5).count() == 0


def test_mmr_first_choice_is_best_and_diversity_zero_keeps_the_order(spark):
    m, df = vectors(spark)
    queries = df.filter("vec_id < 3").withColumnRenamed("vec_id", "query_id")
    ranked = nr.cosine_topk(queries, df, 20)
    plain = kw.keyword_mmr(ranked, df, top_n=10, diversity=0.0)
    best = sorted((r.query_id, r.rank, r.vec_id) for r in ranked.filter("rank <= 10").collect())
    assert sorted((r.query_id, r.rank, r.vec_id) for r in plain.collect()) == best
    mixed = kw.keyword_mmr(ranked, df, top_n=10, diversity=0.7).collect()
    assert len({(r.query_id, r.vec_id) for r in mixed}) == 30
    assert {(r.query_id, r.vec_id) for r in mixed if r.rank == 1} == {(q, v) for q, k, v in best if k == 1}


def test_vector_keywords_against_brute_force(spark):
    rng = random.Random(6)
    words = ["silk", "wool", "moon", "sun", "tide"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 15))) for _ in range(20)]
    df = docs(spark, *texts)
    vectors = train_embeddings(df, size=6, min_count=1)
    vec = {r.word: np.array(r.vector) for r in vectors.collect()}
    got = {(r.doc_id, r.keyword): r.score for r in kw.keyword_extract_by_vectors(df, vectors, 6, top_n=1_000).collect()}
    want = {}
    for i, t in enumerate(texts):
        w = t.split()
        whole = np.mean([vec[x] for x in w], axis=0)
        for g in set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}:
            v = np.mean([vec[x] for x in g.split()], axis=0)
            want[i, g] = whole @ v / np.linalg.norm(whole) / np.linalg.norm(v)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)
    short = kw.keyword_extract_by_vectors(df, vectors, 6, top_n=4)
    diverse = kw.keyword_mmr(short, top_n=2, query_id="doc_id", item_id="keyword")
    assert diverse.groupBy("doc_id").count().filter("count > 2").count() == 0


def test_vector_keywords_send_a_word_once_for_a_shard(spark):
    rows = [(i // 2, "silk wool moon " * 4 + f"w{i}") for i in range(40)] + [(None, "silk"), (50, None), (51, "unheard of")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([("silk", [1.0, 0.0]), ("wool", [0.0, 1.0]), ("moon", [0.6, 0.8])], "word string, vector array<double>")
    got = kw.keyword_extract_by_vectors(df, known, 2, top_n=3)
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", got._jdf.queryExecution().executedPlan().toString())
    assert keys and not any("doc_id" in k for k in keys), keys
    found = {(r.doc_id, r.rank): (r.keyword, round(r.score, 6), r.embedding) for r in got.collect()}
    # Rows of a repeated id are one document; words without a vector count as zero.
    assert {i for i, _ in found} == {None, *range(20), 51}
    assert found[None, 1] == ("silk", 1.0, [1.0, 0.0]) and found[51, 1] == ("unheard", 0.0, [0.0, 0.0])
    # The document is (1.6, 1.8), the nearest candidate silk and wool, (1, 1).
    assert found[0, 1][0] == "silk wool" and found[0, 1][1] == pytest.approx(3.4 / (1.6**2 + 1.8**2) ** 0.5 / 2**0.5, abs=1e-6)


def test_vectors_go_to_few_shards_in_few_bytes(spark):
    rng = random.Random(5)
    df = docs(spark, *[" ".join(f"w{rng.randrange(2_000)}" for _ in range(300)) for _ in range(400)]).cache()
    vectors = train_embeddings(df, size=32, min_count=1)
    placed, packing = word_vectors_of_shards(sharded_words(df, 24, [], "doc_id", "text"), vectors, 24, 32)
    rows = placed.collect()
    assert len({r._shard for r in rows}) == 24
    words = sum(int(np.unpackbits(np.frombuffer(r.found, np.uint8)).sum()) for r in rows)
    assert sum(len(r.data) for r in rows) < 0.6 * 8 * 32 * words
    # A shard's own vectors come back, bit by bit.
    known = {r.word: r.vector for r in vectors.collect()}
    own = [" ".join(sorted({x for x in known if zlib.crc32(x.encode()) % 3})), None, "", "unknown " + next(iter(known))]
    table = pa.table({"doc_id": [1, 2, 3, 4], "_words": own})
    listed = sorted({x for t in own if t for x in t.split()})
    order, starts = in_buckets(pa.array(listed), packing.buckets)
    back = {"_bucket": [], "found": [], "data": []}
    for b in range(packing.buckets):
        run = [listed[i] for i in order[starts[b] : starts[b + 1]]]
        sums = {r.word: r.sums for r in vectors.filter(F.col("word").isin(run)).collect()} if b < 2 else {}
        numbers = np.array([sums[x] for x in run if x in sums], np.int64).ravel()
        back["_bucket"].append(b)
        back["found"].append(np.packbits(np.array([x in sums for x in run], bool)).tobytes())
        back["data"].append(squeezed((numbers << 1) ^ (numbers >> 63)))
    got = packing.unpacked(table, pa.table(back))
    for x, v, there in zip(got.vocab.to_pylist(), got.rows(got.vocab)[0].tolist(), got.known.tolist(), strict=True):
        assert (x, v) == (x, known[x] if there else [0.0] * 32)
    assert 0 < got.known.sum() < len(known)


def test_documents_in_slices_rank_as_in_one(spark, monkeypatch):
    from corpusdeck.operators import wordvectors

    rows = [(i % 30 if i % 7 else None, f"w{i % 5} w{i % 11} moon w{i}") for i in range(200)] + [(5, None), (6, "")]
    table = pa.table({"doc_id": [i for i, _ in rows], "_words": [t for _, t in rows]})
    monkeypatch.setattr(wordvectors, "SLICE_CHARS", 100)
    slices = list(wordvectors.document_slices(table, "doc_id"))
    assert len(slices) > 10
    of = [(i, k) for k, part in enumerate(slices) for i in part["doc_id"].to_pylist()]
    assert len(set(of)) == len({i for i, _ in of}) and len(of) == len(rows)
    assert wordvectors.shard_vocabulary(table).to_pylist() == sorted({w for _, t in rows if t for w in t.split()})


def test_rows_that_are_together_are_chosen_where_they_are(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["silk", "wool", "moon", "sun", "tide", "road"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    df = spark.createDataFrame([(i % 50 if i else None, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    vectors = train_embeddings(df, size=6, min_count=1)
    ranked = kw.keyword_extract_by_vectors(df, vectors, 6, top_n=12)
    own = {"top_n": 6, "diversity": 0.6, "query_id": "doc_id", "item_id": "keyword"}
    there = kw.keyword_mmr(ranked, together=True, **own)
    plans = [x._jdf.queryExecution().executedPlan().toString().count("Exchange") for x in (ranked, there)]
    assert plans[0] == plans[1] > 0
    got, want = (sorted(map(repr, x.collect())) for x in (there, kw.keyword_mmr(ranked, **own)))
    assert got == want and len(got) > 200
    with pytest.raises(ValueError):
        kw.keyword_mmr(ranked, vectors, together=True, **own)


def test_many_orders_are_those_of_each():
    rng = np.random.default_rng(2)
    unit = kw.unit_rows(rng.normal(size=(30 * 8, 4)).round(1)).reshape(30, 8, 4)
    relevance = -np.sort(-rng.random((30, 8)).round(1), axis=1)
    similarity = unit @ unit.transpose(0, 2, 1)
    for top_n in (1, 5, 20):
        got = kw.mmr_orders(similarity, relevance, top_n, 0.7)
        assert got.tolist() == [kw.mmr_order(s, r, top_n, 0.7) for s, r in zip(similarity, relevance)]


# Entities


def dictionary(spark, *rows):
    return spark.createDataFrame([(p, l, s) for p, l, s in rows], "phrase string, label string, score double")


def test_phrases_at_their_anchors(spark, monkeypatch):
    rng = random.Random(8)
    words = ["the", "THE", "of", "silk", "É", "road", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", "the " * 3_000 + "silk road"]
    phrases = ["the", "the of", "of the of", "silk road", "road silk é", "é é", "x x x x", "none here", "the silk"]
    names = dictionary(spark, *[(p, p.upper(), len(p) / 10) for p in phrases], ("", "EMPTY", 0.5), (None, "NULL", 0.5))
    df = docs(spark, *texts).repartition(3).withColumn("words", F.lit("clash"))
    want = set()
    for i, t in enumerate(texts):
        own = (t or "").split()
        for at in range(len(own)):
            for n in range(1, 5):
                span = own[at : at + n]
                if len(span) == n and " ".join(span).lower() in phrases:
                    p = " ".join(span).lower()
                    want.add((i, at, n, " ".join(span), p.upper(), len(p) / 10))

    def rows():
        return [tuple(r) for r in en.model_entities(df, names).select("doc_id", "start", "words", "text", "label", "score").collect()]

    small = rows()
    assert set(small) == want and len(small) == len(want)
    listed = {r.doc_id: r.entities for r in en.document_entities(df, names, Lexicon.categories({}), Lexicon.facets({})).collect()}
    monkeypatch.setattr(en, "SMALL", 3)
    assert en.small_dictionary(names) is None
    assert sorted(rows()) == sorted(small)
    assert {r.doc_id: r.entities for r in en.document_entities(df, names, Lexicon.categories({}), Lexicon.facets({})).collect()} == listed
    assert len(listed) == len(texts) and listed[60] == []
    assert en.model_entities(df, names.limit(0)).count() == 0 and en.model_entities(df.limit(0), names).count() == 0


def test_words_are_gone_through_once_for_all_shapes(spark):
    given = [("a b", 0), ("b a", 1), ("c", 0), ("d a b", 1), ("a x b", 2)]
    phrases = [en.Phrase(tuple(p.split(" ")), "L", 1.0, anchor) for p, anchor in given]
    texts = ["A b a, c C d a B", "b", "a", "a x b b", "d a", "", None, "x b a b", "c"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = df.select("i", en.phrase_hits("text", phrases).alias("h"))
    plan = re.sub(r"#\d+", "", found._jdf.queryExecution().analyzed().toString())
    assert plan.count("transform(lambda low,") == 1, plan

    def brute(text):
        own = re.findall(r"\w+", text)
        spans = [(k, n, " ".join(own[k : k + n]), "L", 1.0) for k in range(len(own)) for n in (1, 2, 3) if k + n <= len(own)]
        return [s for s in spans if s[2].lower() in dict(given)]

    got = {r.i: r.h for r in found.collect()}
    assert {i: None if h is None else [tuple(x) for x in h] for i, h in got.items()} == {i: None if t is None else brute(t) for i, t in enumerate(texts)}


def test_entities_order_categories_and_rollup(spark):
    patterns = Lexicon.categories({"materials": ["silk"], "none": ["zzz"]})
    facets = Lexicon.facets({"season": {"winter": ["snow"]}})
    names = dictionary(spark, ("silk road", "LOC", 0.9), ("snow", "MISC", 0.8), ("ann lee", "PER", 0.7))
    df = docs(spark, "Ann Lee on the Silk Road in Snow", "nothing")
    listed = en.document_entities(df, names, patterns, facets)
    rows = {r.doc_id: r for r in en.entity_rollup(listed).collect()}
    got = [(e.text, e.label, e.category, e.source) for e in rows[0].entities]
    assert got == [
        ("Ann Lee", "PER", "per", "model"),
        ("Silk Road", "LOC", "fashion_materials", "model"),
        ("Snow", "MISC", "season_winter", "model"),
        ("Silk", "FASHION", "fashion_materials", "pattern_matching"),
    ]
    assert (rows[0].total_entities, rows[0].related_entities) == (4, 4)
    assert [e.text for e in rows[0].categories["fashion_materials"]] == ["Silk Road", "Silk"]
    assert rows[1].entities == [] and rows[1].total_entities == 0


def test_strict_categories(spark):
    df = spark.createDataFrame([("Ann", "PER")], "text string, label string")
    none = Lexicon.words([])
    plain = en.with_categories(df, none, none).first()
    strict = en.with_categories(df, none, none, strict=True).first()
    assert (plain.category, plain.is_related) == ("per", True)
    assert (strict.category, strict.is_related) == ("other", False)


def test_analysis_row_per_document(spark):
    cfg = AnalysisConfig(polarity_scorer(["good"], ["bad"]), dictionary(spark, ("silk", "M", 0.5)))
    df = docs(spark, "good Silk dress in summer", "", "x").withColumn("source", F.lit("f.pdf"))
    rows = {r.doc_id: r for r in analyze_documents(df, cfg).collect()}
    assert set(rows) == {0, 1, 2}
    assert rows[0].sentiment.overall_sentiment == "POSITIVE" and rows[0].total_keywords == 7
    assert {e.category for e in rows[0].entities} == {"fashion_materials", "fashion_garments"}
    assert rows[0].facets["season"]["summer"].mentions == ["summer"]
    assert rows[1].keywords == [] and rows[1].entities == []


def test_terms_leave_their_shard_in_buckets(spark, monkeypatch):
    from corpusdeck.operators import terms

    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)] + ["größe", "日本", "ünder"]
    rows = [(i // 2, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(80)] + [(None, "w1 w2"), (90, None), (91, "of a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = kw.keyword_extract(df, ("of",), 4)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    many = sorted(got.collect(), key=str)
    monkeypatch.setattr(terms, "LEAST_SHARDS", 1)
    for chars in (50, 1_000_000):
        monkeypatch.setattr(terms, "SHARD_CHARS", chars)
        assert sorted(kw.keyword_extract(df, ("of",), 4).collect(), key=str) == many
    assert {r.doc_id for r in many} == {i for i, t in rows if t and t != "of a"}


@pytest.mark.parametrize("n", [1, 2, 18])
def test_terms_are_counted_where_their_words_fit_no_number(n):
    import pyarrow as pa

    from corpusdeck.operators.terms import shard_terms

    texts = ["b a b a b a", "", None, "c a", "a b c d e f g h i j k l m n o p q r s t", "b a b"]
    ids = [1, 2, 3, None, 5, 1]
    own = shard_terms(pa.table({"_words": pa.array(texts), "d": pa.array(ids)}), n, "d")
    want = Counter()
    for i, text in zip(ids, texts):
        ws = (text or "").split()
        want.update((i, " ".join(ws[a : a + k])) for k in range(1, n + 1) for a in range(len(ws) - k + 1))
    names = own.keywords(np.arange(own.size)).to_pylist()
    docs = own.docs.to_pylist()
    assert names == sorted(names) == sorted({g for _, g in want})
    assert {(docs[o], names[t]): c for o, t, c in zip(own.owner, own.term, own.tf)} == want
    assert own.found.tolist() == [sum(g == name for _, g in want) for name in names]
