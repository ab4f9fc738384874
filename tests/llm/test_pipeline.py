import corpus_pipeline
from corpusdeck.llm import decontamination
from corpusdeck.llm.common import components, stored
from corpusdeck.llm.queries import QUERIES


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "decontamination", "packing"]


def test_every_stage_takes_effect(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").filter("toxic = 1").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").filter("toxic = 0").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), "test-pipeline")
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert after.keys() <= before.keys()
        gone = before.keys() - after.keys()
        if name == "toxicity":
            assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone & clean) <= 0.03 * len(clean)
        elif name == "simhash_near_dedup":
            assert gone and {before[d] for d in gone if list(before.values()).count(before[d]) > 1} <= set(after.values())
            assert len(set(after.values())) == len(after)
        elif name == "substring_dedup":
            cut = {d for d in after if after[d] != before[d]}
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect() if r["doc_id"] in cut)
        else:
            leaks = decontamination.find_leaks(spark.createDataFrame(list(before.items()), "doc_id long, text string"), spark.read.parquet(f"{folder}/benchmark.parquet"))
            assert gone == {r["doc_id"] for r in leaks.collect()} and gone
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(before)


def test_repeated_passage_is_cut(spark):
    passage = " ".join(f"p{k}" for k in range(55))
    rows = [(1, f"one  two {passage}", "en", "s", 10), (2, f"three {passage} four", "en", "s", 20), (3, passage, None, None, 3), (4, "", "en", "s", 0), (5, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert got == {1: (f"one  two {passage}", 10), 2: ("three four", 10), 4: ("", 0), 5: ("", None)}


def test_pipeline_query_runs(spark, sf):
    assert QUERIES["pipeline"](spark, sf).count() > 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 90), (90, 150)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 90: 90, 150: 90, 200: 90}
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0
