import pytest
from corpusdeck.llm import decontamination


@pytest.mark.parametrize("gone,leaks", [(1, True), (9, True), (13, False)])
def test_document_shorter_than_its_item(spark, gone, leaks):
    """Of 55 shingles 55 - gone are left; 0.8 of 55 are 44."""
    words = [f"v{k}" for k in range(59)]
    docs = spark.createDataFrame([(1, " ".join(words[:-gone])), (2, "v0 v1 v2"), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words)), (8, "v0 v1 v2 v3")], "item_id long, text string")
    found = [tuple(r) for r in decontamination.find_leaks(docs, items).collect()]
    assert found == ([(1, 7, (55 - gone) / 55, 0, 59 - gone)] if leaks else []) + ([(1, 8, 1.0, 0, 4)])
    assert {r["doc_id"] for r in decontamination.keep_clean(docs, items).collect()} == {2, 3}
