from corpusdeck.llm import fixity
from corpusdeck.llm.queries import ORACLES, QUERIES
from corpusdeck.session import scratch_path
from oracle_check import compare, connect
from pyspark.sql import functions as F


def test_query_equals_sql(spark):
    said = compare(spark, connect("0.1"), "0.1", QUERIES["op1_merkle_fixity"], ORACLES["op1_merkle_fixity"])
    assert said.startswith("ok"), said


def store_of(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset int")
    target = scratch_path(spark, "test-archives")
    fixity.write_archives(pages, target)
    return spark.read.schema(fixity.STORE).parquet(target)


ROWS = [(k, f"u{k}", "text " * (k % 50), 1) for k in range(400)] + [(7, "u7", "same", 1)] * 3 + [(None, None, None, None), (500, "u", "x" * 300_000, 0)]


def test_records_lie_end_to_end(spark, monkeypatch):
    monkeypatch.setattr(fixity, "ARCHIVE_BYTES", 20_000)
    store = store_of(spark, ROWS).collect()
    at = {}
    for r in sorted(store, key=lambda r: (r["archive"], r["offset"])):
        assert r["offset"] == at.get(r["archive"], 0) and len(r["record"]) == r["length"]
        at[r["archive"]] = r["offset"] + r["length"]
    assert len(store) == len(ROWS) and len(at) > 3


def test_audit_finds_each_difference(spark):
    store = store_of(spark, ROWS)
    first = fixity.tree(store, "a")
    assert fixity.audit(first, fixity.tree(store, "same")).count() == 0
    spoilt = fixity.damaged(store, F.col("page_id") == 31, F.col("page_id") == 9)
    found = fixity.audit(first, fixity.tree(spoilt, "b")).select("page_id", "status").collect()
    assert sorted(map(tuple, found)) == [(9, "missing"), (31, "altered")]
    back = fixity.audit(fixity.tree(spoilt, "b"), first).select("page_id", "status").collect()
    assert sorted(map(tuple, back)) == [(9, "extra"), (31, "altered")]


def test_lost_archive_and_empty_table(spark):
    store = store_of(spark, ROWS)
    whole, none = fixity.tree(store, "a"), fixity.tree(store.limit(0), "b")
    assert {r["status"] for r in fixity.audit(whole, none).collect()} == {"missing"}
    assert fixity.audit(whole, none).count() == len(ROWS)
    empty = store_of(spark, ROWS).limit(0)
    assert fixity.audit(fixity.tree(empty, "a"), fixity.tree(empty, "b")).count() == 0
