import json

import pytest
from pyspark.sql import functions as F

from corpusdeck.sources import files, pages, patterns, records, runs

def as_of():
    return F.lit("2024-06-30 12:00:00").cast("timestamp")



def test_scan_files_any_case_without_content(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x" * 1536)
    (tmp_path / "B.PDF").write_bytes(b"x")
    (tmp_path / "c.txt").write_text("x")
    found = files.scan_files(spark, str(tmp_path))
    assert sorted((r.name, r.size_kb) for r in found.collect()) == [("B.PDF", 0.0), ("a.pdf", 1.5)]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()


def test_pages_in_order_with_fallback(spark):
    first = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, ""), (2, 1, ""), (2, 2, "")], "doc_id int, page_no int, text string")
    other = spark.createDataFrame([(2, 1, "x"), (2, 2, "")], "doc_id int, page_no int, text string")
    plain = {r.doc_id: r.text for r in pages.assemble_pages(first).collect()}
    both = {r.doc_id: r.text for r in pages.assemble_pages(first, other).collect()}
    assert plain == {1: "a\nb\n", 2: ""} and both == {1: "a\nb\n", 2: "x\n\n"}


def test_page_metadata_defaults(spark):
    rows = [("d", 2, "Second", None), ("d", 1, "", "Ann"), ("e", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, page_no int, title string, author string")
    got = {r.doc_id: tuple(r)[1:] for r in pages.page_metadata(df, as_of()).collect()}
    assert got == {"d": ("Second", "Ann", 2, "2024-06-30"), "e": ("Unknown", "Unknown", 0, "2024-06-30")}


def test_list_store_skips_what_is_not_a_list(spark, tmp_path):
    record = {"type": "sentiment", "text": "t", "sentiment": "POSITIVE", "confidence": 0.5, "source_file": "f"}
    (tmp_path / "training_data_1.json").write_text(json.dumps([record, {"type": "entity", "text": "e"}], indent=2))
    (tmp_path / "training_data_2.json").write_text(json.dumps(record))
    (tmp_path / "training_data_3.json").write_text('[{"type": "sent')
    (tmp_path / "other.json").write_text(json.dumps([record]))
    got = records.read_training(spark, str(tmp_path), layout="list")
    assert sorted((r.type, r.text) for r in got.collect()) == [("entity", "e"), ("sentiment", "t")]
    stats = records.training_stats(got).first()
    assert tuple(stats) == (2, 1, 1, 2)
    assert tuple(records.training_stats(got.limit(0)).first()) == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        records.read_training(spark, str(tmp_path), layout="x")


def test_line_store_appends_and_takes_empty_batches(spark, tmp_path):
    batch = spark.createDataFrame(
        [("sentiment", "té", "POSITIVE", 0.5, None, None, "f", "2024")], records.RECORD
    )
    path = str(tmp_path / "store")
    records.write_training(batch, path)
    records.write_training(batch.limit(0), path)
    records.write_training(batch, path)
    got = records.read_training(spark, path).select(*batch.columns).collect()
    assert got == batch.collect() * 2


def test_patterns_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", ["y", "x"]), ("a", [])], "category string, keywords array<string>")
    patterns.write_patterns(df, str(tmp_path / "p"))
    back = patterns.read_patterns(spark, str(tmp_path / "p"))
    assert {r.category: r.keywords for r in back.collect()} == {"b": ["y", "x"], "a": []}
    assert json.loads(patterns.patterns_json(back).first().patterns) == {"a": [], "b": ["y", "x"]}


def test_latest_run(spark, tmp_path):
    path = str(tmp_path / "runs")
    info = spark.createDataFrame([(15, 3)], "samples int, epochs int")
    for stamp, model in (("2024-06-30 00:00:00", "new"), ("2024-01-01 00:00:00", "old")):
        runs.append_run(runs.run_record(info, {"sentiment": model}, F.lit(stamp).cast("timestamp")), path)
    row = runs.latest_run(spark, path).first()
    assert (row.artifacts, row.samples, row.version) == ({"sentiment": "new"}, 15, "2.0")


def test_list_layout_keeps_every_record(spark, tmp_path, monkeypatch):
    """Lists over several files, with quotes, line breaks, nulls and equal rows, come back as they were."""
    monkeypatch.setattr(records, "LIST_ROWS", 7)
    rows = [("sentiment", f'a "{k % 20}",\n[b] {{c}}', 0.5 if k % 3 else None) for k in range(40)]
    given = spark.createDataFrame(rows, "type string, text string, confidence double")
    target = str(tmp_path / "store")
    records.write_training(given, target, layout="list")
    got = records.read_training(spark, target, "part", "list", ".txt").select("type", "text", "confidence")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, given.collect()))
    empty = str(tmp_path / "empty")
    records.write_training(given.limit(0), empty, layout="list")
    assert records.read_training(spark, empty, "part", "list", ".txt").count() == 0


def test_list_layout_odd_files(spark, tmp_path):
    def file(name, text):
        (tmp_path / f"{name}.json").write_text(text)

    file("training_data_1", ' \n [{"type": "entity", "text": "kept", "confidence": "high"}]')
    file("training_data_2", '{"type": "entity", "text": "alone", "x": [1, 2]}')
    file("training_data_3", '[{"type": "entity", "text": "cut"}, {')
    file("training_data_4", "[]")
    file("training_data_5", "")
    file("training_data_6", '[{"type": "entity", "text": "other", "extra": {"a": [1]}, "score": 2}, {}]')
    file("notes", '[{"type": "entity", "text": "notes"}]')
    got = records.read_training(spark, str(tmp_path), layout="list").select("text", "confidence", "score").collect()
    assert sorted(map(tuple, got), key=repr) == [("kept", None, None), ("other", None, 2.0), (None, None, None)]


def test_list_layout_reads_a_file_once_for_its_records(spark, tmp_path):
    odd = [True, "0.5", " 0.25 ", "x", 7, -1.5e-3, 12345678901234567890, {"a": 1}, [1], None]
    rows = [{"type": "t", "text": str(k), "confidence": odd[k % len(odd)], "score": k / 7} for k in range(20_000)]
    file = tmp_path / "training_data.json"
    file.write_text(json.dumps(rows))

    def bytes_read():
        return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())

    before = bytes_read()
    got = {int(r.text): (r.confidence, r.score) for r in records.read_training(spark, str(tmp_path), layout="list").collect()}
    # Once for the records, twice for what the file begins with.
    assert bytes_read() - before < 5 * file.stat().st_size
    want = [None, 0.5, 0.25, None, 7.0, -0.0015, 12345678901234567890.0, None, None, None]
    assert got == {k: (want[k % len(odd)], k / 7) for k in range(20_000)}
