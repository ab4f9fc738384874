import re
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusdeck.functions import text as tx
from corpusdeck.functions.arrays import argmax, bind, pad

relaxed = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
texts = st.lists(st.text(max_size=60), min_size=1, max_size=30)


def apply(spark, rows, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    return [r.o for r in df.select("i", expr(F.col("t")).alias("o")).orderBy("i").collect()]


def test_clean_text_edge_rows(spark):
    assert apply(spark, ["a\n 12 \nb", "Été — 50% #1", "  x  ", ""], tx.clean_text) == ["a 12 b", "Été  50 1", "x", ""]
    assert apply(spark, ["a\n 12 \nb"], lambda c: tx.clean_text(c, strip_page_numbers=True)) == ["a b"]


@relaxed
@given(texts)
def test_clean_text_matches_python_and_is_idempotent(spark, rows):
    rows = [t.replace("\x00", "").encode("utf-8", "ignore").decode() for t in rows]
    # Characters the two Unicode tables may class differently are left out.
    rows = ["".join(ch for ch in t if ord(ch) < 0x2000) for t in rows]

    def python(t):
        return re.sub(r"[^\w\s.,!?;:()-]", "", re.sub(r"\s+", " ", t)).strip()

    once = apply(spark, rows, tx.clean_text)
    assert once == [python(t) for t in rows]
    assert apply(spark, once, lambda c: tx.clean_text(tx.clean_text(c))) == apply(spark, once, tx.clean_text)


@relaxed
@given(st.lists(st.text(alphabet="aé \n", max_size=2_000), min_size=1, max_size=8))
def test_chunks_join_to_the_text(spark, rows):
    assert apply(spark, rows, lambda c: F.array_join(tx.chunks(c), "")) == rows
    assert apply(spark, rows, lambda c: F.array_join(tx.chunks(c, cap=3), "")) == [t[:1500] for t in rows]


def test_chunk_counts(spark):
    rows = ["", "x" * 500, "x" * 501, "x" * 1500, "x" * 1501]
    assert apply(spark, rows, lambda c: F.size(tx.chunks(c, cap=3))) == [1, 1, 2, 3, 3]
    assert apply(spark, rows, lambda c: F.size(tx.chunks(c))) == [1, 1, 2, 3, 4]


def test_chunks_count_code_points_and_keep_line_ends(spark):
    rows = ["a\r\n\u2028\x85b", "\U0001f600" * 3, "\U0001d41ax\n", None, ""]
    cut = lambda cap: spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string").select("i", tx.chunks(F.col("c"), 2, cap).alias("r"))
    want = [[r[k : k + 2] for k in range(0, len(r), 2)] or [""] if r is not None else None for r in rows]
    assert [r.r for r in cut(None).sort("i").collect()] == want
    assert [r.r for r in cut(2).sort("i").collect()] == [w and w[:2] for w in want]
    assert [r.r for r in cut(1 << 40).sort("i").collect()] == want


def test_a_long_text_is_cut_in_one_pass(spark):
    """Counted from the start for each chunk, this text takes over a minute."""
    df = spark.range(1).select(F.repeat(F.lit("é"), 4_000_000).alias("c"))
    began = time.monotonic()
    assert df.select(F.size(tx.chunks(F.col("c")))).first()[0] == 8_000
    assert time.monotonic() - began < 30


def test_preview_adds_dots_only_when_cut(spark):
    assert apply(spark, ["x" * 500, "x" * 501], tx.preview) == ["x" * 500, "x" * 500 + "..."]


def test_title_case_like_python(spark):
    rows = ["eco-friendly", "3d print", "o'neill mix", "old school", "EAU de vie"]
    assert apply(spark, rows, tx.title_case) == [t.title() for t in rows]
    assert apply(spark, ["tech_accessories"], tx.heading) == ["Tech Accessories"]


def test_growth_bounds(spark):
    got = apply(spark, ["15-20%", "8-12% annually", "7%", "steady"], tx.growth_bounds)
    assert [tuple(r) for r in got] == [(15.0, 20.0), (8.0, 12.0), (7.0, 7.0), (None, None)]


def test_label_id(spark):
    assert apply(spark, ["NEGATIVE", "NEUTRAL", "POSITIVE", "other", None], tx.label_id) == [0, 1, 2, None, None]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    row = df.select(*[tx.token_ngrams(F.col("t"), n).alias(f"g{n}") for n in (1, 2, 3)]).collect()
    assert [(r.g1, r.g2, r.g3) for r in row] == [
        (["a", "b", "c"], ["a b", "b c"], ["a b c"]),
        (["a"], [], []),
        ([], [], []),
    ]


def test_stop_words_keep_repeats(spark):
    df = spark.createDataFrame([(["the", "x", "of", "x"],)], "t array<string>")
    assert df.select(tx.drop_words(F.col("t"), ["the", "of"]).alias("o")).first().o == ["x", "x"]


def test_data_uri_has_no_line_breaks(spark):
    import base64

    long = "é line\n" * 400
    uri = apply(spark, [long], tx.data_uri)[0]
    assert uri == "data:text/plain;base64," + base64.b64encode(long.encode()).decode()


def test_split_bucket_is_stable_under_repartition(spark):
    df = spark.range(1000)
    a = df.select("id", tx.split_bucket(F.col("id")).alias("b"))
    b = df.repartition(7).select("id", tx.split_bucket(F.col("id")).alias("b"))
    assert sorted(a.collect()) == sorted(b.collect())
    share = a.filter("b < 20").count() / 1000
    assert 0.15 < share < 0.25


def test_array_helpers(spark):
    df = spark.createDataFrame([([1, 3, 3],)], "a array<int>")
    row = df.select(
        pad(F.col("a"), 5, F.lit(0)).alias("longer"),
        pad(F.col("a"), 2, F.lit(0)).alias("shorter"),
        argmax(F.col("a")).alias("m"),
        bind(F.size("a"), lambda n: n + n).alias("twice"),
    ).first()
    assert (row.longer, row.shorter, row.m, row.twice) == ([1, 3, 3, 0, 0], [1, 3], 1, 6)


def test_default_lexicons_lower_case_a_text_once(spark, tmp_path):
    from workload.catalog import QUERIES

    rows = [(1, "RUNWAY and Silk of the moon"), (2, ""), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["default_lexicons"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(text") == 1, plan
    found = {r.doc_id: r for r in got.collect()}
    assert (found[1].gate, found[1].patterns, found[1].content_words) == (1, 1, 3) and found[2].content_words == 0
