import json

import pytest
from pyspark.sql import functions as F

from corpusdeck import defaults
from corpusdeck.functions.lexicon import Lexicon
from corpusdeck.plans import insights as ins
from corpusdeck.plans import reports as rep

TERMS = Lexicon.words([k for ks in defaults.ACCESSORIES.values() for k in ks] + defaults.ACCESSORY_EXTRAS)
CATEGORIES = Lexicon.categories(defaults.ACCESSORIES)
def as_of():
    return F.lit("2024-06-30 12:00:00").cast("timestamp")

SCHEMA = (
    "doc_id bigint, filename string, text_preview string, "
    "sentiment struct<overall_sentiment:string,confidence:double,error:string>, "
    "keywords array<struct<keyword:string,score:double>>, "
    "entities array<struct<text:string,label:string,score:double,category:string,is_related:boolean,source:string>>"
)


def analysis(spark, *rows):
    """Rows of ``(label or None, keywords)``."""
    data = [
        (i, f"f{i}.pdf", "text", (l, 0.8, None) if l else (None, None, "failed"), [(k, 0.5) for k in ks], [])
        for i, (l, ks) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA)


def summary(spark, *rows):
    return ins.executive_summary(ins.extract_insights(analysis(spark, *rows), TERMS)).first()


@pytest.mark.parametrize(
    "positive, total, outlook, consumer",
    [
        (7, 10, "Positive", "Optimistic"),
        (8, 10, "Very Positive", "Enthusiastic"),
        (6, 10, "Neutral", "Measured"),
        (4, 10, "Cautious", "Measured"),
        (0, 0, "Neutral", "Measured"),
    ],
)
def test_outlook_bands(spark, positive, total, outlook, consumer):
    rows = [("POSITIVE", [])] * positive + [("NEGATIVE", [])] * (total - positive)
    s = summary(spark, *rows)
    assert (s.market_outlook, s.consumer_sentiment, s.documents) == (outlook, consumer, total)
    assert s.key_trend_directions == [] and s.forecast_confidence == "Strong"


def test_failed_sentiment_counts_as_neutral(spark):
    found = ins.extract_insights(analysis(spark, (None, []), ("POSITIVE", [])), TERMS)
    rows = sorted((r.doc_id, r.sentiment, r.confidence) for r in found.sentiments.collect())
    assert rows == [(0, "NEUTRAL", 0.0), (1, "POSITIVE", 0.8)]


def test_dashboard_sample_keeps_case_and_order(spark):
    words = ["sustainable jewelry", "tech accessories", "Statement Handbags", "designer sunglasses", "smart watches", "vegan leather bags"]
    found = ins.extract_insights(analysis(spark, ("POSITIVE", words)), TERMS)
    kept = [r.keyword for r in found.mentions.orderBy("rank").collect()]
    assert kept == ["Statement Handbags", "designer sunglasses", "vegan leather bags"]


def test_top_keyword_ties_go_to_first_appearance(spark):
    s = summary(spark, ("POSITIVE", ["z", "y"]), ("POSITIVE", ["a", "y", "ring b"]), ("POSITIVE", ["ring a", "b", "c"]))
    assert s.key_trend_directions == ["y", "z", "a", "ring b", "ring a"]
    assert s.accessory_spotlight == ["ring b", "ring a"]


@pytest.mark.parametrize("total, growth", [(10, "Moderate Growth"), (11, "High Growth")])
def test_growth_uses_total_mentions(spark, total, growth):
    assert summary(spark, *[("POSITIVE", ["ring"])] * total).accessories_growth_outlook == growth


@pytest.mark.parametrize("distinct, strategy", [(5, False), (6, True)])
def test_strategy_uses_distinct_mentions(spark, distinct, strategy):
    rows = [("POSITIVE", [f"ring {i}" for i in range(distinct)])] * 3
    assert summary(spark, *rows).has_strategy is strategy


def test_segments_match_separate_corpora(spark):
    rows = [("POSITIVE", ["ring", "a"]), ("NEGATIVE", ["b", "ring"]), ("POSITIVE", ["hat", "b"]), ("POSITIVE", ["b"])]
    df = analysis(spark, *rows).withColumn("seg", F.when(F.col("doc_id") < 2, "x").otherwise("y"))
    both = {r.seg: r for r in ins.executive_summary(ins.extract_insights(df, TERMS, ("seg",)), by="seg").collect()}
    for seg in "xy":
        alone = ins.executive_summary(ins.extract_insights(df.filter(F.col("seg") == seg), TERMS)).first().asDict()
        assert {**both[seg].asDict()} == {"seg": seg, **alone}


def test_category_counts_keep_zeros(spark):
    found = ins.extract_insights(analysis(spark, ("POSITIVE", ["ring", "gold chain"]), ("POSITIVE", ["ring", "earrings"])), TERMS)
    got = {r.category: (r.mentions, r.keywords) for r in ins.category_counts(found.mentions, CATEGORIES).collect()}
    assert got["jewelry"] == (3, 2) and got["belts"] == (0, 0) and list(got) == list(defaults.ACCESSORIES)
    empty = ins.category_counts(found.mentions.limit(0), CATEGORIES).collect()
    assert [tuple(r) for r in empty] == [(c, 0, 0) for c in defaults.ACCESSORIES]


def dims(spark):
    rows = [
        ("seasonal_outlook", "summer", "themes", 1, "light"),
        ("seasonal_outlook", "summer", "themes", 0, "sun"),
        ("seasonal_outlook", "winter", "themes", 0, "wool"),
        ("accessory_strategy", "strategy", "steps", 0, "expand"),
    ]
    return spark.createDataFrame(rows, "section string, item string, attr string, ord int, value string")


def report(spark, distinct):
    found = ins.extract_insights(analysis(spark, ("POSITIVE", [f"ring {i}" for i in range(distinct)])), TERMS)
    return json.loads(rep.report_json(rep.forecast_report(found, dims(spark), CATEGORIES, as_of())).first().report)


def test_forecast_report_json(spark):
    weak, strong = report(spark, 5), report(spark, 6)
    assert "accessory_strategy" not in weak
    assert strong["accessory_strategy"] == {"strategy": {"steps": ["expand"]}}
    assert strong["report_metadata"] == {
        "generation_date": "2024-06-30",
        "forecast_period": "12 Months",
        "documents_analyzed": 1,
        "report_id": "FTR-20240630",
    }
    assert strong["sections"] == {"seasonal_outlook": {"summer": {"themes": ["sun", "light"]}, "winter": {"themes": ["wool"]}}}


def test_accessory_report_lists_five(spark):
    found = ins.extract_insights(analysis(spark, ("POSITIVE", [f"ring {i}" for i in range(8)])), TERMS)
    row = rep.accessory_report(found, dims(spark), CATEGORIES, as_of()).first()
    assert row.executive_summary.top_trending_categories == [f"ring {i}" for i in range(5)]


def test_report_text(spark):
    headers = spark.createDataFrame([("a", "HEAD"), ("b", "NONE")], "k string, header string")
    rows = [("a", 2, "Second", 0, "line", False), ("a", 1, "First", 1, "two", True), ("a", 1, "First", 0, "one", True)]
    sections = spark.createDataFrame(rows, "k string, section_ord int, title string, item_ord int, item string, bullet boolean")
    got = {r.k: r.report for r in rep.report_text(headers, sections, "k", "end").collect()}
    assert got["a"] == "HEAD\n\nFirst:\n- one\n- two\n\nSecond:\nline\n\n---\nend"
    assert got["b"] == "NONE\n\n---\nend"
