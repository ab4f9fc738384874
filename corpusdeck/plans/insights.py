"""Corpus roll-ups over analysed documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusdeck.functions.lexicon import Lexicon
from corpusdeck.operators.filters import keyword_filter

EMPTY_RATIO = 0.5


@dataclass(frozen=True)
class Insights:
    """Flattened analyses. Every frame starts with the document id and the ``keep`` columns."""

    sentiments: DataFrame  # sentiment, confidence
    keywords: DataFrame  # rank, keyword, score
    mentions: DataFrame  # rank, keyword, score: the accessory keywords
    terms: Lexicon
    doc: str
    entities: DataFrame | None = None  # ord, entity struct fields


def extract_insights(
    analysis: DataFrame, terms: Lexicon, keep: tuple[str, ...] = (), doc: str = "doc_id"
) -> Insights:
    """An analysis whose sentiment failed counts as NEUTRAL with confidence 0."""
    kept = [doc, *keep]
    sentiments = analysis.select(
        *kept,
        F.coalesce("sentiment.overall_sentiment", F.lit("NEUTRAL")).alias("sentiment"),
        F.coalesce("sentiment.confidence", F.lit(0.0)).alias("confidence"),
    )
    keywords = analysis.select(*kept, F.posexplode("keywords").alias("_pos", "_k")).select(
        *kept, (F.col("_pos") + 1).alias("rank"), "_k.keyword", "_k.score"
    )
    entities = analysis.select(*kept, F.posexplode("entities").alias("_pos", "_e")).select(
        *kept, (F.col("_pos") + 1).alias("ord"), "_e.*"
    )
    return Insights(sentiments, keywords, keyword_filter(keywords, terms), terms, doc, entities)


def insights_from_keywords(
    sentiments: DataFrame, keywords: DataFrame, terms: Lexicon, doc: str = "doc_id"
) -> Insights:
    """Insights straight from sentiment rows and ranked keyword rows, without nesting them first."""
    return Insights(sentiments, keywords, keyword_filter(keywords, terms), terms, doc)


def sentiment_ratio(sentiments: DataFrame, by: str | None = None) -> DataFrame:
    """Share of POSITIVE documents; one half for an empty corpus."""
    groups = [by] if by else []
    positive = F.avg(F.when(F.col("sentiment") == "POSITIVE", 1.0).otherwise(0.0))
    return sentiments.groupBy(*groups).agg(
        F.count("*").alias("documents"), F.coalesce(positive, F.lit(EMPTY_RATIO)).alias("sentiment_ratio")
    )


def market_outlook(ratio: Column) -> Column:
    return (
        F.when(ratio > 0.7, "Very Positive").when(ratio > 0.6, "Positive").when(ratio > 0.4, "Neutral").otherwise("Cautious")
    )


def consumer_sentiment(ratio: Column) -> Column:
    return F.when(ratio > 0.7, "Enthusiastic").when(ratio > 0.6, "Optimistic").otherwise("Measured")


def growth_outlook(total_mentions: Column) -> Column:
    return F.when(total_mentions > 10, "High Growth").otherwise("Moderate Growth")


def keyword_frequencies(insights: Insights, by: str | None = None) -> DataFrame:
    """``([by,] keyword, mentions, first_seen, is_accessory)``.

    ``first_seen`` orders ties: document, then rank. The accessory test is an aggregate, not a
    filter that could be pushed down, and the closing filter, always true, needs every column: so
    all consumers of a report have the same plan up to here and Spark reuses one shuffle.
    """
    groups = [by] if by else []
    freq = insights.keywords.groupBy(*groups, "keyword").agg(
        F.count("*").alias("mentions"),
        F.min(F.struct(insights.doc, "rank")).alias("first_seen"),
        F.bool_or(insights.terms.any(F.col("keyword"))).alias("is_accessory"),
    )
    return freq.filter(F.col("first_seen").isNotNull() & F.col("is_accessory").isNotNull())


def top_keywords(freq: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """``([by,] rank, keyword, mentions)``: the ``k`` most frequent, ties by first appearance."""
    order = [F.desc("mentions"), F.col("first_seen")]
    if by:
        ranked = freq.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
        return ranked.filter(F.col("rank") <= k).select(by, "rank", "keyword", "mentions")
    best = freq.orderBy(*order).limit(k)
    listed = best.agg(_sorted_list().alias("_top"))
    return listed.select(F.posexplode("_top").alias("_pos", "_t")).select(
        (F.col("_pos") + 1).alias("rank"), "_t.keyword", "_t.mentions"
    )


def _sorted_list() -> Column:
    entry = F.struct((-F.col("mentions")).alias("_n"), "first_seen", "keyword", "mentions")
    return F.sort_array(F.collect_list(entry))


def _top_list(freq: DataFrame, k: int) -> DataFrame:
    best = freq.orderBy(F.desc("mentions"), "first_seen").limit(k)
    return best.agg(F.transform(_sorted_list(), lambda t: t["keyword"]))


def growth_flags(freq: DataFrame, by: str | None = None) -> DataFrame:
    """Total mentions above 10 mean high growth; more than 5 *distinct* ones call for a strategy."""
    groups = [by] if by else []
    totals = freq.groupBy(*groups).agg(
        F.coalesce(F.sum(F.when(F.col("is_accessory"), F.col("mentions"))), F.lit(0)).alias("total_mentions"),
        F.count_if("is_accessory").alias("distinct_mentions"),
    )
    return totals.select(
        "*",
        growth_outlook(F.col("total_mentions")).alias("growth_outlook"),
        (F.col("distinct_mentions") > 5).alias("has_strategy"),
    )


def category_counts(mentions: DataFrame, categories: Lexicon, keyword: str = "keyword") -> DataFrame:
    """``(category, mentions, keywords)`` per category, zeros included.

    ``mentions`` holds one row per mention, or, with a ``mentions`` column, already counted
    keywords. Each category is one conditional sum over distinct keywords, so nothing is
    multiplied.
    """
    if "mentions" in mentions.columns:
        freq = mentions.withColumnRenamed("mentions", "_n")
    else:
        freq = mentions.groupBy(keyword).agg(F.count("*").alias("_n"))
    hit = freq.select("_n", categories.groups_hit(F.col(keyword)).alias("_groups"))
    names = list(enumerate(categories.groups))
    counted = hit.agg(
        *[F.sum(F.when(F.array_contains("_groups", g), F.col("_n"))).alias(f"_n{i}") for i, g in names],
        *[F.count_if(F.array_contains("_groups", g)).alias(f"_k{i}") for i, g in names],
    )
    rows = [
        F.struct(
            F.lit(g).alias("category"),
            F.coalesce(F.col(f"_n{i}"), F.lit(0)).alias("mentions"),
            F.col(f"_k{i}").alias("keywords"),
        )
        for i, g in names
    ]
    return counted.select(F.inline(F.array(*rows)))


def executive_summary(insights: Insights, by: str | None = None, top: int = 5, spotlight: int = 3) -> DataFrame:
    """One row for the corpus, or one per segment."""
    freq = keyword_frequencies(insights, by)
    ratio = sentiment_ratio(insights.sentiments, by)
    flags = growth_flags(freq, by)
    accessories = freq.filter("is_accessory")
    if by is None:
        flag = flags.select(F.struct("total_mentions", "distinct_mentions", "growth_outlook", "has_strategy"))
        row = ratio.select(
            "documents",
            "sentiment_ratio",
            _top_list(freq, top).scalar().alias("key_trend_directions"),
            _top_list(accessories, spotlight).scalar().alias("accessory_spotlight"),
            flag.scalar().alias("_flags"),
        ).select("*", "_flags.*").drop("_flags")
    else:
        row = (
            ratio.join(_segment_lists(freq, by, top, "key_trend_directions"), by, "left")
            .join(_segment_lists(accessories, by, spotlight, "accessory_spotlight"), by, "left")
            .join(flags, by, "left")
        )
    nothing = F.array().cast("array<string>")
    return row.select(
        *([by] if by else []),
        "documents",
        "sentiment_ratio",
        market_outlook(F.col("sentiment_ratio")).alias("market_outlook"),
        F.coalesce("key_trend_directions", nothing).alias("key_trend_directions"),
        F.coalesce("accessory_spotlight", nothing).alias("accessory_spotlight"),
        consumer_sentiment(F.col("sentiment_ratio")).alias("consumer_sentiment"),
        F.lit("Strong").alias("forecast_confidence"),
        F.coalesce("growth_outlook", growth_outlook(F.lit(0))).alias("accessories_growth_outlook"),
        F.coalesce("total_mentions", F.lit(0)).alias("total_mentions"),
        F.coalesce("distinct_mentions", F.lit(0)).alias("distinct_mentions"),
        F.coalesce("has_strategy", F.lit(False)).alias("has_strategy"),
    )


def _segment_lists(freq: DataFrame, by: str, k: int, name: str) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("rank", "keyword")))
    return top_keywords(freq, k, by).groupBy(by).agg(F.transform(listed, lambda t: t["keyword"]).alias(name))
