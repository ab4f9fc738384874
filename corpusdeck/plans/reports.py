"""Nested reports and their text form.

The narrative parts of a report are dimension rows ``(section, item, attr, ord, value)`` supplied
by the user; the measured parts come from :mod:`corpusdeck.plans.insights`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdeck.functions.text import data_uri, report_header
from corpusdeck.functions.lexicon import Lexicon
from corpusdeck.plans.insights import (
    Insights,
    category_counts,
    executive_summary,
    keyword_frequencies,
    top_keywords,
)

STRATEGY = "accessory_strategy"


def dim_sections(dims: DataFrame) -> DataFrame:
    """``(section, content)`` with ``content`` a map item → attr → ordered values.

    Dimension rows are the fixed wording of one report, which a report holds in one row.
    """
    values = dims.groupBy("section", "item", "attr").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "value"))), lambda v: v["value"]).alias("values")
    )
    items = values.groupBy("section", "item").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("attr", "values")))).alias("attrs")
    )
    return items.groupBy("section").agg(
        F.map_from_entries(
            F.transform(
                F.array_sort(
                    F.collect_list(F.struct("item", "attrs")),
                    lambda a, b: F.when(a["item"] < b["item"], -1).when(a["item"] > b["item"], 1).otherwise(0),
                ),
                lambda x: F.struct(x["item"], x["attrs"]),
            )
        ).alias("content")
    )


def _sections(dims: DataFrame, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """All sections as one map, in one row."""
    chosen = dim_sections(dims)
    if leave_out:
        chosen = chosen.filter(~F.col("section").isin(list(leave_out)))
    entry = F.struct("section", "content")
    by_name = F.array_sort(
        F.collect_list(entry),
        lambda a, b: F.when(a["section"] < b["section"], -1).when(a["section"] > b["section"], 1).otherwise(0),
    )
    return chosen.agg(F.map_from_entries(by_name))


def _categories(insights: Insights, categories: Lexicon) -> DataFrame:
    counted = category_counts(keyword_frequencies(insights).filter("is_accessory"), categories)
    entry = F.struct("category", "mentions", "keywords")
    return counted.agg(F.sort_array(F.collect_list(entry)))


def forecast_report(
    insights: Insights, dims: DataFrame, categories: Lexicon, as_of: Column
) -> DataFrame:
    """One nested row: metadata, summary, measured categories, sections. The accessory strategy
    section is null, and so absent from the JSON, unless mentions call for it."""
    summary = executive_summary(insights)
    strategy = dim_sections(dims.filter(F.col("section") == STRATEGY)).select("content")
    return summary.select(
        report_header(as_of, F.col("documents")).alias("report_metadata"),
        F.struct(
            "market_outlook",
            "key_trend_directions",
            "accessory_spotlight",
            "consumer_sentiment",
            "forecast_confidence",
            "accessories_growth_outlook",
        ).alias("executive_summary"),
        _categories(insights, categories).scalar().alias("accessory_categories"),
        _sections(dims, (STRATEGY,)).scalar().alias("sections"),
        F.when(F.col("has_strategy"), strategy.scalar()).alias(STRATEGY),
    )


def accessory_report(insights: Insights, dims: DataFrame, categories: Lexicon, as_of: Column) -> DataFrame:
    """The dedicated accessories report: top five mentions, measured categories, sections."""
    freq = keyword_frequencies(insights).filter("is_accessory")
    top = top_keywords(freq, 5)
    entry = F.struct("rank", "keyword")
    trending = top.agg(F.transform(F.sort_array(F.collect_list(entry)), lambda t: t["keyword"]).alias("top"))
    return trending.select(
        F.lit("Accessories Forecast").alias("report_type"),
        F.date_format(as_of, "yyyy-MM-dd").alias("generation_date"),
        F.struct(
            F.col("top").alias("top_trending_categories"),
            F.lit("Next 12 months").alias("forecast_period"),
            F.lit("Highly Positive").alias("overall_outlook"),
        ).alias("executive_summary"),
        _categories(insights, categories).scalar().alias("category_forecasts"),
        _sections(dims).scalar().alias("sections"),
    )


def report_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct(*report.columns)).alias("report"))


def report_text(headers: DataFrame, sections: DataFrame, key: str, footer: str) -> DataFrame:
    """``(key, report)``: header lines, then a titled list per section, then the footer.

    ``headers`` is ``(key, header)``; ``sections`` is ``(key, section_ord, title, item_ord, item,
    bullet)``. A report's lines are the few rows a reader sees, grouped by its key.
    """
    line = F.concat(F.when(F.col("bullet"), F.lit("- ")).otherwise(F.lit("")), F.col("item"), F.lit("\n"))
    blocks = sections.groupBy(key, "section_ord", "title").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("item_ord", line.alias("line")))), lambda x: x["line"]), ""
        ).alias("lines")
    )
    block = F.concat(F.lit("\n"), F.col("title"), F.lit(":\n"), F.col("lines"))
    bodies = blocks.groupBy(key).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("section_ord", block.alias("b")))), lambda x: x["b"]), ""
        ).alias("body")
    )
    report = F.concat(F.col("header"), F.lit("\n"), F.coalesce("body", F.lit("")), F.lit(f"\n---\n{footer}"))
    return headers.join(bodies, key, "left").select(key, report.alias("report"))


def download_link(report: Column, filename: Column) -> Column:
    """An anchor whose target carries the report itself."""
    return F.concat(
        F.lit('<a href="'), data_uri(report), F.lit('" download="'), filename, F.lit('">Download report</a>')
    )
