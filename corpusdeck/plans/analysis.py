"""All per-document analyses in one row per document."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdeck import defaults
from corpusdeck.functions.lexicon import Lexicon
from corpusdeck.functions.text import preview
from corpusdeck.operators.entities import with_entities
from corpusdeck.operators.facets import facet_map
from corpusdeck.operators.keywords import keyword_extract, nest_keywords
from corpusdeck.operators.sentiment import ChunkScorer, chunk_sentiment
from corpusdeck.operators.topics import TopicModel, assign_topics

KEYWORDS = "array<struct<keyword:string,score:double>>"


@dataclass(frozen=True)
class AnalysisConfig:
    """What the analyses are parameterised with; ``dictionary`` is ``(phrase, label, score)``."""

    scorer: ChunkScorer
    dictionary: DataFrame
    patterns: Lexicon = field(default_factory=lambda: Lexicon.categories(defaults.PATTERNS))
    facets: Lexicon = field(default_factory=lambda: Lexicon.facets(defaults.FACETS))
    stops: tuple[str, ...] = defaults.STOPS
    top_n: int = 20
    # Ranks keywords: texts to (doc, rank, keyword, score) rows. The default is TF-IDF.
    ranker: Callable[[DataFrame], DataFrame] | None = None
    chunk_size: int = 500
    chunk_cap: int | None = None
    strict_categories: bool = False
    # Characters of ``text_preview``; None for the whole text.
    preview_chars: int | None = 500
    # A fitted model that gives each document its topic; None for no topics.
    topics: TopicModel | None = None


def analyze_documents(
    df: DataFrame, cfg: AnalysisConfig, doc: str = "doc_id", text: str = "text", filename: str = "source"
) -> DataFrame:
    """``(doc, filename, text_preview, sentiment, keywords, total_keywords, entities, facets, topic_id, errors)``.

    Sentiment, facets, preview, topic and, with a small dictionary, entities are computed inside the row, so the
    text itself is not carried through the join. Keywords come back keyed by document. ``errors`` has a message
    for each part that failed: without a text no part can be computed, so empty lists beside a message are no
    finding. Without a topic model ``topic_id`` is null.
    """
    local = assign_topics(df, cfg.topics, text) if cfg.topics else df.withColumn("topic_id", F.lit(None).cast("int"))
    local = chunk_sentiment(local, cfg.scorer, text, cfg.chunk_size, cfg.chunk_cap)
    local = facet_map(local, cfg.facets, text)
    local = with_entities(local, cfg.dictionary, cfg.patterns, cfg.facets, cfg.strict_categories, doc, text)
    local = local.select(
        doc,
        F.col(filename).alias("filename"),
        (F.col(text) if cfg.preview_chars is None else preview(F.col(text), cfg.preview_chars)).alias("text_preview"),
        "sentiment",
        "entities",
        "facets",
        F.when(F.col(text).isNotNull(), F.col("topic_id")).alias("topic_id"),
        _errors(F.col(text), cfg.topics is not None).alias("errors"),
    )
    ranked = cfg.ranker(df) if cfg.ranker else keyword_extract(df, cfg.stops, cfg.top_n, doc=doc, text=text)
    return local.join(nest_keywords(ranked, doc), doc, "left").select(
        doc,
        "filename",
        "text_preview",
        "sentiment",
        F.coalesce("keywords", F.array().cast(KEYWORDS)).alias("keywords"),
        F.coalesce("total_keywords", F.lit(0)).alias("total_keywords"),
        "entities",
        "facets",
        "topic_id",
        "errors",
    )


def _errors(text: Column, topics: bool) -> Column:
    """``struct<sentiment, keywords, entities, facets, topic>``, null where the part succeeded."""

    def failed(part: str) -> Column:
        return F.when(text.isNull(), F.lit(f"{part} failed: no text"))

    return F.struct(
        F.col("sentiment.error").alias("sentiment"),
        failed("keyword extraction").alias("keywords"),
        failed("entity recognition").alias("entities"),
        failed("facet analysis").alias("facets"),
        (failed("topic modelling") if topics else F.lit(None).cast("string")).alias("topic"),
    )
