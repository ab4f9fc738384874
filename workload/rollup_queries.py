"""Corpus roll-ups and reports."""

from dataclasses import replace

from pyspark.sql import functions as F

from corpusdeck.operators.facets import facet_scores
from corpusdeck.operators.keywords import keyword_extract
from corpusdeck.operators.patterns import keyword_documents, mine_patterns as mine
from corpusdeck.operators.sentiment import chunk_sentiment
from corpusdeck.plans import insights as ins
from corpusdeck.plans import reports as rep
from corpusdeck.plans.analysis import analyze_documents
from corpusdeck.functions.text import report_header
from corpusdeck.sources.records import training_stats as stats
from corpusdeck.operators.training import collect_training
from workload import fixtures as fx
from workload import fragments as fr
from workload.registry import query


def sentiments(spark, sf):
    scored = chunk_sentiment(fx.docs(spark, sf).select("doc_id", "lang", "source", "text"), fx.scorer)
    return scored.select(
        "doc_id",
        "lang",
        "source",
        F.coalesce("sentiment.overall_sentiment", F.lit("NEUTRAL")).alias("sentiment"),
        F.coalesce("sentiment.confidence", F.lit(0.0)).alias("confidence"),
    )


def insights(spark, sf, keep=()):
    """Sentiment and keyword insights; ``keep`` names document columns to segment by."""
    docs = fx.raw_docs(spark, sf)
    ranked = keyword_extract(docs, fx.STOPS)
    if keep:
        ranked = ranked.join(docs.select("doc_id", *keep), "doc_id")
    return ins.insights_from_keywords(sentiments(spark, sf), ranked, fx.term_lexicon)


_FREQ = f"""{fr.KEYWORDS},
freq AS (SELECT keyword, count(*) AS mentions, min((doc_id, rank)) AS first_seen FROM keywords GROUP BY keyword),
acc AS (SELECT * FROM freq WHERE {fr.any_of("lower(keyword)", fx.TERMS)})"""


@query(
    "extract_insights",
    f"""WITH {fr.KEYWORDS}, {fr.sentiment()}, {fr.ENTITIES}
        SELECT 'sentiment' AS kind, doc_id, 0 AS ord, sentiment AS value FROM sentiments
        UNION ALL SELECT 'keyword', doc_id, rank::INTEGER, keyword FROM keywords
        UNION ALL SELECT 'mention', doc_id, rank::INTEGER, keyword FROM mentions
        UNION ALL SELECT 'entity', doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part, pos, words))::INTEGER, text FROM entities""",
)
def extract_insights(spark, sf):
    analysis = analyze_documents(fx.docs(spark, sf), fx.config(spark, sf))
    found = ins.extract_insights(analysis, fx.term_lexicon)
    frames = [
        (found.sentiments, "sentiment", F.lit(0), "sentiment"),
        (found.keywords, "keyword", F.col("rank"), "keyword"),
        (found.mentions, "mention", F.col("rank"), "keyword"),
        (found.entities, "entity", F.col("ord"), "text"),
    ]
    rows = [
        df.select(F.lit(kind).alias("kind"), "doc_id", ord_.alias("ord"), F.col(value).alias("value"))
        for df, kind, ord_, value in frames
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.union(more)
    return out


_RATIO = "count(*) AS documents, avg(CASE WHEN sentiment = 'POSITIVE' THEN 1.0::DOUBLE ELSE 0 END) AS sentiment_ratio"
_OUTLOOK = """CASE WHEN sentiment_ratio > 0.7 THEN 'Very Positive' WHEN sentiment_ratio > 0.6 THEN 'Positive'
  WHEN sentiment_ratio > 0.4 THEN 'Neutral' ELSE 'Cautious' END AS market_outlook"""
_CONSUMER = """CASE WHEN sentiment_ratio > 0.7 THEN 'Enthusiastic' WHEN sentiment_ratio > 0.6 THEN 'Optimistic'
  ELSE 'Measured' END AS consumer_sentiment"""


@query(
    "sentiment_ratio",
    f"""WITH {fr.sentiment()}, r AS (SELECT {_RATIO} FROM sentiments)
        SELECT documents, round(sentiment_ratio, 6) AS sentiment_ratio FROM r""",
)
def sentiment_ratio(spark, sf):
    ratio = ins.sentiment_ratio(sentiments(spark, sf))
    return ratio.select("documents", F.round("sentiment_ratio", 6).alias("sentiment_ratio"))


def _outlook_sql(by):
    return f"""WITH {fr.sentiment()}, r AS (SELECT {by}, {_RATIO} FROM sentiments JOIN documents USING (doc_id) GROUP BY {by})
        SELECT {by}, documents, round(sentiment_ratio, 6) AS sentiment_ratio, {_OUTLOOK}, {_CONSUMER} FROM r"""


def _outlook(spark, sf, by):
    ratio = ins.sentiment_ratio(sentiments(spark, sf), by)
    r = F.col("sentiment_ratio")
    return ratio.select(
        by,
        "documents",
        F.round(r, 6).alias("sentiment_ratio"),
        ins.market_outlook(r).alias("market_outlook"),
        ins.consumer_sentiment(r).alias("consumer_sentiment"),
    )


@query("market_outlook", _outlook_sql("source"))
def market_outlook(spark, sf):
    return _outlook(spark, sf, "source")


@query("market_outlook_by_lang", _outlook_sql("lang"))
def market_outlook_by_lang(spark, sf):
    return _outlook(spark, sf, "lang")


_RANKED = "(row_number() OVER (ORDER BY mentions DESC, first_seen))::INTEGER AS rank, keyword, mentions"


@query(
    "top_keywords",
    f"""WITH {_FREQ}
        SELECT * FROM (SELECT 'all' AS scope, {_RANKED} FROM freq) WHERE rank <= 5
        UNION ALL SELECT * FROM (SELECT 'accessory', {_RANKED} FROM acc) WHERE rank <= 5""",
)
def top_keywords(spark, sf):
    freq = ins.keyword_frequencies(insights(spark, sf))
    best = ins.top_keywords(freq, 5).withColumn("scope", F.lit("all"))
    accessories = ins.top_keywords(freq.filter("is_accessory"), 5).withColumn("scope", F.lit("accessory"))
    return best.unionByName(accessories)


@query(
    "top_events",
    """SELECT event_type, (rank)::INTEGER AS rank, keyword, mentions FROM (
         SELECT event_type, user_id::VARCHAR AS keyword, count(*) AS mentions,
           row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, min((event_id, 1))) AS rank
         FROM events GROUP BY event_type, user_id) WHERE rank <= 5""",
)
def top_events(spark, sf):
    from corpusdeck.sources.tables import read_table

    rows = read_table(spark, sf, "events").select(
        F.col("event_id").alias("doc_id"), F.lit(1).alias("rank"), F.col("user_id").cast("string").alias("keyword"), "event_type"
    )
    found = ins.insights_from_keywords(rows.limit(0), rows, fx.term_lexicon)
    return ins.top_keywords(ins.keyword_frequencies(found, "event_type"), 5, "event_type")


_FLAGS = """coalesce(sum(mentions), 0)::BIGINT AS total_mentions, count(*) AS distinct_mentions,
  CASE WHEN coalesce(sum(mentions), 0) > 10 THEN 'High Growth' ELSE 'Moderate Growth' END AS growth_outlook,
  count(*) > 5 AS has_strategy"""


@query("growth_flags", f"WITH {_FREQ} SELECT {_FLAGS} FROM acc")
def growth_flags(spark, sf):
    return ins.growth_flags(ins.keyword_frequencies(insights(spark, sf)))


_CATS = " UNION ALL ".join(
    f"""SELECT '{c}' AS category, coalesce(sum(mentions), 0)::BIGINT AS mentions, count(*) AS keywords FROM acc
        WHERE {fr.any_of("lower(keyword)", ks)}"""
    for c, ks in fx.CATEGORIES.items()
)


@query("category_counts", f"WITH {_FREQ} {_CATS}")
def category_counts(spark, sf):
    return ins.category_counts(insights(spark, sf).mentions, fx.category_lexicon)


@query(
    "material_preferences",
    " UNION ALL ".join(
        f"SELECT 'materials' AS category, '{k}' AS keyword, count(*) FILTER (contains(lower(text), '{k}')) AS documents FROM documents"
        for k in fx.MATERIALS["materials"]
    ),
)
def material_preferences(spark, sf):
    return keyword_documents(fx.docs(spark, sf), fx.material_lexicon)


@query(
    "mine_patterns",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS category, coalesce((SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT unnest({fr.listing(ks)}) AS k)
            WHERE EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), k))), '') AS keywords"""
        for c, ks in fx.CATEGORIES.items()
    ),
)
def mine_patterns(spark, sf):
    found = mine(fx.docs(spark, sf), fx.category_lexicon)
    return found.select("category", F.array_join("keywords", ",").alias("keywords"))


_LIST = "coalesce((SELECT string_agg(keyword, '|' ORDER BY mentions DESC, first_seen) FROM (SELECT * FROM {t} ORDER BY mentions DESC, first_seen LIMIT {k})), '')"


@query(
    "executive_summary",
    f"""WITH {_FREQ}, {fr.sentiment()}, r AS (SELECT {_RATIO} FROM sentiments), f AS (SELECT {_FLAGS} FROM acc)
        SELECT documents, round(sentiment_ratio, 6) AS sentiment_ratio, {_OUTLOOK}, {_CONSUMER},
          {_LIST.format(t="freq", k=5)} AS key_trend_directions, {_LIST.format(t="acc", k=3)} AS accessory_spotlight,
          'Strong' AS forecast_confidence, growth_outlook AS accessories_growth_outlook, total_mentions, distinct_mentions, has_strategy
        FROM r, f""",
)
def executive_summary(spark, sf):
    return _flat_summary(ins.executive_summary(insights(spark, sf)))


def _flat_summary(summary):
    return summary.withColumns(
        {
            "sentiment_ratio": F.round("sentiment_ratio", 6),
            "key_trend_directions": F.array_join("key_trend_directions", "|"),
            "accessory_spotlight": F.array_join("accessory_spotlight", "|"),
        }
    )


_SEGMENTS = f"""{fr.KEYWORDS}, {fr.sentiment()},
sfreq AS (SELECT lang, keyword, count(*) AS mentions, min((doc_id, rank)) AS first_seen,
            {fr.any_of("lower(keyword)", fx.TERMS)} AS accessory
          FROM keywords JOIN documents USING (doc_id) GROUP BY lang, keyword),
r AS (SELECT lang, {_RATIO} FROM sentiments JOIN documents USING (doc_id) GROUP BY lang),
f AS (SELECT lang, {_FLAGS} FROM sfreq WHERE accessory GROUP BY lang),
t AS (SELECT lang, string_agg(keyword, '|' ORDER BY n) AS top FROM (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY mentions DESC, first_seen) AS n FROM sfreq) WHERE n <= 5 GROUP BY lang),
a AS (SELECT lang, string_agg(keyword, '|' ORDER BY n) AS spot FROM (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY mentions DESC, first_seen) AS n FROM sfreq WHERE accessory) WHERE n <= 3 GROUP BY lang)"""


@query(
    "executive_summary_by_lang",
    f"""WITH {_SEGMENTS} SELECT lang, documents, round(sentiment_ratio, 6) AS sentiment_ratio, {_OUTLOOK}, {_CONSUMER},
          coalesce(top, '') AS key_trend_directions, coalesce(spot, '') AS accessory_spotlight, 'Strong' AS forecast_confidence,
          coalesce(growth_outlook, 'Moderate Growth') AS accessories_growth_outlook, coalesce(total_mentions, 0) AS total_mentions,
          coalesce(distinct_mentions, 0) AS distinct_mentions, coalesce(has_strategy, false) AS has_strategy
        FROM r LEFT JOIN f USING (lang) LEFT JOIN t USING (lang) LEFT JOIN a USING (lang)""",
)
def executive_summary_by_lang(spark, sf):
    return _flat_summary(ins.executive_summary(insights(spark, sf, ("lang",)), by="lang"))


_THEMES = """(SELECT string_agg(r_name || ':' || names, ';' ORDER BY r_name) FROM (
  SELECT r_name, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name))"""
_CAT_LIST = f"""(SELECT string_agg(category || ':' || mentions || ':' || keywords, ';' ORDER BY category) FROM ({_CATS}))"""


def _themes():
    themes = F.transform(
        F.map_entries(F.col("sections")["seasonal_outlook"]),
        lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"]["key_themes"], ",")),
    )
    return F.array_join(themes, ";")


def _cats(c):
    rows = F.transform(c, lambda x: F.concat_ws(":", x["category"], x["mentions"].cast("string"), x["keywords"].cast("string")))
    return F.array_join(rows, ";")


@query(
    "forecast_report",
    f"""WITH {_FREQ}, {fr.sentiment()}, r AS (SELECT {_RATIO} FROM sentiments), f AS (SELECT {_FLAGS} FROM acc)
        SELECT '2024-06-30' AS generation_date, '12 Months' AS forecast_period, documents AS documents_analyzed,
          'FTR-20240630' AS report_id, {_OUTLOOK}, {_CONSUMER}, {_LIST.format(t="freq", k=5)} AS key_trend_directions,
          {_CAT_LIST} AS categories, {_THEMES} AS themes,
          CASE WHEN has_strategy THEN (SELECT string_agg(r_name, ',' ORDER BY r_regionkey) FROM region) END AS strategy
        FROM r, f""",
)
def forecast_report(spark, sf):
    report = rep.forecast_report(insights(spark, sf), fx.dims(spark, sf), fx.category_lexicon, fx.as_of())
    s = F.col("executive_summary")
    return report.select(
        "report_metadata.*",
        s["market_outlook"].alias("market_outlook"),
        s["consumer_sentiment"].alias("consumer_sentiment"),
        F.array_join(s["key_trend_directions"], "|").alias("key_trend_directions"),
        _cats(F.col("accessory_categories")).alias("categories"),
        _themes().alias("themes"),
        F.array_join(F.col("accessory_strategy")["strategy"]["steps"], ",").alias("strategy"),
    )


@query(
    "accessory_report",
    f"""WITH {_FREQ} SELECT 'Accessories Forecast' AS report_type, '2024-06-30' AS generation_date,
          {_LIST.format(t="acc", k=5)} AS top_trending_categories, {_CAT_LIST} AS categories, {_THEMES} AS themes""",
)
def accessory_report(spark, sf):
    report = rep.accessory_report(insights(spark, sf), fx.dims(spark, sf), fx.category_lexicon, fx.as_of())
    return report.select(
        "report_type",
        "generation_date",
        F.array_join(F.col("executive_summary")["top_trending_categories"], "|").alias("top_trending_categories"),
        _cats(F.col("category_forecasts")).alias("categories"),
        _themes().alias("themes"),
    )


def _reports(spark, sf):
    """A text report per language: header, facet options by documents, sentiment labels."""
    docs = fx.docs(spark, sf)
    counts = fx.raw_docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n"))
    h = F.col("h")
    header = F.concat(
        F.lit("TREND FORECAST REPORT\nGenerated: "), h["generation_date"], F.lit("\nDocuments Analyzed: "), h["documents_analyzed"],
        F.lit("\nReport ID: "), h["report_id"],
    )
    headers = counts.withColumn("h", report_header(fx.as_of(), F.col("n"))).select("lang", header.alias("header"))
    facets = facet_scores(docs, fx.facet_lexicon).join(fx.raw_docs(spark, sf).select("doc_id", "lang"), "doc_id")
    options = facets.groupBy("lang", "facet", "option").agg(F.count("*").alias("n"))
    option_rows = options.select(
        "lang",
        F.when(F.col("facet") == "tongue", 1).otherwise(2).alias("section_ord"),
        F.initcap("facet").alias("title"),
        F.col("option").alias("item_ord"),
        F.concat("option", F.lit(": "), "n").alias("item"),
        F.lit(True).alias("bullet"),
    )
    labels = sentiments(spark, sf).groupBy("lang", "sentiment").agg(F.count("*").alias("n"))
    label_rows = labels.select(
        "lang",
        F.lit(3).alias("section_ord"),
        F.lit("Sentiment").alias("title"),
        F.col("sentiment").alias("item_ord"),
        F.concat("sentiment", F.lit(" "), "n").alias("item"),
        F.lit(False).alias("bullet"),
    )
    return rep.report_text(headers, option_rows.unionByName(label_rows), "lang", "Generated from the document corpus")


_NL = "chr(10)"
_REPORTS = f"""{fr.FACETS}, {fr.sentiment()},
lines AS (
  SELECT lang, CASE WHEN facet = 'tongue' THEN 1 ELSE 2 END AS s, upper(facet[1]) || facet[2:] AS title, option AS o,
         '- ' || option || ': ' || count(*) AS line FROM facets JOIN documents USING (doc_id) GROUP BY lang, facet, option
  UNION ALL SELECT lang, 3, 'Sentiment', sentiment, sentiment || ' ' || count(*)
  FROM sentiments JOIN documents USING (doc_id) GROUP BY lang, sentiment),
blocks AS (SELECT lang, s, {_NL} || title || ':' || {_NL} || string_agg(line || {_NL}, '' ORDER BY o) AS block FROM lines GROUP BY lang, s, title),
bodies AS (SELECT lang, string_agg(block, '' ORDER BY s) AS body FROM blocks GROUP BY lang),
reports AS (
  SELECT lang, 'TREND FORECAST REPORT' || {_NL} || 'Generated: 2024-06-30' || {_NL} || 'Documents Analyzed: ' || n || {_NL} ||
         'Report ID: FTR-20240630' || {_NL} || coalesce(body, '') || {_NL} || '---' || {_NL} || 'Generated from the document corpus' AS report
  FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) LEFT JOIN bodies USING (lang))"""


@query("report_text", f"WITH {_REPORTS} SELECT lang, report FROM reports")
def report_text(spark, sf):
    return _reports(spark, sf)


@query(
    "report_base64",
    f"""WITH {_REPORTS} SELECT lang, '<a href="data:text/plain;base64,' || base64(encode(report)) || '" download="forecast_' || lang
        || '.txt">Download report</a>' AS link FROM reports""",
)
def report_base64(spark, sf):
    name = F.concat(F.lit("forecast_"), F.col("lang"), F.lit(".txt"))
    return _reports(spark, sf).select("lang", rep.download_link(F.col("report"), name).alias("link"))


RECORDS = f"""{fr.sentiment()}, {fr.ENTITIES},
records AS (
  SELECT 'sentiment' AS type, text, sentiment, round(confidence, 6) AS confidence, NULL AS category,
         NULL::DOUBLE AS score, source AS source_file, '2024-06-30T12:00:00' AS timestamp
  FROM sentiments JOIN documents USING (doc_id)
  UNION ALL SELECT 'entity', e.text, NULL, NULL, category, score, source, '2024-06-30T12:00:00'
  FROM entities e JOIN documents USING (doc_id) WHERE category <> 'other')"""


def records(spark, sf, max_chars=None):
    whole = replace(fx.config(spark, sf), preview_chars=None)
    return collect_training(analyze_documents(fx.docs(spark, sf), whole), fx.as_of(), max_chars)


@query(
    "training_stats",
    f"""WITH {RECORDS} SELECT count(*) AS total_samples, count(*) FILTER (type = 'sentiment') AS sentiment_samples,
          count(*) FILTER (type = 'entity') AS entity_samples, count(DISTINCT coalesce(source_file, '')) AS files_count FROM records""",
)
def training_stats(spark, sf):
    return stats(records(spark, sf))
