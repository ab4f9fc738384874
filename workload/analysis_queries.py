"""Per-document analyses."""

from dataclasses import replace

from pyspark.sql import functions as F

from corpusdeck.operators import entities as en
from corpusdeck.operators import keywords as kw
from corpusdeck.operators import nearest as nr
from corpusdeck.operators.facets import facet_scores as facet_rows
from corpusdeck.operators.embeddings import train_embeddings
from corpusdeck.operators.sentiment import chunk_rows, chunk_sentiment as document_sentiment, roll_up_chunks
from corpusdeck.operators.topics import assign_topics, fit_topics, topics as corpus_topics
from corpusdeck.plans.analysis import analyze_documents as analyze
from corpusdeck.sources.tables import read_table
from workload import fixtures as fx
from workload import fragments as fr
from workload.registry import query


def flat_sentiment(df):
    s = F.col("sentiment")
    return df.select(
        "doc_id",
        s["overall_sentiment"].alias("overall_sentiment"),
        F.round(s["confidence"], 6).alias("confidence"),
        *[F.round(s["detailed_scores"][l], 6).alias(l.lower()) for l in ("POSITIVE", "NEGATIVE", "NEUTRAL")],
    )


def _sentiment_sql(cap):
    return f"""WITH {fr.sentiment(cap)} SELECT doc_id, sentiment AS overall_sentiment, round(confidence, 6) AS confidence,
      round(positive, 6) AS positive, round(negative, 6) AS negative, round(neutral, 6) AS neutral FROM sentiments"""


@query("chunk_sentiment", _sentiment_sql(None))
def chunk_sentiment(spark, sf):
    return flat_sentiment(document_sentiment(fx.docs(spark, sf), fx.scorer))


@query("chunk_sentiment_first", _sentiment_sql(3))
def chunk_sentiment_first(spark, sf):
    """The cap as an argument that a caller gives."""
    return flat_sentiment(document_sentiment(fx.docs(spark, sf), fx.scorer, cap=3))


@query("chunk_sentiment_rows", _sentiment_sql(None))
def chunk_sentiment_rows(spark, sf):
    rows = chunk_rows(fx.docs(spark, sf).select("doc_id", "text"))
    judged = rows.withColumn("_s", F.element_at(fx.scorer(F.array("chunk")), 1)).select("doc_id", "_s.*")
    return flat_sentiment(roll_up_chunks(judged))


@query(
    "ngram_candidates",
    f"""WITH {fr.CANDIDATES} SELECT doc_id, len(w) AS words, len(g) AS candidates, md5(array_to_string(g, '|')) AS digest
        FROM (SELECT doc_id, w, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM cand)""",
)
def ngram_candidates(spark, sf):
    uni = kw.ngram_candidates(fx.docs(spark, sf).select("doc_id", "text"), fx.STOPS, 1, out="w")
    both = kw.ngram_candidates(uni, fx.STOPS, 2)
    return both.select(
        "doc_id",
        F.size("w").cast("bigint").alias("words"),
        F.size("candidates").cast("bigint").alias("candidates"),
        F.md5(F.array_join("candidates", "|")).alias("digest"),
    )


@query(
    "keyword_extract",
    f"WITH {fr.KEYWORDS} SELECT doc_id, rank::INTEGER AS rank, keyword, round(score, 6) AS score FROM keywords",
)
def keyword_extract(spark, sf):
    ranked = kw.keyword_extract(fx.raw_docs(spark, sf), fx.STOPS)
    return ranked.select("doc_id", "rank", "keyword", F.round("score", 6).alias("score"))


def centroids(spark, sf):
    """One query vector per class: the mean of its vectors. Bounded by the number of classes."""
    vectors = read_table(spark, sf, "embeddings")
    width = 64
    mean = F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(width)])
    return vectors.groupBy(F.col("label").alias("query_id")).agg(mean.alias("embedding"))


@query(
    "cosine_topk",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
       c AS (SELECT label, list(m ORDER BY i) AS v FROM (
               SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM e) GROUP BY ALL)
             GROUP BY label),
       s AS (SELECT c.label AS query_id, vec_id, list_cosine_similarity(e.v, c.v) AS score FROM e, c)
       SELECT query_id, rank::INTEGER AS rank, vec_id, round(score, 6) AS score FROM (
         SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
       WHERE rank <= 10""",
)
def cosine_topk(spark, sf):
    best = nr.cosine_topk(centroids(spark, sf), read_table(spark, sf, "embeddings"), 10)
    return best.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query(
    "cosine_topk_items",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
       s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.v, e.v) AS score FROM e q, e)
       SELECT query_id, rank::INTEGER AS rank, vec_id, round(round(score, 9), 6) AS score FROM (
         SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
       WHERE rank <= 10""",
)
def cosine_topk_items(spark, sf):
    """The most similar items of every item, itself included: both sides grow with the data."""
    items = read_table(spark, sf, "embeddings")
    queries = items.select(F.col("vec_id").alias("query_id"), "embedding")
    best, _ = nr.nearest_in_cells(queries, nr.cosine_cells(items), 10)
    return best.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query(
    "keyword_mmr",
    f"""WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
       c AS (SELECT label, list(m ORDER BY i) AS v FROM (
               SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM e) GROUP BY ALL)
             GROUP BY label),
       found AS (SELECT c.label AS query_id, vec_id AS item, round(list_cosine_similarity(e.v, c.v), 9) AS score, {fr.unit("e.v")} AS v FROM e, c),
       pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM found) WHERE rank <= 40),
       {fr.mmr("pool", 20, 0.7)}
       SELECT query_id, rank, item AS vec_id, round(score, 6) AS score FROM picked""",
)
def keyword_mmr(spark, sf):
    vectors = read_table(spark, sf, "embeddings")
    ranked = nr.cosine_topk(centroids(spark, sf), vectors, 40)
    picked = kw.keyword_mmr(ranked, vectors, top_n=20, diversity=0.7)
    return picked.withColumn("score", F.round("score", 6))


@query(
    "keyword_extract_vectors",
    f"WITH {fr.VECTOR_KEYWORDS} SELECT doc_id, rank::INTEGER AS rank, keyword, round(score, 6) AS score FROM vranked WHERE rank <= 20",
)
def keyword_extract_vectors(spark, sf):
    docs = fx.raw_docs(spark, sf)
    vectors = train_embeddings(fx.docs(spark, sf), fx.STOPS, size=fr.DIMENSIONS)
    ranked = kw.keyword_extract_by_vectors(docs, vectors, fr.DIMENSIONS, fx.STOPS)
    return ranked.select("doc_id", "rank", "keyword", F.round("score", 6).alias("score"))


@query(
    "keyword_mmr_documents",
    f"""WITH RECURSIVE {fr.VECTOR_KEYWORDS},
        pool AS (SELECT doc_id AS query_id, rank, keyword AS item, score, u AS v FROM vranked WHERE rank <= 40),
        {fr.mmr("pool", 20, 0.7)}
        SELECT query_id AS doc_id, rank, item AS keyword, round(score, 6) AS score FROM picked""",
)
def keyword_mmr_documents(spark, sf):
    docs = fx.raw_docs(spark, sf)
    vectors = train_embeddings(fx.docs(spark, sf), fx.STOPS, size=fr.DIMENSIONS)
    ranked = kw.keyword_extract_by_vectors(docs, vectors, fr.DIMENSIONS, fx.STOPS, top_n=40)
    picked = kw.keyword_mmr(ranked, top_n=20, diversity=0.7, query_id="doc_id", item_id="keyword", together=True)
    return picked.withColumn("score", F.round("score", 6))


@query(
    "pattern_entities",
    f"WITH {fr.PATTERN_ENTITIES[1:]} SELECT doc_id, ord, text, label, score, category FROM pattern_entities",
)
def pattern_entities(spark, sf):
    found = en.pattern_entities(fx.docs(spark, sf).select("doc_id", "text"), fx.pattern_lexicon)
    order = {k.title(): i for i, k in enumerate(fx.pattern_lexicon.keywords)}
    ords = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    rows = found.select("doc_id", F.inline("pattern_entities"))
    return rows.select("doc_id", ords[F.col("text")].alias("ord"), "text", "label", "score", "category")


_FOUND = "doc_id, start::INTEGER AS start, words, text, label, score"


@query("model_entities", f"WITH {fr.MODEL_ENTITIES} SELECT {_FOUND} FROM model_entities")
def model_entities(spark, sf):
    return en.model_entities(fx.docs(spark, sf), fx.dictionary(spark, sf))


@query(
    "categorize_entity",
    f"WITH {fr.MODEL_ENTITIES} SELECT doc_id, start::INTEGER AS start, words, category, category <> 'other' AS is_related FROM model_entities",
)
def categorize_entity(spark, sf):
    found = en.model_entities(fx.docs(spark, sf), fx.dictionary(spark, sf))
    named = en.with_categories(found, fx.pattern_lexicon, fx.facet_lexicon)
    return named.select("doc_id", "start", "words", "category", "is_related")


@query(
    "entity_rollup",
    f"""WITH {fr.ENTITIES} SELECT doc_id, category, count(*)::INTEGER AS entities,
          string_agg(text, '|' ORDER BY part, pos, words) AS texts,
          (sum(count(*)) OVER (PARTITION BY doc_id))::INTEGER AS total_entities FROM entities GROUP BY doc_id, category""",
)
def entity_rollup(spark, sf):
    listed = en.document_entities(fx.docs(spark, sf), fx.dictionary(spark, sf), fx.pattern_lexicon, fx.facet_lexicon)
    rolled = en.entity_rollup(listed)
    rows = rolled.select("doc_id", "total_entities", F.explode("categories").alias("category", "es"))
    return rows.select(
        "doc_id",
        "category",
        F.size("es").alias("entities"),
        F.array_join(F.transform("es", lambda e: e["text"]), "|").alias("texts"),
        "total_entities",
    )


@query(
    "facet_scores",
    f"""WITH {fr.FACETS} SELECT doc_id, facet, option, len(mentions)::INTEGER AS score,
          round(least(len(mentions)::DOUBLE / size, 1.0), 6) AS confidence, array_to_string(mentions, ',') AS mentions FROM facets""",
)
def facet_scores(spark, sf):
    rows = facet_rows(fx.docs(spark, sf), fx.facet_lexicon)
    return rows.select(
        "doc_id", "facet", "option", "score", F.round("confidence", 6).alias("confidence"), F.array_join("mentions", ",").alias("mentions")
    )


@query(
    "topics",
    f"""WITH {fr.topics()},{fr.TOPIC_WORDS}
        SELECT topic_id, topic_size, rank::INTEGER AS rank, word, round(weight, 6) AS weight, 'Topic_' || topic_id AS topic_name,
          (SELECT count(*) FROM tsizes) AS total_topics FROM twords WHERE rank <= 8""",
)
def topics(spark, sf):
    return corpus_topics(fx.docs(spark, sf), fx.STOPS).withColumn("weight", F.round("weight", 6))


@query(
    "topic_of_documents",
    f"WITH {fr.topics()} SELECT doc_id, coalesce(topic_id, -1)::INTEGER AS topic_id FROM documents LEFT JOIN assigned USING (doc_id)",
)
def topic_of_documents(spark, sf):
    """The topic of each document, outliers included, by the fitted model inside the row."""
    docs = fx.docs(spark, sf)
    model, _ = fit_topics(docs, fx.STOPS)
    return assign_topics(docs, model).select("doc_id", "topic_id")


_FLAT = ", ".join(
    f"CASE WHEN {fr.any_of('lower(text)', ks)} THEN '{f}.{o}:' || array_to_string({fr.hits('lower(text)', ks)}, ',') END"
    for f, o, ks in fr.facet_options()
)


@query(
    "analyze_documents",
    f"""WITH {fr.KEYWORDS}, {fr.sentiment()}, {fr.ENTITIES},
        k AS (SELECT doc_id, count(*)::INTEGER AS total_keywords, string_agg(keyword, '|' ORDER BY rank) AS keywords FROM keywords GROUP BY doc_id),
        e AS (SELECT doc_id, count(*)::INTEGER AS total_entities,
                string_agg(text || '/' || category, '|' ORDER BY part, pos, words) AS entities FROM entities GROUP BY doc_id)
        SELECT doc_id, source AS filename, md5({fr.PREVIEW}) AS preview, sentiment AS overall_sentiment,
          round(confidence, 6) AS confidence, coalesce(total_keywords, 0) AS total_keywords, coalesce(keywords, '') AS keywords,
          coalesce(total_entities, 0) AS total_entities, coalesce(entities, '') AS entities, concat_ws(' ', {_FLAT}) AS facets
        FROM documents JOIN sentiments USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN e USING (doc_id)""",
)
def analyze_documents(spark, sf):
    done = analyze(fx.docs(spark, sf), fx.config(spark, sf))
    facets = F.concat_ws(
        " ",
        *[
            F.concat(F.lit(f"{f}.{o}:"), F.array_join(F.col("facets")[f][o]["mentions"], ","))
            for f, options in fx.FACETS.items()
            for o in options
        ],
    )
    return done.select(
        "doc_id",
        "filename",
        F.md5("text_preview").alias("preview"),
        "sentiment.overall_sentiment",
        F.round("sentiment.confidence", 6).alias("confidence"),
        "total_keywords",
        F.array_join(F.transform("keywords", lambda k: k["keyword"]), "|").alias("keywords"),
        F.size("entities").alias("total_entities"),
        F.array_join(F.transform("entities", lambda e: F.concat(e["text"], F.lit("/"), e["category"])), "|").alias("entities"),
        facets.alias("facets"),
    )


_FAILED = "CASE WHEN doc_id % 10 = 0 THEN '{} failed: {}' END AS {}_error"


@query(
    "analyze_documents_errors",
    f"""WITH {fr.topics()}
        SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN -2 ELSE coalesce(topic_id, -1) END::INTEGER AS topic_id,
          {_FAILED.format("sentiment analysis", "no text or unknown label", "sentiment")}, {_FAILED.format("keyword extraction", "no text", "keywords")},
          {_FAILED.format("entity recognition", "no text", "entities")}, {_FAILED.format("facet analysis", "no text", "facets")},
          {_FAILED.format("topic modelling", "no text", "topic")}
        FROM documents LEFT JOIN assigned USING (doc_id)""",
)
def analyze_documents_errors(spark, sf):
    """Topics by a fitted model, and a message for each part of the documents that lost their text."""
    docs = fx.docs(spark, sf)
    model, _ = fit_topics(docs, fx.STOPS)
    broken = docs.withColumn("text", F.when(F.col("doc_id") % 10 != 0, F.col("text")))
    done = analyze(broken, replace(fx.config(spark, sf), topics=model))
    return done.select("doc_id", F.coalesce("topic_id", F.lit(-2)).alias("topic_id"), *[F.col("errors")[p].alias(f"{p}_error") for p in ("sentiment", "keywords", "entities", "facets", "topic")])
