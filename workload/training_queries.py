"""Training sets, models and metrics."""

from pyspark.sql import functions as F

from corpusdeck.functions.text import label_id
from corpusdeck.operators import embeddings as em
from corpusdeck.operators import metrics as mt
from corpusdeck.operators import modeling as md
from corpusdeck.operators import similar as sm
from corpusdeck.operators import training as tr
from corpusdeck.operators.entities import with_hits
from corpusdeck.operators.sentiment import chunk_rows, roll_up_chunks
from corpusdeck.sources.tables import read_table
from workload import fixtures as fx
from workload import fragments as fr
from workload.registry import query
from workload.rollup_queries import RECORDS, records
from workload.text_queries import LABEL_SQL, label_name


def labelled(spark, sf):
    """``(doc_id, text, sentiment)`` of the labelled documents."""
    labels = read_table(spark, sf, "labels").select("doc_id", label_name().alias("sentiment"))
    return fx.docs(spark, sf).select("doc_id", "text").join(labels, "doc_id")


@query("collect_training", f"WITH {RECORDS} SELECT type, text, sentiment, confidence, category, score, source_file, timestamp FROM records")
def collect_training(spark, sf):
    return records(spark, sf).withColumn("confidence", F.round("confidence", 6))


@query(
    "collect_training_first",
    f"""WITH {RECORDS} SELECT type, CASE WHEN type = 'sentiment' THEN substring(text, 1, 500) ELSE text END AS text, sentiment, confidence,
          category, score, source_file, timestamp FROM records""",
)
def collect_training_first(spark, sf):
    """Records that carry the first 500 characters alone."""
    return records(spark, sf, 500).withColumn("confidence", F.round("confidence", 6))


_LABELLED = f"labelled AS (SELECT doc_id, text, {LABEL_SQL} AS sentiment FROM documents JOIN labels USING (doc_id))"
_LABEL_ID = "CASE sentiment WHEN 'NEGATIVE' THEN 0 WHEN 'NEUTRAL' THEN 1 WHEN 'POSITIVE' THEN 2 END"


@query(
    "sentiment_dataset",
    f"""WITH {_LABELLED}, kept AS (SELECT text, sentiment FROM labelled WHERE length(text) > 10),
        few AS (SELECT text, sentiment FROM kept WHERE contains(text, 'qqq'))
        SELECT 'enough' AS sample, text, {_LABEL_ID} AS label FROM kept
        UNION ALL SELECT 'few', text, {_LABEL_ID} FROM few
        UNION ALL SELECT 'few', text, {_LABEL_ID} FROM (VALUES {", ".join(f"('{t}', '{s}')" for t, s in fx.SYNTHETIC_SENTIMENT)}) v(text, sentiment)
        WHERE (SELECT count(*) FROM few) < 10""",
)
def sentiment_dataset(spark, sf):
    rows = labelled(spark, sf).select("text", "sentiment")
    synthetic = spark.createDataFrame(fx.SYNTHETIC_SENTIMENT, "text string, sentiment string")
    enough = tr.sentiment_dataset(rows, synthetic)
    few = tr.sentiment_dataset(rows.filter(F.contains("text", F.lit("qqq"))), synthetic)
    return enough.withColumn("sample", F.lit("enough")).unionByName(few.withColumn("sample", F.lit("few")))


@query(
    "tokenize_pad",
    rf"""WITH toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[{fr.WORD}]+') AS w FROM documents),
        vocab AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) + 1 AS id FROM (
          SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM toks) GROUP BY word) ORDER BY n DESC, word LIMIT 2000),
        pos AS (SELECT doc_id, unnest(w[1:256]) AS word, unnest(range(1, len(w[1:256]) + 1)) AS p FROM toks),
        ids AS (SELECT doc_id, string_agg(coalesce(id, 1)::VARCHAR, ' ' ORDER BY p) AS s, count(*) AS n FROM pos LEFT JOIN vocab USING (word) GROUP BY doc_id)
        SELECT doc_id, coalesce(s, '') || CASE WHEN s IS NULL THEN repeat(' 0', 256)[2:] ELSE repeat(' 0', 256 - coalesce(n, 0)::INTEGER) END AS input_ids,
               coalesce(n, 0) AS used FROM documents LEFT JOIN ids USING (doc_id)""",
)
def tokenize_pad(spark, sf):
    docs = fx.raw_docs(spark, sf)
    ids = tr.tokenize_pad(docs, tr.vocabulary(fx.docs(spark, sf), 2_000))
    used = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return ids.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"), used.alias("used"))


def tag_input(spark, sf):
    """Lower-cased documents with the dictionary phrases found in them as entities."""
    docs = fx.docs(spark, sf).select("doc_id", F.lower("text").alias("text"))
    found = with_hits(docs, fx.dictionary(spark, sf))
    entities = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["text"])))
    return found.withColumn("entities", entities).drop("hits").filter(F.size("entities") > 0)


TAGS = ("B-FASHION", "I-FASHION", "O")


def tagged(spark, sf):
    return tr.bio_tags(tag_input(spark, sf))


_TAGGED = f"""{fr.MODEL_ENTITIES[1:]},
ents AS (SELECT DISTINCT doc_id, lower(text) AS phrase FROM model_entities),
wtoks AS (SELECT doc_id, regexp_extract_all(lower(text), '[^{fr.SPACE}]+') AS w FROM documents
          WHERE doc_id IN (SELECT doc_id FROM ents)),
wwords AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM wtoks),
two AS (SELECT doc_id, p, t, lead(t) OVER (PARTITION BY doc_id ORDER BY p) AS u FROM wwords),
hit AS (SELECT doc_id, p AS start, phrase, 2 AS n FROM two JOIN ents USING (doc_id) WHERE phrase = t || ' ' || u
        UNION ALL SELECT doc_id, p, phrase, 1 FROM two JOIN ents USING (doc_id) WHERE phrase = t),
cover AS (SELECT doc_id, start + k AS p, phrase, start FROM hit, range(2) r(k) WHERE k < n),
best AS (SELECT doc_id, p, max((phrase, start)) AS m FROM cover GROUP BY ALL),
tags AS (SELECT doc_id, p, t, CASE WHEN m IS NULL THEN 'O' WHEN m[2] = p THEN 'B-FASHION' ELSE 'I-FASHION' END AS tag
         FROM wwords LEFT JOIN best USING (doc_id, p))"""


@query(
    "bio_tags",
    f"""WITH {_TAGGED} SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS tokens, string_agg(tag, ' ' ORDER BY p) AS ner_tags FROM tags GROUP BY doc_id""",
)
def bio_tags(spark, sf):
    rows = tagged(spark, sf)
    return rows.select("doc_id", F.array_join("tokens", " ").alias("tokens"), F.array_join("ner_tags", " ").alias("ner_tags"))


_PIECES = f"""{_TAGGED},
pieces AS (SELECT doc_id, p, tag, t, unnest(range(0, greatest(1, ceil(length(t) / 4.0)::INTEGER))) AS j FROM tags),
numbered AS (SELECT doc_id, substring(t, j * 4 + 1, 4) AS piece,
   CASE WHEN j > 0 THEN -100 WHEN tag = 'B-FASHION' THEN 0 WHEN tag = 'I-FASHION' THEN 1 ELSE 2 END AS label,
   length(t) AS width, row_number() OVER (PARTITION BY doc_id ORDER BY p, j) AS i FROM pieces),
kept AS (SELECT * FROM numbered WHERE i <= 128)"""


@query(
    "align_subtokens",
    f"""WITH {_PIECES} SELECT doc_id, string_agg(piece, ' ' ORDER BY i) || repeat(' [PAD]', 128 - count(*)::INTEGER) AS pieces,
          string_agg(label::VARCHAR, ' ' ORDER BY i) || repeat(' -100', 128 - count(*)::INTEGER) AS labels FROM kept GROUP BY doc_id""",
)
def align_subtokens(spark, sf):
    rows = tr.align_subtokens(tagged(spark, sf), TAGS)
    return rows.select("doc_id", F.array_join("pieces", " ").alias("pieces"), F.array_join("labels", " ").alias("labels"))


_LEARNED = "|".join(sorted(fx.PIECES, key=lambda p: (-len(p), p))) + "|[\\s\\S]"

_PIECES_GIVEN = f"""{_TAGGED},
split AS (SELECT doc_id, p, tag, regexp_extract_all(t, '{_LEARNED}') AS w FROM tags WHERE p < 128),
pieces AS (SELECT doc_id, p, tag, unnest(w) AS piece, unnest(range(len(w))) AS j FROM split),
numbered AS (SELECT doc_id, piece, CASE WHEN j > 0 THEN -100 WHEN tag = 'B-FASHION' THEN 0 WHEN tag = 'I-FASHION' THEN 1 ELSE 2 END AS label,
   row_number() OVER (PARTITION BY doc_id ORDER BY p, j) AS i FROM pieces),
kept AS (SELECT * FROM numbered WHERE i <= 128)"""


@query(
    "align_subtokens_pieces",
    f"""WITH {_PIECES_GIVEN} SELECT doc_id, string_agg(piece, ' ' ORDER BY i) || repeat(' [PAD]', 128 - count(*)::INTEGER) AS pieces,
          string_agg(label::VARCHAR, ' ' ORDER BY i) || repeat(' -100', 128 - count(*)::INTEGER) AS labels FROM kept GROUP BY doc_id""",
)
def align_subtokens_pieces(spark, sf):
    """Words split by a given vocabulary of pieces, longest first."""
    rows = tr.align_subtokens(tagged(spark, sf), TAGS, tr.longest_match_pieces(fx.PIECES))
    return rows.select("doc_id", F.array_join("pieces", " ").alias("pieces"), F.array_join("labels", " ").alias("labels"))


@query(
    "bio_tags_floor",
    f"""WITH {_TAGGED}, few AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS tokens, string_agg(tag, ' ' ORDER BY p) AS ner_tags FROM tags
          JOIN documents USING (doc_id) WHERE contains(text, 'qqq') GROUP BY doc_id)
        SELECT * FROM few UNION ALL SELECT -1, 'silk coat', 'B-FASHION O' WHERE (SELECT count(*) FROM few) < 10""",
)
def bio_tags_floor(spark, sf):
    """Synthetic rows are added where fewer than ten documents have tags."""
    synthetic = spark.createDataFrame(fx.SYNTHETIC_TAGS, "doc_id long, tokens array<string>, ner_tags array<string>")
    rows = tr.bio_tags(tag_input(spark, sf).filter(F.contains("text", F.lit("qqq"))), synthetic)
    return rows.select("doc_id", F.array_join("tokens", " ").alias("tokens"), F.array_join("ner_tags", " ").alias("ner_tags"))


@query(
    "train_test_split",
    """SELECT doc_id, CASE WHEN ('0x' || substring(md5('42:' || doc_id), 1, 8))::BIGINT % 100 < 20 THEN 'test' ELSE 'train' END AS split
       FROM documents""",
)
def train_test_split(spark, sf):
    return tr.train_test_split(fx.raw_docs(spark, sf).select("doc_id"))


_HASHES = sm.hash_factors(sm.BANDS * sm.ROWS)
_MINS = ", ".join(f"min(({a} * x + {b}) % {sm.PRIME}) AS m{j}" for j, (a, b) in enumerate(_HASHES))
_BAND_MINS = ", ".join(
    "m%d || ',' || m%d || ',' || m%d" % tuple(range(b * sm.ROWS, (b + 1) * sm.ROWS)) for b in range(sm.BANDS)
)

_PARTNERS = f"""
texts AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[{fr.WORD}]+') AS w FROM documents WHERE length(text) > 20),
shingles AS (
  SELECT DISTINCT doc_id, ('0x' || substr(md5(g), 1, 15))::BIGINT AS s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                               ELSE [array_to_string(w, ' ')] END) AS g FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, ',' ORDER BY s)) AS digest FROM shingles GROUP BY doc_id),
members AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY digest) AS head FROM sizes),
equals AS (
  SELECT doc_id, head AS other, 1.0::DOUBLE AS similarity FROM members WHERE doc_id > head
  UNION ALL SELECT head, min(doc_id), 1.0 FROM members WHERE doc_id > head GROUP BY head),
signs AS (SELECT doc_id, {_MINS} FROM (SELECT doc_id, s % {sm.PRIME} AS x FROM shingles) GROUP BY doc_id),
bands AS (SELECT doc_id, unnest(range({sm.BANDS})) AS band, unnest([{_BAND_MINS}]) AS mins FROM signs WHERE doc_id IN (SELECT head FROM members)),
heads AS (SELECT band, mins, min(doc_id) AS other FROM bands GROUP BY ALL),
met AS (SELECT DISTINCT doc_id, other FROM bands JOIN heads USING (band, mins) WHERE doc_id > other),
shared AS (SELECT m.doc_id, m.other, count(*) AS n FROM met m JOIN shingles a ON a.doc_id = m.doc_id JOIN shingles b ON b.doc_id = m.other AND b.s = a.s GROUP BY ALL),
verified AS (
  SELECT h.doc_id, h.other, h.n / (a.n + b.n - h.n)::DOUBLE AS similarity FROM shared h JOIN sizes a ON a.doc_id = h.doc_id JOIN sizes b ON b.doc_id = h.other),
linked AS (
  SELECT * FROM equals UNION ALL SELECT doc_id, other, similarity FROM verified WHERE similarity >= 0.8
  UNION ALL SELECT other, doc_id, similarity FROM verified WHERE similarity >= 0.8),
partners AS (SELECT doc_id, min((-similarity, other)) AS b FROM linked GROUP BY doc_id)"""


@query(
    "positive_pairs",
    f"""WITH {_PARTNERS}
       SELECT t.doc_id, md5(t.text) AS anchor, md5(coalesce(o.text, t.text)) AS positive, coalesce(b[2], t.doc_id) AS positive_key,
         round(coalesce(-b[1], 1), 6) AS similarity,
         ('0x' || substring(md5(t.doc_id::VARCHAR), 1, 8))::BIGINT % greatest(ceil((SELECT count(*) FROM texts) / 8.0)::BIGINT, 1) AS batch
       FROM texts t LEFT JOIN partners p USING (doc_id) LEFT JOIN texts o ON o.doc_id = b[2]""",
)
def positive_pairs(spark, sf):
    return digested(tr.positive_pairs(fx.raw_docs(spark, sf)))


def digested(pairs):
    return pairs.select(
        "doc_id", F.md5("anchor").alias("anchor"), F.md5("positive").alias("positive"), "positive_key", F.round("similarity", 6).alias("similarity"), "batch"
    )


_SYNTHETIC_PAIRS = [(-1 - k, t) for k, (t, _) in enumerate(fx.SYNTHETIC_SENTIMENT)]


@query(
    "positive_pairs_floor",
    f"""WITH few AS (SELECT doc_id, text FROM documents WHERE length(text) > 20 AND contains(text, 'qqq')),
       chosen AS (SELECT * FROM few WHERE (SELECT count(*) FROM few) >= 10
         UNION ALL SELECT * FROM (VALUES {", ".join(f"({k}, '{t}')" for k, t in _SYNTHETIC_PAIRS)}) v(doc_id, text) WHERE (SELECT count(*) FROM few) < 10)
       SELECT doc_id::BIGINT AS doc_id, md5(text) AS anchor, md5(text) AS positive, doc_id::BIGINT AS positive_key, 1.0::DOUBLE AS similarity,
         ('0x' || substring(md5(doc_id::VARCHAR), 1, 8))::BIGINT % greatest(ceil((SELECT count(*) FROM chosen) / 8.0)::BIGINT, 1) AS batch FROM chosen""",
)
def positive_pairs_floor(spark, sf):
    """The synthetic texts stand in where fewer than ten documents are usable."""
    synthetic = spark.createDataFrame(_SYNTHETIC_PAIRS, "doc_id long, text string")
    few = fx.raw_docs(spark, sf).filter(F.contains("text", F.lit("qqq")))
    return digested(tr.positive_pairs(few, synthetic))


@query(
    "train_sentiment",
    f"""WITH {_LABELLED}, parts AS (SELECT *, ('0x' || substring(md5('42:' || doc_id), 1, 8))::BIGINT % 100 AS bucket, {_LABEL_ID} AS label FROM labelled),
        counts AS (SELECT label, count(*) AS n FROM parts WHERE bucket < 20 GROUP BY label)
        SELECT count(*) FILTER (bucket >= 30) AS train_rows, count(*) FILTER (bucket BETWEEN 20 AND 29) AS choice_rows,
          count(*) FILTER (bucket < 20) AS test_rows, round((SELECT max(n)::DOUBLE / sum(n) FROM counts), 6) AS majority,
          3 AS epochs, '2024-06-30T12:00:00' AS training_date FROM parts""",
)
def train_sentiment(spark, sf):
    """Sizes of the splits, the share that a constant answer gets right, and the run's parameters; the
    tests hold the accuracy against that share."""
    rows = labelled(spark, sf)
    ids = rows.select("doc_id", "text", label_id(F.col("sentiment")).alias("label"))
    _, report = md.train_sentiment(ids, fx.as_of())
    return report.select("train_rows", "choice_rows", "test_rows", F.round("majority", 6).alias("majority"), "epochs", "training_date")


_WEIGHTS = [[((7 * i + 3 * j) % 5 - 2) / 8 for j in range(64)] for i in range(3)]


def linear_model():
    """Three classes over 64 numbers; loaded once in a worker."""
    import numpy as np

    weights = np.array([[((7 * i + 3 * j) % 5 - 2) / 8 for j in range(64)] for i in range(3)])
    return lambda batch: batch @ weights.T


@query(
    "score_own_model",
    f"""WITH s AS (SELECT vec_id, [{", ".join(f"list_dot_product(embedding::DOUBLE[], {w}::DOUBLE[])" for w in _WEIGHTS)}] AS p FROM embeddings)
        SELECT vec_id, ['LOW', 'MIDDLE', 'HIGH'][list_position(p, list_max(p))] AS label, round(list_max(p), 6) AS score FROM s""",
)
def score_own_model(spark, sf):
    items = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    scored = md.score_with(items, linear_model, ("LOW", "MIDDLE", "HIGH"), 64, "embedding")
    return scored.select("vec_id", "label", F.round("score", 6).alias("score"))


@query("score_batch")
def score_batch(spark, sf):
    rows = labelled(spark, sf)
    ids = rows.select("doc_id", "text", label_id(F.col("sentiment")).alias("label"))
    model, _ = md.train_sentiment(ids, fx.as_of(), epochs=1)
    chunks = chunk_rows(fx.docs(spark, sf).select("doc_id", "text")).withColumnRenamed("chunk", "text")
    return roll_up_chunks(md.score_batch(chunks, model)).select("doc_id", "sentiment.overall_sentiment", "sentiment.confidence")


@query(
    "cooccurrence",
    f"""WITH {fr.WORD_VECTORS} SELECT word, count(*) AS contexts, sum(n)::BIGINT AS total, max(n) AS most, max((n, context))[2] AS context FROM near GROUP BY word""",
)
def cooccurrence(spark, sf):
    near = em.cooccurrence(em.word_pairs(fx.docs(spark, sf), fx.STOPS))
    top = F.max(F.struct("n", "context"))
    return near.groupBy("word").agg(F.count("*").alias("contexts"), F.sum("n").alias("total"), F.max("n").alias("most"), top["context"].alias("context"))


def word_vectors(spark, sf):
    return em.train_embeddings(fx.docs(spark, sf), fx.STOPS, size=fr.DIMENSIONS)


@query(
    "train_embeddings",
    f"""WITH {fr.WORD_VECTORS} SELECT word, n, round(sqrt(list_sum(list_transform(vector, lambda x: x * x))), 6) AS norm,
          list_transform(vector, lambda x: round(x, 6)) AS vector FROM vectors""",
)
def train_embeddings(spark, sf):
    vectors = word_vectors(spark, sf)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return vectors.select("word", "n", F.round(norm, 6).alias("norm"), F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query(
    "embed_documents",
    f"""WITH {fr.WORD_VECTORS},
        met AS (SELECT doc_id, count(*) AS known, [{", ".join(f"round(avg(vector[{j + 1}]), 6)" for j in range(fr.DIMENSIONS))}] AS embedding
                FROM (SELECT doc_id, unnest(w) AS word FROM vtoks) JOIN vectors USING (word) GROUP BY doc_id)
        SELECT doc_id, embedding FROM documents LEFT JOIN met USING (doc_id)""",
)
def embed_documents(spark, sf):
    docs = fx.docs(spark, sf).select("doc_id", "text")
    found = em.embed_documents(docs, word_vectors(spark, sf), fr.DIMENSIONS, fx.STOPS)
    return found.select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query(
    "train_tagger",
    f"""WITH {_TAGGED},
        inside AS (SELECT *, sum(CASE WHEN tag = 'B-FASHION' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM tags WHERE tag <> 'O'),
        runs AS (SELECT doc_id, span, string_agg(t, ' ' ORDER BY p) AS phrase FROM inside GROUP BY doc_id, span),
        counts AS (SELECT phrase, CASE WHEN source < 'src2' THEN 'FASHION' ELSE 'STYLE' END AS label, count(*) AS n FROM runs JOIN documents USING (doc_id) GROUP BY ALL)
        SELECT phrase, max((n, label))[2] AS label, round(max(n)::DOUBLE / sum(n), 6) AS score FROM counts GROUP BY phrase""",
)
def train_tagger(spark, sf):
    """Phrases whose tag depends on the source: a phrase may have both, and takes the more frequent."""
    rows = tag_input(spark, sf).join(fx.docs(spark, sf).select("doc_id", "source"), "doc_id")
    kinds = [tr.bio_tags(rows.filter(own), kind=k) for k, own in (("FASHION", F.col("source") < "src2"), ("STYLE", F.col("source") >= "src2"))]
    return md.train_tagger(kinds[0].unionByName(kinds[1])).withColumn("score", F.round("score", 6))


_PRED = """WITH p AS (SELECT label, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS predicted FROM embeddings),
  c AS (SELECT c, count(*) FILTER (label = c) AS support, count(*) FILTER (predicted = c) AS called,
          count(*) FILTER (label = c AND predicted = c) AS hits FROM p, (SELECT DISTINCT label AS c FROM embeddings) GROUP BY c)"""


@query(
    "classification_metrics",
    f"""{_PRED} SELECT round((SELECT sum(hits) FROM c)::DOUBLE / (SELECT count(*) FROM p), 6) AS accuracy,
          round(sum(support * CASE WHEN support + called = 0 THEN 0 ELSE 2.0::DOUBLE * hits / (support + called) END) / sum(support), 6) AS f1 FROM c""",
)
def classification_metrics(spark, sf):
    rows = read_table(spark, sf, "embeddings").select(F.slice("embedding", 1, 10).alias("scores"), "label")
    m = mt.classification_metrics(rows)
    return m.select(F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


@query(
    "token_accuracy",
    f"""WITH {_PIECES} SELECT count(*) AS tokens, round(avg(CASE WHEN label = (CASE WHEN length(piece) < 3 THEN 0 ELSE 2 END) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy
        FROM kept WHERE label <> -100""",
)
def token_accuracy(spark, sf):
    rows = tr.align_subtokens(tagged(spark, sf), TAGS)
    # Class scores of a fixed rule: short pieces open a phrase, all others are outside.
    scores = F.transform(
        "pieces", lambda p: F.array(F.when(F.length(p) < 3, 1.0).otherwise(0.0), F.lit(0.2), F.lit(0.5))
    )
    guessed = mt.token_argmax(rows.withColumn("scores", scores))
    m = mt.token_accuracy(guessed)
    return m.select("tokens", F.round("accuracy", 6).alias("accuracy"))
