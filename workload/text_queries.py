"""Scalar text functions and filters."""

from pyspark.sql import functions as F

from corpusdeck import defaults
from corpusdeck.functions.arrays import bind
from corpusdeck.functions import text as tx
from corpusdeck.operators import filters as fl
from corpusdeck.operators.keywords import keyword_extract
from corpusdeck.sources.pages import html_text
from corpusdeck.sources.tables import read_table
from workload import fixtures as fx
from workload import fragments as fr
from workload.registry import query

W, S = fr.WORD, fr.SPACE


@query(
    "clean_text",
    rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[{S}]+', ' ', 'g'),
         '[^{W}{S}.,!?;:()-]', '', 'g'), ' ') AS cleaned FROM documents""",
)
def clean_text(spark, sf):
    return fx.docs(spark, sf).select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@query(
    "clean_text_pages",
    rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(
           regexp_replace(text, '\n[{S}]*\p{{Nd}}+[{S}]*\n', chr(10), 'g'), '[{S}]+', ' ', 'g'),
         '[^{W}{S}.,!?;:()-]', '', 'g'), ' ') AS cleaned FROM documents""",
)
def clean_text_pages(spark, sf):
    return fx.docs(spark, sf).select("doc_id", tx.clean_text(F.col("text"), strip_page_numbers=True).alias("cleaned"))


@query(
    "clean_lower",
    rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^{W}{S}#@&/-]', ' ', 'g'),
         '[{S}]+', ' ', 'g'), ' ') AS cleaned FROM documents""",
)
def clean_lower(spark, sf):
    return fx.docs(spark, sf).select("doc_id", tx.clean_lower(F.col("text")).alias("cleaned"))


@query(
    "sentence_filter",
    f"""SELECT doc_id, coalesce(array_to_string(list_filter(string_split(text, '.'),
          lambda s: {fr.any_of("lower(s)", fx.SENTENCES)}), '. '), '') AS kept FROM documents""",
)
def sentence_filter(spark, sf):
    kept = fl.sentence_filter(F.col("text"), fx.sentence_lexicon)
    return fx.docs(spark, sf).select("doc_id", kept.alias("kept"))


@query(
    "stopword_filter",
    f"""SELECT doc_id, len(t) AS tokens, md5(array_to_string(t, ' ')) AS digest FROM (
          SELECT doc_id, {fr.without_stops(f"regexp_extract_all(lower(text), '[{W}]+')")} AS t FROM documents)""",
)
def stopword_filter(spark, sf):
    kept = fx.docs(spark, sf).select("doc_id", tx.drop_words(tx.word_tokens(F.lower("text")), fx.STOPS).alias("t"))
    return kept.select("doc_id", F.size("t").cast("bigint").alias("tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


def _default_lexicons_sql():
    lc = "lower(text)"
    counts = [f"len({fr.hits(lc, sorted(set(words)))}) AS {name}" for name, words in _DEFAULT_LEXICONS.items()]
    tokens = f"regexp_extract_all(lower(text), '[{W}]+')"
    kept = f"list_filter({tokens}, lambda w: NOT list_contains({fr.listing(defaults.STOPS)}, w))"
    return f"SELECT doc_id, {', '.join(counts)}, len({kept}) AS content_words FROM documents"


_DEFAULT_LEXICONS = {
    "gate": defaults.GATE,
    "sentence": defaults.SENTENCE,
    "facets": [w for options in defaults.FACETS.values() for words in options.values() for w in words],
    "accessories": [w for words in defaults.ACCESSORIES.values() for w in words] + defaults.ACCESSORY_EXTRAS,
    "patterns": [w for words in defaults.PATTERNS.values() for w in words],
}


@query("default_lexicons", _default_lexicons_sql())
def default_lexicons(spark, sf):
    """Distinct words of each default lexicon in a text, and its words without default stop words."""

    def counted(lc):
        counts = [
            F.size(F.filter(F.array(*[F.lit(w) for w in sorted(set(words))]), lambda w: F.contains(lc, w))).cast("bigint").alias(name)
            for name, words in _DEFAULT_LEXICONS.items()
        ]
        kept = F.size(tx.drop_words(tx.word_tokens(lc), defaults.STOPS)).cast("bigint").alias("content_words")
        return F.struct(*counts, kept)

    # The text is lower-cased once, not for each word of the lexicons.
    return fx.docs(spark, sf).select("doc_id", bind(F.lower("text"), counted).alias("c")).select("doc_id", "c.*")


@query("preview", f"SELECT doc_id, {fr.PREVIEW} AS text_preview FROM documents")
def preview(spark, sf):
    return fx.raw_docs(spark, sf).select("doc_id", tx.preview(F.col("text")).alias("text_preview"))


def _chunk_sql(cap):
    return f"WITH {fr.sentiment(cap)} SELECT doc_id, chunk_no::INTEGER AS chunk_no, chunk FROM chunks"


@query("chunk_text", _chunk_sql(None))
def chunk_text(spark, sf):
    from corpusdeck.operators.sentiment import chunk_rows

    return chunk_rows(fx.docs(spark, sf).select("doc_id", "text"))


@query("chunk_text_first", _chunk_sql(3))
def chunk_text_first(spark, sf):
    """The cap as an argument that a caller gives."""
    from corpusdeck.operators.sentiment import chunk_rows

    return chunk_rows(fx.docs(spark, sf).select("doc_id", "text"), cap=3)


@query("truncate_text", "SELECT doc_id, substring(text, 1, 512) AS model_text, substring(text, 1, 500) AS record_text FROM documents")
def truncate_text(spark, sf):
    return fx.raw_docs(spark, sf).select(
        "doc_id",
        tx.truncate_text(F.col("text"), 512).alias("model_text"),
        tx.truncate_text(F.col("text"), 500).alias("record_text"),
    )


_TITLE = r"""array_to_string(list_transform(regexp_extract_all({c}, '\p{{L}}+|[^\p{{L}}]+'),
  lambda r: upper(r[1]) || lower(r[2:])), '')"""


@query(
    "title_case",
    f"""SELECT p_partkey, {_TITLE.format(c="p_type")} AS type_title,
        {_TITLE.format(c="replace(p_name, ' ', '-') || '3d o''x'")} AS name_title,
        {_TITLE.format(c="replace(replace(p_name, ' ', '_'), '_', ' ')")} AS name_heading FROM part""",
)
def title_case(spark, sf):
    part = read_table(spark, sf, "part")
    hyphened = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("3d o'x"))
    return part.select(
        "p_partkey",
        tx.title_case(F.col("p_type")).alias("type_title"),
        tx.title_case(hyphened).alias("name_title"),
        tx.heading(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name_heading"),
    )


@query(
    "parse_growth_range",
    """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size::DOUBLE END AS low,
         CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 5 = 0 THEN p_size::DOUBLE ELSE p_size + 5.5::DOUBLE END AS high
       FROM part""",
)
def parse_growth_range(spark, sf):
    size = F.col("p_size")
    text = (
        F.when(size % 7 == 0, F.lit("steady"))
        .when(size % 5 == 0, F.concat(size, F.lit("%")))
        .otherwise(F.concat(size, F.lit("-"), size + 5, F.lit(".5% annually")))
    )
    return read_table(spark, sf, "part").select("p_partkey", tx.growth_bounds(text).alias("b")).select("p_partkey", "b.*")


LABEL_SQL = "CASE WHEN toxic = 1 THEN 'NEGATIVE' WHEN quality = 1 THEN 'POSITIVE' WHEN quality = 0 THEN 'NEUTRAL' END"


def label_name():
    return (
        F.when(F.col("toxic") == 1, "NEGATIVE").when(F.col("quality") == 1, "POSITIVE").when(F.col("quality") == 0, "NEUTRAL")
    )


@query(
    "label_to_id",
    f"""SELECT doc_id, label, CASE label WHEN 'NEGATIVE' THEN 0 WHEN 'NEUTRAL' THEN 1 WHEN 'POSITIVE' THEN 2 ELSE -1 END AS label_id
        FROM (SELECT doc_id, coalesce({LABEL_SQL}, 'UNKNOWN') AS label FROM documents LEFT JOIN labels USING (doc_id))""",
)
def label_to_id(spark, sf):
    joined = fx.raw_docs(spark, sf).select("doc_id").join(read_table(spark, sf, "labels"), "doc_id", "left")
    named = joined.select("doc_id", F.coalesce(label_name(), F.lit("UNKNOWN")).alias("label"))
    return named.select("doc_id", "label", F.coalesce(tx.label_id(F.col("label")), F.lit(-1)).alias("label_id"))


@query(
    "report_header",
    """SELECT upper(lang) AS segment, '2024-06-30' AS generation_date, '12 Months' AS forecast_period,
         count(*) AS documents_analyzed, 'FTR-20240630' AS report_id FROM documents GROUP BY lang""",
)
def report_header(spark, sf):
    counts = fx.raw_docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n"))
    header = tx.report_header(fx.as_of(), F.col("n"))
    return counts.select(F.upper("lang").alias("segment"), header.alias("h")).select("segment", "h.*")


_GATE = " + ".join(f"contains(lower(text), '{k}')::INTEGER" for k in fx.GATE)


@query(
    "relevance_gate",
    f"SELECT doc_id, relevance FROM (SELECT doc_id, {_GATE} AS relevance FROM documents) WHERE relevance >= 3",
)
def relevance_gate(spark, sf):
    return fl.relevance_gate(fx.docs(spark, sf), fx.gate_lexicon).select("doc_id", "relevance")


@query("keyword_filter", f"WITH {fr.KEYWORDS} SELECT doc_id, rank::INTEGER AS rank, keyword FROM mentions")
def keyword_filter(spark, sf):
    ranked = keyword_extract(fx.raw_docs(spark, sf), fx.STOPS)
    return fl.keyword_filter(ranked, fx.term_lexicon).select("doc_id", "rank", "keyword")


@query(
    "min_rows_gate",
    """SELECT doc_id, lang FROM documents
       WHERE lang IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= 130)
         AND (SELECT count(*) FROM documents) >= 15""",
)
def min_rows_gate(spark, sf):
    whole = fl.min_rows_gate(fx.raw_docs(spark, sf).select("doc_id", "lang"), 15)
    return fl.min_rows_gate(whole, 130, by="lang", salt="doc_id")


@query(
    "usable_text",
    """SELECT doc_id, length(text) > 20 AS pair_text FROM documents WHERE length(text) > 10""",
)
def usable_text(spark, sf):
    kept = fl.usable_text(fx.raw_docs(spark, sf), 10)
    return kept.select("doc_id", (F.length("text") > 20).alias("pair_text"))


_BARE = r"""trim(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[\s]+', ' ', 'g'), ' ')"""


@query(
    "split_errors",
    f"""SELECT page_id, error, CASE WHEN error IS NULL THEN md5(body) END AS digest FROM (
          SELECT page_id, body, CASE WHEN body = '' OR length(body) <= 200 THEN 'too little text'
            WHEN NOT contains(lower(html), '</html>') THEN 'page is cut off' END AS error
          FROM (SELECT page_id, html, {_BARE} AS body FROM pages))""",
)
def split_errors(spark, sf):
    pages = read_table(spark, sf, "pages").withColumn("body", html_text(F.col("html")))
    checks = {
        "too little text": (F.col("body") != "") & (F.length("body") > 200),
        "page is cut off": F.contains(F.lower("html"), F.lit("</html>")),
    }
    sound = F.when(F.col("error").isNull(), F.md5("body"))
    return fl.flag_errors(pages, checks).select("page_id", "error", sound.alias("digest"))
