"""SQL building blocks shared by the oracle queries (DuckDB dialect)."""

from __future__ import annotations

from workload import fixtures as fx

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"


def listing(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def hits(lc: str, words) -> str:
    """The words of the list that occur in ``lc``."""
    return f"list_filter({listing(words)}, lambda k: contains({lc}, k))"


def any_of(lc: str, words) -> str:
    return f"len({hits(lc, words)}) > 0"


def without_stops(tokens: str) -> str:
    return f"list_filter({tokens}, lambda w: NOT list_contains({listing(fx.STOPS)}, w))"


CANDIDATES = f"""
cand AS (SELECT doc_id, {without_stops(f"regexp_extract_all(lower(text), '[{WORD}]{{2,}}')")} AS w FROM documents),
grams AS (
  SELECT doc_id, unnest(w) AS keyword FROM cand
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM cand)"""

KEYWORDS = f"""{CANDIDATES},
tf AS (SELECT doc_id, keyword, count(*) AS tf FROM grams GROUP BY ALL),
spread AS (SELECT keyword, count(*) AS df FROM tf GROUP BY ALL),
weighed AS (
  SELECT doc_id, keyword, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS weight
  FROM tf JOIN spread USING (keyword)),
ranked AS (
  SELECT doc_id, keyword, weight, sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS norm,
         row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, keyword) AS rank
  FROM weighed),
keywords AS (SELECT doc_id, rank, keyword, weight / norm AS score FROM ranked WHERE rank <= 20),
mentions AS (SELECT * FROM keywords WHERE {any_of("lower(keyword)", fx.TERMS)})"""


def sentiment(cap: int | None = None) -> str:
    chunks = "greatest(1, CAST(ceil(length(text) / 500.0) AS INTEGER))"
    n = chunks if cap is None else f"least({cap}, {chunks})"
    return f"""
numbered AS (SELECT doc_id, text, unnest(range({n})) AS chunk_no FROM documents),
chunks AS (SELECT doc_id, chunk_no, substring(text, chunk_no * 500 + 1, 500) AS chunk FROM numbered),
counted AS (
  SELECT doc_id, chunk_no,
         len(list_filter(toks, lambda t: list_contains({listing(fx.POSITIVE)}, t))) AS p,
         len(list_filter(toks, lambda t: list_contains({listing(fx.NEGATIVE)}, t))) AS n
  FROM (SELECT doc_id, chunk_no, regexp_extract_all(lower(chunk), '[{WORD}]+') AS toks FROM chunks)),
judged AS (
  SELECT doc_id, CASE WHEN p > n THEN 'POSITIVE' WHEN n > p THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label,
         CASE WHEN p = n THEN 0.5::DOUBLE ELSE greatest(p, n)::DOUBLE / (p + n) END AS score
  FROM counted),
summed AS (
  SELECT doc_id, count(*) AS chunks,
         round(sum(CASE WHEN label = 'POSITIVE' THEN score ELSE 0 END), 9) AS positive,
         round(sum(CASE WHEN label = 'NEGATIVE' THEN score ELSE 0 END), 9) AS negative,
         round(sum(CASE WHEN label = 'NEUTRAL' THEN score ELSE 0 END), 9) AS neutral
  FROM judged GROUP BY doc_id),
sentiments AS (
  SELECT doc_id, positive, negative, neutral,
         CASE WHEN positive >= greatest(negative, neutral) THEN 'POSITIVE'
              WHEN negative >= neutral THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment,
         greatest(positive, negative, neutral) / chunks AS confidence
  FROM summed)"""


def category_case(lc: str) -> str:
    rules = [(f"fashion_{c}", ks) for c, ks in fx.PATTERNS.items()]
    rules += [(f"{f}_{o}", ks) for f, options in fx.FACETS.items() for o, ks in options.items()]
    whens = " ".join(f"WHEN {any_of(lc, ks)} THEN '{name}'" for name, ks in rules)
    return f"CASE {whens} ELSE lower(label) END"


DICTIONARY = f"""
dictionary AS (
  SELECT phrase, CASE WHEN max(pair) = 1 THEN 'PAIR' ELSE 'NAME' END AS label,
         CASE WHEN max(pair) = 1 THEN 0.8::DOUBLE ELSE 0.95::DOUBLE END AS score
  FROM (SELECT lower(array_to_string(regexp_extract_all(text, '[{WORD}]+')[1:2], ' ')) AS phrase, 0 AS pair FROM benchmark
        UNION ALL SELECT unnest({listing(fx.PAIRS)}), 1)
  GROUP BY phrase)"""
MODEL_ENTITIES = f"""{DICTIONARY},
toks AS (SELECT doc_id, regexp_extract_all(text, '[{WORD}]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS a, unnest(range(len(w))) AS start FROM toks),
near AS (
  SELECT doc_id, start, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY start)),
spans AS (
  SELECT doc_id, start, 1 AS words, a AS text FROM near
  UNION ALL SELECT doc_id, start, 2, a || ' ' || b FROM near WHERE b IS NOT NULL
  UNION ALL SELECT doc_id, start, 3, a || ' ' || b || ' ' || c FROM near WHERE c IS NOT NULL),
found AS (
  SELECT doc_id, start, words, text, label, score
  FROM spans JOIN dictionary ON phrase = lower(text)),
model_entities AS (SELECT *, {category_case("lower(text)")} AS category FROM found)"""

_PATTERN_ROWS = ", ".join(
    f"({i}, '{c}', '{k}', '{k.title()}')"
    for i, (c, k) in enumerate((c, k) for c, ks in fx.PATTERNS.items() for k in ks)
)
PATTERN_ENTITIES = f"""
patterns(ord, cat, kw, title) AS (VALUES {_PATTERN_ROWS}),
pattern_entities AS (
  SELECT doc_id, ord, title AS text, 'FASHION' AS label, 0.9::DOUBLE AS score, 'fashion_' || cat AS category
  FROM documents, patterns WHERE contains(lower(documents.text), kw))"""

ENTITIES = f"""{MODEL_ENTITIES},{PATTERN_ENTITIES},
entities AS (
  SELECT doc_id, 0 AS part, start AS pos, words, text, label, score, category FROM model_entities
  UNION ALL SELECT doc_id, 1, ord, 0, text, label, score, category FROM pattern_entities)"""

PREVIEW = "CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END"


def facet_options():
    return [(f, o, ks) for f, options in fx.FACETS.items() for o, ks in options.items()]


FACETS = "facets AS (" + " UNION ALL ".join(
    f"""SELECT doc_id, '{f}' AS facet, '{o}' AS option, {hits("lower(text)", ks)} AS mentions, {len(ks)} AS size
        FROM documents WHERE {any_of("lower(text)", ks)}"""
    for f, o, ks in facet_options()
) + ")"


DIMENSIONS = 32
_SIGN = "(1 - 2 * ((h >> {j}) & 1))"

WORD_VECTORS = f"""
vtoks AS (SELECT doc_id, {without_stops(f"regexp_extract_all(lower(text), '[{WORD}]{{2,}}')")} AS w FROM documents),
vsteps AS (
  SELECT unnest(list_transform(range(1, len(w)), lambda i: {{'a': w[i], 'b': w[i + 1]}})) AS p FROM vtoks
  UNION ALL SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: {{'a': w[i], 'b': w[i + 2]}})) FROM vtoks),
near AS (
  SELECT word, context, count(*) AS n FROM (SELECT p.a AS word, p.b AS context FROM vsteps UNION ALL SELECT p.b, p.a FROM vsteps) GROUP BY ALL),
mass AS (SELECT word, sum(n) AS m FROM near GROUP BY word),
frequent AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM vtoks) GROUP BY word HAVING count(*) >= 5),
ppmi AS (
  SELECT near.word, context, f.n, ('0x' || substr(md5('42:' || context), 1, 8))::BIGINT AS h,
    round(1048576 * ln(near.n::DOUBLE * (SELECT sum(m) FROM mass) / (a.m::DOUBLE * b.m)))::BIGINT AS weight
  FROM near JOIN frequent f ON f.word = near.word JOIN frequent g ON g.word = context
  JOIN mass a ON a.word = near.word JOIN mass b ON b.word = context),
summed AS (
  SELECT word, n, [{", ".join(f"sum(weight * {_SIGN.format(j=j)})::DOUBLE" for j in range(DIMENSIONS))}] AS v
  FROM ppmi WHERE weight > 0 GROUP BY word, n),
vectors AS (
  SELECT word, n, list_transform(v, lambda x: x / norm) AS vector
  FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM summed) WHERE norm > 0)"""


def unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_sum(list_transform({v}, lambda y: y * y))), 1e-300))"


_SUMS = ", ".join(f"sum(vector[{j + 1}])" for j in range(DIMENSIONS))

VECTOR_KEYWORDS = f"""{CANDIDATES},{WORD_VECTORS},
dsum AS (SELECT doc_id, [{_SUMS}] AS v FROM (SELECT doc_id, unnest(w) AS word FROM vtoks) JOIN vectors USING (word) GROUP BY doc_id),
each AS (SELECT DISTINCT doc_id, keyword FROM grams),
parts AS (SELECT keyword, unnest(string_split(keyword, ' ')) AS word FROM (SELECT DISTINCT keyword FROM each)),
ksum AS (SELECT keyword, [{_SUMS}] AS v FROM parts JOIN vectors USING (word) GROUP BY keyword),
dunit AS (SELECT doc_id, {unit("v")} AS d FROM dsum),
kunit AS (SELECT keyword, {unit("v")} AS u FROM ksum),
scored AS (
  SELECT doc_id, keyword, coalesce(u, list_transform(range({DIMENSIONS}), lambda x: 0.0::DOUBLE)) AS u, round(coalesce(list_dot_product(d, u), 0), 9) AS score
  FROM each LEFT JOIN dunit USING (doc_id) LEFT JOIN kunit USING (keyword)),
vranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, keyword) AS rank FROM scored)"""


def mmr(pool: str, top_n: int, diversity: float) -> str:
    """CTEs that end in ``picked (query_id, rank, item, score)``: greedy choice from ``pool`` (query_id,
    rank, item, score, v)."""
    value = f"round({1 - diversity:.1f} * s[p] - {diversity} * list_max(list_transform(chosen, lambda c: list_dot_product(vs[p], vs[c]))), 9)"
    values = f"list_transform(range(1, len(s) + 1), lambda p: CASE WHEN list_contains(chosen, p) THEN -9.0 ELSE {value} END)"
    return f"""
lists AS (SELECT query_id, list(item ORDER BY rank) AS items, list(score ORDER BY rank) AS s, list(v ORDER BY rank) AS vs FROM {pool} GROUP BY query_id),
steps AS (
  SELECT query_id, items, s, vs, [1::BIGINT] AS chosen FROM lists
  UNION ALL
  SELECT query_id, items, s, vs, list_append(chosen, list_position(vals, list_max(vals))::BIGINT) FROM (
    SELECT *, {values} AS vals FROM steps WHERE len(chosen) < least({top_n}, len(s)))),
done AS (SELECT * FROM steps WHERE len(chosen) = least({top_n}, len(s))),
picked AS (
  SELECT query_id, unnest(range(1, len(chosen) + 1))::INTEGER AS rank, unnest(list_transform(chosen, lambda c: items[c])) AS item,
         unnest(list_transform(chosen, lambda c: s[c])) AS score FROM done)"""


def topics(k: int = 5, vocab: int = 100, seed: int = 42, rounds: int = 10, similarity: float = 0.2) -> str:
    """CTEs that end in ``assigned (doc_id, topic_id)``, outliers left out, and ``tvec (doc_id, no, tf, v)``. Every
    round is a pair of CTEs; rounds after the centres stand still change nothing."""

    def units(name: str) -> str:
        return f"""SELECT topic, no, floor(1048576 * s::DOUBLE / norm + 0.5)::BIGINT AS w FROM {name}
          JOIN (SELECT topic, sqrt(list_sum(list(s::DOUBLE * s::DOUBLE ORDER BY no))) AS norm FROM {name} GROUP BY topic) USING (topic)"""

    def nearest(centres: str) -> str:
        return f"""SELECT doc_id, topic, score FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic) AS place
          FROM (SELECT doc_id, topic, sum(v * w) AS score FROM tvec JOIN {centres} USING (no) GROUP BY ALL) WHERE score > 0) WHERE place = 1"""

    steps = [
        f"""
sums{i} AS MATERIALIZED (SELECT topic, no, sum(v)::BIGINT AS s FROM tvec JOIN ({nearest(f"centres{i}")}) USING (doc_id) GROUP BY ALL),
centres{i + 1} AS MATERIALIZED ({units(f"sums{i}")} UNION ALL SELECT * FROM centres{i} WHERE topic NOT IN (SELECT topic FROM sums{i})),"""
        for i in range(rounds)
    ]
    return f"""{CANDIDATES},
tterms AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY df DESC, keyword) - 1 AS no,
    floor(1048576 * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1) + 0.5) AS idf
  FROM (SELECT keyword, count(*) AS df FROM (SELECT DISTINCT doc_id, keyword FROM grams) GROUP BY keyword ORDER BY df DESC, keyword LIMIT {vocab})),
tcount AS MATERIALIZED (SELECT doc_id, no, count(*) AS tf, (count(*) * any_value(idf))::DOUBLE AS x FROM grams JOIN tterms USING (keyword) GROUP BY doc_id, no),
tnorm AS (SELECT doc_id, sqrt(list_sum(list(x * x ORDER BY no))) AS norm FROM tcount GROUP BY doc_id),
tvec AS MATERIALIZED (SELECT doc_id, no, tf, floor(1048576 * x / norm + 0.5)::BIGINT AS v FROM tcount JOIN tnorm USING (doc_id)),
starts AS (
  SELECT place, row_number() OVER (ORDER BY place) - 1 AS topic FROM (
    SELECT min(md5('{seed}:' || doc_id)) AS place
    FROM (SELECT doc_id, string_agg(no || ':' || v, ',' ORDER BY no) AS vector FROM tvec GROUP BY doc_id) GROUP BY vector ORDER BY place LIMIT {k})),
centres0 AS MATERIALIZED (SELECT topic, no, v AS w FROM tvec JOIN starts ON place = md5('{seed}:' || doc_id)),{"".join(steps)}
tnear AS (SELECT doc_id, topic FROM ({nearest(f"centres{rounds}")}) WHERE score >= floor({similarity}::DOUBLE * 1048576 * 1048576)),
tsizes AS (SELECT topic, topic_size, row_number() OVER (ORDER BY topic_size DESC, topic) - 1 AS topic_id FROM (SELECT topic, count(*) AS topic_size FROM tnear GROUP BY topic)),
assigned AS (SELECT doc_id, topic_id::INTEGER AS topic_id, topic_size FROM tnear JOIN tsizes USING (topic))"""


TOPIC_WORDS = """
tcells AS (SELECT topic_id, any_value(topic_size) AS topic_size, keyword AS word, sum(tf) AS n FROM assigned JOIN tvec USING (doc_id) JOIN tterms USING (no) GROUP BY topic_id, keyword),
tweighed AS (
  SELECT *, round(n / sum(n) OVER (PARTITION BY topic_id)
    * ln(1 + (SELECT sum(n) / count(DISTINCT topic_id) FROM tcells) / sum(n) OVER (PARTITION BY word)), 9) AS weight FROM tcells),
twords AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, word) AS rank FROM tweighed)"""
