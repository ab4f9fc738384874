"""Entities from patterns and from a phrase dictionary, their categories and roll-up."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdeck.defaults import CATEGORY_PREFIX, PATTERN_LABEL, PATTERN_SCORE, PATTERN_SOURCE
from corpusdeck.functions.arrays import bind
from corpusdeck.functions.lexicon import Lexicon, contains_any
from corpusdeck.functions.text import WORD, word_tokens
from corpusdeck.operators.skew import attach_by_key

#: Rows and characters of a dictionary that travels with the tasks.
SMALL, SMALL_CHARS = 2_000, 1 << 18
HITS = "array<struct<start:int,words:int,text:string,label:string,score:double>>"
ENTITY = (
    "struct<text:string,label:string,score:double,category:string,is_related:boolean,source:string>"
)


def pattern_entities(
    df: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "pattern_entities"
) -> DataFrame:
    """Add the entities whose pattern occurs in the text, in category then pattern order.

    Row-local: an array column, no explosion and no shuffle.
    """
    table = F.array(
        *[
            F.struct(
                F.lit(e.keyword).alias("keyword"),
                F.struct(
                    F.lit(e.keyword.title()).alias("text"),
                    F.lit(PATTERN_LABEL).alias("label"),
                    F.lit(PATTERN_SCORE).alias("score"),
                    F.lit(CATEGORY_PREFIX + e.group).alias("category"),
                    F.lit(True).alias("is_related"),
                    F.lit(PATTERN_SOURCE).alias("source"),
                ).alias("entity"),
            )
            for e in lexicon.entries
        ]
    )
    if not lexicon.entries:
        return df.withColumn(out, F.array().cast(f"array<{ENTITY}>"))
    found = bind(
        F.lower(text),
        lambda lc: F.transform(F.filter(table, lambda p: F.contains(lc, p["keyword"])), lambda p: p["entity"]),
    )
    return df.withColumn(out, found.cast(f"array<{ENTITY}>"))


@dataclass(frozen=True)
class Phrase:
    """A dictionary phrase and its anchor: the place of its rarest word."""

    words: tuple[str, ...]
    label: str | None
    score: float | None
    anchor: int


def small_dictionary(dictionary: DataFrame) -> list[Phrase] | None:
    """The phrases of a dictionary of at most ``SMALL`` rows and ``SMALL_CHARS`` characters, else None.

    Here the rarest word is the one that the fewest phrases have; it changes the work and not what is found."""
    given = dictionary.filter("phrase <> ''").select("phrase", "label", "score")
    # A row more than may come shows that there are more.
    rows = given.limit(SMALL + 1).collect()
    if len(rows) > SMALL or sum(len(r.phrase) for r in rows) > SMALL_CHARS:
        return None
    seen = Counter(w for r in rows for w in set(r.phrase.split(" ")))

    def phrase(r) -> Phrase:
        words = tuple(r.phrase.split(" "))
        return Phrase(words, r.label, r.score, min(range(len(words)), key=lambda k: (seen[words[k]], -len(words[k]), k)))

    return [phrase(r) for r in rows]


def _quoted(word: str | None) -> str:
    return "CAST(NULL AS STRING)" if word is None else "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def phrase_hits(text: str, phrases: list[Phrase]) -> Column:
    """Array of ``struct<start, words, text, label, score>`` of every span of the column ``text`` that is a
    phrase, in text order.

    Row-local: spans are formed only where a word is the anchor of a phrase and the word beside it fits. The
    expression is given as text, since building it from as many columns as there are words takes seconds."""
    if not phrases:
        return F.array().cast(HITS)
    shapes: dict[tuple[int, int], list[tuple[str, ...]]] = {}
    for p in phrases:
        shapes.setdefault((len(p.words), p.anchor), []).append(p.words)
    score = lambda x: "CAST(NULL AS DOUBLE)" if x is None else f"CAST({x!r} AS DOUBLE)"
    entries = {" ".join(p.words): f"named_struct('label', {_quoted(p.label)}, 'score', {score(p.score)})" for p in phrases}
    table = f"map({', '.join(f'{_quoted(k)}, {v}' for k, v in entries.items())})"

    def among(words: set[str]) -> str:
        return f"IN ({', '.join(map(_quoted, sorted(words)))})"

    def joined(words: str, n: int) -> str:
        # A slice would copy the whole array.
        return "concat_ws(' ', " + ", ".join(f"get({words}, at + {k})" for k in range(n)) + ")"

    def of_shape(n: int, anchor: int) -> str:
        known = shapes[n, anchor]
        fits = f"get(low, i) {among({x[anchor] for x in known})}"
        if n > 1:
            beside = anchor + 1 if anchor + 1 < n else anchor - 1
            fits += f" AND get(low, i + {beside - anchor}) {among({x[beside] for x in known})}"
        starts = f"transform(filter(anchored, i -> {fits}), i -> i - {anchor})"
        if n > 1:
            starts = f"filter({starts}, at -> at >= 0 AND at + {n} <= size(low) AND {joined('low', n)} {among({' '.join(x) for x in known})})"
        named = f"element_at({table}, {joined('low', n)})"
        return f"transform({starts}, at -> named_struct('start', at, 'words', {n}, 'text', {joined('own', n)}, 'label', {named}.label, 'score', {named}.score))"

    hits = f"array_sort(concat({', '.join(of_shape(*x) for x in sorted(shapes))}))"
    # The words are gone through once, not for each shape.
    anchors = among({x[anchor] for (_, anchor), known in shapes.items() for x in known})
    places = f"filter(transform(low, (w, i) -> CASE WHEN w {anchors} THEN i END), i -> i IS NOT NULL)"
    found = f"element_at(transform(array({places}), anchored -> {hits}), 1)"
    tokens = f"regexp_extract_all(`{text}`, r'[{WORD}]+', 0)"
    bound = f"element_at(transform(array(transform(own, x -> lower(x))), low -> {found}), 1)"
    return F.expr(f"element_at(transform(array({tokens}), own -> {bound}), 1)")


def anchored_hits(df: DataFrame, dictionary: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, hits)`` as :func:`phrase_hits`, for a dictionary of any size.

    Words of the texts meet the phrases that they anchor; a phrase's anchor is its rarest word by count, so
    few meet. Texts are placed by document once and come back to their candidates there, where the other
    words of a phrase are compared. ``doc`` is a key."""
    phrases = dictionary.filter("phrase <> ''").select("phrase", "label", "score", F.split("phrase", " ").alias("own"))
    placed = df.select(doc, word_tokens(F.col(text)).alias("_words")).repartition(doc)
    tokens = placed.select(doc, F.posexplode_outer(F.transform("_words", lambda w: F.lower(w))).alias("_at", "_word")).filter("_word is not null")
    each = phrases.select("phrase", F.posexplode("own").alias("anchor", "_word"))
    needed = each.groupBy("_word").agg(F.count("*").alias("_phrases"))
    counts = tokens.groupBy("_word").agg(F.count("*").alias("n"))
    rare = each.join(needed.join(counts, "_word", "left"), "_word").groupBy("phrase").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("anchor"), F.col("_word"))).alias("_a")
    )
    anchors = phrases.join(rare, "phrase").select(F.col("_a._word").alias("_word"), F.struct("own", "label", "score", "_a.anchor").alias("_p"), F.col("_a.n").alias("n"))
    by_word = anchors.groupBy("_word").agg(F.collect_list("_p").alias("_phrases"), F.max("n").alias("n"))
    met = attach_by_key(tokens, by_word, "_word", "n", F.col("_at")).select(doc, "_at", F.explode("_phrases").alias("_p"))
    candidate = F.struct((F.col("_at") - F.col("_p.anchor")).alias("start"), F.col("_p"))
    candidates = met.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(candidate["start"].alias("start"), F.size("_p.own").alias("words"), F.col("_p")))).alias("_c"))

    def hits(words: Column) -> Column:
        def spelled(c: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), c["words"] - 1), lambda k: F.get(words, c["start"] + k))

        real = F.filter(F.col("_c"), lambda c: (c["start"] >= 0) & (F.transform(spelled(c), lambda w: F.lower(w)) == c["_p"]["own"]))
        return F.transform(
            real,
            lambda c: F.struct(
                c["start"].alias("start"), c["words"].alias("words"), F.array_join(spelled(c), " ").alias("text"), c["_p"]["label"].alias("label"), c["_p"]["score"].alias("score")
            ),
        )

    return placed.join(candidates, doc).select(doc, bind(F.col("_words"), hits).cast(HITS).alias("hits"))


def with_hits(df: DataFrame, dictionary: DataFrame, doc: str = "doc_id", text: str = "text", out: str = "hits") -> DataFrame:
    """``df`` with the array of its dictionary phrases. With a small dictionary the row is not left; the hits
    of a large one are joined by document. Null for a null text."""
    phrases = small_dictionary(dictionary)
    if phrases is not None:
        return df.withColumn(out, phrase_hits(text, phrases))
    found = anchored_hits(df, dictionary, doc, text).withColumnRenamed("hits", "_found")
    joined = df.join(found, doc, "left").withColumn(out, F.coalesce("_found", F.when(F.col(text).isNotNull(), F.array().cast(HITS))))
    return joined.drop("_found")


def model_entities(
    df: DataFrame,
    dictionary: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Every span that is a dictionary phrase: ``(doc, start, words, text, label, score)``.

    ``dictionary`` holds ``(phrase, label, score)``, one row per lower-cased phrase of blank-joined
    words. A small one travels with the tasks and only hits become rows; a large one is joined at the
    anchors of its phrases.
    """
    found = with_hits(df.select(doc, text), dictionary, doc, text, "hits")
    # Outer, because the inner form adds an emptiness filter that computes the hits again.
    return found.select(doc, F.inline_outer("hits")).filter(F.col("start").isNotNull())


def categorize_entity(
    text: Column, label: Column, patterns: Lexicon, facets: Lexicon, strict: bool = False
) -> Column:
    """First match wins: pattern category, then facet option, then the lower-cased label.

    With ``strict`` an entity known only by its label is ``other``.
    """
    rules = [(patterns.group(g).keywords, CATEGORY_PREFIX + g) for g in patterns.groups]
    rules += [(words, f"{facet}_{option}") for (facet, option), words in facets.options().items()]

    def first(lc: Column) -> Column:
        rule = F.lit("other") if strict else F.lower(label)
        for words, name in reversed(rules):
            if words:
                rule = F.when(contains_any(lc, words), F.lit(name)).otherwise(rule)
        return rule

    return bind(F.lower(text), first)


def with_categories(
    entities: DataFrame, patterns: Lexicon, facets: Lexicon, strict: bool = False
) -> DataFrame:
    """Add ``category`` and ``is_related`` to ``(…, text, label)`` rows."""
    category = categorize_entity(F.col("text"), F.col("label"), patterns, facets, strict)
    return entities.withColumn("category", category).withColumn("is_related", F.col("category") != "other")


def model_entity_column(hits: Column, patterns: Lexicon, facets: Lexicon, strict: bool = False) -> Column:
    """Categorised model entities of ``hits``, in text order."""

    def entity(h: Column) -> Column:
        category = categorize_entity(h["text"], h["label"], patterns, facets, strict)
        return bind(
            category,
            lambda c: F.struct(
                h["text"].alias("text"), h["label"].alias("label"), h["score"].alias("score"), c.alias("category"),
                (c != "other").alias("is_related"), F.lit("model").alias("source"),
            ),
        )

    return F.transform(hits, entity).cast(f"array<{ENTITY}>")


def with_entities(
    df: DataFrame,
    dictionary: DataFrame,
    patterns: Lexicon,
    facets: Lexicon,
    strict: bool = False,
    doc: str = "doc_id",
    text: str = "text",
    out: str = "entities",
) -> DataFrame:
    """``df`` with its entities: model entities in text order, then patterns. With a small dictionary the
    row is not left; the hits of a large one are joined by document."""
    staged = with_hits(df, dictionary, doc, text, "_hits")
    staged = pattern_entities(staged, patterns, text, "_patterns")
    model = F.coalesce(model_entity_column(F.col("_hits"), patterns, facets, strict), F.array().cast(f"array<{ENTITY}>"))
    return staged.withColumn(out, F.concat(model, F.coalesce("_patterns", F.array().cast(f"array<{ENTITY}>")))).drop("_hits", "_patterns")


def document_entities(
    df: DataFrame,
    dictionary: DataFrame,
    patterns: Lexicon,
    facets: Lexicon,
    strict: bool = False,
    doc: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(doc, entities)`` for every document: model entities in text order, then patterns."""
    return with_entities(df.select(doc, text), dictionary, patterns, facets, strict, doc, text).select(doc, "entities")


def entity_rollup(df: DataFrame, entities: str = "entities") -> DataFrame:
    """Add ``categories`` (category → its entities, in order), ``total_entities`` and
    ``related_entities``. Row-local."""
    e = F.col(entities)
    names = F.array_distinct(F.transform(e, lambda x: x["category"]))
    grouped = F.map_from_entries(
        F.transform(names, lambda name: F.struct(name, F.filter(e, lambda x: x["category"] == name)))
    )
    return (
        df.withColumn("categories", grouped)
        .withColumn("total_entities", F.size(e))
        .withColumn("related_entities", F.size(F.filter(e, lambda x: x["is_related"])))
    )


def entity_categories(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Long form: entities and related entities per ``(doc, category)``."""
    return found.groupBy(doc, "category").agg(
        F.count("*").alias("entities"), F.count_if("is_related").alias("related")
    )
