"""Corpus topics: spherical k-means over the TF-IDF weights of the terms in most documents.

Weights are whole multiples of 2^-20 and are only added as longs, and the start centres come from a fixed
order of ids, so the result is the same for any partitioning. Of the corpus the driver holds the ``vocab``
terms and ``k`` centres of ``vocab`` weights, nothing that grows with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusdeck.functions.arrays import bind
from corpusdeck.functions.text import drop_words, token_ngrams, word_tokens
from corpusdeck.operators.keywords import ngram_candidates
from corpusdeck.session import stored

OUTLIER = -1
ONE = 1 << 20
#: Words whose neighbours are looked up in the row; more of them, and all terms are counted together.
FREQUENT = 2_000


@dataclass(frozen=True)
class TopicModel:
    """``labels`` names the topic of each centre; small clusters are labelled ``OUTLIER``."""

    terms: list[str]
    idf: list[int]
    centres: list[list[int]]
    labels: list[int]
    least: int
    stops: tuple[str, ...]


def _units(values: list[int]) -> list[int]:
    norm = math.sqrt(sum(float(v) * float(v) for v in values))
    return [math.floor(ONE * float(v) / norm + 0.5) for v in values]


def _longs(values: list[int]) -> Column:
    return F.lit(values).cast("array<bigint>") if values else F.array().cast("array<bigint>")


def term_weights(candidates: Column, terms: list[str], idf: list[int]) -> Column:
    """``array<struct<at, tf, v>>``: the terms of the vocabulary among the candidates, in its order; ``v`` is
    the unit-length TF-IDF weight in units of 2^-20. Computed in the row."""
    if not terms:
        return F.array().cast("array<struct<at:int,tf:bigint,v:bigint>>")
    names, rarity = F.lit(terms), _longs(idf)
    known = F.filter(F.coalesce(candidates, F.array().cast("array<string>")), lambda c: c.isin(terms))

    def counted(own: Column) -> Column:
        def cell(term: Column) -> Column:
            at = (F.array_position(names, term) - 1).cast("int")
            tf = F.size(F.filter(own, lambda c: c == term)).cast("bigint")
            return F.struct(at.alias("at"), tf.alias("tf"), (tf * F.get(rarity, at)).cast("double").alias("w"))

        return F.array_sort(F.transform(F.array_distinct(own), cell))

    def scaled(cells: Column) -> Column:
        norm = F.sqrt(F.aggregate(cells, F.lit(0.0), lambda total, c: total + c["w"] * c["w"]))
        return bind(
            norm,
            lambda length: F.transform(
                cells, lambda c: F.struct(c["at"].alias("at"), c["tf"].alias("tf"), F.floor(F.lit(float(ONE)) * c["w"] / length + 0.5).alias("v"))
            ),
        )

    return bind(bind(known, counted), scaled)


def _nearest(cells: Column, centres: list[list[int]]) -> Column:
    """``struct<at, score>``: the first of the centres with the largest product; ``at`` is null where all are zero."""
    if not centres:
        return F.struct(F.lit(None).cast("int").alias("at"), F.lit(0).cast("bigint").alias("score"))
    zero = F.lit(0).cast("bigint")
    scores = F.transform(
        F.lit(centres).cast("array<array<bigint>>"),
        lambda centre: F.aggregate(cells, zero, lambda total, c: total + c["v"] * F.get(centre, c["at"])),
    )

    def best(s: Column) -> Column:
        top = F.array_max(s)
        at = F.when(top > 0, (F.array_position(s, top) - 1).cast("int"))
        return F.struct(at.alias("at"), top.alias("score"))

    return bind(scores, best)


def topic_of(candidates: Column, model: TopicModel) -> Column:
    """The topic of a document from its n-gram candidates, in the row; ``OUTLIER`` for a document that is not
    near enough to any centre, has no term of the vocabulary or no text."""
    # Bound, or every centre would work the weights out again.
    nearest = bind(term_weights(candidates, model.terms, model.idf), lambda cells: _nearest(cells, model.centres))
    return _label(nearest, model.labels, model.least)


def _label(nearest: Column, labels: list[int], least: int) -> Column:
    names = F.lit(labels).cast("array<int>") if labels else F.array().cast("array<int>")
    return bind(nearest, lambda n: F.when(n["at"].isNotNull() & (n["score"] >= least), F.get(names, n["at"])).otherwise(F.lit(OUTLIER)))


def _documents_with(terms: DataFrame) -> DataFrame:
    """``(term, n)``: the rows whose array ``_terms`` has the term."""
    spread = terms.select(F.explode_outer(F.array_distinct("_terms")).alias("term")).filter("term is not null")
    return spread.groupBy("term").agg(F.count("*").alias("n"))


def _likely_terms(texts: DataFrame, stops: tuple[str, ...], vocab: int, text: str) -> DataFrame:
    """``texts`` with ``_terms``, those words and bigrams that can be among the ``vocab`` terms in most documents.

    Words are counted alone. A bigram stands in no more documents than either of its words, so with ``vocab``
    words in at least ``n`` documents each only bigrams of such words can be among the first; they are found in
    the row and no others are spread or shuffled. Where over ``FREQUENT`` words tie, every term is kept.
    """
    words = texts.withColumn("_terms", drop_words(word_tokens(F.lower(text), 2), stops))
    counted = stored(_documents_with(words), "topic-words")
    best = counted.orderBy(F.desc("n"), "term").limit(vocab).collect()
    least = best[-1]["n"] if len(best) == vocab else 0
    frequent = [r["term"] for r in counted.filter(F.col("n") >= least).limit(FREQUENT + 1).collect()]
    if len(frequent) > FREQUENT:
        return ngram_candidates(texts, stops, 2, text, "_terms").drop(text)

    return words.withColumn("_terms", _terms_among(F.col("_terms"), frequent)).drop(text)


def _terms_among(words: Column, chosen: list[str]) -> Column:
    """The words and bigrams of ``words`` that are made of ``chosen`` words alone."""

    def terms(own: Column) -> Column:
        # Other words are null, and so are their bigrams.
        return F.filter(F.concat(own, token_ngrams(own, 2)), lambda g: g.isNotNull())

    if not chosen:
        return F.slice(words, 1, 0)
    return bind(F.transform(words, lambda w: F.when(w.isin(chosen), w)), terms)


def _cluster_sums(cells: DataFrame, centres: list[list[int]]) -> DataFrame:
    """``(topic, at, v)``: the sums of the weights of the documents nearest to each centre, see :func:`_nearest`.
    All numbers stay below 2^53."""
    schema = "topic int, at int, v long"
    if not centres or not centres[0]:
        return cells.sparkSession.createDataFrame([], schema)
    matrix = np.array(centres, np.int64)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(matrix.size, np.int64)
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            at, v = (pc.struct_field(flat, name).to_numpy(zero_copy_only=False) for name in ("at", "v"))
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lengths)), lengths)
            scores = np.stack([np.bincount(row, centre[at] * v, len(lengths)) for centre in matrix])
            own = np.flatnonzero(scores.max(axis=0)[row] > 0)
            place = scores.argmax(axis=0)[row[own]] * matrix.shape[1] + at[own]
            total += np.bincount(place, v[own], matrix.size).astype(np.int64)
        (found,) = np.nonzero(total)
        topic, at = np.divmod(found, matrix.shape[1])
        arrays = [pa.array(topic.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[found])]
        yield pa.RecordBatch.from_arrays(arrays, names=["topic", "at", "v"])

    sums = cells.select("cells").mapInArrow(summed, schema)
    return sums.groupBy("topic", "at").agg(F.sum("v").alias("v"))


def fit_topics(
    df: DataFrame,
    stops: Iterable[str] = (),
    k: int = 5,
    vocab: int = 100,
    seed: int = 42,
    min_size: int = 1,
    min_similarity: float = 0.2,
    rounds: int = 10,
    doc: str = "doc_id",
    text: str = "text",
) -> tuple[TopicModel, DataFrame]:
    """The model, and ``(doc, cells, topic_id)`` of every row.

    The texts are read twice, for their words and for the likely terms; the vocabulary is counted over those, and
    the rounds run over the stored weights. Start centres are the first ``k`` distinct vectors in the order of ``md5(seed:doc)``. A cluster
    of fewer than ``min_size`` documents and documents less than ``min_similarity`` from their centre are
    outliers. Topics are numbered by size.
    """
    stops = tuple(stops)
    grams = stored(_likely_terms(df.select(doc, text), stops, vocab, text), "topic-terms")
    best = _documents_with(grams).orderBy(F.desc("n"), "term").limit(vocab).collect()
    total = df.count()
    terms = [r["term"] for r in best]
    idf = [math.floor(ONE * (math.log((1 + total) / (1 + r["n"])) + 1) + 0.5) for r in best]
    cells = stored(grams.select(doc, term_weights(F.col("_terms"), terms, idf).alias("cells")), "topic-weights")

    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc).cast("string"), F.lit(""))))
    vector = F.transform("cells", lambda c: F.struct(c["at"].alias("at"), c["v"].alias("v")))
    distinct = cells.filter(F.size("cells") > 0).groupBy(vector.alias("vector")).agg(F.min(place).alias("place"))
    centres = []
    for row in distinct.orderBy("place").limit(k).collect():
        own = dict(row["vector"])
        centres.append([own.get(at, 0) for at in range(len(terms))])

    for _ in range(rounds):
        moved = [list(c) for c in centres]
        # At most k times vocab rows.
        found: dict[int, dict[int, int]] = {}
        for row in _cluster_sums(cells, centres).collect():
            found.setdefault(row["topic"], {})[row["at"]] = row["v"]
        for topic, own in found.items():
            moved[topic] = _units([own.get(at, 0) for at in range(len(terms))])
        if moved == centres:
            break
        centres = moved

    least = math.floor(min_similarity * ONE * ONE)
    near = cells.withColumn("_near", _nearest(F.col("cells"), centres))
    sizes = near.filter(F.col("_near.score") >= least).groupBy("_near.at").agg(F.count("*").alias("n")).filter("at is not null")
    kept = sorted((-r["n"], r["at"]) for r in sizes.collect() if r["n"] >= min_size)
    number = {at: topic for topic, (_, at) in enumerate(kept)}
    labels = [number.get(at, OUTLIER) for at in range(len(centres))]
    model = TopicModel(terms, idf, centres, labels, least, stops)
    return model, near.withColumn("topic_id", _label(F.col("_near"), labels, least)).drop("_near")


def assign_topics(df: DataFrame, model: TopicModel, text: str = "text") -> DataFrame:
    """Add ``topic_id`` to rows of any table, without a join."""
    # Of the candidates only those made of words of the vocabulary are formed.
    chosen = sorted({word for term in model.terms for word in term.split(" ")})
    words = df.withColumn("_words", drop_words(word_tokens(F.lower(text), 2), model.stops))
    known = words.withColumn("_candidates", _terms_among(F.col("_words"), chosen))
    return known.withColumn("topic_id", topic_of(F.col("_candidates"), model)).drop("_candidates", "_words")


def topic_words(assigned: DataFrame, model: TopicModel, top_words: int = 8) -> DataFrame:
    """``(topic_id, topic_size, rank, word, weight)``: the words that set a topic apart.

    The weight is the word's share of the topic's terms times ``ln(1 + mean terms of a topic / occurrences
    of the word in all topics)``. Ties rank by word.
    """
    inside = assigned.filter(F.col("topic_id") != OUTLIER)
    sizes = inside.groupBy("topic_id").agg(F.count("*").alias("topic_size"))
    # From here on at most k times vocab rows.
    counts = inside.select("topic_id", F.inline("cells")).groupBy("topic_id", "at").agg(F.sum("tf").alias("n"))
    each = counts.groupBy("topic_id").agg(F.sum("n").alias("own"))
    mean = each.agg(F.sum("own") / F.count("*")).scalar()
    share = F.col("n") / F.sum("n").over(Window.partitionBy("topic_id"))
    rare = F.log(1 + mean / F.sum("n").over(Window.partitionBy("at")))
    word = F.get(F.lit(model.terms), F.col("at")) if model.terms else F.lit(None).cast("string")
    weighed = counts.select("topic_id", word.alias("word"), F.round(share * rare, 9).alias("weight"))
    heaviest = Window.partitionBy("topic_id").orderBy(F.desc("weight"), "word")
    top = weighed.withColumn("rank", F.row_number().over(heaviest)).filter(F.col("rank") <= top_words)
    return top.join(sizes, "topic_id").select("topic_id", "topic_size", "rank", "word", "weight")


def topics(
    df: DataFrame,
    stops: Iterable[str] = (),
    k: int = 5,
    vocab: int = 100,
    seed: int = 42,
    top_words: int = 8,
    min_size: int = 1,
    min_similarity: float = 0.2,
    rounds: int = 10,
    doc: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(topic_id, topic_name, topic_size, rank, word, weight, total_topics)``; outliers are left out."""
    model, assigned = fit_topics(df, stops, k, vocab, seed, min_size, min_similarity, rounds, doc, text)
    return (
        topic_words(assigned, model, top_words)
        .withColumn("topic_name", F.concat(F.lit("Topic_"), F.col("topic_id")))
        .withColumn("total_topics", F.lit(sum(label != OUTLIER for label in model.labels)).cast("bigint"))
    )
