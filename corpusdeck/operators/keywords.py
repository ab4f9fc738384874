"""Keyword candidates, TF-IDF ranking, vector ranking, diversity re-ranking."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusdeck.defaults import STOPS
from corpusdeck.functions.text import drop_words, token_ngrams, word_tokens
from corpusdeck.operators.nearest import unit_rows
from corpusdeck.operators.terms import (
    best_rows,
    bucket_count,
    by_shard,
    flat_words,
    free_memory,
    packed,
    shard_count,
    shard_terms,
    sharded_words,
    summed_rows,
    unpacked,
)
from corpusdeck.operators.wordvectors import ShardVectors, document_slices, vector_shard_count, word_vectors_of_shards


def ngram_candidates(
    df: DataFrame, stops: Iterable[str] = STOPS, n: int = 2, text: str = "text", out: str = "candidates"
) -> DataFrame:
    """Add the 1..n-grams of lower-cased words of two or more characters, in order, with repeats.

    Stop words go before n-grams form, so a bigram may bridge a removed word.
    """
    staged = df.withColumn("_words", drop_words(word_tokens(F.lower(text), 2), stops))
    grams = [token_ngrams(F.col("_words"), i) for i in range(1, n + 1)]
    return staged.withColumn(out, F.concat(*grams)).drop("_words")


def keyword_extract(
    df: DataFrame, stops: Iterable[str] = STOPS, top_n: int = 20, n: int = 2, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Top ``top_n`` candidates per document: ``(doc, rank, keyword, score)``.

    The score is the cosine between document and candidate in TF-IDF space, i.e. the candidate's
    share of the document's unit-length TF-IDF vector, with idf = ln((1+N)/(1+df)) + 1. Equal
    scores rank by keyword.

    Terms are counted in shards of documents. A shard's distinct terms leave it in buckets, with the number of its
    documents that have them; a bucket holds all shards' counts of its terms, and sends each shard the sums in the
    order in which its terms came.
    """
    size = df.agg(F.count("*").alias("corpus"), F.sum(F.length(text)).alias("chars")).first()
    corpus, shards = size.corpus, shard_count(size.chars)
    buckets = bucket_count(shards)
    words = sharded_words(df, shards, stops, doc, text)

    def counted(table: pa.Table) -> pa.Table:
        own = shard_terms(table, n, doc)
        order, starts = own.bucketed(buckets)
        # No word has a line end.
        keywords = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), own.keywords(order)), "\n")
        shard = np.full(buckets, table["_shard"][0].as_py(), np.int32)
        columns = [np.arange(buckets, dtype=np.int32), shard, keywords, packed(own.found[order], starts)]
        rows = pa.table(columns, names=["_bucket", "_shard", "keywords", "found"])
        return rows.filter(pa.array(np.diff(starts) > 0))

    each = words.groupBy("_shard").applyInArrow(counted, "_bucket int, _shard int, keywords string, found binary")

    def summed(table: pa.Table) -> pa.Table:
        lists = pc.split_pattern(table["keywords"].combine_chunks(), "\n")
        term = pc.list_flatten(lists).dictionary_encode().indices.to_numpy()
        df = np.bincount(term, unpacked(table["found"]))[term]
        starts = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
        return pa.table([table["_bucket"], table["_shard"], packed(df, starts)], names=["_bucket", "_shard", "df"])

    sums = each.repartition(buckets, "_bucket").groupBy("_bucket").applyInArrow(summed, "_bucket int, _shard int, df binary")
    spread = by_shard(sums, shards)

    def ranked(table: pa.Table, spread: pa.Table) -> pa.Table:
        own = shard_terms(table, n, doc)
        rarity = np.empty(own.size)
        rarity[own.bucketed(buckets)[0]] = np.log((1 + corpus) / (1.0 + unpacked(spread.sort_by("_bucket")["df"]))) + 1
        weight = own.tf * rarity[own.term]
        # Of equal weights the term of the smaller number stays first.
        values = np.unique(weight)
        order = np.argsort((own.owner + 1) * (len(values) + 1) - np.searchsorted(values, weight), kind="stable")
        starts, kept, rank = best_rows(own.owner, order, top_n)
        weight = weight[order]
        # Added one by one from the largest on, so the sum is the same wherever it is made.
        norms = np.array([np.sqrt(np.cumsum(w * w)[-1]) for w in np.split(weight, starts[1:-1]) if len(w)])
        chosen = order[kept]
        norm = np.repeat(norms, np.diff(starts))[kept]
        ids = own.docs.take(pa.array(own.owner[chosen]))
        columns = [ids, pa.array(rank.astype(np.int32)), own.keywords(own.term[chosen]), pa.array(weight[kept] / norm)]
        return pa.table(columns, names=[doc, "rank", "keyword", "score"])

    kind = df.schema[doc].dataType.simpleString()
    both = words.groupBy("_shard").cogroup(spread.groupBy("_shard"))
    return both.applyInArrow(ranked, f"{doc} {kind}, rank int, keyword string, score double")


def keyword_extract_by_vectors(
    df: DataFrame,
    vectors: DataFrame,
    size: int,
    stops: Iterable[str] = STOPS,
    top_n: int = 20,
    n: int = 2,
    doc: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Top candidates by cosine between the document's vector and the candidate's, both means of
    word vectors ``(word, vector)`` of ``size`` dimensions: ``(doc, rank, keyword, score, embedding)``.

    ``doc`` is a key. A shard's distinct words leave it and come back with their vectors, by number; its
    documents look their words and candidates up there, a slice of them at a time. Words without a vector count as
    zero. Rows of a document stand one after another, in the order of ``rank``.
    """
    shards = vector_shard_count(df.agg(F.sum(F.length(text))).first()[0], size)
    words = sharded_words(df, shards, stops, doc, text)
    placed, packing = word_vectors_of_shards(words, vectors, shards, size)

    def ranked_slice(table: pa.Table, own: ShardVectors) -> pa.Table:
        terms = shard_terms(table, n, doc)
        matrix, _ = own.rows(terms.vocab)
        _, number, row, docs = flat_words(table, doc)
        of = docs.indices.to_numpy().astype(np.int64)[row]
        inside = np.argsort(of, kind="stable")
        text_starts = np.searchsorted(of[inside], np.arange(len(terms.docs) + 1))
        term_starts = np.searchsorted(terms.owner, np.arange(len(terms.docs) + 1))
        chosen, ranks, scores, embedded = [], [], [], []
        for d in range(len(terms.docs)):
            at = terms.term[term_starts[d] : term_starts[d + 1]]
            if not len(at):
                continue
            whole = unit_rows(summed_rows(matrix, number[inside[text_starts[d] : text_starts[d + 1]]])[None])[0]
            vector = np.zeros((len(at), size))
            for head in terms.heads:
                there = head[at] >= 0
                vector[there] += matrix[head[at][there]]
            vector = unit_rows(vector)
            score = np.round(vector @ whole, 9)
            # Terms are numbered in the order of keywords.
            best = np.argsort(-score, kind="stable")[:top_n]
            chosen.append(np.stack([np.full(len(best), d), at[best]]))
            ranks.append(np.arange(1, len(best) + 1, dtype=np.int32))
            scores.append(score[best])
            embedded.append(vector[best])
        owner, at = np.concatenate(chosen, axis=1) if chosen else np.zeros((2, 0), np.int64)
        flat = np.concatenate(embedded).ravel() if embedded else np.zeros(0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size, dtype=np.int32)), pa.array(flat))
        rank = np.concatenate(ranks) if ranks else np.zeros(0, np.int32)
        score = np.concatenate(scores) if scores else np.zeros(0)
        columns = [terms.docs.take(pa.array(owner)), pa.array(rank), terms.keywords(at), pa.array(score), lists]
        return pa.table(columns, names=[doc, "rank", "keyword", "score", "embedding"])

    def ranked(table: pa.Table, found: pa.Table) -> pa.Table:
        free_memory()
        own = packing.unpacked(table, found)
        parts = [ranked_slice(part, own) for part in document_slices(table, doc)]
        return pa.concat_tables(parts) if parts else ranked_slice(table, own)

    kind = df.schema[doc].dataType.simpleString()
    both = words.groupBy("_shard").cogroup(placed.groupBy("_shard"))
    return both.applyInArrow(ranked, f"{doc} {kind}, rank int, keyword string, score double, embedding array<double>")


def nest_keywords(ranked: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row per document: ``keywords array<struct<keyword, score>>`` in rank order and
    ``total_keywords``. A document has at most ``top_n`` rows here."""
    entry = F.struct("rank", "keyword", "score")
    return (
        ranked.groupBy(doc)
        .agg(F.sort_array(F.collect_list(entry)).alias("_k"))
        .select(
            doc,
            F.transform("_k", lambda k: F.struct(k["keyword"].alias("keyword"), k["score"].alias("score"))).alias(
                "keywords"
            ),
            F.size("_k").alias("total_keywords"),
        )
    )


def keyword_mmr(
    ranked: DataFrame,
    vectors: DataFrame | None = None,
    top_n: int = 20,
    diversity: float = 0.7,
    query_id: str = "query_id",
    item_id: str = "vec_id",
    vector: str = "embedding",
    together: bool = False,
) -> DataFrame:
    """Greedy maximal-marginal-relevance choice of ``top_n`` from the best ``2 * top_n`` per query.

    ``ranked`` has ``(query_id, rank, item_id, score)`` and either the vectors themselves, as
    :func:`keyword_extract_by_vectors` gives them per document, or takes them from ``vectors``. A
    group never has more than ``2 * top_n`` rows. Output: the same columns, in the order chosen.

    ``together`` says that the rows of a query stand one after another in one partition, as those that
    :func:`keyword_extract_by_vectors` has just given; they are then chosen from where they are, without a shuffle
    of their vectors.
    """
    if together and vectors is not None:
        raise ValueError("rows that are together have their vectors")
    pool = ranked.filter(F.col("rank") <= 2 * top_n)
    if vectors is not None:
        narrow = pool.select(query_id, item_id, "score")
        # No hint: whether one side is broadcast follows from its measured size.
        pool = vectors.select(item_id, vector).join(narrow, item_id)
    schema = f"{query_id} {ranked.schema[query_id].dataType.simpleString()}, rank int, {item_id} " + (
        f"{ranked.schema[item_id].dataType.simpleString()}, score double"
    )

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", item_id], ascending=[False, True]).reset_index(drop=True)
        unit = unit_rows(np.stack(pdf[vector].to_numpy()).astype("float64"))
        chosen = mmr_order(unit @ unit.T, pdf["score"].to_numpy(), top_n, diversity)
        out = pdf.loc[chosen, [query_id, item_id, "score"]]
        return out.assign(rank=np.arange(1, len(chosen) + 1))[[query_id, "rank", item_id, "score"]]

    if not together:
        return pool.select(query_id, item_id, "score", vector).groupBy(query_id).applyInPandas(pick, schema)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
            starts = _runs(rows[query_id])
            yield from _mmr_rows(rows.slice(0, starts[-2]), query_id, item_id, vector, top_n, diversity).to_batches()
            rest = rows.slice(starts[-2])
        if rest is not None:
            yield from _mmr_rows(rest, query_id, item_id, vector, top_n, diversity).to_batches()

    return pool.select(query_id, "rank", item_id, "score", vector).mapInArrow(picked, schema)


def _runs(ids: pa.ChunkedArray) -> np.ndarray:
    """Where the runs of equal ids begin (with the end); null is an id."""
    codes = ids.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.append(np.flatnonzero(np.diff(codes, prepend=-1)), len(codes))


def _mmr_rows(rows: pa.Table, query_id: str, item_id: str, vector: str, top_n: int, diversity: float) -> pa.Table:
    """The rows chosen from each run of a query's rows; runs of one length are gone through at once."""
    starts = _runs(rows[query_id])
    run = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((rows["rank"].to_numpy(), run))
    score = rows["score"].to_numpy()[order]
    flat = pc.list_flatten(rows[vector].combine_chunks()).to_numpy(zero_copy_only=False)
    unit = unit_rows(flat.reshape(rows.num_rows, -1).astype("float64"))[order] if rows.num_rows else flat
    chosen, rank = np.zeros(0, np.int64), np.zeros(0, np.int32)
    for length in np.unique(np.diff(starts)):
        at = starts[:-1][np.diff(starts) == length][:, None] + np.arange(length)
        own = unit[at]
        best = mmr_orders(own @ own.transpose(0, 2, 1), score[at], top_n, diversity)
        chosen = np.append(chosen, np.take_along_axis(at, best, axis=1))
        rank = np.append(rank, np.tile(np.arange(1, best.shape[1] + 1, dtype=np.int32), len(at)))
    out = rows.take(pa.array(order[chosen]))
    return pa.table([out[query_id], rank, out[item_id], out["score"]], names=[query_id, "rank", item_id, "score"])


def mmr_order(similarity: np.ndarray, relevance: np.ndarray, top_n: int, diversity: float) -> list[int]:
    """Positions in the order chosen: first the most relevant, then each time the best trade-off of
    relevance against the closest choice so far. Inputs are sorted by relevance; ties go first."""
    if not len(relevance):
        return []
    chosen = [0]
    closest = similarity[0].copy()
    while len(chosen) < min(top_n, len(relevance)):
        value = np.round((1 - diversity) * relevance - diversity * closest, 9)
        value[chosen] = -np.inf
        best = int(np.argmax(value))
        chosen.append(best)
        closest = np.maximum(closest, similarity[best])
    return chosen


def mmr_orders(similarity: np.ndarray, relevance: np.ndarray, top_n: int, diversity: float) -> np.ndarray:
    """:func:`mmr_order` of many queries of as many rows each, a row of positions for each query."""
    each = np.arange(len(relevance))
    chosen = np.zeros((len(each), min(top_n, relevance.shape[1])), np.int64)
    taken = np.zeros(relevance.shape, bool)
    taken[:, 0] = True
    closest = similarity[:, 0].copy()
    for step in range(1, chosen.shape[1]):
        value = np.round((1 - diversity) * relevance - diversity * closest, 9)
        value[taken] = -np.inf
        best = np.argmax(value, axis=1)
        chosen[:, step], taken[each, best] = best, True
        closest = np.maximum(closest, similarity[each, best])
    return chosen
