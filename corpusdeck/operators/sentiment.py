"""Chunked document sentiment.

Two forms. With an expression scorer everything happens inside the row and nothing is shuffled.
With a fitted model the chunks become rows, the model adds ``label`` and ``score``, and
:func:`roll_up_chunks` sums them per document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdeck.functions.text import chunks, word_tokens

DIGITS = 9
# Order decides ties.
LABELS = ("POSITIVE", "NEGATIVE", "NEUTRAL")

ChunkScorer = Callable[[Column], Column]


def polarity_scorer(positive: Iterable[str], negative: Iterable[str]) -> ChunkScorer:
    """Scorer by word lists: more hits win with their share of all hits, equal is NEUTRAL 0.5.

    Maps ``array<string>`` to ``array<struct<label, score>>``.
    """
    pos, neg = sorted(set(positive)), sorted(set(negative))

    def score(texts: Column) -> Column:
        words = F.transform(texts, lambda t: word_tokens(F.lower(t)))
        hits = F.transform(
            words,
            lambda ws: F.struct(
                F.size(F.filter(ws, lambda w: w.isin(pos))).alias("p"),
                F.size(F.filter(ws, lambda w: w.isin(neg))).alias("n"),
            ),
        )
        return F.transform(hits, _judge)

    return score


def _judge(h: Column) -> Column:
    p, n = h["p"], h["n"]
    return F.struct(
        F.when(p > n, "POSITIVE").when(n > p, "NEGATIVE").otherwise("NEUTRAL").alias("label"),
        F.when(p == n, F.lit(0.5)).otherwise(F.greatest(p, n) / (p + n)).alias("score"),
    )


def chunk_rows(df: DataFrame, text: str = "text", size: int = 500, cap: int | None = None) -> DataFrame:
    """One row per chunk: all columns but the text, plus ``chunk_no`` and ``chunk``."""
    kept = [c for c in df.columns if c != text]
    rows = df.select(*kept, F.posexplode_outer(chunks(F.col(text), size, cap)).alias("chunk_no", "chunk"))
    return rows.filter(F.col("chunk").isNotNull())


def chunk_sentiment(
    df: DataFrame,
    scorer: ChunkScorer,
    text: str = "text",
    size: int = 500,
    cap: int | None = None,
    model: str = "lexicon",
) -> DataFrame:
    """Add ``sentiment``: winning label, confidence over *all* chunks, the three sums, an error."""
    scored = df.withColumn("_scored", scorer(chunks(F.col(text), size, cap)))
    scored = scored.withColumns({f"_{label}": _label_sum(F.col("_scored"), label) for label in LABELS})
    n = F.size("_scored")
    known = F.forall("_scored", lambda s: F.upper(s["label"]).isin(list(LABELS)))
    out = scored.withColumn("sentiment", _sentiment({l: F.col(f"_{l}") for l in LABELS}, n, known, model))
    return out.drop("_scored", *[f"_{label}" for label in LABELS])


def _label_sum(scored: Column, label: str) -> Column:
    own = F.filter(scored, lambda s: F.upper(s["label"]) == label)
    return F.aggregate(own, F.lit(0.0), lambda total, s: total + s["score"])


def roll_up_chunks(scored: DataFrame, by: str = "doc_id", model: str = "model") -> DataFrame:
    """Per-document ``sentiment`` from chunk rows with ``label`` and ``score``."""
    label = F.upper("label")
    sums = scored.groupBy(by).agg(
        *[F.sum(F.when(label == l, F.col("score")).otherwise(0.0)).alias(f"_{l}") for l in LABELS],
        F.count("*").alias("_n"),
        F.bool_and(label.isin(list(LABELS))).alias("_known"),
    )
    sentiment = _sentiment({l: F.col(f"_{l}") for l in LABELS}, F.col("_n"), F.col("_known"), model)
    return sums.select(by, sentiment.alias("sentiment"))


def _sentiment(sums: dict[str, Column], n: Column, known: Column, model: str) -> Column:
    # Sums of the same scores in another order differ in their last bits, which must not pick the winner.
    sums = {label: F.round(s, DIGITS) for label, s in sums.items()}
    top = F.greatest(*sums.values())
    winner = F.lit(LABELS[-1])
    for label in reversed(LABELS[:-1]):
        winner = F.when(sums[label] == top, F.lit(label)).otherwise(winner)
    ok = F.coalesce(known, F.lit(False))
    detail = F.create_map(*[x for label in LABELS for x in (F.lit(label), sums[label])])
    return F.struct(
        F.when(ok, winner).alias("overall_sentiment"),
        F.when(ok, top / n).alias("confidence"),
        F.when(ok, detail).alias("detailed_scores"),
        F.lit(model).alias("model"),
        F.when(~ok, F.lit("sentiment analysis failed: no text or unknown label")).alias("error"),
    )
