"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A few toxic words do not move the average of a long text, so bags are windows of words: a document's score
is that of its worst window, over the whole text. Training follows that: whole texts first, then, in each
epoch, every text's worst window under the model so far. Misspellings never met share character n-gram
vectors with what was learned; features never met say nothing.

A null text is empty; an empty text has no window and gets the score of the bias alone. Null labels and
null ids are not learned from; a null id is not held out. Repeated rows are scored alike. With no labelled
row of a class the model stays at its start, and all scores are one half. An empty table gives an empty
table. Other columns are passed on by :func:`keep_clean` only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdeck.llm.common import fold, in_batches, raw_text
from corpusdeck.llm.subwords import Bags, Model, Settings, new_key, parts_of, sample, sigmoid, tokens, word_margins

#: Words of a window, and from one window to the next.
WIDTH = 6
STEP = 2
WARM_UP = 2


def window_starts(words: int) -> np.ndarray:
    """Starts of windows that cover all words; the last one ends with the text."""
    last = max(0, words - WIDTH)
    return np.append(np.arange(0, last, STEP), last)


def window_margins(margins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Average margin of each window."""
    starts = window_starts(len(margins))
    ends = np.minimum(starts + WIDTH, len(margins))
    m, n = np.concatenate([[0], np.cumsum(margins)]), np.concatenate([[0], np.cumsum(counts)])
    return (m[ends] - m[starts]) / np.maximum(n[ends] - n[starts], 1)


def train(texts: list[bytes], labels: np.ndarray, s: Settings) -> Model:
    model, bags = Model(s), Bags(s)
    if len(set(labels.tolist())) < 2:
        return model
    docs = [bags.of(tokens(t)) for t in texts]
    table, starts = bags.lookup()
    sizes = np.diff(starts)
    rng = np.random.default_rng(s.seed)
    for epoch in range(s.epochs):
        chosen = docs
        if epoch >= WARM_UP:
            margins = np.add.reduceat(model.margins()[table], starts[:-1])
            chosen = []
            for d in docs:
                at = 0
                if len(d) > WIDTH:
                    at = window_starts(len(d))[np.argmax(window_margins(margins[d], sizes[d]))]
                chosen.append(d[at : at + WIDTH])
        order = rng.permutation(len(docs))
        for at in range(0, len(order), s.batch):
            part = order[at : at + s.batch]
            model.step([chosen[k] for k in part], labels[part], table, starts, s.rate / (1 + 0.3 * epoch))
    return model


SETTINGS = Settings(epochs=10, lower=True)


def _scorer(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, s: Settings, doc: str, text: str) -> Callable[[list[bytes]], np.ndarray]:
    model = train(*sample(docs, labels, label, parts, held, s, doc, text), s)
    sent = docs.sparkSession.sparkContext.broadcast(model.margins())
    key, offset = new_key(), model.offset()

    def scores(texts: list[bytes]) -> np.ndarray:
        known, out = word_margins(key, sent.value, s), np.zeros(len(texts))
        for k, t in enumerate(texts):
            if words := tokens(t):
                out[k] = window_margins(*parts_of(known, words)).max()
        return sigmoid(out + offset)

    return scores


def score_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, held: int = 2, settings: Settings = SETTINGS,
    threshold: float = 0.3, doc: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, held_out, score, predicted``; learns from labels whose ``crc32(doc_id) mod parts`` is not
    ``held``."""
    scores = _scorer(docs, labels, label, parts, held, settings, doc, text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(scores(batch.column(2).to_pylist()))], ["doc_id", "held_out", "score"]
        )

    given = docs.select(
        F.col(doc).cast("long").alias("doc_id"), F.coalesce(fold(doc, parts) == held, F.lit(False)).alias("held_out"), raw_text(text).alias("text")
    )
    scored = given.mapInArrow(in_batches(work), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, held: int = 2, settings: Settings = SETTINGS,
    threshold: float = 0.3, doc: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``docs`` with all their columns, without the documents that score ``threshold`` or more."""
    scores = _scorer(docs, labels, label, parts, held, settings, doc, text)
    at = docs.columns.index(text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
        return batch.filter(pa.array(scores(texts) < threshold))

    return docs.mapInArrow(in_batches(work), docs.schema)
