"""Quality classifier: learned word and character n-gram vectors, averaged over the whole document.

Trained by stochastic gradient descent in numpy on a bounded sample of labelled texts
(:class:`~corpusdeck.llm.subwords.Settings`); every document is scored over its whole text.

A null text is empty; an empty text has no features and gets the score of the bias alone. Null labels and
null ids are not learned from; a null id is not held out. Repeated rows are scored alike. With no labelled
row of a class the model stays at its start, and all scores are one half. An empty table gives an empty
table. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdeck.llm.common import fold, in_batches, raw_text
from corpusdeck.llm.subwords import Bags, Model, Settings, new_key, parts_of, sample, sigmoid, tokens, word_margins


def train(texts: list[bytes], labels: np.ndarray, s: Settings) -> Model:
    model, bags = Model(s), Bags(s)
    if len(set(labels.tolist())) < 2:
        return model
    docs = [bags.of(tokens(t)) for t in texts]
    table, starts = bags.lookup()
    rng = np.random.default_rng(s.seed)
    for epoch in range(s.epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), s.batch):
            part = order[at : at + s.batch]
            model.step([docs[k] for k in part], labels[part], table, starts, s.rate / (1 + epoch))
    return model


def score_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, held: int = 0, settings: Settings | None = None,
    threshold: float = 0.3, doc: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, held_out, score, predicted``; learns from labels whose ``crc32(doc_id) mod parts`` is not
    ``held``."""
    s = settings or Settings(epochs=6)
    model = train(*sample(docs, labels, label, parts, held, s, doc, text), s)
    sent = docs.sparkSession.sparkContext.broadcast(model.margins())
    key, offset = new_key(), model.offset()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, scores = word_margins(key, sent.value, s), np.zeros(batch.num_rows)
        for k, t in enumerate(batch.column(2).to_pylist()):
            margins, counts = parts_of(known, tokens(t))
            scores[k] = margins.sum() / max(1, counts.sum())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigmoid(scores + offset))], ["doc_id", "held_out", "score"])

    given = docs.select(
        F.col(doc).cast("long").alias("doc_id"), F.coalesce(fold(doc, parts) == held, F.lit(False)).alias("held_out"), raw_text(text).alias("text")
    )
    scored = given.mapInArrow(in_batches(work), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
