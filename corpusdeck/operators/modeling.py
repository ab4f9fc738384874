"""Model training and scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from corpusdeck.defaults import SENTIMENT_LABELS
from corpusdeck.functions.arrays import argmax, bind
from corpusdeck.functions.text import split_bucket, word_tokens
from corpusdeck.session import stored

STEPS_PER_EPOCH = 10
CLASSES = len(SENTIMENT_LABELS)
#: Features whose gradients are summed together.
CHUNK = 256
PENALTY = 1e-4
#: A step by the smoothness of the loss over vectors of length one.
STEP = 2.0
SPLITS = ("train", "choice", "test")


@dataclass(frozen=True)
class SentimentModel:
    """Weights ``(features + 1, classes)``, the last row the offsets, and the idf of every feature."""

    idf: np.ndarray
    weights: np.ndarray

    def save(self, spark: SparkSession, path: str) -> None:
        row = (self.idf.tolist(), self.weights.ravel().tolist())
        spark.createDataFrame([row], "idf array<double>, weights array<double>").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> SentimentModel:
        row = spark.read.parquet(path).first()
        return SentimentModel(np.array(row["idf"]), np.array(row["weights"]).reshape(len(row["idf"]) + 1, -1))

    def probabilities(self, features: list[np.ndarray]) -> np.ndarray:
        rows, places, values = self._sparse(features)
        return _softmax(self._logits(len(features), rows, places, values))

    def _sparse(self, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of the TF-IDF vectors of length one: document, feature, value."""
        counted = [np.unique(np.asarray(x, np.int64), return_counts=True) for x in features]
        rows = np.repeat(np.arange(len(features)), [len(places) for places, _ in counted])
        places = np.concatenate([p for p, _ in counted]) if counted else np.zeros(0, np.int64)
        values = np.concatenate([n for _, n in counted]) * self.idf[places] if counted else np.zeros(0)
        norms = np.sqrt(np.bincount(rows, values * values, len(features)))
        return rows, places, values / np.maximum(norms, 1e-300)[rows]

    def _logits(self, n: int, rows: np.ndarray, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        each = values[:, None] * self.weights[places]
        return np.stack([np.bincount(rows, each[:, c], n) for c in range(each.shape[1])], axis=1) + self.weights[-1]


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _features(text: Column, features: int) -> Column:
    """Hashed words, with repeats; none for a null text."""
    hashed = F.transform(word_tokens(F.lower(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))
    return F.coalesce(hashed, F.array().cast("array<int>"))


def three_way_split(df: DataFrame, key: str = "doc_id", test: float = 0.2, choice: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``split``: ``test`` and ``choice`` for shares of the keys' hashes, else ``train``. The test rows
    are those of :func:`corpusdeck.operators.training.train_test_split`."""
    bucket, first = split_bucket(F.col(key), seed), round(test * 100)
    named = F.when(bucket < first, "test").when(bucket < first + round(choice * 100), "choice").otherwise("train")
    return df.withColumn("split", named)


def _one_pass(rows: DataFrame, model: SentimentModel) -> tuple[np.ndarray, float, dict[str, np.ndarray]]:
    """Gradient and mean loss over the train rows, and each split's counts of (label, predicted).

    Every task sums over its rows; the sums of a stretch of features are added up in tasks of their own, so
    that the driver gets one model's worth of numbers."""
    size = len(model.idf) + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gradient, told = np.zeros((size, CLASSES)), np.zeros(2 + len(SPLITS) * CLASSES * CLASSES)
        for batch in batches:
            if not len(batch):
                continue
            entries = model._sparse(batch["features"].tolist())
            chance = _softmax(model._logits(len(batch), *entries))
            label, split = batch["label"].to_numpy(np.int64), batch["split"].to_numpy(np.int64)
            cell = (split * CLASSES + label) * CLASSES + chance.argmax(axis=1)
            told[2:] += np.bincount(cell, minlength=len(told) - 2)
            own = split == 0
            told[:2] += own.sum(), -np.log(np.maximum(chance[np.arange(len(batch)), label], 1e-300))[own].sum()
            error = (chance - np.eye(CLASSES)[label]) * own[:, None]
            document, places, values = entries
            for c in range(CLASSES):
                gradient[:-1, c] += np.bincount(places, values * error[document, c], size - 1)
            gradient[-1] += error.sum(axis=0)
        flat = [*(gradient[at : at + CHUNK].ravel() for at in range(0, size, CHUNK)), told]
        yield pd.DataFrame({"chunk": range(len(flat)), "sums": flat})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": group["chunk"].iloc[:1], "sums": [np.sum(group["sums"].tolist(), axis=0)]})

    schema = "chunk int, sums array<double>"
    found = rows.mapInPandas(partial, schema).groupBy("chunk").applyInPandas(added, schema).collect()
    sums = [np.array(r.sums) for r in sorted(found, key=lambda r: r.chunk)]
    if not sums:
        return np.zeros((size, CLASSES)), 0.0, {s: np.zeros((CLASSES, CLASSES)) for s in SPLITS}
    told, n = sums[-1], max(sums[-1][0], 1.0)
    counts = dict(zip(SPLITS, told[2:].reshape(len(SPLITS), CLASSES, CLASSES), strict=True))
    return np.concatenate(sums[:-1]).reshape(size, CLASSES) / n, told[1] / n, counts


def accuracy(counts: np.ndarray) -> float:
    return float(np.trace(counts) / max(counts.sum(), 1))


def weighted_f1(counts: np.ndarray) -> float:
    support, called, hits = counts.sum(axis=1), counts.sum(axis=0), np.diag(counts)
    return float((support * 2 * hits / np.maximum(support + called, 1)).sum() / max(counts.sum(), 1))


def train_sentiment(
    df: DataFrame,
    as_of: Column,
    epochs: int = 3,
    features: int = 1 << 14,
    key: str = "doc_id",
    test: float = 0.2,
    choice: float = 0.1,
    seed: int = 42,
    path: str | None = None,
) -> tuple[SentimentModel, DataFrame]:
    """Three-class text classifier on ``(key, text, label)``, multinomial logistic regression over hashed
    TF-IDF; the model and its metrics row ``(epoch, train_loss, eval_accuracy, eval_f1, epochs,
    train_rows, choice_rows, test_rows, majority, training_date)``.

    Texts are read once, into a stored table of word hashes; one accelerated gradient descent goes on from
    epoch to epoch over it. The epoch of best accuracy on the ``choice`` rows is kept, and reported with its
    figures on the ``test`` rows, which decide nothing. ``majority`` is the share of their largest class.
    """
    parts = three_way_split(df.filter(F.col("label").isNotNull()), key, test, choice, seed)
    number = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split")) - 1
    rows = stored(parts.select(F.col("label").cast("int").alias("label"), number.cast("int").alias("split"), _features(F.col("text"), features).alias("features")), "sentiment-rows")
    train = rows.filter("split = 0")
    n = train.count()
    # One number for each feature: a parameter of the model.
    held = train.select(F.explode(F.array_distinct("features")).alias("f")).groupBy("f").agg(F.count("*").alias("n")).collect()
    idf = np.zeros(features)
    for r in held:
        idf[r.f] = np.log((1 + n) / (1 + r.n)) if r.n >= 2 else 0.0
    weights = ahead = np.zeros((features + 1, CLASSES))
    best, pace = None, 1.0
    for step in range(epochs * STEPS_PER_EPOCH + 1):
        gradient, loss, counts = _one_pass(rows, SentimentModel(idf, ahead))
        if step and step % STEPS_PER_EPOCH == 0 and (best is None or accuracy(counts["choice"]) > accuracy(best[3]["choice"])):
            best = (step // STEPS_PER_EPOCH, SentimentModel(idf, ahead), loss, counts)
        moved = ahead - STEP * (gradient + PENALTY * ahead)
        following = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = moved + (pace - 1) / following * (moved - weights)
        weights, pace = moved, following
    epoch, model, loss, counts = best
    if path:
        model.save(df.sparkSession, path)
    tested = counts["test"]
    majority = float(tested.sum(axis=1).max() / max(tested.sum(), 1))
    sizes = [int(counts[s].sum()) for s in SPLITS]
    row = [(epoch, float(loss), accuracy(tested), weighted_f1(tested), epochs, *sizes, majority)]
    schema = (
        "epoch int, train_loss double, eval_accuracy double, eval_f1 double, epochs int, "
        "train_rows long, choice_rows long, test_rows long, majority double"
    )
    stamp = F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss")
    return model, df.sparkSession.createDataFrame(row, schema).withColumn("training_date", stamp)


def score_batch(df: DataFrame, model: SentimentModel, labels: tuple[str, ...] = SENTIMENT_LABELS, text: str = "text") -> DataFrame:
    """Add ``label`` and ``score`` (probability of that label) from a fitted classifier."""
    kept = df.drop("label", "score")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "label string, score double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                chance = model.probabilities(batch.pop("_features").tolist())
                batch["label"] = [labels[k] for k in chance.argmax(axis=1)]
                batch["score"] = chance.max(axis=1)
                yield batch

    return kept.withColumn("_features", _features(F.col(text), len(model.idf))).mapInPandas(run, schema)


def score_with(
    df: DataFrame,
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    labels: tuple[str, ...],
    width: int,
    features: str = "features",
    batch: int = 1_024,
) -> DataFrame:
    """Add ``label`` and ``score`` of the best class by a model of the caller's own.

    ``make_predict()`` loads the model, once in every Python worker, and returns a function from a batch of
    ``features`` (rows of ``width`` numbers) to a row of class scores for each. Null features have no label;
    of equal scores the first class counts."""
    predict = predict_batch_udf(make_predict, return_type=ArrayType(DoubleType()), batch_size=batch, input_tensor_shapes=[[width]])
    known = F.transform(F.col(features), lambda x: x.cast("double"))
    usable = F.when(F.size(known) == width, known).otherwise(F.array_repeat(F.lit(0.0), width))
    scored = df.withColumn("_scores", predict(usable))
    names = F.array(*[F.lit(x) for x in labels])
    best = F.when(F.size(F.col(features)) == width, bind(F.col("_scores"), lambda s: F.struct(F.get(names, argmax(s)).alias("label"), F.array_max(s).alias("score"))))
    return scored.withColumn("_best", best).select(*[c for c in df.columns if c not in ("label", "score")], "_best.label", "_best.score")


def train_tagger(tagged: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Phrase dictionary ``(phrase, label, score)`` from ``(doc, tokens, ner_tags)`` rows.

    A phrase takes the tag it has most often (ties: the greater name), the score is that tag's share. Usable as the
    ``dictionary`` of :func:`corpusdeck.operators.entities.model_entities`.
    """
    rows = tagged.select(doc, F.posexplode(F.arrays_zip("tokens", "ner_tags")).alias("pos", "x")).select(
        doc, "pos", F.col("x.tokens").alias("token"), F.col("x.ner_tags").alias("tag")
    )
    inside = rows.filter(F.col("tag") != "O")
    order = Window.partitionBy(doc).orderBy("pos")
    numbered = inside.withColumn("_span", F.sum(F.when(F.col("tag").startswith("B-"), 1).otherwise(0)).over(order))
    entry = F.struct("pos", "token", "tag")
    spans = numbered.groupBy(doc, "_span").agg(F.sort_array(F.collect_list(entry)).alias("_s"))
    named = spans.select(
        F.lower(F.array_join(F.transform("_s", lambda x: x["token"]), " ")).alias("phrase"),
        F.substring(F.element_at("_s", 1)["tag"], 3, 1_000).alias("label"),
    )
    counts = named.groupBy("phrase", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("phrase").agg(
        F.max_by("label", F.struct("n", "label")).alias("label"), (F.max("n") / F.sum("n")).alias("score")
    )
