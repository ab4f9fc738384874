"""Evaluation metrics from class scores and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdeck.functions.arrays import argmax

IGNORED = -100


def confusion(df: DataFrame, scores: str = "scores", label: str = "label") -> DataFrame:
    """``(label, predicted, n)``, the prediction being the first highest score."""
    predicted = df.select(F.col(label).cast("int").alias("label"), argmax(F.col(scores)).alias("predicted"))
    return predicted.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def classification_metrics(df: DataFrame, scores: str = "scores", label: str = "label") -> DataFrame:
    """One row ``(accuracy, f1)``; F1 is weighted by support and 0 where undefined.

    Only the confusion counts leave the map side.
    """
    cells = confusion(df, scores, label)
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("c"), F.col("n").alias("support"), F.lit(0).alias("called"), hit.alias("hits")),
                F.struct(F.col("predicted").alias("c"), F.lit(0).alias("support"), F.col("n").alias("called"), F.lit(0).alias("hits")),
            )
        )
    )
    classes = sides.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("support", "called", "hits")])
    f1 = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("called")), F.lit(0.0))
    return classes.agg(
        F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.try_divide(F.sum(f1 * F.col("support")), F.sum("support")).alias("f1"),
    )


def token_accuracy(df: DataFrame, predicted: str = "predicted", labels: str = "labels") -> DataFrame:
    """One row ``(tokens, accuracy)`` over the positions whose label is not -100.

    Each row is reduced to two counts before anything is aggregated.
    """
    counted = df.select(
        F.size(F.filter(labels, lambda l: l != IGNORED)).alias("tokens"),
        F.size(
            F.filter(
                F.arrays_zip(F.col(predicted).alias("p"), F.col(labels).alias("l")),
                lambda x: (x["l"] != IGNORED) & (x["p"] == x["l"]),
            )
        ).alias("hits"),
    )
    return counted.agg(
        F.sum("tokens").alias("tokens"), F.try_divide(F.sum("hits"), F.sum("tokens")).alias("accuracy")
    )


def token_argmax(df: DataFrame, scores: str = "scores", out: str = "predicted") -> DataFrame:
    """Class ids per position from ``array<array<double>>`` scores."""
    return df.withColumn(out, F.transform(scores, argmax))
