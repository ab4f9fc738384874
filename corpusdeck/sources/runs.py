"""Run records of training jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "training_date string, samples bigint, epochs int, artifacts map<string,string>, version string"
METRICS = "model string, training_date string, epochs int, metrics map<string,double>"
VERSION = "2.0"


def run_record(info: DataFrame, artifacts: dict[str, str], as_of: Column, version: str = VERSION) -> DataFrame:
    """``info`` is one row ``(samples, epochs)``."""
    paths = F.create_map(*[F.lit(x) for kv in artifacts.items() for x in kv]).cast("map<string,string>")
    return info.select(
        F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss").alias("training_date"),
        F.col("samples").cast("bigint").alias("samples"),
        F.col("epochs").cast("int").alias("epochs"),
        paths.alias("artifacts"),
        F.lit(version).alias("version"),
    )


def append_run(record: DataFrame, path: str) -> None:
    record.write.mode("append").json(path)


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    """The most recent run record, as one row."""
    runs = spark.read.schema(RUN).json(path)
    return runs.agg(F.max_by(F.struct(*runs.columns), "training_date").alias("_run")).select("_run.*")


def metrics_record(measured: DataFrame, as_of: Column, model: str = "model", epochs: str = "epochs") -> DataFrame:
    """One record for each row of ``measured``; every other column is a figure of that model."""
    figures = [c for c in measured.columns if c not in (model, epochs)]
    pairs = [x for c in figures for x in (F.lit(c), F.col(c).cast("double"))]
    return measured.select(
        F.col(model).cast("string").alias("model"),
        F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss").alias("training_date"),
        F.col(epochs).cast("int").alias("epochs"),
        F.create_map(*pairs).cast("map<string,double>").alias("metrics"),
    )


def latest_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The most recent metrics record of each model."""
    records = spark.read.schema(METRICS).json(path)
    return records.groupBy("model").agg(F.max_by(F.struct("training_date", "epochs", "metrics"), "training_date").alias("_m")).select("model", "_m.*")
