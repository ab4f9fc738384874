"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


# Join strategies follow measured sizes only. A table that grows with the corpus is never broadcast
# on the planner's estimate, which takes a few compressed megabytes of text for their keyword rows;
# once a shuffle has been written its true size is known, and small ones are still broadcast or
# hashed instead of sorted.
JOIN_SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}


def measured_joins(spark: SparkSession) -> SparkSession:
    """Apply :data:`JOIN_SETTINGS` to a session created elsewhere."""
    for key, value in JOIN_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "corpusdeck", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **JOIN_SETTINGS,
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, else the session's warehouse.

    Both are places that the driver and every executor reach; no machine-local folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df, name: str):
    """``df`` written once as a Parquet table below the shared folder, and read from there.

    What follows no longer depends on executors that computed it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go when a query ends; else they stay until the driver happens to
    collect its garbage, and the files of one step lie beside those of the next."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
