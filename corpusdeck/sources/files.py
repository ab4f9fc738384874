"""File listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_files(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """``(path, name, size_kb)`` of the files whose name ends in ``suffix``, any case.

    ``content`` is not selected, so no file is opened. Files without a single byte are not listed.
    """
    glob = "*" + "".join(f"[{ch.lower()}{ch.upper()}]" if ch.isalpha() else ch for ch in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.round(F.col("length") / 1024, 1).alias("size_kb"),
    )
