"""Storing mined patterns: long rows ``(category, keyword)``, nested on reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = "category string, ord int, keyword string"


def write_patterns(patterns: DataFrame, path: str) -> None:
    """``(category, keywords)`` to JSON lines; an empty category keeps a row with a null keyword."""
    long = patterns.select("category", F.posexplode_outer("keywords").alias("ord", "keyword"))
    long.write.mode("overwrite").json(path)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """``(category, keywords)`` as written."""
    stored = spark.read.schema(LONG).json(path)
    listed = F.sort_array(F.collect_list(F.when(F.col("keyword").isNotNull(), F.struct("ord", "keyword"))))
    return stored.groupBy("category").agg(F.transform(listed, lambda k: k["keyword"]).alias("keywords"))


def patterns_json(patterns: DataFrame) -> DataFrame:
    """All categories as one JSON object in one row; a pattern table is a lexicon, hence small."""
    entry = F.sort_array(F.collect_list(F.struct("category", "keywords")))
    return patterns.agg(F.to_json(F.map_from_entries(entry)).alias("patterns"))
