"""The training-record store.

Two layouts: ``list``, one JSON array per file, as interactive tools write it, each parsed by one task;
``lines``, JSON lines partitioned by record type, which is what :func:`write_training` produces and what large
stores should use, since its files split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusdeck.operators.skew import lookup

RECORD = (
    "type string, text string, sentiment string, confidence double, category string, score double, "
    "source_file string, timestamp string"
)


#: Records of one list file, which one task parses.
LIST_ROWS = 10_000
BROKEN = "_broken"


def write_training(df: DataFrame, path: str, name: str = "training_data", layout: str = "lines") -> None:
    """Append the records below ``path/name``; an empty batch adds no record.

    ``list`` writes text files of one JSON array each, of about ``LIST_ROWS`` records; no list is held in a row."""
    target = f"{path.rstrip('/')}/{name}"
    if layout == "lines":
        df.write.mode("append").partitionBy("type").json(target)
        return
    if layout != "list":
        raise ValueError(f"unknown layout {layout!r}")
    lists = max(1, -(-df.count() // LIST_ROWS))
    record = F.to_json(F.struct(*df.columns))
    dealt = df.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(lists)).alias("list"), record.alias("value"))
    place = F.row_number().over(Window.partitionBy("list").orderBy("value")).cast("long")
    numbered = dealt.withColumn("ord", place)
    separated = numbered.withColumn("value", F.when(F.col("ord") == 1, F.col("value")).otherwise(F.concat(F.lit(","), "value")))
    # Every list gets its ends, whatever was dealt to it.
    ends = F.array(*[F.struct(F.lit(at).cast("long").alias("ord"), F.lit(end).alias("value")) for at, end in ((0, "["), (2**63 - 1, "]"))])
    frames = df.sparkSession.range(lists).select(F.col("id").alias("list"), F.inline(ends))
    lines = separated.select("list", "ord", "value").unionByName(frames)
    placed = lines.repartition("list").sortWithinPartitions("list", "ord")
    placed.select("list", "value").write.mode("append").partitionBy("list").text(target)


def read_training(
    spark: SparkSession, path: str, name: str = "training_data", layout: str = "lines", suffix: str = ".json"
) -> DataFrame:
    """All records of the store.

    ``list`` reads the files below ``path`` whose name contains ``name`` and ends with ``suffix``, record by
    record, and skips files that are broken or hold anything but a list of objects. A value of another type
    than its column is null.
    """
    if layout == "lines":
        return spark.read.schema(RECORD).json(f"{path.rstrip('/')}/{name}")
    if layout != "list":
        raise ValueError(f"unknown layout {layout!r}")
    columns = [c.split() for c in RECORD.split(", ")]
    chosen = {"pathGlobFilter": f"*{name}*{suffix}", "recursiveFileLookup": "true"}
    # As text, so that a value of another type is no broken file. Numbers as variants: for text the reader goes back
    # to the file for the digits of each.
    loose = ", ".join(f"{c} {'variant' if kind == 'double' else 'string'}" for c, kind in columns) + f", {BROKEN} string"
    parsed = spark.read.options(**chosen, multiLine="true", columnNameOfCorruptRecord=BROKEN).schema(loose).json(path)
    # The reader refuses queries of the broken text alone, such as a count: one more column is looked at.
    sound = F.concat_ws("", BROKEN, F.substring("type", 1, 0)) == ""
    records = parsed.select("*", F.col("_metadata.file_path").alias("_path")).filter(sound)
    # The reader gives one row for a list of one object and for an object alone: what a file begins with tells.
    pieces = spark.read.options(**chosen, lineSep=",").text(path)
    begins = pieces.filter((F.col("_metadata.file_block_start") == 0) & F.col("value").rlike(r"\S")).select(
        F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_at"), "value"
    )
    first = begins.groupBy("_path").agg(F.min_by("value", "_at").alias("_first"))
    lists = first.filter(F.col("_first").rlike(r"^\s*\[")).select("_path")
    found = lookup(records, lists, "_path", F.xxhash64("text"))
    values = {c: f"try_variant_get({c}, '$', 'string')" if kind == "double" else c for c, kind in columns}
    return found.select(*[F.expr(f"try_cast({values[c]} AS {kind})").alias(c) for c, kind in columns])


def training_stats(records: DataFrame) -> DataFrame:
    """One row of counts; a missing source counts as one value, an empty store gives zeros."""
    return records.agg(
        F.count("*").alias("total_samples"),
        F.count_if(F.col("type") == "sentiment").alias("sentiment_samples"),
        F.count_if(F.col("type") == "entity").alias("entity_samples"),
        F.countDistinct(F.coalesce("source_file", F.lit(""))).alias("files_count"),
    )
