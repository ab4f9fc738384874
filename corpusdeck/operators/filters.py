"""Row filters and run-or-skip gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdeck.functions.lexicon import Lexicon
from corpusdeck.functions.text import SPACE
from corpusdeck.operators.skew import attach_by_key


def relevance_gate(df: DataFrame, lexicon: Lexicon, k: int = 3, text: str = "text") -> DataFrame:
    """Keep texts that contain at least ``k`` lexicon entries; adds ``relevance``. Blank texts fail."""
    scored = df.withColumn("relevance", lexicon.score(F.col(text)))
    return scored.filter((F.col("relevance") >= k) & not_blank(F.col(text)))


def not_blank(c: Column) -> Column:
    return F.regexp_like(c, F.lit(f"[^{SPACE}]"))


def sentence_filter(c: Column, lexicon: Lexicon) -> Column:
    """Keep the ``.``-separated fragments that contain any entry, re-joined with ``". "``."""
    return F.array_join(F.filter(F.split(c, r"\."), lexicon.any), ". ")


def keyword_filter(df: DataFrame, lexicon: Lexicon, keyword: str = "keyword") -> DataFrame:
    """Keep keywords that contain any term; case and repeats stay as they are."""
    return df.filter(lexicon.any(F.col(keyword)))


def min_rows_gate(df: DataFrame, k: int, by: str | None = None, salt: str | None = None) -> DataFrame:
    """All rows if there are at least ``k`` of them, else none; with ``by``, the same per group.

    The count is a lazy scalar subquery, so nothing runs on the driver. Per group, the group counts
    are joined back with large groups salted by ``salt`` (default: all columns).
    """
    if by is None:
        return df.filter(df.agg(F.count("*")).scalar() >= k)
    counts = df.groupBy(by).agg(F.count("*").alias("_rows")).filter(F.col("_rows") >= k)
    spread = F.col(salt) if salt else F.struct(*df.columns)
    return attach_by_key(df, counts, by, "_rows", spread).select(*df.columns)


def usable_text(df: DataFrame, more_than: int, text: str = "text", entities: str | None = None) -> DataFrame:
    """Texts longer than ``more_than`` characters, optionally with at least one entity."""
    kept = df.filter(F.length(text) > more_than)
    return kept.filter(F.size(entities) > 0) if entities else kept


def flag_errors(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Add ``error``: the message of the first failing check, null for sound rows.

    ``checks`` maps a message to a condition that must hold; null counts as failing.
    """
    error = F.lit(None).cast("string")
    for message, holds in reversed(checks.items()):
        error = F.when(~F.coalesce(holds, F.lit(False)), F.lit(message)).otherwise(error)
    return df.withColumn("error", error)


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(sound rows, failed rows)`` of a frame with an ``error`` column."""
    return df.filter(F.col("error").isNull()).drop("error"), df.filter(F.col("error").isNotNull())
