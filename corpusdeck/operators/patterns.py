"""Mining which known keywords a corpus uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdeck.functions.lexicon import Lexicon


def mine_patterns(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``(category, keywords)``: the sorted distinct keywords present anywhere; empty categories stay.

    One pass with one boolean aggregate per keyword: a task returns a single row of flags.
    """
    staged = df.select(F.lower(text).alias("_lc"))
    words = list(dict.fromkeys(lexicon.keywords))
    flags = staged.agg(
        *[F.coalesce(F.bool_or(F.contains("_lc", F.lit(k))), F.lit(False)).alias(f"k{i}") for i, k in enumerate(words)]
    )
    rows = []
    for category in lexicon.groups:
        own = sorted(set(lexicon.group(category).keywords))
        present = [F.when(F.col(f"k{words.index(k)}"), F.lit(k)) for k in own]
        found = F.array_compact(F.array(*present)) if present else F.array().cast("array<string>")
        rows.append(F.struct(F.lit(category).alias("category"), found.alias("keywords")))
    return flags.select(F.inline(F.array(*rows)))


def keyword_documents(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``(category, keyword, documents)``: in how many texts each keyword occurs, zeros included."""
    staged = df.select(F.lower(text).alias("_lc"))
    entries = list(dict.fromkeys(lexicon.entries))
    counts = staged.agg(
        *[F.count_if(F.contains("_lc", F.lit(e.keyword))).alias(f"n{i}") for i, e in enumerate(entries)]
    )
    rows = [
        F.struct(F.lit(e.group).alias("category"), F.lit(e.keyword).alias("keyword"), F.col(f"n{i}").alias("documents"))
        for i, e in enumerate(entries)
    ]
    return counts.select(F.inline(F.array(*rows)))
