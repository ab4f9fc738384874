"""A training corpus from ``documents``: toxic texts out, one text of each group of near copies, repeated
passages out, texts with benchmark passages out, the rest packed into sequences of token ids.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``documents``, with
``n_chars`` as the length of the text that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusdeck.llm import decontamination, packing, simhash, substrings, toxicity
from corpusdeck.llm.common import stored, table
from corpusdeck.llm.queries import tokenizer_file
from corpusdeck.llm.shipping import ship

#: Near copies: words of a shingle, and the most bits in which linked fingerprints differ.
SHINGLE, RADIUS = 3, 2
#: Words of a passage that is removed where it stands again.
PASSAGE = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id stays; of equal rows with that id, one. Texts
    without words are copies of each other."""
    ship(spark)
    return simhash.keep_first(docs, simhash.Routes.pigeonhole(RADIUS), SHINGLE)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that lose words are what is left of them, with one space between words; others stay as they
    are. A text that loses all its words goes."""
    ship(spark)
    found = substrings.dedup_substrings(docs, window=PASSAGE)
    left = found.filter((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    columns = {c: F.col("row")[c] for c in docs.columns if c != "text"}
    columns |= {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return left.select(*[columns[c].alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces with their ids, sequence by sequence."""
    ship(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), "blank_free", end=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: Trained scores, fingerprints and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
