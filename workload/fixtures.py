"""Parameters for the test corpus, whose prose is invented: lexicons of substrings that occur in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusdeck.functions.lexicon import Lexicon
from corpusdeck.functions.text import word_tokens
from corpusdeck.operators.sentiment import polarity_scorer
from corpusdeck.plans.analysis import AnalysisConfig
from corpusdeck.sources.tables import read_table

AS_OF = "2024-06-30 12:00:00"
STOPS = "the of and in to on is that it as be was for with this are by from at".split()
# "erin" counts twice: a lexicon is a bag.
GATE = ["thre", "thnt", "thes", "erin", "thor", "anea", "erin"]
SENTENCES = ["erin", "thor", "sch", "eau"]
POSITIVE = ["with", "from", "this"]
NEGATIVE = ["that", "are", "was"]
FACETS = {
    "tongue": {
        "english": ["ther", "thon", "than", "with", "this"],
        "german": ["sch", "und", "chen"],
        "romance": ["que", "eau", "ment", "oi", "ando"],
    },
    "texture": {"soft": ["ble", "ly"], "hard": ["erin", "ed"], "none": ["zzqx"]},
}
CATEGORIES = {
    "english": ["ther", "thon", "than", "with", "this"],
    "german": ["sch", "und", "chen"],
    "romance": ["que", "eau", "ment", "oi", "ando"],
    "soft": ["ble", "ly"],
    "hard": ["erin", "ed"],
    "none": ["zzqx"],
}
EXTRAS = ["tion"]
TERMS = [k for ks in CATEGORIES.values() for k in ks] + EXTRAS
PATTERNS = {"joined": [" the", " of"], "strong": ["thre", "erin"], "rare": ["zzqx"]}
MATERIALS = {"materials": ["ther", "erin", "sch", "eau", "ment", "zzqx"]}
PAIRS = ["of the", "in the", "on the", "and the"]
# A vocabulary of sub-word pieces; other letters stand alone.
PIECES = "the and ther thon tion ment with sch und chen que eau ing er es en on re st th an in ed ly ble".split()
SYNTHETIC_TAGS = [(-1, ["silk", "coat"], ["B-FASHION", "O"])]
SYNTHETIC_SENTIMENT = [("a calm and useful text", "POSITIVE"), ("a dull and broken text", "NEGATIVE")]

gate_lexicon = Lexicon.words(GATE)
sentence_lexicon = Lexicon.words(SENTENCES)
facet_lexicon = Lexicon.facets(FACETS)
category_lexicon = Lexicon.categories(CATEGORIES)
term_lexicon = Lexicon.words(TERMS)
pattern_lexicon = Lexicon.categories(PATTERNS)
material_lexicon = Lexicon.categories(MATERIALS)
scorer = polarity_scorer(POSITIVE, NEGATIVE)


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def raw_docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """``(phrase, label, score)``: the first two words of each benchmark item, and common pairs."""
    first_two = F.lower(F.array_join(F.slice(word_tokens(F.col("text")), 1, 2), " "))
    names = read_table(spark, sf, "benchmark").select(first_two.alias("phrase")).distinct()
    pairs = spark.createDataFrame([(p,) for p in PAIRS], "phrase string")
    both = names.withColumn("_pair", F.lit(0)).union(pairs.withColumn("_pair", F.lit(1)))
    return both.groupBy("phrase").agg(F.max("_pair").alias("_pair")).select(
        "phrase",
        F.when(F.col("_pair") == 1, "PAIR").otherwise("NAME").alias("label"),
        F.when(F.col("_pair") == 1, F.lit(0.8)).otherwise(F.lit(0.95)).alias("score"),
    )


def config(spark: SparkSession, sf: str) -> AnalysisConfig:
    return AnalysisConfig(
        scorer=scorer,
        dictionary=dictionary(spark, sf),
        patterns=pattern_lexicon,
        facets=facet_lexicon,
        stops=tuple(STOPS),
    )


def dims(spark: SparkSession, sf: str) -> DataFrame:
    """Report dimension rows ``(section, item, attr, ord, value)`` from the region and nation tables."""
    region = read_table(spark, sf, "region")
    nation = read_table(spark, sf, "nation")
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
    outlook = joined.select(
        F.lit("seasonal_outlook").alias("section"),
        F.col("r_name").alias("item"),
        F.lit("key_themes").alias("attr"),
        F.col("n_nationkey").alias("ord"),
        F.col("n_name").alias("value"),
    )
    strategy = region.select(
        F.lit("accessory_strategy").alias("section"),
        F.lit("strategy").alias("item"),
        F.lit("steps").alias("attr"),
        F.col("r_regionkey").alias("ord"),
        F.col("r_name").alias("value"),
    )
    return outlook.unionByName(strategy)
