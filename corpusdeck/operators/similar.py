"""A similar partner for every text, by MinHash signatures in bands.

A text is the set of its shingles. Each of ``bands * rows`` hash functions keeps the smallest value of a
set; two texts are candidates if all ``rows`` values of some band agree, with chance ``1 - (1 - s ** rows)
** bands`` at similarity ``s`` (0.99999 at 0.8 with 16 bands of 3). Candidates are verified on whole sets.

Texts with equal sets are one class and stand in the bands once. In a band's bucket every text is held
against the text of smallest key alone, so a crowded bucket costs one comparison for each of its texts and
not the square of their number; what is found counts for both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdeck.functions.arrays import bind
from corpusdeck.functions.text import token_ngrams, word_tokens
from corpusdeck.session import stored

SHINGLE = 5
BANDS, ROWS = 16, 3
PRIME = (1 << 31) - 1


def hash_factors(count: int) -> list[tuple[int, int]]:
    """Factor and offset of each hash function: powers of two primitive roots of the prime."""
    return [(pow(48271, j, PRIME), pow(69621, j, PRIME)) for j in range(1, count + 1)]


def shingle_set(text: Column, size: int = SHINGLE) -> Column:
    """Distinct hashes (60 bits) of the runs of ``size`` lower-cased words; of all words, if there are fewer.
    Null for a text without words."""

    def hashed(words: Column) -> Column:
        grams = F.when(F.size(words) >= size, token_ngrams(words, size)).when(F.size(words) > 0, F.array(F.array_join(words, " ")))
        return F.array_distinct(F.transform(grams, lambda g: F.conv(F.substring(F.md5(g), 1, 15), 16, 10).cast("long")))

    return bind(word_tokens(F.lower(text)), hashed)


def digested_sets(df: DataFrame, shingle: int, key: str, text: str) -> DataFrame:
    """``(key, shingles, digest)`` of texts with words. The set leaves a generator, so neither the digest nor a
    filter works it out again."""

    def digested(own: Column) -> Column:
        return F.struct(own.alias("shingles"), F.sha2(F.array_join(F.array_sort(own), ","), 256).alias("digest"))

    both = F.transform(F.array(shingle_set(F.col(text), shingle)), digested)
    return df.filter(F.col(key).isNotNull()).select(key, F.inline_outer(both)).filter("shingles is not null")


def band_rows(sets: DataFrame, key: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(key, band, mins)`` for each band of each ``(key, shingles)``."""
    factor, offset = (np.array(x, np.int64)[:, None] for x in zip(*hash_factors(bands * rows), strict=True))

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.iloc[at : at + 100]
                mins = [_smallest(np.asarray(x, np.int64) % PRIME, factor, offset).reshape(bands, rows) for x in part["shingles"]]
                if mins:
                    values = [",".join(map(str, band)) for sign in mins for band in sign.tolist()]
                    yield pd.DataFrame({key: np.repeat(part[key].to_numpy(), bands), "band": np.tile(np.arange(bands), len(mins)), "mins": values})

    kind = sets.schema[key].dataType.simpleString()
    return sets.select(key, "shingles").mapInPandas(signed, f"{key} {kind}, band int, mins string")


def _smallest(values: np.ndarray, factor: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Of each hash function the smallest value, in blocks of bounded size."""
    blocks = (values[at : at + 4_096] for at in range(0, len(values), 4_096))
    return np.min([((factor * x + offset) % PRIME).min(axis=1) for x in blocks], axis=0)


def similar_partners(
    df: DataFrame, similar: float = 0.8, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, other, similarity)``: for every text with a candidate of Jaccard similarity ``similar`` or more
    the most similar one found, of equal ones that of smallest key. ``key`` is a key, nulls have no partner."""
    sets = stored(digested_sets(df, shingle, key, text), "similar-sets")
    classes = sets.groupBy("digest").agg(F.min(key).alias("first"))
    members = stored(sets.select(key, "digest").join(classes, "digest").select(key, "first"), "similar-classes")
    copies = members.filter(F.col(key) > F.col("first"))
    seconds = copies.groupBy(F.col("first").alias(key)).agg(F.min(key).alias("other"))
    equal = copies.select(key, F.col("first").alias("other")).unionByName(seconds).withColumn("similarity", F.lit(1.0))

    firsts = sets.join(members.filter(F.col(key) == F.col("first")).select(key), key)
    banded = stored(band_rows(firsts, key, bands, rows), "similar-bands")
    heads = banded.groupBy("band", "mins").agg(F.min(key).alias("other"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = banded.join(heads.drop("n"), ["band", "mins"]).filter(F.col(key) > F.col("other")).select(key, "other").distinct()
    others = sets.select(F.col(key).alias("other"), F.col("shingles").alias("theirs"), F.size("shingles").alias("_their_size"))
    # Sets whose sizes differ too much cannot be similar: sizes meet before the sets do.
    sized = met.join(sets.select(key, F.size("shingles").alias("_size")), key).join(others.select("other", "_their_size"), "other")
    near = sized.filter(F.least("_size", "_their_size") >= similar * F.greatest("_size", "_their_size")).select(key, "other")
    held = near.join(sets.select(key, "shingles"), key).join(others.select("other", "theirs"), "other")

    def jaccard(own: Column, theirs: Column) -> Column:
        return bind(F.size(F.array_intersect(own, theirs)), lambda both: both / (F.size(own) + F.size(theirs) - both))

    found = held.select(key, "other", jaccard(F.col("shingles"), F.col("theirs")).alias("similarity")).filter(F.col("similarity") >= similar)
    found = stored(found, "similar-found")
    back = found.select(F.col("other").alias(key), F.col(key).alias("other"), "similarity")
    both = equal.unionByName(found).unionByName(back)
    best = F.min(F.struct((-F.col("similarity")).alias("less"), F.col("other").alias("other")))
    return both.groupBy(key).agg(best.alias("_b")).select(key, "_b.other", (-F.col("_b.less")).alias("similarity"))
