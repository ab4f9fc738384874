"""Taxonomy facets: how strongly each option of each facet shows in a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdeck.functions.arrays import bind
from corpusdeck.functions.lexicon import Lexicon, word_array


def facet_hits(text: Column, lexicon: Lexicon) -> Column:
    """The options that occur: ``array<struct<facet, option, score, confidence, mentions>>``."""
    options = F.array(
        *[
            F.struct(F.lit(f).alias("facet"), F.lit(o).alias("option"), word_array(ks).alias("words"))
            for (f, o), ks in lexicon.options().items()
        ]
    )

    def found(lc: Column) -> Column:
        return F.transform(
            options,
            lambda o: F.struct(
                o["facet"].alias("facet"),
                o["option"].alias("option"),
                F.size(o["words"]).alias("of"),
                F.filter(o["words"], lambda k: F.contains(lc, k)).alias("mentions"),
            ),
        )

    hits = F.filter(bind(F.lower(text), found), lambda h: F.size(h["mentions"]) > 0)
    return F.transform(
        hits,
        lambda h: F.struct(
            h["facet"].alias("facet"),
            h["option"].alias("option"),
            F.size(h["mentions"]).alias("score"),
            F.least(F.size(h["mentions"]) / h["of"], F.lit(1.0)).alias("confidence"),
            h["mentions"].alias("mentions"),
        ),
    )


def facet_scores(df: DataFrame, lexicon: Lexicon, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Long form: one row per option that occurs, ``(doc, facet, option, score, confidence, mentions)``."""
    # Outer, because the inner form adds an emptiness filter that computes the array a second time.
    rows = df.select(doc, F.inline_outer(facet_hits(F.col(text), lexicon)))
    return rows.filter(F.col("facet").isNotNull())


def facet_map(df: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "facets") -> DataFrame:
    """Add the nested form: facet → option → ``struct<score, confidence, mentions>``.

    Options that do not occur are dropped, a facet's key always stays.
    """

    def nested(hits: Column) -> Column:
        def options_of(facet: Column) -> Column:
            return F.map_from_entries(
                F.transform(
                    F.filter(hits, lambda h: h["facet"] == facet),
                    lambda h: F.struct(h["option"], _score(h)),
                )
            )

        return F.map_from_entries(F.transform(word_array(lexicon.groups), lambda f: F.struct(f, options_of(f))))

    return df.withColumn(out, bind(facet_hits(F.col(text), lexicon), nested))


def _score(hit: Column) -> Column:
    return F.struct(
        hit["score"].alias("score"), hit["confidence"].alias("confidence"), hit["mentions"].alias("mentions")
    )
