"""Training-set preparation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdeck.functions.arrays import bind, pad
from corpusdeck.functions.text import label_id, space_tokens, split_bucket, truncate_text, word_tokens
from corpusdeck.operators.similar import similar_partners
from corpusdeck.operators.skew import fits

IGNORED = -100
PAD_ID, UNKNOWN_ID, FIRST_ID = 0, 1, 2
#: Texts that are tagged at once.
TAGGED_ROWS = 64


def collect_training(analysis: DataFrame, as_of: Column, max_chars: int | None = None) -> DataFrame:
    """Training records: one per sound sentiment, one per related entity. The text of a sentiment is the
    analysis's ``text_preview``, cut to ``max_chars`` if given.

    Both kinds are rows of one array, so the analysis is read once rather than once per kind.
    """
    stamp = F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss")
    source = F.coalesce("filename", F.lit("unknown"))
    missing = F.lit(None)
    text = F.coalesce("text_preview", F.lit(""))
    sentiment = F.struct(
        F.lit("sentiment").alias("type"),
        (text if max_chars is None else truncate_text(text, max_chars)).alias("text"),
        F.col("sentiment.overall_sentiment").alias("sentiment"),
        F.col("sentiment.confidence").alias("confidence"),
        missing.cast("string").alias("category"),
        missing.cast("double").alias("score"),
    )
    sound = F.col("sentiment").isNotNull() & F.col("sentiment.error").isNull()
    none = F.filter(F.array(sentiment), lambda _: F.lit(False))
    entities = F.transform(
        F.filter("entities", lambda e: F.coalesce(e["is_related"], F.lit(False))),
        lambda e: F.struct(
            F.lit("entity").alias("type"),
            e["text"].alias("text"),
            missing.cast("string").alias("sentiment"),
            missing.cast("double").alias("confidence"),
            e["category"].alias("category"),
            e["score"].alias("score"),
        ),
    )
    rows = F.concat(F.when(sound, F.array(sentiment)).otherwise(none), F.coalesce(entities, none))
    # Outer, because the inner form adds an emptiness filter that computes the rows again.
    listed = analysis.select(F.inline_outer(rows), source.alias("source_file"), stamp.alias("timestamp"))
    return listed.filter(F.col("type").isNotNull())


def sentiment_samples(df: DataFrame) -> DataFrame:
    """``(text, sentiment)`` from stored records (``type``, ``sentiment`` string) or from analyses
    (``sentiment`` struct)."""
    if dict(df.dtypes)["sentiment"].startswith("struct"):
        return df.filter(F.col("sentiment.error").isNull()).select(
            "text", F.col("sentiment.overall_sentiment").alias("sentiment")
        )
    kept = df.filter(F.col("type") == "sentiment") if "type" in df.columns else df
    return kept.filter(F.col("sentiment").isNotNull()).select("text", "sentiment")


def with_synthetic(real: DataFrame, synthetic: DataFrame | None, floor: int, replace: bool = False) -> DataFrame:
    """``real``, plus (or, with ``replace``, instead of it) ``synthetic`` if it has fewer than
    ``floor`` rows. The count is a scalar subquery, so nothing runs on the driver."""
    if synthetic is None:
        return real
    # Whether the floor is reached shows in its first rows.
    count = real.limit(floor).agg(F.count("*")).scalar()
    extra = synthetic.select(*real.columns).filter(count < floor)
    kept = real.filter(count >= floor) if replace else real
    return kept.unionByName(extra)


def sentiment_dataset(
    df: DataFrame, synthetic: DataFrame | None = None, floor: int = 10, max_chars: int | None = None, longer_than: int = 10
) -> DataFrame:
    """``(text, label)`` from records or analyses; label ids NEGATIVE 0, NEUTRAL 1, POSITIVE 2."""
    cut = sentiment_samples(df)
    if max_chars is not None:
        cut = cut.withColumn("text", truncate_text(F.col("text"), max_chars))
    kept = cut.filter(F.length("text") > longer_than)
    both = with_synthetic(kept, synthetic, floor)
    return both.select("text", label_id(F.col("sentiment")).alias("label"))


def vocabulary(df: DataFrame, size: int = 30_000, text: str = "text") -> DataFrame:
    """``(word, id)``: the ``size`` most frequent words, ids from 2 by frequency then spelling.

    All other words share the unknown id, so no text loses a position.
    """
    words = df.select(F.explode_outer(word_tokens(F.lower(text))).alias("word"))
    top = words.filter(F.col("word").isNotNull()).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    listed = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("_v"))
    return listed.select(F.posexplode("_v").alias("pos", "_w")).select(
        F.col("_w.word").alias("word"), (F.col("pos") + FIRST_ID).alias("id")
    )


def tokenize_pad(df: DataFrame, vocab: DataFrame, n: int = 256, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, input_ids, attention_mask)`` of exactly ``n`` positions.

    The first ``n`` words of a text are placed by document before they fan out, so regrouping needs no
    shuffle where the vocabulary is small enough to broadcast; a larger one is joined by word.
    """
    words = F.slice(word_tokens(F.lower(text)), 1, n)
    placed = df.select(doc, words.alias("_words")).repartition(doc)
    rows = placed.select(doc, F.posexplode_outer("_words").alias("pos", "word"))
    found = rows.join(F.broadcast(vocab) if fits(vocab) else vocab, "word", "left")
    entry = F.struct("pos", F.coalesce("id", F.lit(UNKNOWN_ID)).alias("id"))
    grouped = found.groupBy(doc).agg(
        F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), entry))).alias("_ids")
    )
    return grouped.select(
        doc,
        pad(F.transform("_ids", lambda e: e["id"]), n, F.lit(PAD_ID)).alias("input_ids"),
        pad(F.transform("_ids", lambda _: F.lit(1)), n, F.lit(0)).alias("attention_mask"),
    )


def bio_tags(
    df: DataFrame,
    synthetic: DataFrame | None = None,
    floor: int = 10,
    max_chars: int | None = None,
    kind: str = "FASHION",
    doc: str = "doc_id",
    text: str = "text",
    entities: str = "entities",
) -> DataFrame:
    """``(doc, tokens, ner_tags)`` of texts with entities (``array<string>``).

    Every exact token match of an entity is tagged, later entities and later matches overwriting
    earlier ones: a position takes the tag of the covering match with the greatest (entity
    position, start). Row-local: at every token the entities that begin with it are looked up, so the
    cost is that of the tokens and matches, however many entities there are. Entities without a token, and
    nulls, are ignored.
    """
    kept = df.filter((F.length(text) > 0) & (F.size(entities) > 0))
    cut = F.col(text) if max_chars is None else truncate_text(F.col(text), max_chars)
    phrases = F.transform(entities, lambda e: F.coalesce(space_tokens(e), F.array().cast("array<string>")))
    given = kept.select(doc, space_tokens(cut).alias("tokens"), phrases.alias("phrases"))
    tags = ("O", f"B-{kind}", f"I-{kind}")

    def tag(tokens: list[str], phrases: list[list[str]]) -> list[str]:
        # By first token, then by length: a phrase's last place among the entities.
        known: dict[str, dict[int, dict[tuple[str, ...], int]]] = {}
        for at, phrase in enumerate(phrases):
            if phrase:
                known.setdefault(phrase[0], {}).setdefault(len(phrase), {})[tuple(phrase)] = at
        best: dict[int, tuple[int, int]] = {}
        for start, token in enumerate(tokens):
            for size, there in known.get(token, {}).items():
                found = there.get(tuple(tokens[start : start + size]))
                if found is not None:
                    for place in range(start, start + size):
                        best[place] = max(best.get(place, (-1, -1)), (found, start))
        out = [tags[0]] * len(tokens)
        for place, (_, start) in best.items():
            out[place] = tags[1] if start == place else tags[2]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few texts at a time as Python objects, each of them many times its bytes.
            for part in (batch.slice(at, TAGGED_ROWS) for at in range(0, batch.num_rows, TAGGED_ROWS)):
                both = zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)
                tagged = pa.array([tag(t, p) for t, p in both], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), tagged], names=[doc, "tokens", "ner_tags"])

    kind_of = df.schema[doc].dataType.simpleString()
    real = given.mapInArrow(run, f"{doc} {kind_of}, tokens array<string>, ner_tags array<string>")
    return with_synthetic(real, synthetic, floor)


def fixed_width_pieces(width: int = 4) -> Callable[[Column], Column]:
    """Splitter that cuts a word into pieces of ``width`` characters."""

    def split(word: Column) -> Column:
        last = F.greatest(F.ceil(F.length(word) / F.lit(width)).cast("int"), F.lit(1)) - 1
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(word, i * width + 1, F.lit(width)))

    return split


def longest_match_pieces(pieces: Sequence[str]) -> Callable[[Column], Column]:
    """Splitter by a given vocabulary of pieces: the longest that fits at each place, else one character."""
    ordered = sorted({p for p in pieces if p}, key=lambda p: (-len(p), p))
    pattern = "|".join([*(re.sub(r"(\W)", r"\\\1", p) for p in ordered), r"[\s\S]"])

    def split(word: Column) -> Column:
        return F.when(F.length(word) > 0, F.regexp_extract_all(word, F.lit(pattern), F.lit(0))).otherwise(F.array(F.lit("")))

    return split


def tag_vocabulary(df: DataFrame, tags: str = "ner_tags") -> DataFrame:
    """One row with the sorted distinct tags: a tag's id is its position."""
    each = df.select(F.explode(tags).alias("tag")).distinct()
    return each.agg(F.sort_array(F.collect_list("tag")).alias("tags"))


def align_subtokens(
    df: DataFrame,
    tag_ids: DataFrame | Sequence[str] | None = None,
    splitter: Callable[[Column], Column] | None = None,
    n: int = 128,
    tokens: str = "tokens",
    tags: str = "ner_tags",
) -> DataFrame:
    """Replace word tags by sub-token ``pieces`` and ``labels`` of exactly ``n`` positions.

    The first piece of a word carries its tag id, other pieces and padding get -100. ``tag_ids`` are the
    tags in the order of their ids, as names or as a table; without them the input is read twice.
    """
    split = splitter or fixed_width_pieces()
    if tag_ids is None or isinstance(tag_ids, DataFrame):
        ids = tag_ids if tag_ids is not None else tag_vocabulary(df, tags)
        known = ids.select("tags").scalar()
    else:
        known = F.array(*[F.lit(t) for t in tag_ids])
    staged = df.withColumn("_tags", known)
    # A word has at least one piece, so no word after the first n has one that is kept.
    words = F.arrays_zip(F.slice(tokens, 1, n).alias("w"), F.slice(tags, 1, n).alias("t"))
    expanded = F.flatten(
        F.transform(
            words,
            lambda x: F.transform(
                split(x["w"]),
                lambda piece, j: F.struct(
                    piece.alias("piece"),
                    F.when(j == 0, F.array_position(F.col("_tags"), x["t"]).cast("int") - 1)
                    .otherwise(F.lit(IGNORED))
                    .alias("label"),
                ),
            ),
        )
    )
    staged = staged.withColumn("_pieces", F.slice(expanded, 1, n))
    return staged.select(
        *[c for c in df.columns if c not in (tokens, tags)],
        pad(F.transform("_pieces", lambda p: p["piece"]), n, F.lit("[PAD]")).alias("pieces"),
        pad(F.transform("_pieces", lambda p: p["label"]), n, F.lit(IGNORED)).alias("labels"),
    )


def train_test_split(df: DataFrame, key: str = "doc_id", test: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split``: ``test`` for a share of the keys, else ``train``.

    A hash of the key decides, so the split needs no shuffle and stays put when data are added.
    """
    bucket = split_bucket(F.col(key), seed)
    return df.withColumn("split", F.when(bucket < round(test * 100), "test").otherwise("train"))


def positive_pairs(
    df: DataFrame,
    synthetic: DataFrame | None = None,
    floor: int = 10,
    longer_than: int = 20,
    batch: int = 8,
    similar: float | None = 0.8,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(key, anchor, positive, positive_key, similarity, batch)``: each usable text with the most similar
    other text found, if one reaches ``similar`` (:func:`corpusdeck.operators.similar.similar_partners`), else
    with itself, in about ``rows / batch`` hash batches. Without ``similar`` all are paired with themselves.
    Fewer than ``floor`` usable texts are replaced by ``synthetic``."""
    kept = df.select(key, text).filter(F.length(text) > longer_than)
    chosen = with_synthetic(kept, synthetic, floor, replace=True)
    batches = F.greatest(F.ceil(chosen.agg(F.count("*")).scalar() / batch), F.lit(1))
    digest = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    numbered = chosen.select(key, F.col(text).alias("anchor"), F.pmod(digest, batches).alias("batch"))
    alone = [F.col(key).alias("positive_key"), F.lit(1.0).alias("similarity")]
    order = [key, "anchor", "positive", "positive_key", "similarity", "batch"]
    if similar is None:
        return numbered.select("*", F.col("anchor").alias("positive"), *alone).select(*order)
    partners = similar_partners(chosen, similar, key=key, text=text)
    texts = chosen.select(F.col(key).alias("other"), F.col(text).alias("positive"))
    # Only texts with a partner meet another text.
    paired = numbered.join(partners, key).join(texts, "other").withColumnRenamed("other", "positive_key")
    single = numbered.join(partners.select(key), key, "left_anti").select("*", F.col("anchor").alias("positive"), *alone)
    return paired.select(*order).unionByName(single.select(*order))
