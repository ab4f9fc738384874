"""Scalar text functions.

Java's ``\\w`` and ``\\s`` are ASCII only; the classes below are their Unicode counterparts.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SPACE}]+", " ")


def clean_text(c: Column, strip_page_numbers: bool = False) -> Column:
    """Collapse whitespace, drop all but words, spaces and basic punctuation, trim.

    Collapsing removes every newline, so a page-number rule that looks for newlines can only act
    before it; that rule is off by default.
    """
    if strip_page_numbers:
        c = F.regexp_replace(c, rf"\n[{SPACE}]*\p{{Nd}}+[{SPACE}]*\n", "\n")
    return F.trim(F.regexp_replace(collapse_space(c), f"[^{WORD}{SPACE}.,!?;:()-]", ""))


def clean_lower(c: Column) -> Column:
    """Lower-case and blank out all but words, spaces and ``# @ & / -``."""
    return F.trim(collapse_space(F.regexp_replace(F.lower(c), f"[^{WORD}{SPACE}#@&/-]", " ")))


def word_tokens(c: Column, min_length: int = 1) -> Column:
    """Maximal runs of word characters of at least ``min_length``."""
    return F.regexp_extract_all(c, F.lit(f"[{WORD}]{{{min_length},}}"), F.lit(0))


def space_tokens(c: Column) -> Column:
    """Whitespace-separated tokens, none of them empty."""
    return F.regexp_extract_all(c, F.lit(f"[^{SPACE}]+"), F.lit(0))


def drop_words(tokens: Column, words: Iterable[str]) -> Column:
    """Remove every occurrence of ``words``, keeping order and the repeats of what stays."""
    banned = sorted(set(words))
    return F.filter(tokens, lambda t: ~t.isin(banned)) if banned else tokens


def token_ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring tokens joined by a blank. Pass a plain column, not an expression:
    the argument occurs several times.

    Arrays shifted against each other are zipped, which is linear in the text; a slice per run
    would copy the array each time.
    """
    grams = tokens
    for k in range(2, n + 1):
        length = F.greatest(F.size(tokens) - (k - 1), F.lit(0))
        grams = F.zip_with(
            F.slice(grams, 1, length), F.slice(tokens, k, length), lambda head, t: F.concat(head, F.lit(" "), t)
        )
    return grams


def preview(c: Column, length: int = 500) -> Column:
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c)


def truncate_text(c: Column, length: int = 512) -> Column:
    return F.substring(c, 1, length)


def chunks(c: Column, size: int = 500, cap: int | None = None) -> Column:
    """Consecutive chunks of ``size`` code points: all, or the first ``cap`` of them.

    The empty text is one empty chunk, a missing text none. One pass over the text finds them: ``substring``
    counts from the start of the text each time, which takes the square of its length.
    """
    if cap is not None:
        c = F.substring(c, 1, min(size * cap, (1 << 31) - 1))
    return F.when(c == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(c, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def title_case(c: Column) -> Column:
    """Capitalise every letter run, whatever stands before it; ``initcap`` only looks for blanks."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def heading(c: Column) -> Column:
    return title_case(F.replace(c, F.lit("_"), F.lit(" ")))


def growth_bounds(c: Column) -> Column:
    """``"15-20%"`` as ``struct(low, high)``; a single figure is both bounds, anything else null."""
    number = r"([0-9]+(?:\.[0-9]+)?)"
    low = F.regexp_extract(c, rf"^\s*{number}\s*%?", 1).try_cast("double")
    high = F.regexp_extract(c, rf"-\s*{number}\s*%?", 1).try_cast("double")
    return F.struct(low.alias("low"), F.coalesce(high, low).alias("high"))


def label_id(c: Column, labels: tuple[str, ...] = ("NEGATIVE", "NEUTRAL", "POSITIVE")) -> Column:
    """Position of the label, null if unknown."""
    rule = F.lit(None).cast("int")
    for i, label in reversed(list(enumerate(labels))):
        rule = F.when(c == label, F.lit(i)).otherwise(rule)
    return rule


def report_header(as_of: Column, documents: Column, prefix: str = "FTR", period: str = "12 Months") -> Column:
    return F.struct(
        F.date_format(as_of, "yyyy-MM-dd").alias("generation_date"),
        F.lit(period).alias("forecast_period"),
        documents.alias("documents_analyzed"),
        F.concat(F.lit(f"{prefix}-"), F.date_format(as_of, "yyyyMMdd")).alias("report_id"),
    )


def data_uri(c: Column) -> Column:
    """Base64 data URI; Spark breaks long Base64 into lines, a URI must not."""
    encoded = F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"[\r\n]", "")
    return F.concat(F.lit("data:text/plain;base64,"), encoded)


def split_bucket(id_col: Column, seed: int = 42, buckets: int = 100) -> Column:
    """A bucket in ``[0, buckets)`` that depends on the id and the seed alone, so it survives
    re-partitioning and re-runs."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string"))), 1, 8)
    return F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.lit(buckets)).cast("int")
