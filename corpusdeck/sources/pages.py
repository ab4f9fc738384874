"""Documents from page rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdeck.operators.filters import not_blank


def assemble_pages(
    pages: DataFrame, fallback: DataFrame | None = None, doc: str = "doc_id", page: str = "page_no", text: str = "text"
) -> DataFrame:
    """``(doc, text)``: the non-empty pages in order, each followed by a newline.

    A document that comes out blank is taken from ``fallback``, where *all* pages count. So are documents that
    only ``fallback`` has. The pages of one document end up in one string, so a document has to fit in a row.
    """
    kept = _join_pages(pages, doc, page, text, F.col(text) != "")
    if fallback is None:
        return kept
    other = _join_pages(fallback, doc, page, text, F.lit(True)).select(F.col(doc).alias("_doc"), F.col(text).alias("_other"))
    chosen = F.when(not_blank(F.col(text)), F.col(text)).otherwise(F.coalesce("_other", F.col(text)))
    both = kept.join(other, F.col(doc).eqNullSafe(F.col("_doc")), "full")
    return both.select(F.coalesce(doc, "_doc").alias(doc), chosen.alias(text))


def _join_pages(pages: DataFrame, doc: str, page: str, text: str, keep: Column) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.when(keep, F.struct(page, text))))
    return pages.groupBy(doc).agg(
        F.array_join(F.transform(listed, lambda p: F.concat(p[text], F.lit("\n"))), "").alias(text)
    )


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_author(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<meta\s+name=[\"']author[\"']\s+content=[\"']([^\"']*)[\"']", 1)


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments go with their content, then all tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"[\s]+", " "))


def page_metadata(pages: DataFrame, as_of: Column, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """``(doc, title, author, pages, extraction_date)`` from page rows with ``title`` and ``author``.

    Title and author are those of the first page that has one, else ``Unknown``; a document without
    readable pages (null ``page_no``) has 0 pages. Plain aggregates, so a document with very many
    pages is combined before the shuffle.
    """

    def first_known(name: str) -> Column:
        known = F.col(name).isNotNull() & (F.trim(F.col(name)) != "")
        return F.coalesce(F.min_by(F.when(known, F.col(name)), F.when(known, F.col(page))), F.lit("Unknown"))

    return pages.groupBy(doc).agg(
        first_known("title").alias("title"),
        first_known("author").alias("author"),
        F.count(page).alias("pages"),
        F.first(F.date_format(as_of, "yyyy-MM-dd")).alias("extraction_date"),
    )
