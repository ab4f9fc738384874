"""Lexicons: small parameter tables that become Column expressions.

A lexicon is a *bag* of ``(group, option, keyword)`` rows: a keyword listed twice counts twice.
Matching is case-insensitive containment. Each expression lower-cases its text once and runs over a
literal array, whatever the optimizer makes of the surrounding projections and filters. Beyond
``MAX_ENTRIES`` a lexicon is data rather than a parameter and belongs into a dictionary join
(:func:`corpusdeck.operators.entities.model_entities`).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdeck.functions.arrays import bind

MAX_ENTRIES = 5_000


@dataclass(frozen=True)
class Entry:
    group: str
    option: str
    keyword: str


class Lexicon:
    """An ordered bag of entries."""

    def __init__(self, entries: Iterable[Entry], groups: Iterable[str] = ()):
        self.entries = tuple(entries)
        if len(self.entries) > MAX_ENTRIES:
            raise ValueError(f"{len(self.entries)} entries: use a dictionary join instead")
        self.groups = tuple(dict.fromkeys([*groups, *(e.group for e in self.entries)]))

    @classmethod
    def words(cls, keywords: Iterable[str]) -> Lexicon:
        return cls(Entry("", "", k) for k in keywords)

    @classmethod
    def categories(cls, table: Mapping[str, Iterable[str]]) -> Lexicon:
        return cls((Entry(g, g, k) for g, ks in table.items() for k in ks), groups=table)

    @classmethod
    def facets(cls, table: Mapping[str, Mapping[str, Iterable[str]]]) -> Lexicon:
        rows = (Entry(f, o, k) for f, options in table.items() for o, ks in options.items() for k in ks)
        return cls(rows, groups=table)

    @classmethod
    def from_df(cls, df: DataFrame) -> Lexicon:
        """From ``(facet, option, keyword, ord)`` rows; refuses tables above ``MAX_ENTRIES``."""
        rows = df.select("facet", "option", "keyword").orderBy("ord").limit(MAX_ENTRIES + 1).collect()
        return cls(Entry(r.facet, r.option, r.keyword) for r in rows)

    @property
    def keywords(self) -> list[str]:
        return [e.keyword for e in self.entries]

    def group(self, name: str) -> Lexicon:
        return Lexicon((e for e in self.entries if e.group == name), groups=(name,))

    def options(self) -> dict[tuple[str, str], list[str]]:
        """Keywords per ``(group, option)``, in declaration order."""
        table: dict[tuple[str, str], list[str]] = {}
        for e in self.entries:
            table.setdefault((e.group, e.option), []).append(e.keyword)
        return table

    def matches(self, text: Column) -> Column:
        """The entries that occur, in lexicon order."""
        words = word_array(self.keywords)
        return bind(F.lower(text), lambda lc: F.filter(words, lambda k: F.contains(lc, k)))

    def score(self, text: Column) -> Column:
        """How many entries occur in the text."""
        return F.size(self.matches(text))

    def any(self, text: Column) -> Column:
        """Whether any entry occurs in the text."""
        return bind(F.lower(text), lambda lc: contains_any(lc, self.keywords))

    def groups_hit(self, text: Column) -> Column:
        """The groups with at least one occurring entry, in declaration order."""
        table = F.array(
            *[
                F.struct(F.lit(g).alias("name"), word_array(self.group(g).keywords).alias("words"))
                for g in self.groups
            ]
        )
        return bind(
            F.lower(text),
            lambda lc: F.transform(
                F.filter(table, lambda g: F.exists(g["words"], lambda k: F.contains(lc, k))), lambda g: g["name"]
            ),
        )


def word_array(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def contains_any(lc: Column, words: Iterable[str]) -> Column:
    return F.exists(word_array(words), lambda k: F.contains(lc, k))
