"""Words grouped with their more frequent spelling variants, by pairs of trie nodes.

Two words are near if one inserted, deleted or replaced letter makes one the other. All words make up two
tries, one of the words and one of the words read backwards, and each node has a number. A word without its
letter ``i`` is then a pair of integers: the node of what stands before and the node of what follows. Words
with an equal pair differ in that letter alone. A word cut at ``i`` is a pair as well, which names this word
only; words whose pair without a letter equals it have one letter more. Both are one grouping of integer
pairs: a group holds at most one word for each letter of the alphabet, and is reduced to counts and best
neighbours without forming pairs of words. Of equal letters side by side only the first is left out to meet
a shorter word, so no two words meet twice.

Nodes of up to seven bytes are numbered by these bytes. Deeper ones are numbered in the order of the words,
where words of one head (their first seven bytes) come together: a word shares the nodes of its common
prefix with the word before it and takes new numbers for the others.

Words are counted in every task before they are grouped. A null text has no words and a null document id
counts as an empty one; repeated rows count each. Ties go to the word first in code-point order. An empty
table gives no rows; other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdeck.llm.common import raw_text, stored

#: Bytes of a prefix or suffix that are its number.
HEAD = 7
#: Distinct words that a task counts before it hands them on.
HELD = 300_000
#: Rows handed on at once.
ROWS = 200_000
#: What a pair stands for: a word cut at a place, a word without a letter, without the first of equal letters.
CUT, WITHOUT, WITHOUT_FIRST = 0, 1, 2


def word_counts(
    docs: DataFrame, letters: str = "A-Za-zÀ-ÿ", least: int = 7, times: int = 2, slip: int = 31, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``word, n``: the runs of ``letters`` in all texts, A-Z lower-cased, of at least ``least`` letters and
    ``times`` occurrences.

    With ``slip``, runs whose crc32 with the document id is divisible by it have lost a letter: a made-up
    misspelling, the same in any run of the job. 0 leaves all runs as they are.
    """
    # Maximal runs of fewer letters cannot give a word, and a longer match is a maximal run.
    pattern = re.compile(f"[{letters}]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            columns = [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        for batch in batches:
            for own, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = crc32(f"{own}:".encode())
                for word, n in Counter(pattern.findall(raw.lower().decode("utf-8", "replace"))).items():
                    if slip and (h := crc32(word.encode(), start)) % slip == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    keyed = docs.select(F.coalesce(F.col(doc).cast("string"), F.lit("")), raw_text(text))
    return keyed.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


class TrieNumbers:
    """Numbers of the trie nodes along words that come in order, those of one head together."""

    def __init__(self, part: int) -> None:
        self.next = (1 << 62) + (part << 40)
        self.word, self.nodes = "", [0]

    def along(self, word: str) -> list[int]:
        """The nodes of the prefixes of ``word``, the empty one first."""
        same, most = 0, min(len(word), len(self.word))
        while same < most and word[same] == self.word[same]:
            same += 1
        nodes = self.nodes[: same + 1]
        size = len(word[:same].encode()) if same < HEAD else HEAD
        for letter in word[same:]:
            raw = letter.encode()
            size += len(raw)
            if size <= HEAD:
                nodes.append(int.from_bytes(raw, "big") | nodes[-1] << 8 * len(raw))
            else:
                nodes.append(self.next)
                self.next += 1
        self.word, self.nodes = word, nodes
        return nodes


def _in_order(words: DataFrame, spelled: Column) -> DataFrame:
    head = F.substring(spelled.cast("binary"), 1, HEAD)
    return words.withColumn("spelled", spelled).withColumn("head", head).repartitionByRange("head").sortWithinPartitions("spelled")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, n`` in order to ``id, word, n, before``: ids ascend as the words do."""
    part = TaskContext.get().partitionId()
    tries, ids = TrieNumbers(part), part << 40
    for batch in batches:
        nodes = [tries.along(w) for w in batch.column(0).to_pylist()]
        own = pa.array(np.arange(ids, ids + len(nodes)))
        ids += len(nodes)
        columns = [own, batch.column(0), batch.column(1), pa.array(nodes, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "word", "n", "before"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, n, before, backwards`` in order of ``backwards`` to a row ``before, after, kind, id, n`` for
    each place and each letter of a word."""
    tries = TrieNumbers(TaskContext.get().partitionId())
    names, held, rows = ["before", "after", "kind", "id", "n"], [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)

    for batch in batches:
        for own, n, before, backwards in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            size = len(backwards)
            front, back = np.array(before), np.array(tries.along(backwards))[::-1]
            kind = np.full(2 * size + 1, CUT, np.int8)
            spelled = np.frombuffer(backwards.encode("utf-32-le"), "<u4")[::-1]
            kind[size + 1 :] = WITHOUT_FIRST - (spelled == np.append(np.uint32(0xFFFFFFFF), spelled[:-1])) if size else 0
            both = np.concatenate([front, front[:-1]]), np.concatenate([back, back[1:]])
            held.append((*both, kind, np.full(len(kind), own), np.full(len(kind), n)))
            rows += len(kind)
            if rows >= ROWS:
                yield out()
                held, rows = [], 0
    if held:
        yield out()


def near_counts(words: DataFrame) -> DataFrame:
    """``id, n_near, best`` (``struct(less_n, id)``, the near word of largest n) of every numbered word that
    has a near one. ``words`` has ``id, word, n, before`` of :func:`numbered`."""
    backwards = _in_order(words, F.reverse("word")).select("id", "n", "before", "spelled")
    pairs = backwards.mapInArrow(_pairs, "before long, after long, kind byte, id long, n long")
    # The smaller struct is the better neighbour: larger n, then the word first in order.
    own = F.struct((-F.col("n")).alias("less_n"), F.col("id").alias("id"))
    groups = pairs.groupBy("before", "after").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") != CUT, F.struct(own.alias("own"), (F.col("kind") == WITHOUT_FIRST).alias("first"))))).alias("longer"),
        F.max(F.when(F.col("kind") == CUT, own)).alias("whole"),
    )
    groups = groups.filter((F.size("longer") > 1) | ((F.size("longer") == 1) & F.col("whole").isNotNull()))

    def told(to: Column, n: Column, best: Column) -> Column:
        return F.struct(to.alias("id"), n.cast("long").alias("n_near"), best.alias("best"))

    def to_longer(x: Column) -> Column:
        first, size = F.get("longer", F.lit(0))["own"], F.size("longer")
        other = F.when(first["id"] == x["own"]["id"], F.get("longer", F.lit(1))["own"]).otherwise(first)
        shorter = F.when(x["first"], F.col("whole"))
        return told(x["own"]["id"], size - 1 + F.when(shorter.isNotNull(), 1).otherwise(0), F.least(other, shorter))

    firsts = F.filter("longer", lambda x: x["first"])
    to_whole = F.when(
        F.col("whole").isNotNull() & (F.size(firsts) > 0),
        F.array(told(F.col("whole")["id"], F.size(firsts), F.get(firsts, F.lit(0))["own"])),
    )
    messages = groups.select(F.concat(F.transform("longer", to_longer), F.coalesce(to_whole, F.array())).alias("to"))
    messages = messages.select(F.explode("to").alias("to")).select("to.*").filter("n_near > 0")
    return messages.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def numbered(words: DataFrame) -> DataFrame:
    """``id, word, n, before``: words numbered in code-point order, with the trie nodes of their prefixes."""
    ordered = _in_order(words.filter("word is not null").select("word", "n"), F.col("word")).select("word", "n")
    return ordered.mapInArrow(_numbered, "id long, word string, n long, before array<long>")


def ends_of(links: DataFrame, name: str) -> DataFrame:
    """``id, root`` of ``links (id, form)`` that form no ring: where the links from ``id`` end. Every round
    doubles the links that are followed."""
    ends = stored(links.select("id", F.col("form").alias("root")), name)
    while True:
        further = ends.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = stored(ends.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), "next"), name)
        ends = step.select("id", "root")
        if step.filter("next is not null").limit(1).count() == 0:
            return ends


def spelling_variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of distinct ``word, n``: the number of near words; the most
    frequent of them, if it is ``factor`` (2 at least) times as frequent as the word; the end of the chain of forms."""
    if factor < 2:
        raise ValueError("forms of equal frequency could follow each other for ever")
    words = stored(numbered(words), "variant-words")
    near = stored(near_counts(words), "variant-near")
    known = words.select("id", "word", "n").join(near, "id", "left")
    known = known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.id").alias("form"), (-F.col("best.less_n")).alias("form_n"))
    has = F.col("form_n") >= factor * F.col("n")
    known = known.withColumns({c: F.when(has, F.col(c)) for c in ("form", "form_n")})
    roots = ends_of(known.filter("form is not null").select("id", "form"), "variant-roots")
    spelled = words.select(F.col("id").alias("to"), F.col("word").alias("spelled"))
    links = (
        known.filter("form is not null").select("id", "form").join(roots, "id")
        .join(spelled, F.col("form") == F.col("to")).select("id", "root", F.col("spelled").alias("form_word"))
        .join(spelled, F.col("root") == F.col("to")).select("id", "form_word", F.col("spelled").alias("root_word"))
    )
    found = known.join(links, "id", "left")
    return found.select("word", "n", "n_near", F.col("form_word").alias("form"), "form_n", F.coalesce("root_word", "word").alias("root"))
