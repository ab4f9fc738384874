"""Word vectors from co-occurrence counts.

Words that stand within a window of each other are counted, weighed by positive pointwise mutual
information and projected to ``size`` dimensions: every context word has a vector of signs drawn from its
hash, and a word's vector is the weighted sum over its contexts. Weights are whole multiples of ``1 / SCALE``,
so sums are exact and the vectors are the same for any partitioning. The vocabulary lies in buckets and is
never on the driver; pairs travel as numbers, so a frequent word is no more than its distinct contexts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from corpusdeck.functions.arrays import bind
from corpusdeck.functions.text import drop_words, word_tokens
from corpusdeck.operators.terms import (
    LEAST_SHARDS,
    by_shard,
    coded_words,
    flat_words,
    free_memory,
    in_buckets,
    lines,
    sharded_words,
    squeezed,
    summed_rows,
    unsqueezed,
)
from corpusdeck.operators.wordvectors import document_slices, units, vector_shard_count, word_vectors_of_shards
from corpusdeck.session import scratch_path, shuffles_freed, stored

SCALE = 1 << 20
MOST_DIMENSIONS = 128
#: Characters of the texts of a shard and for each block of words, about; turns in which a shard's pairs are counted;
#: slices of a block's contexts; pairs that wait to be merged and that are weighed at once; pairs whose signs are added
#: at once.
PAIR_SHARD_CHARS = 12_000_000
BLOCK_CHARS = 96_000_000
TURNS = 4
SLICES = 8
WAITING = 1 << 21
STEP = 1 << 15


def _words(text: str, stops: Iterable[str]) -> Column:
    return drop_words(word_tokens(F.lower(text), 2), stops)


def word_pairs(df: DataFrame, stops: Iterable[str] = (), window: int = 2, text: str = "text") -> DataFrame:
    """``(a, b, n)`` with ``a <= b``: how often two words stand at most ``window`` words apart, in either
    order; ``b`` is null in the row with the number of occurrences of ``a``. One scan and one shuffle."""

    def pairs(words: Column) -> Column:
        def apart(k: int) -> Column:
            length = F.greatest(F.size(words) - k, F.lit(0))
            return F.zip_with(
                F.slice(words, 1, length), F.slice(words, k + 1, length), lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
            )

        alone = F.transform(words, lambda x: F.struct(x.alias("a"), F.lit(None).cast("string").alias("b")))
        return F.concat(alone, *(apart(k) for k in range(1, window + 1)))

    rows = df.select(F.explode_outer(bind(_words(text, stops), pairs)).alias("p")).select("p.a", "p.b")
    return rows.filter("a is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def cooccurrence(pairs: DataFrame) -> DataFrame:
    """``(word, context, n)`` in both directions; a word beside itself counts once in each."""
    both = F.when(
        F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("context"), (2 * F.col("n")).alias("n")))
    ).otherwise(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("context"), F.col("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("context"), F.col("n"))))
    return pairs.filter("b is not null").select(F.inline(both))


def _sign_bits(words: list[str], size: int, seed: int) -> np.ndarray:
    """The bits of a word's signs, 32 in a number; a set bit is -1."""
    digests = b"".join(hashlib.md5(f"{seed}:{w}".encode()).digest() for w in words)
    return np.frombuffer(digests, ">u4").reshape(-1, 4)[:, : (size + 31) // 32].astype("<u4")


def _neighbours(row: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words at most ``window`` words apart in one row, left and right."""
    for k in range(1, window + 1):
        left = np.flatnonzero(row[: max(len(row) - k, 0)] == row[k:])
        yield left, left + k


def _merged(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once with the sum of its ``n``."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(n[order], first) if len(first) else n[order]


def _added(sums: np.ndarray, x: np.ndarray, bits: np.ndarray, weight: np.ndarray) -> None:
    """Adds to ``sums[x]`` the signs of ``bits`` times ``weight``; ``x`` is in order."""
    part, shift = np.divmod(np.arange(sums.shape[1]), 32)
    for a in range(0, len(x), STEP):
        own = x[a : a + STEP]
        minus = (bits[a : a + STEP][:, part] >> shift.astype(np.uint32)) & np.uint32(1)
        first = np.flatnonzero(np.diff(own, prepend=-1))
        w = weight[a : a + STEP]
        signed = np.where(minus, -w[:, None], w[:, None])
        sums[own[first]] += np.add.reduceat(signed, first, axis=0)


def _packed_pairs(number: np.ndarray, row: np.ndarray, bucket: np.ndarray, place: np.ndarray, window: int, buckets: int) -> dict[str, list]:
    """The pairs of the words ``number`` of a shard in both directions, a row for each block of the first and slice of
    the second word. A pair is a number, ``place`` of the first times ``base`` plus place of the second in its slice;
    numbers are in order and kept as differences."""
    at = place * -(-buckets // SLICES) + bucket // SLICES
    base, heads = int(at.max(initial=0)) + 1, int(place.max(initial=0)) + 1
    out = {"_block": [], "slice": [], "base": [], "pairs": [], "n": []}
    for turn in range(TURNS):
        # In turns, as all pairs at once would take several times the memory of the texts.
        first = (place >= 0) & (bucket % TURNS == turn)
        found = []
        for left, right in _neighbours(row, window):
            a, b = number[left], number[right]
            for x, y in ((a, b), (b, a)):
                both = np.flatnonzero(first[x] & (place[y] >= 0))
                x, y = x[both], y[both]
                found.append(((bucket[x] * SLICES + bucket[y] % SLICES) * heads + place[x]) * base + at[y])
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        groups, keys = np.divmod(keys, heads * base)
        starts = np.append(np.flatnonzero(np.diff(groups, prepend=-1)), len(groups))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            block, part = divmod(int(groups[a]), SLICES)
            columns = block, part, base, squeezed(np.diff(keys[a:b], prepend=0)), squeezed(n[a:b] - 1)
            for column, value in zip(out.values(), columns, strict=True):
                column.append(value)
    return out


def train_embeddings(
    df: DataFrame,
    stops: Iterable[str] = (),
    size: int = 64,
    min_count: int = 5,
    window: int = 2,
    seed: int = 42,
    text: str = "text",
    path: str | None = None,
) -> DataFrame:
    """``(word, n, vector, sums)``: occurrences and unit vector of every word that occurs ``min_count`` times and has
    a context of positive weight, and the whole numbers that the vector has the direction of. Written to ``path`` if
    given, else to the scratch folder.

    Texts are tokenised once and placed in shards. A shard's distinct words go to their buckets with their occurrences
    and neighbours; a bucket numbers its frequent words and sends the numbers back. Pairs of frequent words leave a shard
    as numbers, to the bucket of the first word, where all shards' counts meet the figures of the second words. So
    neither words nor vectors travel with pairs."""
    if not 0 < size <= MOST_DIMENSIONS:
        raise ValueError(f"{size} dimensions; a hash has signs for 1 to {MOST_DIMENSIONS}")
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    shards, buckets = max(LEAST_SHARDS, -(-chars // PAIR_SHARD_CHARS)), max(LEAST_SHARDS, -(-chars // BLOCK_CHARS))
    # Equal texts of different rows are dealt out.
    spread = [F.col(f.name) for f in df.schema.fields if not isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType))]
    joined = F.array_join(_words(text, stops), " ").alias("_words")
    words = by_shard(df.select(F.pmod(F.xxhash64(*spread), F.lit(shards)).cast("int").alias("_shard"), joined), shards)

    def counted(table: pa.Table) -> pa.Table:
        free_memory()
        vocab, number, row = coded_words(table["_words"])
        mass = np.zeros(len(vocab), np.int64)
        for left, right in _neighbours(row, window):
            mass += np.bincount(number[left], minlength=len(vocab)) + np.bincount(number[right], minlength=len(vocab))
        n = np.bincount(number, minlength=len(vocab))
        order, starts = in_buckets(vocab, buckets)
        runs = list(zip(starts[:-1], starts[1:], strict=True))
        rows = {
            "_bucket": np.arange(buckets, dtype=np.int32),
            "_shard": np.full(buckets, table["_shard"][0].as_py(), np.int32),
            "words": lines(vocab.take(pa.array(order)), starts),
            "n": [squeezed(n[order[a:b]]) for a, b in runs],
            "m": [squeezed(mass[order[a:b]]) for a, b in runs],
        }
        return pa.table(rows).filter(pa.array(np.diff(starts) > 0))

    each = words.groupBy("_shard").applyInArrow(counted, "_bucket int, _shard int, words string, n binary, m binary")
    met = each.repartition(buckets, "_bucket")

    def summed(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words of a bucket, their occurrences and neighbours, the frequent ones in order, the most frequent first, and
        the word of each entry and where each row's entries begin."""
        lists = pc.split_pattern(table["words"].combine_chunks(), "\n")
        coded = pc.list_flatten(lists).dictionary_encode()
        term, vocab = coded.indices.to_numpy(), coded.dictionary
        n, m = np.zeros((2, len(vocab)), np.int64)
        for total, column in ((n, "n"), (m, "m")):
            np.add.at(total, term, np.concatenate([unsqueezed(x) for x in table[column].to_pylist()]))
        by_word = pc.sort_indices(vocab).to_numpy()
        by_word = by_word[n[by_word] >= min_count]
        frequent = by_word[np.argsort(-n[by_word], kind="stable")]
        return vocab, n, m, frequent, term, np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))

    def places(table: pa.Table) -> pa.Table:
        vocab, _, _, frequent, term, starts = summed(table)
        place = np.zeros(len(vocab), np.int64)
        place[frequent] = np.arange(1, len(frequent) + 1)
        sent = [squeezed(place[term[a:b]]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        return pa.table([table["_bucket"], table["_shard"], sent], names=["_bucket", "_shard", "place"])

    def vocabulary(table: pa.Table) -> pa.Table:
        vocab, n, m, frequent, _, _ = summed(table)
        names = vocab.take(pa.array(frequent))
        rows = {
            "_bucket": table["_bucket"].slice(0, 1),
            "total": [int(m.sum())],
            "words": lines(names, np.array([0, len(names)])),
            "n": [squeezed(n[frequent])],
            "m": [squeezed(m[frequent])],
            "bits": [_sign_bits(names.to_pylist(), size, seed).tobytes()],
        }
        return pa.table(rows)

    numbers = by_shard(met.groupBy("_bucket").applyInArrow(places, "_bucket int, _shard int, place binary"), shards)
    known = met.groupBy("_bucket").applyInArrow(vocabulary, "_bucket int, total long, words string, n binary, m binary, bits binary")
    block = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_block")
    own = F.col("_bucket") == F.col("_block")
    known = known.select("*", block).withColumns({c: F.when(own, F.col(c)) for c in ("words", "n")}).repartition(buckets, "_block")

    def paired(table: pa.Table, numbers: pa.Table) -> pa.Table:
        free_memory()
        vocab, number, row = coded_words(table["_words"])
        number, row = number.astype(np.int32), row.astype(np.int32)
        order, starts = in_buckets(vocab, buckets)
        bucket, place = np.empty((2, len(vocab)), np.int64)
        bucket[order] = np.repeat(np.arange(buckets), np.diff(starts))
        sent = numbers.sort_by("_bucket")["place"].to_pylist()
        place[order] = np.concatenate([unsqueezed(x) for x in sent]) - 1 if sent else -1
        schema = pa.schema([("_block", pa.int32()), ("slice", pa.int32()), ("base", pa.int64()), ("pairs", pa.binary()), ("n", pa.binary())])
        return pa.table(_packed_pairs(number, row, bucket, place, window, buckets), schema=schema)

    both = words.groupBy("_shard").cogroup(numbers.groupBy("_shard"))
    pairs = both.applyInArrow(paired, "_block int, slice int, base long, pairs binary, n binary").repartition(buckets, "_block")

    def weighed(pairs: pa.Table, known: pa.Table) -> pa.Table:
        free_memory()
        figures = {r["_bucket"]: r for r in known.select(["_bucket", "m", "bits"]).to_pylist()}
        total = float(sum(known["total"].to_pylist()))
        none = squeezed(np.zeros(0, np.int64))
        mine = known.filter(pc.equal(known["_bucket"], known["_block"])).to_pylist() or [{"words": "", "n": none, "m": none}]
        words = mine[0]["words"].split("\n") if mine[0]["words"] else []
        n, m = unsqueezed(mine[0]["n"]), unsqueezed(mine[0]["m"]).astype(float)
        sums = np.zeros((len(words), size), np.int64)
        apart = -(-buckets // SLICES)
        for part in range(SLICES if pairs.num_rows else 0):
            own = [(b, unsqueezed(figures[b]["m"]), figures[b]["bits"]) for b in range(part, buckets, SLICES) if b in figures]
            base = max((len(x) for _, x, _ in own), default=0) * apart
            mass, bits = np.zeros(base), np.zeros((base, (size + 31) // 32), np.uint32)
            for b, x, data in own:
                mass[b // SLICES :: apart][: len(x)] = x
                bits[b // SLICES :: apart][: len(x)] = np.frombuffer(data, "<u4").reshape(len(x), bits.shape[1])
            key, count, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []
            rows = pairs.filter(pc.equal(pairs["slice"], part))
            for i in range(rows.num_rows):
                first, second = np.divmod(np.cumsum(unsqueezed(rows["pairs"][i].as_py())), rows["base"][i].as_py())
                waiting.append((first * base + second, unsqueezed(rows["n"][i].as_py()) + 1))
                if i + 1 == rows.num_rows or sum(len(k) for k, _ in waiting) > max(WAITING, len(key)):
                    waiting.append((key, count))
                    key, count = _merged(np.concatenate([k for k, _ in waiting]), np.concatenate([c for _, c in waiting]))
                    waiting = []
            for a in range(0, len(key), WAITING):
                x, y = np.divmod(key[a : a + WAITING], base)
                lift = count[a : a + WAITING] * total / (m[x] * mass[y])
                weight = np.floor(SCALE * np.log(lift) + 0.5).astype(np.int64)
                kept = weight > 0
                _added(sums, x[kept], bits[y[kept]], weight[kept])
        vector, squares = units(sums)
        found = np.flatnonzero(squares > 0)
        offsets = pa.array(np.arange(0, len(found) * size + 1, size), pa.int32())
        columns = [pa.array(words, pa.string()).take(pa.array(found)), n[found]]
        columns += [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (vector[found], sums[found])]
        return pa.table(columns, names=["word", "n", "vector", "sums"])

    both = pairs.groupBy("_block").cogroup(known.groupBy("_block"))
    found = both.applyInArrow(weighed, "word string, n long, vector array<double>, sums array<long>")
    path = path or scratch_path(df.sparkSession, "word-vectors")
    with shuffles_freed(df.sparkSession):
        found.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(found.schema).parquet(path)


def embed_documents(
    df: DataFrame, vectors: DataFrame, size: int, stops: Iterable[str] = (), doc: str = "doc_id", text: str = "text", out: str = "embedding"
) -> DataFrame:
    """Add the mean vector of a document's known words, null if it has none. ``doc`` is a key; the vectors
    have ``size`` dimensions.

    Texts are tokenised once and placed in shards of documents; a shard's distinct words leave it and come back with their
    vectors. The means are stored in the scratch folder."""
    shards = vector_shard_count(df.agg(F.sum(F.length(text))).first()[0], size)
    words = sharded_words(df, shards, stops, doc, text)
    placed, packing = word_vectors_of_shards(words, vectors, shards, size)
    kind = df.schema[doc].dataType.simpleString()

    def means(table: pa.Table, found: pa.Table) -> pa.Table:
        free_memory()
        vectors = packing.unpacked(table, found)
        ids, mean = [], []
        for part in document_slices(table, doc):
            vocab, number, row, docs = flat_words(part, doc)
            matrix, known = vectors.rows(vocab)
            # A document's rows stand together.
            starts = np.searchsorted(docs.indices.to_numpy()[row], np.arange(len(docs.dictionary) + 1))
            for d, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                if n := int(known[number[a:b]].sum()):
                    ids.append(docs.dictionary[d])
                    mean.append(summed_rows(matrix, number[a:b]) / n)
        offsets = pa.array(np.arange(0, len(mean) * size + 1, size), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(mean) if mean else np.zeros(0)))
        return pa.table([pa.array(ids, table.schema.field(doc).type), lists], names=[doc, out])

    both = words.groupBy("_shard").cogroup(placed.groupBy("_shard"))
    with shuffles_freed(df.sparkSession):
        mean = stored(both.applyInArrow(means, f"{doc} {kind}, {out} array<double>"), "document-vectors")
    return df.drop(out).join(mean, doc, "left")
