"""Word and character n-gram vectors for text classifiers, trained by numpy stochastic gradient descent.

A bag of words is the average of the vectors of its features: each word and its character n-grams, hashed
into a table. The average goes through a linear softmax of two classes. As that is linear, a word adds
one number (the margin of its features) and a count to its bag, which workers remember.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdeck.llm.common import CACHE_WORDS, fold, raw_text, worker_memory


@dataclass(frozen=True)
class Settings:
    """``rows`` labelled texts of each class, of at most ``longest`` bytes, are learned from: the bound
    on what the driver holds. Texts are scored whole, whatever their size."""

    buckets: int = 1 << 18
    width: int = 8
    shortest_gram: int = 3
    longest_gram: int = 5
    rows: int = 1500
    longest: int = 40_000
    epochs: int = 8
    batch: int = 32
    rate: float = 0.5
    lower: bool = False
    seed: int = 5


AGAIN = b"="


def tokens(text: bytes) -> list[bytes]:
    """Words; one that repeats the word before it becomes a sign of its own, so that what is learned from
    one run of repeats holds for others."""
    words = text.split()
    return words[:1] + [AGAIN if a == b else b for a, b in zip(words, words[1:], strict=False)]


def features(word: bytes, s: Settings) -> list[int]:
    text = f"<{word.decode().lower() if s.lower else word.decode()}>"
    grams = [text]
    for n in range(s.shortest_gram, s.longest_gram + 1):
        grams += [text[k : k + n] for k in range(len(text) - n + 1)]
    return [zlib.crc32(g.encode()) % s.buckets for g in grams]


@dataclass
class Bags:
    """Bags of words over a vocabulary whose features lie end to end."""

    settings: Settings
    numbers: dict[bytes, int] = field(default_factory=dict)
    found: list[np.ndarray] = field(default_factory=list)

    def of(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words), np.int64)
        for k, w in enumerate(words):
            if (n := self.numbers.get(w)) is None:
                n = self.numbers[w] = len(self.found)
                self.found.append(np.array(features(w, self.settings), np.int64))
            out[k] = n
        return out

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """All features, and where those of each word begin."""
        sizes = np.fromiter(map(len, self.found), np.int64, len(self.found))
        return np.concatenate([*self.found, np.zeros(0, np.int64)]), np.concatenate([[0], np.cumsum(sizes)])


class Model:
    def __init__(self, settings: Settings) -> None:
        rng = np.random.default_rng(settings.seed)
        self.settings = settings
        # Features never seen keep the zero vector and say nothing.
        self.vectors = np.zeros((settings.buckets, settings.width), np.float32)
        self.output = rng.normal(0, 1, (settings.width, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.seen = np.full(settings.buckets, 1e-8, np.float32)

    def margins(self) -> np.ndarray:
        """What each feature adds to the logit of class 1 against class 0."""
        return self.vectors @ (self.output[:, 1] - self.output[:, 0])

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])

    def step(self, bags: list[np.ndarray], labels: np.ndarray, table: np.ndarray, starts: np.ndarray, rate: float) -> None:
        """One stochastic gradient step, for vectors, output and bias together."""
        words = np.concatenate(bags)
        sizes = starts[words + 1] - starts[words]
        at = np.repeat(starts[words] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        used = table[at]
        bag = np.repeat(np.repeat(np.arange(len(bags)), [len(b) for b in bags]), sizes)
        counts = np.bincount(bag, minlength=len(bags)).astype(np.float32)
        unique, back = np.unique(used, return_inverse=True)
        share = 1 / np.maximum(counts, 1)[bag]
        own = self.vectors[unique]
        hidden = np.zeros((len(bags), self.settings.width), np.float32)
        for k in range(self.settings.width):
            hidden[:, k] = np.bincount(bag, own[back, k] * share, len(bags))
        logits = hidden @ self.output + self.bias
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        error = prob
        error[np.arange(len(bags)), labels] -= 1
        error /= len(bags)
        slope = error @ self.output.T
        change = np.empty_like(own)
        for k in range(self.settings.width):
            change[:, k] = np.bincount(back, slope[bag, k] * share, len(unique))
        self.seen[unique] += (change**2).mean(axis=1)
        self.vectors[unique] -= rate * change / np.sqrt(self.seen[unique])[:, None]
        self.output -= rate * 0.1 * (hidden.T @ error)
        self.bias -= rate * 0.1 * error.sum(axis=0)


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, s: Settings, doc: str, text: str) -> tuple[list[bytes], np.ndarray]:
    """At most ``s.rows`` labelled texts of each class from outside the held-out part, in hash order."""
    open_ = labels.filter(F.col(label).isin(0, 1) & (fold(doc, parts) != held))
    open_ = open_.select(F.col(doc).cast("long").alias("_id"), F.col(label).cast("int").alias("_label"))
    got_texts: list[bytes] = []
    got_labels: list[int] = []
    for value in (0, 1):
        few = open_.filter(F.col("_label") == value).distinct().orderBy(F.xxhash64("_id"), "_id").limit(s.rows)
        short = docs.select(F.col(doc).cast("long").alias("_id"), raw_text(text).alias("_text")).filter(F.octet_length("_text") <= s.longest)
        # `few` has at most s.rows ids. Rows of a repeated id are bounded again.
        rows = short.join(F.broadcast(few), "_id").orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text")).limit(s.rows)
        found = rows.select("_text").toArrow().column(0).to_pylist()
        got_texts += found
        got_labels += [value] * len(found)
    return got_texts, np.array(got_labels, np.int64)


#: Fixed point of a word's margin, beside its feature count in the low bits of one integer.
COUNT_BITS = 24
SCALE = 1 << 12
#: Bytes of a word beyond which its features are hashed in blocks and its sums kept apart.
LONG, BLOCK = 1 << 14, 1 << 18
LONG_WORD = -(1 << 62)
CRC = np.array([zlib.crc32(bytes([k]), 0xFFFFFFFF) ^ 0xFFFFFFFF for k in range(256)], np.uint32)


def long_sums(word: bytes, margins: np.ndarray, s: Settings) -> tuple[float, int]:
    """Margin and number of the features of a word of any length, ``BLOCK`` n-grams at a time."""
    text = f"<{word.decode().lower() if s.lower else word.decode()}>".encode()
    data = np.frombuffer(text, np.uint8)
    starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)).astype(np.int32)
    total, count = float(margins[zlib.crc32(text) % s.buckets]), 1
    for n in range(s.shortest_gram, s.longest_gram + 1):
        grams = max(0, len(starts) - n)
        count += grams
        for at in range(0, grams, BLOCK):
            end = min(at + BLOCK, grams)
            first, size = starts[at:end], starts[at + n : end + n] - starts[at:end]
            crc = np.full(end - at, 0xFFFFFFFF, np.uint32)
            for k in range(int(size.max())):
                own = np.flatnonzero(size > k)
                crc[own] = CRC[(crc[own] ^ data[first[own] + k]) & 0xFF] ^ (crc[own] >> np.uint32(8))
            total += float(margins[~crc % np.uint32(s.buckets)].sum(dtype=np.float64))
    return total, count


class WordMargins(dict):
    """Word to its margin and feature count in one integer, remembered while there is room. Long words are
    marked, not remembered."""

    def __init__(self, margins: np.ndarray, settings: Settings) -> None:
        self.margins, self.settings = margins, settings

    def __missing__(self, word: bytes) -> int:
        if len(word) > LONG:
            return LONG_WORD
        own = features(word, self.settings)
        got = (round(float(self.margins[own].sum(dtype=np.float64)) * SCALE) << COUNT_BITS) + len(own)
        if len(self) < CACHE_WORDS:
            self[word] = got
        return got


def word_margins(key: str, margins: np.ndarray, settings: Settings) -> WordMargins:
    """The worker's memory for a model."""
    return worker_memory(f"margins {key}", lambda: WordMargins(margins, settings))


def parts_of(known: WordMargins, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Margins and feature counts of ``words``."""
    both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    margins, counts = (both >> COUNT_BITS) / SCALE, both & ((1 << COUNT_BITS) - 1)
    for k in np.flatnonzero(both == LONG_WORD).tolist():
        margins[k], counts[k] = long_sums(words[k], known.margins, known.settings)
    return margins, counts


def new_key() -> str:
    return uuid.uuid4().hex


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
