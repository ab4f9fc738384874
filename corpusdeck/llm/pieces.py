"""SentencePiece ids of whole texts for vocabularies of merge type, and texts of ids.

The ids are those that the vocabulary's merges give, found without merging the text. An Aho-Corasick
automaton gives the longest piece that begins at each place. Pieces are taken from the left, longest first;
a piece may follow another only if the two are compatible, that is, if merging their joined letters anew
gives the same two again. Where none fits, the place is marked in a bitfield of failed positions, the last
piece is taken back and its next shorter prefix is tried. A chain of compatible pieces is the only result
merging can have for the text before it, so a place that failed once fails always, and each is tried once.

A letter without a piece takes the ids of its UTF-8 bytes (or the unknown id, in a vocabulary without
them). Pieces that merging never gives are left out of the automaton.

Whether two pieces are compatible is seen at their seam alone: from the whole pieces back to single letters,
the later of the two merges beside the seam is undone, and at each step merging over the seam must not come
first. That needs pieces that merge in order of priority, which is checked when a vocabulary is read; others
are merged anew as a whole.

Texts are cut where no piece reaches over: before blanks, at line ends, and between letters that stand side
by side in no piece. So words repeat, and a worker remembers those it met lately. A null text is empty: it
has the begin and end ids only. A byte that is not UTF-8 counts as U+FFFD, as in the library. Null ids and
repeated rows are kept, an empty table gives none; other columns are left out.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, pairwise
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusdeck.llm.common import in_batches, raw_text, worker_memory

SPACE = "▁"

#: Words, their parts and pairs of pieces that a worker remembers in each of two generations.
WORDS = 300_000
PARTS = 150_000
PAIRS = 200_000
#: Texts handled at once.
TEXTS = 400
#: Texts by which a vocabulary's normaliser is compared with "blanks become marks, one more in front".
PROBES = ("", "a", " a  b ", "Ａ①ﬁ ﾊﾟ", "é é ẛ̣", "a　b c d", "x\ty\nz\r\n", "­​\u0001", "<s>A")

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class Recent(dict):
    """Remembers what was met lately: entries not asked for during a whole generation are forgotten."""

    def __init__(self, room: int, make: Callable) -> None:
        super().__init__()
        self.room, self.make, self.older = room, make, {}

    def __missing__(self, key):
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        return got


class PieceCoder:
    """``encode`` and ``decode`` by a SentencePiece vocabulary file of merge type."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        ids = list(range(size))
        self.pieces: list[str] = sp.id_to_piece(ids)
        scores = sp.get_score(ids)
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        byte = {k: int(self.pieces[k][3:5], 16) for k in ids if sp.is_byte(k)}
        self.byte_ids = {v: k for k, v in byte.items()}
        silent = {k for k in ids if sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)}
        mergeable = [k for k in ids if k not in byte and k not in silent]
        #: Piece to its priority in merging, lowest first; equal scores share one.
        order = {s: at for at, s in enumerate(sorted({scores[k] for k in mergeable}, reverse=True))}
        self.priority = {self.pieces[k]: order[scores[k]] for k in mergeable}
        self.number = {self.pieces[k]: k for k in mergeable}
        #: Pieces that merging their letters gives.
        self.own_result = [False] * size
        for k in mergeable:
            self.own_result[k] = self.merged(self.pieces[k]) == [self.pieces[k]]
        self._automaton([k for k in mergeable if self.own_result[k]])
        self._merges(mergeable)
        self.compatible = Recent(PAIRS, self._compatible if self.ordered else self._merged_apart)
        self.parts = Recent(PARTS, self._part)
        self.words = Recent(WORDS, self._word)
        self.plain = all(sp.normalize(p) == (self.spaced(p) if p else "") for p in PROBES)
        self.surface = [b"" if k in silent else bytes([byte[k]]) if k in byte else p.replace(SPACE, " ").encode() for k, p in enumerate(self.pieces)]
        self.surface[self.unknown] = None
        #: Letters that stand side by side in a piece, and whether a text can be cut at its blanks and line ends.
        self.joined = {two for p in self.number for two in pairwise(p)}
        self.cuts = not any((p[1] == SPACE and p[0] != SPACE) or "\n" in p for p in self.joined)

    @staticmethod
    def spaced(text: str) -> str:
        return SPACE + text.replace(" ", SPACE)

    def merged(self, text: str, keep: int = 1) -> list[str]:
        """``text`` merged letter by letter, the best pair first, of equal ones the leftmost, until nothing
        merges or ``keep`` parts are left."""
        parts, priority = list(text), self.priority
        while len(parts) > keep:
            pairs = [(priority[a + b], at) for at, (a, b) in enumerate(pairwise(parts)) if a + b in priority]
            if not pairs:
                break
            at = min(pairs)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merges(self, own: list[int]) -> None:
        """For each piece of several letters the two parts of its last merge, and whether no part's own
        merge has a later priority than that."""
        self.halves = {p: tuple(self.merged(p, keep=2)) for p in map(self.pieces.__getitem__, own) if len(p) > 1}
        self.made = {p: -1 if len(p) == 1 else at for p, at in self.priority.items()}
        last = {p: max(self.made.get(x, len(self.made)) for x in two) for p, two in self.halves.items()}
        self.ordered = all(len(two) == 2 and last[p] <= self.made[p] for p, two in self.halves.items())

    def _merged_apart(self, pair: tuple[int, int]) -> bool:
        a, b = self.pieces[pair[0]], self.pieces[pair[1]]
        return self.merged(a + b) == [a, b]

    def _compatible(self, pair: tuple[int, int]) -> bool:
        a, b = self.pieces[pair[0]], self.pieces[pair[1]]
        priority, made = self.priority, self.made
        left_ends = right_ends = len(priority)  # when a and b, as they stand here, are merged further
        while True:
            both = priority.get(a + b)
            if both is not None:
                when = max(both, made[a], made[b])
                if when < left_ends and when <= right_ends:  # of equal merges the leftmost comes first
                    return False
            if len(a) == 1 and len(b) == 1:
                return True
            if made[a] > made[b]:
                left_ends, a = made[a], self.halves[a][1]
            else:
                right_ends, b = made[b], self.halves[b][0]

    def _automaton(self, own: list[int]) -> None:
        """The automaton of pieces, and for each the longest other piece that it begins with."""
        self.finder = ahocorasick.Automaton()
        for k in own:
            self.finder.add_word(self.pieces[k], k)
        self.finder.make_automaton()
        self.width = [len(p) for p in self.pieces]
        kept = {self.pieces[k]: k for k in own}
        self.shorter = [-1] * len(self.pieces)
        for k in own:
            p = self.pieces[k]
            self.shorter[k] = next((kept[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in kept), -1)

    def _bytes_of(self, letter: str) -> list[int]:
        raw = letter.encode()
        return [self.byte_ids[b] for b in raw] if all(b in self.byte_ids for b in raw) else [self.unknown]

    def backtracked(self, text: str) -> list[int]:
        """Ids of normalised text; a letter of no piece stands as ``-1 - code point``."""
        n, width, shorter, compatible = len(text), self.width, self.shorter, self.compatible
        longest = [-1] * (n + 1)
        for last, piece in self.finder.iter(text):
            longest[last - width[piece] + 1] = piece  # ends ascend, so the longest comes last
        failed = bytearray((n >> 3) + 1)
        taken: list[int] = []
        at, piece, before = 0, longest[0], -1
        while at < n:
            if piece < 0 and longest[at] < 0:
                piece, to = -1 - ord(text[at]), at + 1
            else:
                while piece >= 0:
                    to = at + width[piece]
                    if (before < 0 or compatible[before, piece]) and not failed[to >> 3] >> (to & 7) & 1:
                        break
                    piece = shorter[piece]
                else:
                    failed[at >> 3] |= 1 << (at & 7)
                    at -= width[before] if before >= 0 else 1
                    piece = shorter[before] if before >= 0 else -1
                    del taken[-1]
                    before = taken[-1] if taken else -1
                    continue
            taken.append(piece)
            at, before, piece = to, piece, longest[to]
        return taken

    def _part(self, text: str) -> bytes:
        own = self.number.get(text)
        ids = self.backtracked(text) if own is None or not self.own_result[own] else [own]
        if min(ids) < 0:
            ids = list(chain.from_iterable([k] if k >= 0 else self._bytes_of(chr(-1 - k)) for k in ids))
            if not self.byte_ids:  # neighbouring unknown letters are one unknown piece
                ids = [k for at, k in enumerate(ids) if k != self.unknown or at == 0 or ids[at - 1] != self.unknown]
        return np.array(ids, "<u4").tobytes() if len(ids) > 50 else pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """Ids of a blank and the letters that follow, or of a line end and those."""
        text, joined = word if word[:1] == "\n" else SPACE + word, self.joined
        ends = [at for at, two in enumerate(pairwise(text), 1) if two not in joined]
        if not ends:
            return self.parts[text]
        return b"".join([self.parts[text[a:b]] for a, b in zip([0, *ends], [*ends, len(text)])])

    def encode(self, raw: bytes) -> bytes:
        """Ids of a text's UTF-8 bytes, little-endian unsigned 32-bit integers, without begin and end."""
        if not raw:
            return b""
        text = raw.decode("utf-8", "each_byte")
        if not (self.plain and self.cuts and self.byte_ids):
            return self._part(self.spaced(text) if self.plain else self.library.normalize(text))
        text = text.replace(SPACE, " ")
        if text[0] != " " and "  " not in text:
            return b"".join(map(self.words.__getitem__, text.replace("\n", " \n").split(" ")))
        units = re.findall(r" +[^ \n]*|\n[^ \n]*", " " + text)
        return b"".join([self.words[u if u[0] == "\n" else u[1:].replace(" ", SPACE)] for u in units])

    def decode(self, ids: bytes) -> str:
        """The text of ids; the blank put in front of it by ``encode`` goes. The library decodes ids that
        are not those of a text: unknown ones, broken letters, a first blank in bytes."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.plain and self.byte_ids:
            try:
                text = b"".join(map(self.surface.__getitem__, numbers)).decode()
            except (TypeError, UnicodeDecodeError):
                return self.library.decode(numbers)
            if text[:1] != " ":
                return text
            if self.pieces[next(k for k in numbers if self.surface[k])][0] == SPACE:
                return text[1:]
        return self.library.decode(numbers)


def coder(path: str) -> PieceCoder:
    return worker_memory(f"pieces {path}", lambda: PieceCoder(path))


def encode_texts(
    docs: DataFrame, path: str, begin: bool = True, end: bool = True, decoded: bool = False, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit integers) of every text, and on request
    ``decoded``, the text of those ids."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(path)
        head = np.array([own.begin] * begin, "<u4").tobytes()
        tail = np.array([own.end] * end, "<u4").tobytes()
        ids = [head + own.encode(t) + tail for t in batch.column(1).to_pylist()]
        texts = map(own.decode, ids) if decoded else (None for _ in ids)
        columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (batch.slice(at, TEXTS) for batch in batches for at in range(0, batch.num_rows, TEXTS))
        return in_batches(work)(small)

    keyed = docs.select(F.col(doc).cast("long").alias("doc_id"), raw_text(text).alias("text"))
    found = keyed.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
    return found if decoded else found.drop("decoded")


def decode_ids(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text of the column ``ids``; null for null ids, and ``df``'s own column
    ``decoded``, if any, gives way."""
    kept = df.drop("decoded")
    schema = StructType([*kept.schema, StructField("decoded", StringType())])
    place = kept.columns.index(ids)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(path)
        texts = [None if x is None else own.decode(x) for x in batch.column(place).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(in_batches(work), schema)
