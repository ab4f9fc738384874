"""Token ids of whole texts by public tokenizer files, remembering words that were met before.

Neither kind of vocabulary has tokens that reach over the end of a word, so a text can be encoded word by
word with the same ids. The tokenizers library encodes the words that are not remembered, many in one
call; a text that a cut at blanks could change is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import string
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusdeck.llm.common import worker_memory

#: Texts handled at once, words encoded in one call.
TEXTS = 400
WORDS = 100
#: Texts and bytes of a stretch whose words are numbered.
STRETCH = 4_000
STRETCH_BYTES = 16 << 20


class WordEncoder:
    """``encode(texts)`` gives the ids of each text as little-endian unsigned 32-bit integers."""

    #: Words after which a worker begins a new generation: it remembers those and, of the generation before,
    #: every word until the next begins. Words that keep coming back are never worked out again.
    room = 700_000

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: None marks a word whose texts have to be encoded whole.
        self.known: dict[bytes, bytes | None] = {}
        self.older: dict[bytes, bytes | None] = {}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), TEXTS):
            part = texts[at : at + TEXTS]
            words = [self.cut(t) for t in part]
            self.remember(set(chain.from_iterable(words)).difference(self.known))
            out += [self.joined(w, t) for w, t in zip(words, part, strict=True)]
            self.age()
        return out

    def remember(self, new: set[bytes]) -> None:
        again = set(filter(self.older.__contains__, new))
        self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        self.known.update(self.learn(list(new - again)))

    def age(self) -> None:
        if len(self.known) > self.room:
            self.known, self.older = {}, self.known

    def joined(self, words: list[bytes], text: bytes) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, words))
        except TypeError:
            return self.ids([text.decode()])[0].tobytes()

    def split_ids(self, calls: list[list[bytes]], join: str, mark: int, keep: bool, lead: str = "") -> list[bytes]:
        """Ids of the words of each call, which are encoded as one text and told apart by the id ``mark``."""
        out = []
        texts = [lead + join.encode().join(c).decode() for c in calls]
        for ids, words in zip(self.ids(texts), calls, strict=True):
            cuts = np.flatnonzero(ids == mark)
            starts, ends = (cuts, np.append(cuts[1:], len(ids))) if keep else (np.append(0, cuts + 1), np.append(cuts, len(ids)))
            raw = ids.tobytes()
            assert len(starts) == len(words)
            out += [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return out

    def cut(self, text: bytes) -> list[bytes]:
        raise NotImplementedError

    def learn(self, words: list[bytes]) -> dict[bytes, bytes | None]:
        raise NotImplementedError


def _calls(words: list[bytes]) -> list[list[bytes]]:
    return [words[at : at + WORDS] for at in range(0, len(words), WORDS)]


class BlankFree(WordEncoder):
    """For vocabularies that drop white space. A control character, with one id, stands between words."""

    MARK = "\x01"
    room = 500_000

    def cut(self, text: bytes) -> list[bytes]:
        return text.split()

    def learn(self, words: list[bytes]) -> dict[bytes, bytes | None]:
        plain = [w for w in words if b"\x01" not in w]
        (mark,) = self.ids([self.MARK])[0].tolist()
        got = dict(zip(plain, self.split_ids(_calls(plain), f" {self.MARK} ", mark, False), strict=True))
        return {w: got.get(w) for w in words}


class BlankLed(WordEncoder):
    """For byte-level vocabularies, where one blank or line end belongs to what follows.

    A text is cut before each blank and line end that has no white space beside it; a word after a line
    end keeps it, one after a blank does not. The first word counts as one after a line end.

    Where the file cuts texts by the byte-level rule, a run of letters is one piece with the blank before it and
    the run of marks after it is another; the model gets such pieces without the library's passes over the text.
    """

    MARKS = string.punctuation.encode()
    LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
    #: Runs of marks that are remembered.
    most = 10_000

    def __init__(self, path: str) -> None:
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        rule, model = given.get("pre_tokenizer") or {}, given["model"]
        by_rule = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space")
        # A token of the file's own that letters and then marks could hold would be found before pieces are.
        apart = all(re.search(r"[!-/:-@[-`{-~][A-Za-z]", t["content"]) for t in given.get("added_tokens") or [])
        self.simple = by_rule and apart and not given.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        #: How the rule writes the other bytes.
        self.spelled = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - shown))}
        self.model = self.tokenizer.model
        self.four = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.runs: dict[bytes, bytes] = {b"": b""}

    def piece(self, raw: bytes) -> bytes:
        found = self.model.tokenize(raw.decode("latin-1").translate(self.spelled))
        return b"".join([self.four[t.id] for t in found])

    def cut(self, text: bytes) -> list[bytes]:
        return self.spaced(text).split(b" ")

    @staticmethod
    def spaced(text: bytes) -> bytes:
        return (b"\n" + text).replace(b"\n", b" \n")[1:]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Words are numbered a stretch of texts at a time, so each is looked up once for a stretch."""
        out: list[bytes] = []
        start = size = 0
        for at, text in enumerate(texts):
            if at > start and (at - start == STRETCH or size + len(text) > STRETCH_BYTES):
                out += self.encode_stretch(texts[start:at])
                start, size = at, 0
            size += len(text)
        return out + self.encode_stretch(texts[start:])

    def encode_stretch(self, texts: list[bytes]) -> list[bytes]:
        if sum(map(len, texts)) > 2 * STRETCH_BYTES:
            return super().encode(texts)
        words = pc.split_pattern(pa.array(map(self.spaced, texts), pa.binary()), b" ")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, distinct))
        lacking = [at for at, own in enumerate(ids) if own is None]
        self.remember(set(filterfalse(self.known.__contains__, [distinct[at] for at in lacking])))
        for at in lacking:
            ids[at] = self.known[distinct[at]]
        found = pa.array(ids, pa.binary()).take(coded.indices)
        self.age()
        starts = words.offsets.to_numpy()
        _, offsets, data = found.buffers()
        cuts = np.frombuffer(offsets, np.int32)[starts].tolist()
        raw = memoryview(data)
        out = [bytes(raw[a + 4 : b]) for a, b in zip(cuts, cuts[1:])]
        if found.null_count:
            lost = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
            for k in np.unique(np.searchsorted(starts, lost, "right") - 1).tolist():
                out[k] = self.ids([texts[k].decode()])[0].tobytes()
        return out

    def joined(self, words: list[bytes], text: bytes) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, words))[4:]
        except TypeError:
            return self.ids([text.decode()])[0].tobytes()

    def learn(self, words: list[bytes]) -> dict[bytes, bytes | None]:
        if not self.simple:
            return self.learn_by_text(words)
        got: dict[bytes, bytes | None] = {}
        rest, marked, latin = [], [], self.LATIN.fullmatch
        for word in words:
            head = word.rstrip(self.MARKS)
            if not (head.isalpha() or latin(head[head[:1] == b"\n" :])):
                rest.append(word)
            elif len(head) == len(word):
                got[word] = self.spell(word)
            else:
                marked.append((word, head))
        for word, head in marked:
            run = word[len(head) :]
            if run not in self.runs and len(self.runs) < self.most:
                self.runs[run] = self.piece(run)
            ids = got.get(head) or self.known.get(head) or self.spell(head)
            got[word] = ids + (self.runs.get(run) or self.piece(run))
        return got | self.learn_by_text(rest)

    def spell(self, word: bytes) -> bytes:
        """Ids of a word of letters: the line end before it is a piece, the blank is not."""
        if word[:1] == b"\n":
            return self.piece(b"\n") + self.piece(word[1:])
        if word.isascii():
            return b"".join([self.four[t.id] for t in self.model.tokenize("\u0120" + word.decode())])
        return self.piece(b" " + word)

    def learn_by_text(self, words: list[bytes]) -> dict[bytes, bytes | None]:
        got: dict[bytes, bytes | None] = dict.fromkeys(words)
        (line,) = self.ids(["\n"])[0].tolist()
        after_line = [w for w in words if w[:1] == b"\n" and self.regular(w[1:].decode())]
        got.update(zip(after_line, self.split_ids(_calls(after_line), "", line, True), strict=True))
        after_blank = [w for w in words if w[:1] != b"\n" and self.regular(w.decode())]
        got.update(zip(after_blank, self.split_ids(_calls(after_blank), "\n ", line, False, " "), strict=True))
        return got

    @staticmethod
    def regular(word: str) -> bool:
        """Not empty, and no white space of any kind at either end."""
        return word != "" and word == word.strip()


def encoder(kind: str, path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file; ``kind`` is ``blank_free`` or ``blank_led``."""
    make = {"blank_free": BlankFree, "blank_led": BlankLed}[kind]
    return worker_memory(f"tokens {kind} {path}", lambda: make(path))
