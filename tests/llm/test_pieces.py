import hashlib

import numpy as np
import pytest
from corpusdeck.llm import pieces
from corpusdeck.llm.queries import QUERIES, tokenizer_file
from hypothesis import given, settings
from hypothesis import strategies as st

PATH = tokenizer_file("piece_bpe_32k.model")
ODD = [
    "", "a", " ", "  a b", "▁", "▁▁a ▁b", "\n", "a\n\nb", " \n \n  x", "x \n", "\x00", "a\x00b", "<s>", "</s> x", "<0x41>", "<unk> u",
    "é ﾊ", "𝒳 ok", " ", " " * 51 + "the", "1234567", "foo\tbar", "﻿x", "日本語テスト", "ab" * 50, "aaaaaaa " * 9, "x\r\ny",
]


@pytest.fixture(scope="module")
def coder():
    return pieces.PieceCoder(PATH)


def ids(coder, text):
    return np.frombuffer(coder.encode(text.encode()), "<u4").tolist()


def same_as_library(coder, text):
    want = coder.library.encode(text)
    assert ids(coder, text) == want
    framed = [1, *want, 2]
    assert coder.decode(np.array(framed, "<u4").tobytes()) == coder.library.decode(framed)


def test_odd_texts(coder):
    for text in ODD:
        same_as_library(coder, text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n▁.,'asthe0"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(coder, text):
    same_as_library(coder, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(259, 31_999) | st.integers(259, 700), max_size=12))
def test_joined_pieces(coder, picked):
    same_as_library(coder, "".join(coder.pieces[k] for k in picked))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31_999), max_size=12))
def test_any_ids_decode_as_in_the_library(coder, picked):
    assert coder.decode(np.array(picked, "<u4").tobytes()) == coder.library.decode(picked)


def test_bytes_that_are_not_utf8(coder):
    raw = b"ab \xff\xc3( \xed\xa0\x80 z\xf0\x9f"
    assert np.frombuffer(coder.encode(raw), "<u4").tolist() == coder.library.encode(raw)


@settings(max_examples=500, deadline=None)
@given(st.integers(259, 31_999) | st.integers(259, 600), st.integers(259, 31_999) | st.integers(259, 600))
def test_compatible_at_the_seam_as_by_merging_anew(coder, a, b):
    assert coder.ordered and coder._compatible((a, b)) == coder._merged_apart((a, b))


def test_backtracking_happens_and_places_fail_once(coder):
    text = coder.spaced("thethe erthan anorble" * 20)
    taken = coder.backtracked(text)
    assert taken == coder.library.encode(text[1:].replace(pieces.SPACE, " "))
    greedy, at = [], 0
    while at < len(text):
        n = max(k for k in range(1, 17) if text[at : at + k] in coder.number)
        greedy.append(coder.number[text[at : at + n]])
        at += n
    assert greedy != taken


def test_forgetting_changes_nothing(coder, monkeypatch):
    for name in ("words", "parts", "compatible"):
        monkeypatch.setattr(getattr(coder, name), "room", 2)
    for text in ODD:
        same_as_library(coder, text)


def test_a_text_of_one_very_long_word(coder):
    for text in ("ab" * 200_000, "x" * 300_000, "é\x00" * 20_000, " " * 100_000):
        same_as_library(coder, text)


def test_query_has_every_text_as_the_library(spark, sf, coder):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        found = coder.library.encode(r["text"], add_bos=True, add_eos=True)
        digest = hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest()
        want[r["doc_id"]] = (len(found), digest, hashlib.sha256(coder.library.decode(found).encode()).hexdigest())
    got = QUERIES["op11_piece_backtracking"](spark, sf).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want and len(got) == len(docs)


def test_odd_rows_and_round_trip(spark, odd, none):
    frame = pieces.encode_texts(odd, PATH)
    assert frame.columns == ["doc_id", "n_tokens", "ids"]
    got = pieces.decode_ids(frame, PATH).collect()
    texts = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in odd.collect())
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["decoded"]) for r in got) == texts
    assert all(r["n_tokens"] == 2 for r in got if r["decoded"] == "")
    assert pieces.encode_texts(none, PATH, decoded=True).count() == 0
    clash = frame.selectExpr("ids", "doc_id as decoded", "n_tokens as text").limit(1)
    assert pieces.decode_ids(clash, PATH).columns == ["ids", "text", "decoded"]
    assert pieces.decode_ids(frame.selectExpr("cast(null as binary) ids"), PATH).filter("decoded is not null").count() == 0
