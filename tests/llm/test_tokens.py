import zlib

import numpy as np
import pytest
from corpusdeck.llm import packing, tokenfile, tokens
from corpusdeck.llm.queries import QUERIES, tokenizer_file
from corpusdeck.session import scratch_path
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

KINDS = {"blank_free": "word_bpe_49k.json", "blank_led": "byte_bpe_50k.json"}
ODD = [
    "", "a", "  a  b ", "x\n\ny", "a \nb", "<|endoftext|> hi", "it's  John's  x", "\x1cfoo \x1d bar", "a\u0085 b", "tab\there x\t y",
    "é ́ a", "　wide space", "Σας ΟΣ x", "foo\r\nbar baz\r\n", "1234 5.6", "\x01 a \x01b", "\n", " ",
]


def exact(kind, text, _cache={}):
    if kind not in _cache:
        _cache[kind] = Tokenizer.from_file(tokenizer_file(KINDS[kind]))
    return _cache[kind].encode(text, add_special_tokens=False).ids


def by_words(kind, texts):
    got = tokens.encoder(kind, tokenizer_file(KINDS[kind])).encode([t.encode() for t in texts])
    return [np.frombuffer(g, "<u4").tolist() for g in got]


@pytest.mark.parametrize("kind", KINDS)
def test_words_have_the_ids_of_the_text(kind):
    assert by_words(kind, ODD) == [exact(kind, t) for t in ODD]


@pytest.mark.parametrize("kind", KINDS)
@settings(max_examples=60, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from(" \n\t.'as"), st.characters(codec="utf-8")), max_size=40))
def test_any_text(kind, text):
    assert by_words(kind, [text]) == [exact(kind, text)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_block_round_trip(ids):
    ids = np.array(ids, "<u4")
    assert tokenfile.decode_block(*tokenfile.encode_block(ids), len(ids)).tolist() == ids.tolist()


def test_many_distinct_ids_round_trip():
    ids = np.concatenate([np.arange(70_000), np.zeros(10), np.arange(300)]).astype("<u4")
    ranked, control, data = tokenfile.encode_block(ids)
    assert tokenfile.decode_block(ranked, control, data, len(ids)).tolist() == ids.tolist()
    assert np.frombuffer(ranked, "<u4")[0] == 0 and len(control) == -(-len(ids) // 4)


def files_of(spark, docs):
    target = scratch_path(spark, "test-tokens")
    tokenfile.write_tokens(docs, target, tokenizer_file(KINDS["blank_led"]))
    return tokenfile.read_tokens(spark, target, with_ids=True)


def test_query_has_every_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, at = [], 0
    for r in docs:
        ids = exact("blank_led", r["text"]) + [2]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = QUERIES["op7_ranked_token_files"](spark, sf).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_files_of_odd_rows(spark, odd, none, monkeypatch):
    got = files_of(spark, odd).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in odd.collect()), key=lambda d: -1 if d is None else d)
    texts = sorted(exact("blank_led", r["text"] or "") + [2] for r in odd.collect())
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in got) == texts
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert files_of(spark, none).count() == 0


def check_pieces(docs, pieces):
    """Every id of every document in one piece; sequences gapless and not too long."""
    own = sorted(np.array(exact("blank_free", t or "") + [1], "<u4").tobytes() for _, t in docs)
    starts = {}
    for p in pieces:
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"] > 0
        starts.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    joined = []
    for group in starts.values():
        group.sort(key=lambda p: p["start"])
        total = group[0]["doc_tokens"]
        while group:
            at, text = 0, b""
            while at < total:
                k = next(k for k, p in enumerate(group) if p["start"] == at)
                piece = group.pop(k)
                text, at = text + piece["ids"], at + piece["length"]
            joined.append(text)
    assert sorted(joined) == own
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    return sum(p["length"] for p in pieces) / (len(sequences) * packing.LENGTH)


def test_packing_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = packing.pack(docs, tokenizer_file(KINDS["blank_free"])).collect()
    used = check_pieces([(r["doc_id"], r["text"]) for r in docs.collect()], pieces)
    assert used > 0.95
    query = QUERIES["op3_bounded_space_packing"](spark, sf)
    assert query.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert query.count() == len(pieces)


def test_packing_odd_rows(odd, none):
    pieces = packing.pack(odd.repartition(5), tokenizer_file(KINDS["blank_free"])).collect()
    check_pieces([(r["doc_id"], r["text"]) for r in odd.collect()], pieces)
    assert packing.pack(none, tokenizer_file(KINDS["blank_free"])).count() == 0


def test_open_windows_stay_bounded():
    windows, rng = packing.Windows(length=100, open_=4), np.random.default_rng(0)
    for size in rng.integers(1, 101, 500).tolist():
        assert sum(n for _, _, n in windows.place(size)) == size
        assert len(windows.fills) <= 4


def test_letters_and_marks_go_to_the_model_as_pieces(monkeypatch):
    path = tokenizer_file(KINDS["blank_led"])
    encoder = tokens.BlankLed(path)
    assert encoder.simple
    by_text = []
    plain = encoder.learn_by_text
    monkeypatch.setattr(encoder, "learn_by_text", lambda words: by_text.extend(words) or plain(words))
    monkeypatch.setattr(tokens, "STRETCH", 3)
    encoder.room = 20
    texts = ["Silk, wool;\nsilk... (moon) größe!", "", "silk silk$$$ '' 's it's", "a\nb", "x×y ÿ <|endoftext|>. a", "日本. _a_ ", "\n\nno 3.5%", "wool; silk"]
    for _ in range(2):
        got = encoder.encode([t.encode() for t in texts])
        assert [list(np.frombuffer(g, "<u4")) for g in got] == [exact("blank_led", t) for t in texts]
    assert not {b"wool;", b"silk...", b"\nsilk...", "größe!".encode(), b"silk$$$", b"\nSilk,"} & set(by_text)
