import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from corpusdeck.llm import variants
from corpusdeck.llm.queries import QUERIES


def counted(rows, least=7, times=2):
    words = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            words[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in words.items() if len(w) >= least and n >= times}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, factor=10):
    cut = defaultdict(set)
    for w in words:
        for rest in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            cut[rest].add(w)
    near = defaultdict(set)
    for group in cut.values():
        for a in group:
            near[a].update(b for b in group if is_near(a, b))
    form = {}
    for w, others in near.items():
        if others and words[best := min(others, key=lambda x: (-words[x], x))] >= factor * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def rows_of(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def key(rows):
    return sorted(rows, key=repr)


def test_query_as_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert key(rows_of(QUERIES["op13_trie_pair_variants"](spark, sf))) == key(brute(counted(docs)))


@pytest.mark.parametrize("letters,size", [("ab", 9), ("aé", 6), ("xyz日𝒳\U0010ffff", 4)])
def test_words_of_few_letters(spark, letters, size):
    rnd = random.Random(size)
    made = {"".join(rnd.choices(letters, k=rnd.randrange(0, size))) for _ in range(120)}
    words = {w: 10 ** rnd.randrange(0, 6) + rnd.randrange(3) for w in made}
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert key(rows_of(variants.spelling_variants(frame, 2))) == key(brute(words, 2))


def test_long_words_chains_and_ties(spark):
    base = "longword" * 400
    words = {base: 1000, base[:-1]: 100, base[:-2]: 10, base[:-3]: 1, base[:5] + "é" + base[6:]: 1000, "alone": 3}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = rows_of(variants.spelling_variants(frame))
    assert key(got) == key(brute(words))
    assert {r[0]: r[2] for r in got}[base[:-3]] == base
    tied = {"aaaaaaab": 50, "aaaaaaac": 50, "aaaaaaad": 1}
    got = rows_of(variants.spelling_variants(spark.createDataFrame(list(tied.items()), "word string, n long")))
    assert ("aaaaaaad", "aaaaaaab", "aaaaaaab", 1, 2, 50) in got


def test_a_word_of_a_million_letters(spark):
    word = "a" * 1_000_000
    words = {word: 20, word[:-1]: 2, word[:-2] + "b": 1}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = variants.spelling_variants(frame).selectExpr("length(word) l", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=lambda r: r[:3]) == [(999_999, 1, 1, None), (999_999, 2, 2, 20), (1_000_000, 20, 1, None)]


def test_odd_rows(spark, odd, none):
    got = rows_of(variants.spelling_variants(variants.word_counts(odd, least=3, slip=31)))
    assert key(got) == key(brute(counted([(r["doc_id"], r["text"]) for r in odd.collect()], least=3)))
    assert variants.spelling_variants(variants.word_counts(none)).count() == 0
    frame = spark.createDataFrame([(None, 5, "x"), ("anything", 7, "y")], "word string, n long, form string")
    assert rows_of(variants.spelling_variants(frame)) == [("anything", None, "anything", 7, 0, None)]


def test_letters_lose_nothing_without_slips(spark):
    frame = spark.createDataFrame([(1, "Éclairs éclairs ÉCLAIRS abc×defg word2word"), (2, "abc×defg")], "doc_id long, text string")
    got = {r["word"]: r["n"] for r in variants.word_counts(frame, times=1, slip=0).collect()}
    assert got == {"Éclairs": 2, "éclairs": 1, "abc×defg": 2}  # É stays as it is


def test_no_forms_of_equal_frequency(spark):
    with pytest.raises(ValueError):
        variants.spelling_variants(spark.createDataFrame([("a", 1)], "word string, n long"), 1)
