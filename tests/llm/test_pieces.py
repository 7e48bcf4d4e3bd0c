import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gridspark.llm.pieces import MERGES, NORMAL, UNIGRAM, UNKNOWN, Machine, decode_ids, encode_texts, machine

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(m, t):
    return np.frombuffer(m.encode(t), np.uint32).tolist()


def test_the_same_as_the_library(library):
    m = machine(PATH)
    assert m.kind == MERGES and m.by_word
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "ing", "\n", "\t", "é", "漢字", "\U0001f600", "▁", "'", "12", "==", "<0x41>", "</s>", "\x00", "ñ", "ion", "S"]
    texts = ["", " ", "  ", "   a", "a   ", "▁", "a▁b", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "word " * 30] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    assert [np.frombuffer(x, np.uint32).tolist() for x in m.encode_many(texts)] == library.encode(texts)
    for t in texts:
        assert ids(m, t) == library.encode(t), repr(t)
        if "▁" not in t:
            assert m.decode(ids(m, t)) == t
        assert m.decode(ids(m, t)) == library.decode(ids(m, t)), repr(t)


def test_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = encode_texts(docs, "text", PATH, {"doc_id": F.col("doc_id"), "text": F.col("text")}).collect()
    assert len(got) == docs.count() and all(r.round_trip for r in got)
    for r in got:
        assert r.ids == library.encode(r.text) and r.n_tokens == len(r.ids)


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "é" * 20000, "x"), (3, "a b", "x"), (3, "a b", "x")], "k int, text string, ids string")
    got = encode_texts(df, "text", PATH, {"k": F.col("k")})
    assert sorted((r.k, r.n_tokens > 0, r.round_trip) for r in got.collect()) == [(1, False, True), (2, False, True), (3, True, True), (3, True, True), (3, True, True)]
    back = decode_ids(got, "ids", PATH, {"k": F.col("k")}).collect()
    assert sorted((r.k, r.text) for r in back) == [(1, ""), (2, ""), (3, "a b"), (3, "a b"), (3, "é" * 20000)]
    assert encode_texts(df.limit(0), "text", PATH, {"k": F.col("k")}).collect() == []


def test_unigram_takes_the_cheapest_cover():
    rng = random.Random(3)
    pieces = [("<unk>", 0.0, UNKNOWN)] + [(p, -rng.random() * 9, NORMAL) for p in ["a", "b", "ab", "aba", "bb", "▁", "▁a", "▁ab", "ba"]]
    m = Machine(pieces, UNIGRAM, dummy_prefix=True, squeeze=True, escape=True)

    def best(text):
        if not text:
            return 0.0
        return min((-m.score[text[:k]] if text[:k] in m.score else m.unknown_cost) + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in m.score or k == 1)

    for _ in range(300):
        t = "".join(rng.choice("aab c") for _ in range(rng.randint(0, 9)))
        n = m.normalise(t)
        path = m.shortest(n)
        assert "".join(path) == n
        assert abs(sum(-m.score[p] if p in m.score else m.unknown_cost for p in path) - best(n)) < 1e-9
        assert ids(m, t) == [i for w in path for i in m.ids_of(w)] or m.by_word


def test_few_words_are_held_at_a_time():
    m = machine(PATH)
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=350)) for _ in range(2000)]
    m.forget()
    want = m.encode_many(texts[:5])
    tracemalloc.start()
    got = m.encode_many(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    m.forget()
    assert got[:5] == want and len(got) == len(texts)
    assert peak < 7 * sum(map(len, texts))


def test_paths_are_searched_once_for_what_stands_between_cuts(library, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(40)]
    texts = [" ".join(f"{a}.\n{b.capitalize()}," for a in words) for b in words]
    m, asked = machine(PATH), []
    m.forget()
    paths = Machine._merge_paths
    monkeypatch.setattr(Machine, "_merge_paths", lambda self, units: asked.extend(units) or paths(self, units))
    got = m.encode_many(texts)
    monkeypatch.undo()
    m.forget()
    assert [np.frombuffer(x, np.uint32).tolist() for x in got] == library.encode(texts)
    assert len(asked) <= 200  # 1,600 words


@pytest.mark.parametrize("alphabet", [2, 16, 1 << 10])
def test_cuts_are_exact_for_any_alphabet(library, monkeypatch, alphabet):
    monkeypatch.setattr("gridspark.llm.pieces.ALPHABET", alphabet)
    m = Machine.load(PATH)
    rng = random.Random(alphabet)
    parts = [*rng.choices(m.plain[300:], k=400), "\n", "\t", "é", "漢字", "\U0010ffff", " ", "  ", "▁", "\x00"]
    texts = ["", *("".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(400))]
    units, begin = m.units([m.normalise(x) for x in texts])
    assert ["".join(units[a:b]) for a, b in zip(begin, begin[1:], strict=False)] == [m.normalise(x) for x in texts]
    got = [np.frombuffer(x, np.uint32).tolist() for x in m.encode_many(texts)]
    assert got == library.encode(texts)
    assert [m.decode(x) for x in got] == [library.decode(x) for x in got]
