import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridspark.llm.records import frame, ids_of, masked, read_records, sweep, unframe, write_records
from gridspark.llm.tokenize import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def odd_texts(rng, n):
    parts = ["don't", "I'LL", " x", "  ", "\n\n", "\t", "é", "ß1", "12", "²", "Ⅷ", "½", "_a_", "a_b", "\x1c", "\x85", "\xa0", " ", "漢字", "か゛", "\U0001f600", "\U00010940", "՘", "é", "<|endoftext|>", "''s", "'s", "#$%", "​", "٣", "\x00"]
    return ["", " ", "a", "'s", " 's", "<|endoftext|>"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_encoder_is_the_library(plain):
    texts = odd_texts(random.Random(1), 1500)
    enc = Encoder(PATH)
    assert enc.by_word
    for _ in range(2):
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == plain(texts)


def test_encoder_with_a_small_cache(plain, monkeypatch):
    from gridspark.llm import tokenize

    monkeypatch.setattr(tokenize, "CACHE_WORDS", 20)
    enc = Encoder(PATH)
    rng = random.Random(4)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("ab.\n'") for _ in range(rng.randint(0, 4))) for _ in range(9)) for _ in range(9)]
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == plain(texts)


def test_words_before_a_mark_are_looked_up_not_encoded_again(plain, monkeypatch):
    enc = Encoder(PATH)
    asked = []
    encode = enc._bytes
    monkeypatch.setattr(enc, "_bytes", lambda texts: asked.extend(texts) or encode(texts))
    ids = lambda texts: [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)]
    first, second = ["start alpha beta gamma delta"], ["start alpha, beta. gamma' delta\n", "start alpha1 beta_ gamma\u00bd delta; alpha)"]
    assert ids(first) + ids(second) == plain(first + second)
    assert not {" alpha", " beta", " gamma", " delta"} & set(asked)
    third = ["start a's a'sx a' 's x\u2167, \u00e9, \u00df; \u304b\u309b, \u6f22\u3002 \u0663, \n, \t alpha\tbeta, gamma,, 'll. n't d'"]
    assert ids(third) == plain(third)


def test_encoder_on_documents(spark, sf, plain):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    enc = Encoder(PATH)
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == plain(texts)


def test_frames():
    for payload in (b"", b"\2", b"\2" + bytes(1000)):
        r = frame(payload)
        assert unframe(r) == payload
        for i in range(0, len(r), 7):
            with pytest.raises(ValueError):
                unframe(r[:i] + bytes([r[i] ^ 1]) + r[i + 1 :])
        with pytest.raises(ValueError):
            unframe(r[:-1])
    x = zlib.crc32(b"abc")
    assert masked(b"abc") == (((x >> 15) | ((x << 17) & 0xFFFFFFFF)) + 0xA282EAD8) % (1 << 32)
    assert ids_of(b"\4" + struct.pack("<II", 5, 70000)).tolist() == [5, 70000]


def test_round_trip(spark, tmp_path, plain):
    rng = random.Random(2)
    texts = odd_texts(rng, 60)
    rows = [(i * 3 - 20, t, "x", 1) for i, t in enumerate(texts)] + [(None, "null id", "x", 1), (900, None, "x", 1), (901, "long " * 40000, "x", 1), (5000, "same", "x", 1), (5000, "same", "x", 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, file string, part int").repartition(3)
    folder = str(tmp_path / "out")
    index = write_records(df, "doc_id", "text", folder, PATH)
    got = sorted(read_records(index, folder).collect(), key=lambda r: r.start)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    start = 0
    for r, ids in zip(got, plain([x[1] or "" for x in rows])):
        want = np.array([*ids, 0], "<u4")
        assert (r.start, r.n_tokens, bytes(r.ids)) == (start, len(want), want.tobytes())
        start += len(want)
    some = read_records(index.where("doc_id % 2 = 0").orderBy(F.desc("doc_id")), folder)
    assert {r.doc_id for r in some.collect()} == {r[0] for r in rows if r[0] is not None and r[0] % 2 == 0}
    (tmp_path / "out" / "part-99999-left.bin").write_bytes(b"x")
    assert sweep(spark, index, folder) == 1 and sweep(spark, index, folder) == 0
    assert read_records(write_records(df.limit(0), "doc_id", "text", folder, PATH), folder).collect() == []
