"""The op queries that SQL cannot express, over the smallest tables, against their definitions."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from gridspark.llm import queries as q
from gridspark.llm.media import encode


@pytest.fixture(scope="module")
def docs(spark, sf):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())


def test_op3(spark, sf, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: zlib.crc32(np.array(library.encode(t), "<u4").tobytes()) for i, t in docs}
    got = q.op3_sentencepiece_wfst(spark, sf).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == want and all(r.round_trip for r in got)


def test_op7(spark, sf, docs):
    got = {r.doc_id: r for r in q.op7_media_columns(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        raw = t.encode()
        body = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(encode(body)), hashlib.sha256(encode(body)).hexdigest())


def test_op8(spark, sf, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want, start = {}, 0
    for (i, _), e in zip(docs, t.encode_batch([x for _, x in docs], add_special_tokens=False)):
        ids = np.array([*e.ids, 0], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in q.op8_token_records(spark, sf).collect()} == want


def test_op9(spark, sf, docs):
    least, want = {}, {}
    for i, t in docs:
        b = t.encode()
        for p in range(len(b) - 99):
            least.setdefault(b[p : p + 100], (i, p))
    for i, t in docs:
        b = t.encode()
        gone = np.zeros(len(b) + 1, np.int8)
        for p in range(len(b) - 99):
            if least[b[p : p + 100]] < (i, p):
                gone[p : p + 100] = 1
        spans = int((np.diff(gone, prepend=0) == 1).sum())
        want[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[gone[:-1] == 0].tobytes()).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in q.op9_suffix_dedup(spark, sf).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0


def test_op10(spark, sf, docs):
    fps = {}
    for i, t in docs:
        words = t.encode().lower().split()
        grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(fps)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if b < a and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in q.op10_simhash_near_dedup(spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", root(i)) for i in ids}
