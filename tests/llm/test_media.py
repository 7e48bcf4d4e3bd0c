import hashlib
import io
import random
import tarfile
import zlib

import pytest
from pyspark.sql import functions as F

from gridspark.llm import media
from gridspark.llm.media import COLUMNS, canonical, decode, describe, encode, features, header, member, metadata, pad, payloads, store, store_text


def test_png_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 191, 192, 193, 5000):
        raw = bytes(rng.randrange(256) for _ in range(n))
        body = pad(raw)
        assert len(body) % COLUMNS == 0 and len(body) > 0 and body.rstrip(b" ") == raw.rstrip(b" ") and len(body) - len(raw) <= COLUMNS
        data = encode(body)
        assert decode(data) == body
        assert header(data[:33]) == {"width": 192, "height": len(body) // 192, "depth": 8, "format": "png/grey"}
        with pytest.raises((ValueError, zlib.error)):
            decode(data[:45] + bytes([data[45] ^ 1]) + data[46:])
    with pytest.raises(ValueError):
        header(b"x" * 33)


def test_member_header_is_ustar():
    data = encode(pad(b"abc"))
    t = tarfile.open(fileobj=io.BytesIO(member("f" * 64, len(data)) + data + media.fill(len(data)) + bytes(1024)))
    (m,) = t.getmembers()
    assert m.name == "f" * 64 and t.extractfile(m).read() == data


def test_store_and_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "SHARD_BYTES", 3000)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc é漢") for _ in range(rng.randint(0, 900))) for _ in range(40)]
    rows = [(i, t, "q", 5) for i, t in enumerate(texts)] + [(100 + i, texts[i % 3], "q", 5) for i in range(20)] + [(None, "x", "q", 5), (200, None, "q", 5), (201, "", "q", 5), (202, "y" * 300000, "q", 5), (3, texts[3], "q", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, offset int").repartition(3)
    folder = str(tmp_path / "media")
    stored = store_text(df, "doc_id", "text", folder)
    got = describe(stored, folder).collect()
    assert len(got) == len(rows)
    by_id = {i: (t or "").encode() for i, t, *_ in rows}
    for r in got:
        raw = by_id[r.doc_id]
        body = pad(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]))
        assert r.feature == features(body)["feature"]
        assert (r.length, r.digest) == (len(encode(body)), hashlib.sha256(encode(body)).hexdigest())
    for r in metadata(stored, folder).collect():
        assert (r.width, r.height, r.depth) == (192, len(pad(by_id[r.doc_id])) // 192, 8)
    assert all(bytes(r.payload) == pad(by_id[r.doc_id]) for r in payloads(stored.where("doc_id % 2 = 0"), folder).collect())
    assert canonical(stored).count() == len({pad(x) for x in by_id.values()})
    shards = list((tmp_path / "media").iterdir())
    names = [m.name for s in shards for m in tarfile.open(s).getmembers()]
    assert len(shards) >= 3 and set(names) == {r.digest for r in got}
    assert store_text(df.limit(0), "doc_id", "text", folder).isEmpty()


def test_binary_payloads(spark, tmp_path):
    df = spark.createDataFrame([(1, b"\x00\xff"), (2, None)], "k int, b binary")
    stored = store(df, F.col("b"), str(tmp_path), {"k": F.col("k")})
    assert {r.k: bytes(r.payload) for r in payloads(stored, str(tmp_path)).collect()} == {1: pad(b"\x00\xff"), 2: b" " * 192}
