"""Media columns: content-addressed payloads in tar shards, with metadata from their headers.

``store`` writes each payload as an 8-bit greyscale PNG of 192 columns into tar shards in a folder that all executors
share. A member is named by the SHA-256 of its bytes and written once per shard; rows carry digest, shard, offset and
length of the stored bytes. ``metadata`` fills width, height, depth and format from the first 33 bytes of each member by
range reads; ``payloads`` reads members whole, verifies the digest, and decodes. ``canonical`` picks one place for each
digest over all shards; a shard may hold bytes that are also in another one.

Shards have a name of their own per task attempt and rows are cut from their lineage, so a repeated task leaves no row
that names a wrong shard. Rows of one shard stay together, so no payload crosses a shuffle.

Rows: a null payload is empty. Equal payloads have equal digests. Null ids and other columns pass through ``keep``. An
empty table writes no shard.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridspark.llm.common import c, cut

#: Samples of a row; payloads are padded by blanks to a positive multiple.
COLUMNS = 192
#: Bytes of a shard before the next one is begun.
SHARD_BYTES = 256 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and header chunk.
HEADER = 33
BLOCK = 512


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(data: bytes) -> bytes:
    """data and blanks up to a positive multiple of COLUMNS bytes."""
    return data.ljust(max(1, -(-len(data) // COLUMNS)) * COLUMNS, b" ")


def encode(payload: bytes) -> bytes:
    """A PNG whose samples are the payload's bytes, row by row, unfiltered."""
    rows = np.zeros((len(payload) // COLUMNS, COLUMNS + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS)
    head = struct.pack(">IIBBBBB", COLUMNS, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def header(data: bytes) -> dict:
    """width, height, depth and format from the first HEADER bytes; ValueError if they are not a PNG's."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR" or struct.unpack_from(">I", data, 29)[0] != zlib.crc32(data[12:29]):
        raise ValueError("not a PNG header")
    width, height, depth, colour = struct.unpack_from(">IIBB", data, 16)
    return {"width": width, "height": height, "depth": depth, "format": "png/grey" if colour == 0 else f"png/{colour}"}


def decode(data: bytes) -> bytes:
    """The samples of a PNG made by ``encode``."""
    h = header(data)
    at, packed = HEADER, []
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("PNG chunk with a wrong checksum")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h["height"], h["width"] + 1)
    if rows[:, 0].any():
        raise ValueError("PNG with filtered rows")
    return rows[:, 1:].tobytes()


def member(name: str, size: int) -> bytes:
    """A ustar header block; sizes beyond its eight octal digits in base 256."""
    octal = b"%011o\0" % size if size < 8**11 else b"\x80" + size.to_bytes(11, "big")
    block = bytearray(BLOCK)
    for at, value in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, octal), (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        block[at : at + len(value)] = value
    block[148:156] = b"%06o\0 " % sum(block)
    return bytes(block)


def fill(n: int) -> bytes:
    return bytes(-n % BLOCK)


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def store(df: DataFrame, payload: Column, folder: str, keep: dict[str, Column]) -> DataFrame:
    """Columns `keep`, n_bytes (before padding), digest, shard, offset, length of each row's stored payload."""
    rows = df.select(*[v.alias(k) for k, v in keep.items()], F.coalesce(payload.cast("binary"), F.lit(b"")).alias("__payload"))
    out = StructType(list(rows.drop("__payload").schema.fields)).add("n_bytes", "long").add("digest", "string").add("shard", "string").add("offset", "long").add("length", "long")
    names = out.fieldNames()

    def run(batches):
        fs, base = place(folder)
        fs.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        shard = f = None
        at, seen = 0, {}
        try:
            for batch in batches:
                made = []
                for x in batch.column(batch.num_columns - 1):
                    raw = x.as_py()
                    if f is not None and at >= SHARD_BYTES:
                        f.write(bytes(2 * BLOCK))
                        f.close()
                        f = None
                    if f is None:
                        shard, at, seen = f"shard-{part:05d}-{uuid.uuid4().hex}.tar", 0, {}
                        f = fs.open_output_stream(f"{base}/{shard}", buffer_size=1 << 20)
                    # Equal payloads are known by digest before they are encoded.
                    body = pad(raw)
                    own = hashlib.sha256(body).digest()
                    if own not in seen:
                        data = encode(body)
                        name = hashlib.sha256(data).hexdigest()
                        f.write(member(name, len(data)))
                        f.write(data)
                        f.write(fill(len(data)))
                        seen[own] = (name, shard, at + BLOCK, len(data))
                        at += BLOCK + len(data) + len(fill(len(data)))
                    made.append((len(raw), *seen[own]))
                if made:
                    cols = list(zip(*made, strict=True))
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(v, k) for v, k in zip(cols, kinds, strict=True))], names=names)
            if f is not None:
                f.write(bytes(2 * BLOCK))
        finally:
            if f is not None:
                f.close()

    return cut(rows.mapInArrow(run, out))


def each_member(df: DataFrame, folder: str, fields: str, make, whole: bool) -> DataFrame:
    """df (with shard, offset, length, digest) and the fields that make(bytes, digest) gives; each place is read once
    as long as its rows follow one another in a shard."""
    out = StructType(list(df.schema.fields))
    for field in StructType.fromDDL(fields).fields:
        out = out.add(field)
    added = StructType.fromDDL(fields).fieldNames()
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[x.dataType.simpleString()] for x in StructType.fromDDL(fields).fields]

    def run(batches):
        fs, base = place(folder)
        name, f, known = None, None, {}
        for batch in batches:
            get = lambda k: batch.column(batch.schema.get_field_index(k)).to_pylist()  # noqa: B023, E731
            made = []
            for shard, offset, length, digest in zip(get("shard"), get("offset"), get("length"), get("digest"), strict=True):
                if shard != name:
                    if f is not None:
                        f.close()
                    name, f, known = shard, fs.open_input_file(f"{base}/{shard}"), {}
                if offset not in known:
                    if len(known) > 20_000:
                        known = {}
                    known[offset] = make(f.read_at(length if whole else min(length, HEADER), offset), digest)
                made.append(known[offset])
            columns = [pa.array([x[k] for x in made], t) for k, t in zip(added, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])
        if f is not None:
            f.close()

    return df.mapInArrow(run, out)


def metadata(stored: DataFrame, folder: str) -> DataFrame:
    """stored with width, height, depth, format: header bytes only are read."""
    return each_member(stored, folder, "width int, height int, depth int, format string", lambda data, _: header(data), whole=False)


def verified(data: bytes, digest: str) -> bytes:
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError(f"stored bytes do not match {digest}")
    return decode(data)


def payloads(stored: DataFrame, folder: str) -> DataFrame:
    """stored with payload (binary, padded)."""
    return each_member(stored, folder, "payload binary", lambda data, digest: {"payload": verified(data, digest)}, whole=True)


def features(payload: bytes) -> dict:
    """Of a payload: sizes, checksums, and a feature: rows, mean and deviation of the samples (hundredths), entropy of
    their histogram (millibits), and a 64-bit average hash of an 8 x 8 reduction."""
    a = np.frombuffer(payload, np.uint8)
    n = np.bincount(a, minlength=256)
    value = np.arange(256)
    total = int(n.sum())
    mean = int((n * value).sum()) / total
    var = int((n * value * value).sum()) / total - mean * mean
    p = n[n > 0] / total
    edges = np.linspace(0, len(a), 65).astype(np.int64)
    sums = np.add.reduceat(a.astype(np.int64), np.minimum(edges[:-1], len(a) - 1)) / np.maximum(1, np.diff(edges))
    bits = sum(1 << i for i in np.flatnonzero(sums > mean).tolist())
    text = f"rows={len(a) // COLUMNS};mean={round(mean * 100)};dev={round(max(0.0, var) ** 0.5 * 100)};entropy={round(float(-(p * np.log2(p)).sum()) * 1000)};hash={bits:016x}"
    return {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "feature": text}


def describe(stored: DataFrame, folder: str) -> DataFrame:
    """stored with payload_bytes, payload_sha256, tail_crc32, feature, all computed from the bytes read back."""
    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
    return each_member(stored, folder, fields, lambda data, digest: features(verified(data, digest)), whole=True)


def canonical(stored: DataFrame) -> DataFrame:
    """digest, shard, offset, length: one place of each digest. Rows combine map-side, whatever their number."""
    return stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("x")).select("digest", "x.*")


def store_text(df: DataFrame, id: str, text: str, folder: str) -> DataFrame:
    return store(df, F.encode(c(text).cast("string"), "utf-8"), folder, {id: c(id)})
