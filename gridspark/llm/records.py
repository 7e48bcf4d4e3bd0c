"""Token ids as length-delimited binary records with a separate offset index.

A data file holds records in ascending id order, one file per task. A record is: the payload's length (8 bytes,
little-endian), the masked CRC-32 of those 8 bytes (4), the payload, the masked CRC-32 of the payload (4). The payload
is a byte that tells the width of an id (2 or 4), then the ids, little-endian. Masking turns a checksum right by 15 bits
and adds a constant, so that checksums of data that holds checksums stay meaningful.

Beside each data file lies an index (.idx) of 24 bytes per record: offset, length, first token's number in the file.
Any record can be read by seeking, in any order, without the others.

Files have a name of their own per task attempt; only the rows of attempts that succeeded name theirs, and those rows
are cut from their lineage, so a repeated task leaves no wrong file behind. ``sweep`` deletes files that no row names.

Rows: a null text is empty (its record holds the end id alone); null ids come first; equal ids are ordered by a hash of
the text, so one id with many rows spreads over tasks. An empty table writes no file. Other columns are ignored.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.llm.common import about_bytes, c, cut
from gridspark.llm.tokenize import encoder

#: Text bytes of one data file.
FILE_BYTES = 16 << 20
INDEX, INDEX_SIZE = "<QQQ", 24
ROWS = "part int, doc_id long, file string, seq long, offset long, length long, local long, n_tokens long"


def masked(data: bytes) -> int:
    x = zlib.crc32(data)
    return ((x >> 15 | x << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(record: bytes) -> bytes:
    """The payload of one whole record; ValueError if a length or checksum is wrong."""
    if len(record) < 16:
        raise ValueError("record cut short")
    head, (check,) = record[:8], struct.unpack_from("<I", record, 8)
    (n,) = struct.unpack("<Q", head)
    if masked(head) != check or len(record) != n + 16:
        raise ValueError("record with a wrong length")
    payload = record[12 : 12 + n]
    if masked(payload) != struct.unpack_from("<I", record, 12 + n)[0]:
        raise ValueError("record with a wrong checksum")
    return payload


def ids_of(payload: bytes) -> np.ndarray:
    """The ids of a payload, as little-endian unsigned 32-bit integers."""
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4")


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("file:", "/")) else posixpath.abspath(uri))


def write_records(df: DataFrame, id: str, text: str, folder: str, tokenizer: str, end_id: int = 0, special_strings: bool = False) -> DataFrame:
    """Writes the files below folder (shared by all executors) and returns their index, cut from its lineage: part,
    doc_id, file, seq, offset, length, start (ids of all rows before this), n_tokens (with the end id). With `special_strings` what spells a
    special token in a text becomes that token. Ids that are not integers are cast (null where that fails)."""
    rows = df.select(c(id).cast("long").alias("id"), F.coalesce(c(text).cast("string"), F.lit("")).alias("text"))
    parts = max(1, -(-about_bytes(df, text) // FILE_BYTES))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(int(parts), F.asc_nulls_first("id"), tie).sortWithinPartitions(F.asc_nulls_first("id"), tie)

    def run(batches):
        fs, base = place(folder)
        fs.create_dir(base, recursive=True)
        enc = encoder(tokenizer, special_strings)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}.bin"
        end = np.array([end_id], enc.dtype).tobytes()
        width = bytes([enc.dtype.itemsize])
        out = idx = None
        seq = offset = local = 0
        try:
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                if texts and out is None:
                    out, idx = fs.open_output_stream(f"{base}/{name}", buffer_size=1 << 20), fs.open_output_stream(f"{base}/{name}.idx", buffer_size=1 << 16)
                at = []
                for payload in enc.encode(texts):
                    n = len(payload) // enc.dtype.itemsize + 1
                    record = frame(width + payload + end)
                    out.write(record)
                    idx.write(struct.pack(INDEX, offset, len(record), local))
                    at.append((seq, offset, len(record), local, n))
                    seq, offset, local = seq + 1, offset + len(record), local + n
                if at:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(at), pa.int32()), ids, pa.array([name] * len(at)), *(pa.array(x, pa.int64()) for x in zip(*at, strict=True))],
                        names=["part", "doc_id", "file", "seq", "offset", "length", "local", "n_tokens"],
                    )
        finally:
            for f in (out, idx):
                if f is not None:
                    f.close()

    index = cut(rows.mapInArrow(run, ROWS))
    # One row per file: few, and small enough to broadcast by construction (FILE_BYTES of text each).
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    out = index.join(starts, "part").withColumn("start", F.col("base") + F.col("local")).drop("base", "local")
    return out


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian 32-bit), for each row (doc_id, file, seq, start) of an index,
    in any order and any part of it. Places come from the .idx files, bytes from the data files; all are verified."""
    rows = index.select("doc_id", "start", "file", "seq")

    def run(batches):
        fs, base = place(folder)
        name, data, table = None, None, b""
        for batch in batches:
            out = []
            for file, seq in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if file != name:
                    if data is not None:
                        data.close()
                    name, data = file, fs.open_input_file(f"{base}/{file}")
                    with fs.open_input_stream(f"{base}/{file}.idx") as f:
                        table = f.read()
                offset, length, _ = struct.unpack_from(INDEX, table, seq * INDEX_SIZE)
                out.append(ids_of(unframe(data.read_at(length, offset))).tobytes())
            n = [len(x) // 4 for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
        if data is not None:
            data.close()

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def sweep(spark: SparkSession, index: DataFrame, folder: str) -> int:
    """Deletes what attempts that failed have left in folder; returns the number of files."""
    fs, base = place(folder)
    named = {r[0] for r in index.select("file").distinct().collect()}  # one per file
    gone = [x.path for x in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if x.base_name.removesuffix(".idx") not in named]
    for x in gone:
        fs.delete_file(x)
    return len(gone)
