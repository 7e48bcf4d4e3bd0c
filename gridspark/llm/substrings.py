"""Exact removal of repeated substrings over a whole corpus, with suffix arrays built by Lyndon groups.

A byte goes if a `size`-byte string of its document covers it and also starts earlier: in a document of smaller id,
or in the same document further left. Strings never cross documents and are judged on the input.

Every `size`-byte window holds one anchor: its left-most smallest k-gram by hash. Equal windows have equal anchors at
equal places, so windows that can be equal meet under their anchor's hash:

A. one pass finds the runs of windows that share an anchor and sends each distinct anchor hash of a task once;
B. hashes seen twice are named back to their documents (bounded per task, however common a passage is);
C. those runs are cut out; equal strings of a task collapse to their earliest start, the rest are removed at once;
D. per anchor hash, the distinct strings that are left share windows only in part: their suffix array lists equal
   windows side by side, and all but the earliest of each are marked;
E. marked ranges go back to their documents, which are cut.

Exact copies of a whole text are found first, by digest, and skip C and D: all but those of the smallest id go.
All comparisons that decide are on bytes; hashes only route.

Rows: a null text is empty; null ids sort last and count as one id; rows of equal id and text fall together (neither
starts earlier), rows of equal id with other texts compare by start. Ids are integers. An empty table gives an empty
result. Columns besides id and text are ignored.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.common import c, cut, lean, pack, total_bytes, utf8_parts
from gridspark.llm.suffixes import suffix_array

#: Stands for a null id: after every other.
LAST = (1 << 63) - 1
#: Text bytes for each bucket of hashes or documents.
BUCKET_BYTES = 8 << 20
MASK = (1 << 64) - 1
ENTRY = np.dtype([("h", "<u8"), ("d", "<i8")])
HEAD = np.dtype([("h", "<u8"), ("d", "<i8"), ("tag", "<i8"), ("p", "<i8"), ("n", "<i4")])
#: Spans go by their text's tag: d is that too.
SPAN = np.dtype([("d", "<i8"), ("tag", "<i8"), ("p", "<i8"), ("n", "<i8")])
ROWS = "kind int, bucket long, blob binary"


def gram(size: int) -> int:
    """Length of the anchors' k-grams: a power of two, 32 at most."""
    k = 1
    while k < 32 and k * 4 <= size:
        k *= 2
    return k


#: A random word for each byte value (SplitMix64 of the value).
def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = _mix(np.arange(256, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
STEP = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << i, 1 << 64)) for i in range(40)]


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of each k-gram, k a power of two."""
    h, m, i = BYTE[data], 1, 0
    while m < k:
        if len(h) <= m:
            return np.zeros(0, np.uint64)
        h = h[:-m] * STEP[i] + h[m:]
        m *= 2
        i += 1
    return h


def window_hash(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size`-byte window, from two power-of-two windows that cover it."""
    k = 1 << (size.bit_length() - 1)
    h = rolling(data, k)
    n = len(data) - size + 1
    return _mix(h[:n]) + h[size - k : size - k + n] * np.uint64(0xD6E8FEB86659FD93) if n > 0 else np.zeros(0, np.uint64)


def anchor_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, block: int = 1 << 18):
    """(document index, anchor hash, first window start, last window start) of each run, positions in data."""
    k = gram(size)
    w = size - k + 1
    low = np.uint64((1 << 20) - 1)
    valid = np.zeros(len(data), bool)
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if e - s >= size:
            valid[s : e - size + 1] = True
    parts = []
    block = min(block, (1 << 20) - 2 * size) if size < (1 << 18) else block
    for lo in range(0, len(data), block):
        h = rolling(data[lo : lo + block + size - 1], k)
        if len(h) < w:
            continue
        h = _mix(h)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(h) // w)
        padded = np.full(rows * w, np.uint64(MASK))
        padded[: len(h)] = key
        grid = padded.reshape(rows, w)
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        upto = np.minimum.accumulate(grid, axis=1).ravel()
        n = min(len(h) - w + 1, block)
        at = (np.minimum(after[:n], upto[w - 1 : w - 1 + n]) & low).astype(np.int64)
        i = np.flatnonzero(valid[lo : lo + n])
        if not len(i):
            continue
        a = at[i]
        cutpoints = np.flatnonzero((np.diff(a) != 0) | (np.diff(i) != 1)) + 1
        first, last = np.r_[0, cutpoints], np.r_[cutpoints, len(i)] - 1
        parts.append((h[a[first]], i[first] + lo, i[last] + lo))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), z, z
    h, p, q = (np.concatenate(x) for x in zip(*parts, strict=True))
    return np.searchsorted(starts, p, side="right") - 1, h, p, q


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(x.view(np.uint64) ^ np.uint64(0xA5A5)) % np.uint64(buckets)).astype(np.int64)


def batch_docs(batch: pa.RecordBatch, text: str):
    """Bytes and bounds of a batch's texts; empty texts do not shift the order of starts."""
    return utf8_parts(batch.column(batch.schema.get_field_index(text)))


def anchors_of(size: int, buckets: int, flush: int = 2_000_000):
    """Stage A: rows of entries (hash, document), kind 0, one per hash and flush, and of replies, kind 1."""

    def settle(held):
        e = np.concatenate(held)
        e = e[np.argsort(e["h"], kind="stable")]
        same = np.r_[False, e["h"][1:] == e["h"][:-1]]
        yield pack(bucket_of(e["h"][~same], buckets), e[~same], 0)
        again = e[same | np.r_[same[1:], False]]
        if len(again):
            again = np.unique(again)
            yield pack(bucket_of(again["d"], buckets), again, 1)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            data, starts, ends = batch_docs(batch, "text")
            ids = batch.column(0).to_numpy()
            some = ends - starts >= size
            doc, h, _, _ = anchor_runs(data, starts[some], ends[some], size)
            e = np.empty(len(h), ENTRY)
            e["h"], e["d"] = h, ids[some][doc]
            held.append(e)
            n += len(e)
            if n >= flush:
                yield from settle(held)
                held, n = [], 0
        if n:
            yield from settle(held)

    return run


def gather(batches) -> dict[int, list[bytes]]:
    found: dict[int, list[bytes]] = {0: [], 1: []}
    for batch in batches:
        for kind, blob in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            found[kind].append(blob.as_py())
    return found


def repeated_of(buckets: int):
    """Stage B: hashes with two entries are told to their documents; replies pass."""

    def run(batches):
        found = gather(batches)
        e = np.frombuffer(b"".join(found[0]), ENTRY)
        e = e[np.argsort(e["h"], kind="stable")]
        same = np.r_[False, e["h"][1:] == e["h"][:-1]] if len(e) else np.zeros(0, bool)
        told = e[same | np.r_[same[1:], False]] if len(e) else e
        told = np.concatenate([told, np.frombuffer(b"".join(found[1]), ENTRY)])
        if len(told):
            yield pack(bucket_of(told["d"], buckets), told, 1)

    return run


def per_document(dtype: np.dtype, unique: str | None):
    """Rows (d, blob): all records of a document in one value."""

    def run(batches):
        r = np.frombuffer(b"".join(gather(batches)[1]), dtype)
        r = r[np.argsort(r["d"], kind="stable")]
        at = np.flatnonzero(np.diff(r["d"])) + 1
        for lo in range(0, len(at) + 1 if len(r) else 0, 10_000):
            edges = np.r_[0, at, len(r)][lo : lo + 10_001]
            blobs = [(np.unique(r[unique][a:b]) if unique else r[a:b]).tobytes() for a, b in pairwise(edges.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(r["d"][edges[:-1]]), pa.array(blobs, pa.binary())], names=["d", "blob"])

    return run


def strings_of(size: int, buckets: int, flush: int = 24 << 20):
    """Stage C: the strings of repeated runs, kind 0, each once a flush; later equal ones as removed spans, kind 1."""

    def settle(strings, spans):
        by: dict[int, tuple[list, list]] = {}
        heads = np.array([(h, d, t, p, len(s)) for s, (d, p, t, h) in strings.items()], HEAD)
        for b, head, s in zip(bucket_of(heads["h"], buckets).tolist(), heads, strings, strict=True):
            hs, ss = by.setdefault(b, ([], []))
            hs.append(head.tobytes())
            ss.append(s)
        if by:
            blobs = [len(hs).to_bytes(8, "little") + b"".join(hs) + b"".join(ss) for hs, ss in by.values()]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(by), pa.int32()), pa.array(list(by), pa.int64()), pa.array(blobs, pa.binary())], names=["kind", "bucket", "blob"])
        if spans:
            out = np.array(spans, SPAN)
            yield pack(bucket_of(out["d"], buckets), out, 1)

    def run(batches):
        strings: dict[bytes, tuple] = {}
        spans: list[tuple] = []
        held = 0
        for batch in batches:
            data, starts, ends = batch_docs(batch, "text")
            ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            wanted = batch.column(batch.schema.get_field_index("blob"))
            long = np.flatnonzero(ends - starts >= size)
            doc, h, p, q = anchor_runs(data, starts[long], ends[long], size)
            edges = np.searchsorted(doc, np.arange(len(long) + 1))
            raw = data.tobytes()
            for k, i in enumerate(long.tolist()):
                lo, hi = edges[k], edges[k + 1]
                found = np.flatnonzero(np.isin(h[lo:hi], np.frombuffer(wanted[i].as_py(), np.uint64))) + lo
                d, tag, origin = ids[i], tags[i], int(starts[i])
                for a, b, x in zip(p[found].tolist(), q[found].tolist(), h[found].tolist(), strict=True):
                    s = raw[a : b + size]
                    new = (d, a - origin, tag, x)
                    old = strings.get(s)
                    if old is None:
                        strings[s] = new
                        held += len(s) + 200
                    elif new[:2] < old[:2]:
                        strings[s] = new
                        spans.append((old[2], old[2], old[1], len(s)))
                    elif new[:2] > old[:2]:
                        spans.append((tag, tag, a - origin, len(s)))
                if held + 80 * len(spans) > flush:
                    yield from settle(strings, spans)
                    strings, spans, held = {}, [], 0
        yield from settle(strings, spans)

    return run


def shared_windows(strings: list[bytes], size: int) -> list[tuple[int, int]]:
    """For each string its first and last window whose hash some string's window repeats, or (0, -1)."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    h = window_hash(data, size)
    owner = np.repeat(np.arange(len(strings)), lengths - size + 1)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths - size + 1) - (lengths - size + 1), lengths - size + 1)
    h = h[starts[owner] + place]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.r_[False, s[1:] == s[:-1]]
    hit = order[same | np.r_[same[1:], False]]
    lo = np.full(len(strings), 1 << 60)
    hi = np.full(len(strings), -1)
    np.minimum.at(lo, owner[hit], place[hit])
    np.maximum.at(hi, owner[hit], place[hit])
    return [(int(a), int(b)) if b >= 0 else (0, -1) for a, b in zip(lo, hi, strict=True)]


def repeats(strings: list[bytes], starts: list[tuple[int, int]], size: int) -> list[list[int]]:
    """For each string, the window offsets whose bytes occur at an earlier (document, position): by suffix array.

    starts[i] is the (document, position) of string i's first byte."""
    text: list[int] = []
    origin = []
    for s in strings:
        origin.append(len(text))
        text += [x + 2 for x in s]
        text.append(1)
    text.append(0)
    owner = [-1] * len(text)
    for i, (o, s) in enumerate(zip(origin, strings, strict=True)):
        owner[o : o + len(s) - size + 1] = [i] * (len(s) - size + 1)
    out: list[list[int]] = [[] for _ in strings]
    group: list[tuple[int, int, int, int]] = []
    last = b""

    def close():
        if len(group) > 1:
            least = min(group)[:2]
            for d, p, i, at in group:
                if (d, p) > least:
                    out[i].append(at)

    for x in suffix_array(text):
        i = owner[x]
        if i < 0:
            continue
        at = x - origin[i]
        s = strings[i][at : at + size]
        if s != last:
            close()
            group, last = [], s
        d, p = starts[i]
        group.append((d, p + at, i, at))
    close()
    return out


def resolve(size: int, buckets: int):
    """Stage D: spans to remove, as kind 1 rows by document."""

    def parse(blobs):
        groups: dict[int, dict[bytes, list]] = {}
        for blob in blobs:
            n = int.from_bytes(blob[:8], "little")
            heads = np.frombuffer(blob, HEAD, n, 8)
            at = 8 + n * HEAD.itemsize
            for h, d, tag, p, k in heads.tolist():
                groups.setdefault(h, {}).setdefault(blob[at : at + k], []).append((d, p, tag))
                at += k
        return groups

    def run(batches):
        found = gather(batches)
        spans: list[tuple] = []
        many: list[tuple[int, bytes, tuple]] = []
        for h, group in parse(found[0]).items():
            for s, at in group.items():
                least = min(at)
                if len(at) > 1:
                    spans += [(tag, tag, p, len(s)) for d, p, tag in at if (d, p) > least[:2]]
                if len(group) > 1:
                    many.append((h, s, least))
        by: dict[int, list] = {}
        if many:
            for (h, s, (d, p, tag)), (a, b) in zip(many, shared_windows([x[1] for x in many], size), strict=True):
                if b >= 0:
                    by.setdefault(h, []).append((s[a : b + size], d, p + a, tag))
        for group in by.values():
            marks = repeats([x[0] for x in group], [(x[1], x[2]) for x in group], size)
            for (_, _, p, tag), at in zip(group, marks, strict=True):
                if at:
                    m = np.sort(np.array(at))
                    gap = np.flatnonzero(np.diff(m) > size) + 1
                    first, last = m[np.r_[0, gap]], m[np.r_[gap, len(m)] - 1]
                    spans += [(tag, tag, p + x, y - x + size) for x, y in zip(first.tolist(), last.tolist(), strict=True)]
        out = np.concatenate([np.array(spans, SPAN), np.frombuffer(b"".join(found[1]), SPAN)])
        if len(out):
            yield pack(bucket_of(out["d"], buckets), out, 1)

    return run


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of spans (p, n)."""
    out: list[list[int]] = []
    for p, n in sorted(zip(spans["p"].tolist(), spans["n"].tolist(), strict=True)):
        if out and p <= out[-1][1]:
            out[-1][1] = max(out[-1][1], p + n)
        else:
            out.append([p, p + n])
    return [tuple(x) for x in out]


def remove_repeats(df: DataFrame, id: str, text: str, size: int = 100, keep: list[str] = ()) -> DataFrame:
    """A row for each row of df: id, kept binary (what is left), n_bytes, n_removed, n_spans long,
    spans array of (start, end): the maximal removed runs, in bytes. With `keep`, also text: what is left as
    text, and row: a struct of these columns (of rows with equal id and text, the least such struct), which travel with
    the small tables, not with the texts."""
    docs = df.select(F.coalesce(c(id).cast("long"), F.lit(LAST)).alias("d"), F.coalesce(c(text).cast("string"), F.lit("")).alias("text"))
    # Rows of equal id and text share a tag; rows of one id with many texts have nothing else in common.
    docs = docs.select("d", F.xxhash64("d", "text").alias("tag"), "text")
    buckets = max(16, total_bytes(df, text) // BUCKET_BYTES)
    long = docs.where(F.octet_length("text") >= size)

    def deal(rows: DataFrame) -> DataFrame:
        return rows.repartition(buckets, "bucket")

    told = deal(long.select("tag", "text").mapInArrow(lean(anchors_of(size, buckets)), ROWS)).mapInArrow(lean(repeated_of(buckets)), ROWS)
    told = deal(told).mapInArrow(lean(per_document(ENTRY, "h")), "tag long, blob binary")
    digest = F.unhex(F.sha2("text", 256))
    firsts = long.groupBy(digest.alias("digest")).agg(F.min(F.struct("d", "tag")).alias("x")).select(F.col("x.tag").alias("tag")).distinct()
    info = firsts.withColumn("first", F.lit(True)).join(told, "tag", "left")
    if keep:
        row = F.struct(*[c(k).alias(k) for k in keep])
        own = df.select(F.xxhash64(F.coalesce(c(id).cast("long"), F.lit(LAST)), F.coalesce(c(text).cast("string"), F.lit(""))).alias("tag"), row.alias("row"))
        info = own.groupBy("tag").agg(F.min("row").alias("row")).join(info, "tag", "left")
    info = cut(info)

    wide = docs.join(info, "tag", "left")
    asked = wide.where("blob is not null and first").select("d", "tag", "text", "blob")
    spans = deal(deal(asked.mapInArrow(lean(strings_of(size, buckets)), ROWS)).mapInArrow(lean(resolve(size, buckets)), ROWS))
    spans = spans.mapInArrow(lean(per_document(SPAN, None)), "tag long, spans binary")

    def cut_out(batches):
        for batch in batches:
            data, starts, ends = batch_docs(batch, "text")
            raw = data.tobytes()
            copy = batch.column(3).to_pylist()
            kept, runs = [], []
            for i, blob in enumerate(batch.column(4)):
                s, e = int(starts[i]), int(ends[i])
                body = raw[s:e]
                if copy[i]:
                    r = [(0, e - s)]
                elif blob.is_valid:
                    r = merged(np.frombuffer(blob.as_py(), SPAN))
                else:
                    r = []
                edges = [0, *(x for y in r for x in y), e - s]
                kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if r else body)
                runs.append([{"start": a, "end": b} for a, b in r])
            n = ends - starts
            gone = n - np.fromiter(map(len, kept), np.int64, len(kept))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(kept, pa.binary()), pa.array(n), pa.array(gone), pa.array([len(x) for x in runs], pa.int64()), pa.array(runs, kind)],
                names=["d", "tag", "kept", "n_bytes", "n_removed", "n_spans", "spans"],
            )

    copy = (F.octet_length("text") >= size) & F.col("first").isNull()
    last = wide.join(spans, "tag", "left").select("d", "text", "tag", copy.alias("copy"), "spans", *(["row"] if keep else []))
    fields = "d long, tag long, kept binary, n_bytes long, n_removed long, n_spans long, spans array<struct<start long, end long>>"
    named = [F.when(F.col("d") != LAST, F.col("d")).alias(id), "kept", "n_bytes", "n_removed", "n_spans", "spans"]
    if not keep:
        return last.mapInArrow(lean(cut_out), fields).select(*named)

    def with_rows(batches):
        for batch in batches:
            (out,) = cut_out([batch])
            # A character that a removed run cuts in two goes with it.
            text = pa.array([x.as_py().decode("utf-8", "ignore") for x in out.column("kept")], pa.string())
            yield out.append_column("row", batch.column(5)).append_column("text", text)

    schema = T.StructType([*T.StructType.fromDDL(fields).fields, last.schema["row"], T.StructField("text", T.StringType())])
    out = last.mapInArrow(lean(with_rows), schema)
    return out.select(*named, "row", "text")
