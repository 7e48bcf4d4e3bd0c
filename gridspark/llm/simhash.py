"""SimHash near-duplicates over a vantage-point tree.

Texts become 64-bit fingerprints (a bit is 1 if it is set in over half of the text's shingle hashes); two
fingerprints link at `radius` or fewer differing bits; components of linked fingerprints are found without any
driver-side list of documents.

1. ``fingerprints``: one narrow pass (Arrow batches, XXH64).
2. Equal fingerprints collapse to one row (map-side min), so groups of copies cost one row.
3. The top of a vantage-point tree is fitted on a bounded sample of distinct fingerprints. Each distinct
   fingerprint goes to its home shard, and as a query to every shard that the triangle bound cannot rule out:
   a vantage v splits at distance m; a query q needs the near side unless d(q,v) > m + r, the far side unless
   d(q,v) <= m - r. As both ends of a pair search, q visits only shards at or after its own.
4. In a shard the tree goes on, down to small leaves compared in full. A shard returns a spanning forest of its
   links, never all pairs of a group.
5. ``components``: alternating large-star / small-star contraction on DataFrames; the last few edges in one task.

Nulls: a null text has no word: fingerprint zero, linked as any other. A null id is a row like any other; a
component whose ids are all null has a null component_id. Repeated rows and ties need no rule: a component takes
its smallest id. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import about_bytes, c, cut, drop_unused, hot_keys, lean, lean_group, pack, salted_join, utf8_parts

#: Expected size, with hashing's small spread, of the sample on which the top of the tree is fitted; every fingerprint is routed exactly.
SAMPLE = 40_000
#: Distinct fingerprints that one shard should hold at home.
SHARD = 5_000
#: Fingerprints of a leaf that is compared in full.
LEAF = 256
#: Edges, 16 bytes each, whose components one task finds.
ONE_TASK = 1 << 18


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: len(words) - width].tolist()]
        stops = (ends[width - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(np.ascontiguousarray(hashes[lo : lo + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > len(hashes)).tolist())


def fingerprints(df: DataFrame, text: str, width: int = 3, keep: list[str] = ()) -> DataFrame:
    """`keep` columns and fp, the fingerprint as a signed 64-bit integer."""
    picked = df.select(*[c(k) for k in keep], c(text).cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            at = batch.num_columns - 1
            fps = [fingerprint(x.as_py(), width) for x in batch.column(at)]
            fp = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(fp)], names=[*batch.schema.names[:at], "fp"])

    out = picked.drop("__text").withColumn("fp", F.lit(0).cast("long")).schema
    return picked.mapInArrow(lean(run), out)


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def top_tree(sample: np.ndarray, leaves: int) -> list:
    """A tree of [vantage, split, near, far] with shard numbers at its leaves, splits at the sample's medians."""
    number = iter(range(1 << 30))

    def build(points: np.ndarray, want: int):
        if want > 1 and len(points) >= 8:
            tries = points[:: max(1, len(points) // 16)][:16]
            spreads = [distance(points, v).std() for v in tries]
            v = tries[int(np.argmax(spreads))]
            d = distance(points, v)
            m = int(np.median(d))
            if 0 < (d <= m).sum() < len(points):
                return [int(v), m, build(points[d <= m], want // 2), build(points[d > m], want - want // 2)]
        return next(number)

    return build(sample, leaves)


def shards_of(tree, fps: np.ndarray, radius: int, own: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of fingerprint, shard, is home) for each shard that fingerprint must visit, at or after its home; with
    own=False it is a guest everywhere and visits them all."""
    found: list[tuple[np.ndarray, int, np.ndarray]] = []

    def go(node, index, home):
        if not len(index):
            return
        if isinstance(node, int):
            found.append((index, node, home))
            return
        v, m, near, far = node
        d = distance(fps[index], np.uint64(v))
        # Shards are numbered near first: a fingerprint at home on the near side looks ahead at the far side.
        n = d <= m
        is_home = home & n
        ahead = d <= m + radius
        go(near, index[is_home | (~home & ahead)], is_home[is_home | (~home & ahead)])
        f = (home & ~n) | (home & n & (d > m - radius)) | (~home & (d > m - radius))
        go(far, index[f], (home & ~n)[f])

    go(tree, np.arange(len(fps)), np.full(len(fps), own))
    index = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.int64)
    shard = np.concatenate([np.full(len(x[0]), x[1], np.int64) for x in found]) if found else np.zeros(0, np.int64)
    home = np.concatenate([x[2] for x in found]) if found else np.zeros(0, bool)
    return index, shard, home


class Forest:
    """Union of fingerprints by index, rooted at the smallest index."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)


def pairs_in_shard(home: np.ndarray, guests: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (a, b) between fingerprints: pairs home-home and guest-home at `radius` or fewer bits.

    """
    points = np.concatenate([home, guests])
    up = forest_in_shard(home, guests, radius)
    child = np.flatnonzero(up != np.arange(len(points)))
    return points[child], points[up[child]]


def forest_in_shard(home: np.ndarray, guests: np.ndarray, radius: int, confirmed=None) -> np.ndarray:
    """For each point (home, then guests) the first point of its group; only pairs that `confirmed` accepts link.

    A vantage-point tree over the home points; queries descend together, node by node."""
    points = np.concatenate([home, guests])
    forest = Forest(len(points))
    n = len(home)
    rng = np.random.default_rng(len(home))

    def leaf(inside: np.ndarray, asking: np.ndarray) -> None:
        p = points[inside]
        step = max(1, 4_000_000 // max(1, len(p)))
        for lo in range(0, len(asking), step):
            q = asking[lo : lo + step]
            x, y = np.nonzero(np.bitwise_count(points[q][:, None] ^ p[None, :]) <= radius)
            a, b = q[x], inside[y]
            more = a > b  # a guest always is; of two home points each pair once
            a, b = a[more], b[more]
            if confirmed is not None:
                ok = np.concatenate([confirmed(a[k : k + 100_000], b[k : k + 100_000]) for k in range(0, len(a), 100_000)] or [np.zeros(0, bool)])
                a, b = a[ok], b[ok]
            while len(a):  # links whose ends are already joined say nothing new
                forest.join(a[:2000], b[:2000])
                a, b = a[2000:], b[2000:]
                while (forest.up != (nxt := forest.up[forest.up])).any():
                    forest.up = nxt
                new = forest.up[a] != forest.up[b]
                a, b = a[new], b[new]

    def go(inside: np.ndarray, asking: np.ndarray) -> None:
        if not len(asking) or not len(inside):
            return
        if len(inside) > LEAF:
            p = points[inside]
            tries = p[rng.integers(0, len(p), 8)]
            look = p[rng.integers(0, len(p), 200)]
            v = tries[int(np.argmax([distance(look, t).std() for t in tries]))]
            d = distance(p, v)
            m = int(np.median(d))
            near = d <= m
            if 0 < near.sum() < len(p):
                e = distance(points[asking], v)
                go(inside[near], asking[e <= m + radius])
                go(inside[~near], asking[e > m - radius])
                return
        leaf(inside, asking)

    go(np.arange(n), np.arange(len(points)))
    while (forest.up != (nxt := forest.up[forest.up])).any():
        forest.up = nxt
    return forest.up


def hashed_sample(distinct: DataFrame, key: str, value: str, n: int) -> list:
    """About SAMPLE values of n rows with distinct keys, those whose key hashes low: the same ones each time, and no task
    sends more than its share."""
    share = int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))
    low = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30)) < share
    return sorted(r[0] for r in distinct.where(low).select(value).collect())


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Spanning links (a, b) of the distinct fingerprints in column fp."""
    n = distinct.count()
    leaves = 1
    while leaves * SHARD < n:
        leaves *= 2
    sample = hashed_sample(distinct, "fp", "fp", n) if leaves > 1 else []
    tree = top_tree(np.array(sample, np.int64).view(np.uint64), leaves)

    def route(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            index, shard, home = shards_of(tree, fp.view(np.uint64), radius)
            for kind in (False, True):
                yield pack(shard[home == kind], fp[index[home == kind]], int(kind))

    def pair(table: pa.Table) -> pa.Table:
        held = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
            held[kind].append(np.frombuffer(blob, np.uint64))
        guests, home = (np.sort(np.concatenate(x)) for x in held)
        a, b = pairs_in_shard(home, guests, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    routed = distinct.select("fp").mapInArrow(route, "kind int, bucket long, blob binary")
    return routed.groupBy("bucket").applyInArrow(pair, "a long, b long")


def state(edges: DataFrame) -> tuple:
    """Two sets of edges are taken as equal if these agree: their number and two sums of hashes modulo 2^64."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of the component of each) of edges a, b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while len(x):
        x, y = up[x], up[y]
        x, y = x[x != y], y[x != y]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up != (nxt := up[up])).any():
            up = nxt
    return nodes, nodes[up]


def stars(batches):
    """Rows (node, root) of all edges (a, b), which one task holds."""
    held = [np.zeros((2, 0), np.int64), *(np.array([x.to_numpy() for x in batch.columns]) for batch in batches)]
    nodes, least = least_nodes(*np.concatenate(held, axis=1))
    below = nodes != least
    yield pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(least[below])], names=["node", "root"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's component, for the nodes that edges (a, b) name.

    Large-star and small-star rounds; each halves the depth of what is left, the lineage is cut each time. Once there are
    ONE_TASK edges or fewer, one task finds all the rest: rounds of many tasks that hold next to nothing cost far more."""
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    was = state(e)
    for _ in range(rounds):
        if was[0] <= ONE_TASK:
            return cut(e.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(lean(stars), "node long, root long"))
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        wide = salted_join(both, least, "a", hot_keys(both, "a"), "inner").where("b > a and b <> m")
        large = cut(wide.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        wide = salted_join(large, least, "a", hot_keys(large, "a"), "inner")
        small = wide.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = cut(small.where("a <> b").distinct())
        if was == (now := state(e)):
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        was = now
    raise RuntimeError(f"components not settled in {rounds} rounds")


def near_duplicates(df: DataFrame, id: str, text: str, width: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp, component_id): a row per row of df; the component's smallest id, itself included. A result's name that
    the id has already gets a `_`."""
    rows = cut(fingerprints(df.select(c(id).alias("__id"), c(text).alias("__t")), "__t", width, ["__id"]))
    found = group(rows, radius)
    return found.select(F.col("__id").alias(id), F.col("fp").alias("fp_" if id == "fp" else "fp"), F.col("component_id").alias("component_id_" if id == "component_id" else "component_id"))


def group(rows: DataFrame, radius: int) -> DataFrame:
    """rows (__id, fp) with component_id."""
    distinct = cut(rows.groupBy("fp").agg(F.min("__id").alias("least")))
    star = components(links(distinct, radius))
    owned = distinct.join(star, distinct.fp == star.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # A component's rows are its distinct fingerprints; its least id is a map-side minimum.
    least = owned.groupBy("root").agg(F.min("least").alias("component_id"))
    hot_roots = hot_keys(owned, "root")
    named = salted_join(owned.select("fp", "root"), least, "root", hot_roots).select("fp", "component_id")
    return salted_join(rows, cut(named), "fp", hot_keys(rows, "fp")).select("__id", "fp", "component_id")


# Near copies by similarity. Fingerprints only propose: whether two texts are near copies is counted on their whole sets
# of shingle hashes. Proposals come in three steps, and pairs whose ends are in one group by then are never made, so that
# a group of copies costs its size and not its square:
#
# 1. Fingerprints of the shingle sets that link over the vantage-point tree: each text with the first of its group.
# 2. A prefix filter: all shingles have one order, by frequency. If sets of n and m shingles are similar to s, at
#    least s * n and s * m are shared, so the first n - ceil(s * n) + 1 of one and the first m - ceil(s * m) + 1 of the
#    other have a shingle in common. Of the texts that share such a shingle each meets the one that shares most.
# 3. What is left: pairs that share a prefix shingle and are in different groups. All of them are made, which loses none.

#: Words of the confirming fingerprint.
WIDE = 4


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each distinct word shingle, ASCII letters in lower case; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - width].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64))


def expected_bits(similarity: float, bits: int) -> float:
    """Bits in which fingerprints of texts at this Jaccard similarity differ on average: the angle between two sets of
    equal size, as a share of a half turn."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi * bits)


def limits(similarity: float) -> tuple[int, int]:
    """(radius of the search, greatest distance of the confirming words): the mean at that similarity, and over
    it 4 deviations for the search and 1.75 for the confirmation, so that few pairs at the similarity are lost; pairs
    down to about 0.7 can link, texts that share no more than that do not."""
    spread = lambda n: (n * (p := expected_bits(similarity, 1)) * (1 - p)) ** 0.5
    return int(expected_bits(similarity, 64) + 4 * spread(64)), int(expected_bits(similarity, 64 * WIDE) + 1.75 * spread(64 * WIDE))


#: Of rounding: a product with the similarity this little above a whole number is that number.
EPS = 1e-9
#: Shingles of hashes below this are counted over all texts (a text's prefix seldom has others); those in more than COMMON_TEXTS of them are
#: ordered last. At most COMMON of these are told to every task (16 bytes each): beyond, only those in more texts.
COUNTED, COMMON_TEXTS, COMMON = np.uint64(int(0.3 * 2**64)), 8, 1 << 20
#: Texts from which on a shingle's entries are dealt over several tasks.
HOT_TEXTS = 50_000
#: Bytes of texts whose shingles are counted in one task.
COUNT_BYTES = 32 << 20
#: Bytes of the sets, and entries, that one task compares; texts that meet one text there at most; entries of a block of a
#: shingle that very many texts share.
TASK_BYTES, TASK_ENTRIES, BLOCK, SHARED_BLOCK = 32 << 20, 200_000, 256, 20_000
#: Pairs that a task holds at a time.
PAIRS_AT_ONCE = 500_000
#: Candidate texts up to which their keys are broadcast.
BROADCAST_TEXTS = 200_000
#: Bytes of a sketch: tight for texts of up to about 2,000 shingles, never wrong for longer ones.
SKETCH = 256
#: Bits in which fingerprints of one group differ.
NEAR_BITS = 3


COUNT = np.dtype([("h", "<u8"), ("n", "<u4")])
ENTRY = np.dtype([("shingle", "<u8"), ("key", "<i8"), ("n", "<u4"), ("last", "<u4")])


def spread(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) % buckets


def common_shingles(df: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of common shingles, sorted, and the number of texts with each (of repeated texts, each counts): they are
    ordered last. Any list gives the same links; a good one gives few candidates."""
    buckets = max(1, about_bytes(df, text) // COUNT_BYTES)
    def settle(held):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        e = np.zeros(len(h), COUNT)
        e["h"], e["n"] = h, n
        return pack(spread(h, buckets), e)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for x in batch.column(0):
                h = shingle_hashes(x.as_py(), width)
                held.append(h[: int(np.searchsorted(h, COUNTED))])
                size += len(held[-1])
                if size > 1_000_000:
                    yield settle(held)
                    held, size = [], 0
        if held:
            yield settle(held)

    def count(table: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(table.column("blob").to_pylist()), COUNT)
        e = e[np.argsort(e["h"], kind="stable")]
        at = np.flatnonzero(np.r_[True, e["h"][1:] != e["h"][:-1]]) if len(e) else np.zeros(0, np.int64)
        n = np.add.reduceat(e["n"].astype(np.int64), at) if len(e) else at
        some = n > COMMON_TEXTS
        return pa.table({"h": pa.array(e["h"][at][some].view(np.int64)), "n": pa.array(n[some])})

    counted = df.select(c(text).cast("string")).mapInArrow(lean(run), "kind int, bucket long, blob binary")
    counts = cut(counted.groupBy("bucket").applyInArrow(lean_group(count), "h long, n long"))
    # Numbers of shingles by the power of two of their texts: 64 rows at most.
    powers = sorted((r[0], r[1]) for r in counts.groupBy(F.length(F.bin("n"))).count().collect())
    while sum(n for _, n in powers) > COMMON:
        powers.pop(0)
    found = counts.where(F.length(F.bin("n")) >= (powers[0][0] if powers else 64)).toArrow()
    h, n = (found.column(k).to_numpy() for k in ("h", "n"))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], n[order]


def least_shared(n, similarity: float):
    """Shingles that a set of n shares with any set at the similarity, at least."""
    return np.ceil(n * similarity - EPS).astype(np.int64)


def ordered(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Each shingle's place in the order of all (6 bits of rank, 58 of its hash): those counted and in few texts first,
    then the common ones, rarer before more frequent, then those that were not counted."""
    rank = np.where(hashes < COUNTED, 0, 63).astype(np.uint64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], hashes), len(common[0]) - 1)
        known = common[0][at] == hashes
        rank[known] = np.minimum(62, np.ceil(np.log2(common[1][at[known]]))).astype(np.uint64)
    return (rank << np.uint64(58)) | (hashes >> np.uint64(6))


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of the set, in the order of all."""
    return np.sort(ordered(hashes, common))[: len(hashes) - int(least_shared(np.array(len(hashes)), similarity)) + 1]


def sketch(hashes: np.ndarray) -> bytes:
    """Whether an odd number of hashes has each value of the highest 11 bits. A hash that only one of two sets has turns
    one bit, so that the sets have no fewer such hashes than their sketches have differing bits."""
    n = np.bincount((hashes >> np.uint64(53)).astype(np.int64), minlength=8 * SKETCH)
    return np.packbits((n & 1).astype(np.uint8)).tobytes()


def least_apart(sketches: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hashes that only one of the sets x and y of these sketches (64-bit words, one row each) has, at least."""
    out = np.zeros(len(x), np.int64)
    for lo in range(0, len(x), 20_000):
        out[lo : lo + 20_000] = np.bitwise_count(sketches[x[lo : lo + 20_000]] ^ sketches[y[lo : lo + 20_000]]).sum(axis=1)
    return out


def prefixes(df: DataFrame, text: str, width: int, similarity: float, keep: dict, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """`keep` columns, key (a hash of the set of shingles), n (their number), fp (their fingerprint), prefix and sketch (binary)."""
    picked = df.select(*[v.alias(k) for k, v in keep.items()], c(text).cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            at = batch.num_columns - 1
            key, n, fp, first, drawn = [], [], [], [], []
            for x in batch.column(at):
                h = shingle_hashes(x.as_py(), width)
                key.append(xxhash.xxh64_intdigest(h.tobytes(), 7) - (1 << 63))
                n.append(len(h))
                fp.append(majority(h))
                first.append(prefix(h, common, similarity).tobytes())
                drawn.append(sketch(h))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(first, pa.binary()), pa.array(drawn, pa.binary())],
                names=[*batch.schema.names[:at], "key", "n", "fp", "prefix", "sketch"],
            )

    zero = F.lit(0).cast("long")
    out = picked.drop("__text").withColumns({"key": zero, "n": zero, "fp": zero, "prefix": F.lit(b""), "sketch": F.lit(b"")}).schema
    return picked.mapInArrow(lean(run), out)


def fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys of distinct (key, fp): each text and the first of those whose fingerprints link."""
    fps = cut(distinct.groupBy("fp").agg(F.min("key").alias("a")))
    star = components(links(fps, NEAR_BITS))
    owned = fps.join(star, fps.fp == star.node, "left").select("fp", "a", F.coalesce("root", "fp").alias("root"))
    least = owned.groupBy("root").agg(F.min("a").alias("a"))
    named = cut(salted_join(owned.select("fp", "root"), least, "root", hot_keys(owned, "root"), "inner").select("fp", "a"))
    both = salted_join(distinct.select("key", "fp"), named, "fp", hot_keys(distinct, "fp"), "inner")
    return both.where("a <> key").select("a", F.col("key").alias("b"))


def shared_prefixes(distinct: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Entries (shingle, key, n, last, texts) of the prefix shingles that more than one of distinct (key, n, prefix) has,
    with texts, how many or a little more, and last, the upper half of the text's last prefix shingle."""
    total = distinct.agg(F.sum(F.octet_length("prefix").cast("long"))).first()[0] or 0
    buckets = max(1, total // (8 * TASK_ENTRIES))
    hot = common[1] > HOT_TEXTS
    hot, parts = ordered(common[0][hot], common), -(-common[1][hot] // HOT_TEXTS)
    hot, first = np.unique(hot, return_index=True)
    parts = parts[first]

    def of_hot(shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of these are hot, the number of parts of each)."""
        if not len(hot):
            return np.zeros(len(shingle), bool), np.ones(len(shingle), np.int64)
        at = np.minimum(np.searchsorted(hot, shingle), len(hot) - 1)
        is_hot = hot[at] == shingle
        return is_hot, np.where(is_hot, parts[at], 1)

    def route(batches):
        for batch in batches:
            key, n = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in (0, 1))
            blobs = batch.column(2).to_pylist()
            size = np.fromiter((len(x) // 8 for x in blobs), np.int64, len(blobs))
            if not len(size):
                continue
            e = np.zeros(int(size.sum()), ENTRY)
            e["shingle"] = np.frombuffer(b"".join(blobs), np.uint64)
            e["key"], e["n"] = np.repeat(key, size), np.repeat(n, size)
            e["last"] = np.repeat(e["shingle"][np.cumsum(size) - 1] >> np.uint64(32), size)
            _, dealt = of_hot(e["shingle"])
            part = (e["key"].view(np.uint64) % dealt.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            yield pack(spread(e["shingle"] ^ part, buckets), e)

    def several(table: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(table.column("blob").to_pylist()), ENTRY)
        e = e[np.argsort(e["shingle"], kind="stable")]
        at = np.flatnonzero(np.r_[True, e["shingle"][1:] != e["shingle"][:-1]]) if len(e) else np.zeros(0, np.int64)
        n = np.diff(np.r_[at, len(e)])
        is_hot, dealt = of_hot(e["shingle"][at])
        keep, texts = np.repeat((n > 1) | is_hot, n), np.repeat(n * dealt, n)
        e, texts = e[keep], texts[keep]
        columns = [e["shingle"].view(np.int64), e["key"], e["n"].astype(np.int64), e["last"].astype(np.int64), texts]
        return pa.table([pa.array(np.ascontiguousarray(x)) for x in columns], names=["shingle", "key", "n", "last", "texts"])

    routed = distinct.select("key", "n", "prefix").mapInArrow(lean(route), "kind int, bucket long, blob binary")
    return routed.groupBy("bucket").applyInArrow(lean_group(several), "shingle long, key long, n long, last long, texts long")


def leader_pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b): a has, of the texts with a shingle in common, the most texts in common with others."""
    score = shared.groupBy("key").agg(F.sum("texts").alias("score"))
    scored = cut(salted_join(shared, score, "key", hot_keys(shared, "key"), "inner"))
    # Many texts of a family tie: all their shingles must name the same one, or none is seen to share enough with it.
    first = F.max(F.struct("score", "key", "n", "last")).alias("first")
    best = scored.groupBy("shingle").agg(first).select("shingle", F.col("first.key").alias("a"), F.col("first.n").alias("na"), F.col("first.last").alias("la"))
    both = salted_join(scored.select("shingle", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("last").alias("lb")), best, "shingle", hot_keys(scored, "shingle"), "inner")
    # A guess: shingles that another text leads are not counted. What it loses is found later.
    return enough_shared(both.where(f"a <> b and least(na, nb) >= greatest(na, nb) * {similarity!r}D - {EPS!r}D").withColumn("shared", F.lit(1)), similarity)


def enough_shared(found: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that can be at the similarity, given the prefix shingles that they share, one row or more for each."""
    # Shared shingles up to the earlier end of the two prefixes are all counted; that text has only `rest` more.
    rest = lambda k: F.ceil(F.col(k) * F.lit(similarity) - F.lit(EPS)) - 1
    after = F.when(F.col("la") < F.col("lb"), rest("na")).when(F.col("lb") < F.col("la"), rest("nb")).otherwise(F.greatest(rest("na"), rest("nb")))
    need = F.ceil((F.col("na") + F.col("nb")) * F.lit(similarity / (1 + similarity)) - F.lit(EPS))
    same = [F.max(k).alias(k) for k in ("na", "nb", "la", "lb")]
    return found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), *same).where(F.col("shared") + after >= need).select("a", "b")


def one_row_a_pair(held: list[np.ndarray]) -> np.ndarray:
    """These columns (a, b, shared and more; each a row of the array) with one column for each pair (a, b), shared summed."""
    rows = np.concatenate(held, axis=1)
    if not rows.shape[1]:
        return rows
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    at = np.flatnonzero(np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])
    shared = np.add.reduceat(rows[2], at)
    rows = rows[:, at]
    rows[2] = shared
    return rows


def open_pairs(shared: DataFrame, labels: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of keys in different groups of labels (node, root) that may be at the similarity: every such pair that
    is, is there. Sketches (key, sketch) settle most others before they leave their task."""
    named = salted_join(shared, labels.select(F.col("node").alias("key"), "root"), "key", hot_keys(shared, "key"))
    named = cut(named.withColumn("root", F.coalesce("root", "key")))
    several = named.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle")
    left = cut(salted_join(named, several, "shingle", hot_keys(named, "shingle"), "inner"))
    tasks = max(1, -(-left.count() // TASK_ENTRIES))
    # Very common shingles are cut into blocks, each two of which meet.
    blocks = left.groupBy("shingle").agg(F.ceil(F.count("*") / SHARED_BLOCK).alias("blocks")).where("blocks > 1")
    left = salted_join(left, cut(blocks), "shingle", hot_keys(left, "shingle")).withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    cells = left.withColumn("block", F.pmod(F.xxhash64("key", F.lit(17)), F.col("blocks")))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    bucket = F.pmod(F.xxhash64("shingle", "lo", "hi"), F.lit(tasks)).cast("int")

    def pair(table: pa.Table) -> pa.Table:
        held = table.column("sketch").is_valid()
        drawn, at = np.unique(table.column("key").filter(held).to_numpy(), return_index=True)
        sketches = utf8_parts(table.column("sketch").filter(held))[0].reshape(-1, SKETCH)[at].view(np.uint64)
        entries = table.drop_columns(["sketch", "bucket"]).filter(pa.compute.invert(held))
        column = {k: entries.column(k).to_numpy() for k in entries.column_names}
        order = np.lexsort((column["key"], column["root"], column["hi"], column["lo"], column["shingle"]))
        e = {k: v[order] for k, v in column.items()}
        new = lambda *names: np.r_[True, np.logical_or.reduce([e[k][1:] != e[k][:-1] for k in names])]
        # An entry meets those of its cell behind its own group.
        cell, group = new("shingle", "lo", "hi"), new("shingle", "lo", "hi", "root")
        edges = lambda starts: np.repeat(np.r_[np.flatnonzero(starts)[1:], len(starts)], np.diff(np.r_[np.flatnonzero(starts), len(starts)]))
        begin, stop = edges(group), edges(cell)
        out, lo = [], 0
        ends = np.cumsum(stop - begin)
        while lo < len(begin):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
            k = (stop - begin)[lo:hi]
            x = np.repeat(np.arange(lo, hi), k)
            y = np.repeat(begin[lo:hi], k) + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
            lo = hi
            small, large = np.minimum(e["n"][x], e["n"][y]), np.maximum(e["n"][x], e["n"][y])
            # Of blocks that meet, only pairs across them: those within meet by themselves.
            ok = (small >= large * similarity - EPS) & ((e["lo"][x] == e["hi"][x]) | (e["block"][x] != e["block"][y]))
            x, y = x[ok], y[ok]
            swap = e["key"][x] > e["key"][y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            pairs = np.lexsort((e["key"][y], e["key"][x]))
            x, y = x[pairs], y[pairs]
            at = np.flatnonzero(np.r_[True, (e["key"][x][1:] != e["key"][x][:-1]) | (e["key"][y][1:] != e["key"][y][:-1])]) if len(x) else np.zeros(0, np.int64)
            shared = np.diff(np.r_[at, len(x)])
            size = e["n"][x[at]] + e["n"][y[at]]
            apart = least_apart(sketches, np.searchsorted(drawn, e["key"][x[at]]), np.searchsorted(drawn, e["key"][y[at]]))
            may = (size - apart) // 2 >= np.ceil(size * (similarity / (1 + similarity)) - EPS)
            at, shared = at[may], shared[may]
            x, y = x[at], y[at]
            out.append(np.array([e["key"][x], e["key"][y], shared, e["n"][x], e["n"][y], e["last"][x], e["last"][y]], np.int64))
            if sum(v.shape[1] for v in out[1:]) > max(PAIRS_AT_ONCE, out[0].shape[1]):
                out = [one_row_a_pair(out)]
        made = one_row_a_pair(out) if out else np.zeros((len(names), 0), np.int64)
        return pa.table([pa.array(v) for v in made], names=names)

    names = ["a", "b", "shared", "na", "nb", "la", "lb"]
    cells = cut(cells.select(bucket.alias("bucket"), "shingle", "lo", "hi", "block", "key", "root", "n", "last"))
    # A sketch goes once to each task that asks for it.
    asked = cells.select("bucket", "key").distinct()
    drawn = salted_join(asked, sketches, "key", hot_keys(asked, "key"), "inner")
    every = cells.withColumn("sketch", F.lit(None).cast("binary")).unionByName(drawn, allowMissingColumns=True)
    found = every.groupBy("bucket").applyInArrow(lean_group(pair), ", ".join(f"{k} long" for k in names))
    return enough_shared(found, similarity)


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets of hashes have this Jaccard similarity or more."""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(x) + len(y) - shared) - EPS


def similar_links(texts: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose sets of shingles are at the similarity. texts: key and text, of every key in pairs.

    A text meets those that name it as a in tasks of BLOCK of them; each text's set goes once to each task."""
    block = F.pmod(F.xxhash64("b", F.lit(17)), F.ceil(F.col("of_a") / BLOCK))
    of_a = pairs.groupBy("a").agg(F.count("*").alias("of_a"))
    placed = cut(salted_join(pairs, of_a, "a", hot_keys(pairs, "a"), "inner").select("a", "b", F.xxhash64("a", block, F.lit(19)).alias("cell")))
    ends = cut(placed.select(F.col("a").alias("key"), "cell").union(placed.select("b", "cell")).distinct())
    sized = texts.select("key", F.octet_length("text").alias("size"))
    held = salted_join(ends, sized, "key", hot_keys(ends, "key"), "inner").agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
    tasks = max(1, -(-2 * held // TASK_BYTES))
    bucket = F.pmod(F.col("cell"), F.lit(tasks)).cast("int").alias("bucket")
    sent = salted_join(ends.select("key", bucket).distinct(), texts, "key", hot_keys(ends, "key"), "inner").select("bucket", "key", "text")

    def run(batches):
        seen = set()  # rows that are repeated are sent once
        for batch in batches:
            places = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            fresh = pa.array([i for i, x in enumerate(places) if x not in seen and not seen.add(x)], pa.int64())
            bucket, key, text = (batch.column(k).take(fresh) for k in range(3))
            blobs = [shingle_hashes(x.as_py(), width).tobytes() for x in text]
            yield pa.RecordBatch.from_arrays([bucket, key, pa.nulls(len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "a", "b", "blob"])

    def compare(table: pa.Table) -> pa.Table:
        a, b, blob = (table.column(k).to_pylist() for k in ("a", "b", "blob"))
        held = {k: np.frombuffer(x, np.uint64) for k, x in zip(a, blob, strict=True) if x is not None}
        found = [(x, y) for x, y, s in zip(a, b, blob, strict=True) if s is None and similar(held[x], held[y], similarity)]
        return pa.table([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    asked = placed.select(bucket, "a", "b", F.lit(None).cast("binary").alias("blob"))
    every = sent.mapInArrow(lean(run), "bucket int, a long, b long, blob binary").union(asked)
    return every.groupBy("bucket").applyInArrow(lean_group(compare), "a long, b long")


def near_copies(df: DataFrame, id: str, text: str, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of df without near copies: of each component of texts at the similarity or above one row stays, that of the
    smallest id (nulls last; of equal ids, the smallest hash of the text; of equal rows, any one). A null or empty text
    has one shingle, the empty one. Texts of any length are taken whole."""
    own = F.xxhash64(c(id), c(text), F.lit(3))
    common = common_shingles(df, text, width)
    rows = cut(prefixes(df, text, width, similarity, {"__own": own, "__id": c(id)}, common))
    distinct = cut(rows.groupBy("key").agg(F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("prefix").alias("prefix"), F.min("sketch").alias("sketch"), F.min(F.struct(F.col("__id").isNull(), "__id", "__own")).alias("least")))
    shared = cut(shared_prefixes(distinct, common))
    owners = distinct.select("key", F.col("least.__own").alias("__own"))
    drop_unused(df.sparkSession)

    def confirmed(pairs: DataFrame) -> DataFrame:
        named = cut(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
        asked = owners.join(named, "key", "left_semi")
        texts = df.select(own.alias("__own"), c(text).cast("string").alias("text"))
        texts = texts.join(asked if named.count() > BROADCAST_TEXTS else F.broadcast(asked), "__own")
        drop_unused(df.sparkSession)
        return cut(similar_links(texts.select("key", "text"), pairs, width, similarity))

    first = confirmed(cut(fingerprint_pairs(distinct).union(leader_pairs(shared, similarity)).distinct()))
    labels = components(first)
    drop_unused(df.sparkSession)
    more = confirmed(cut(open_pairs(shared, labels, distinct.select("key", "sketch"), similarity)))
    star = components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    drop_unused(df.sparkSession)
    owned = distinct.join(star, distinct.key == star.node, "left").select(F.coalesce("root", "key").alias("root"), "least")
    winners = owned.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.__own").alias("__own"))
    stays = cut(rows.select("__own").join(winners, "__own", "left_semi").groupBy("__own").agg(F.count("*").alias("__rows")))
    kept = df.withColumn("__own", own).join(stays, "__own")
    if not stays.where("__rows > 1").isEmpty():
        kept = kept.dropDuplicates(["__own"])
    return kept.select(*[c(k) for k in df.columns])
