import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gridspark.llm.simhash import components, distance, fingerprint, least_apart, limits, near_copies, near_duplicates, pairs_in_shard, shards_of, sketch, top_tree


def slow_fingerprint(text, width=3):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, radius=3):
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        r = root(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, f, least.get(root(i))) for i, (d, f) in enumerate(fps)), key=str)


def test_fingerprint():
    for t in [None, "", "  \t", "One", "One two", "a b c", "A b\x0bC d e É f", "x " * 50, "Straße STRASSE \x1c q"]:
        assert fingerprint(t) == slow_fingerprint(t), t


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for i in range(120)]
    for i in range(80):
        t = rows[i % 20][1].split()
        if t and i % 3:
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((1000 - i, " ".join(t)))
    rows += [(2000, None), (2001, ""), (None, rows[3][1]), (None, None), rows[4], rows[4]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = near_duplicates(df, "doc_id", "text").collect()
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == slow_components(rows)
    assert near_duplicates(df.limit(0), "doc_id", "text").collect() == []


def test_tree_finds_every_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = base[:1500] ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    tree = top_tree(fps[::3], 8)
    index, shard, home = shards_of(tree, fps, 3)
    assert home.sum() == len(fps)
    linked = set()
    for s in np.unique(shard):
        at = shard == s
        a, b = pairs_in_shard(fps[index[at & home]], fps[index[at & ~home]], 3)
        assert (distance(a, b) <= 64).all()
        linked |= {frozenset(x) for x in zip(a.tolist(), b.tolist())}
    up = {x: x for x in fps.tolist()}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for pair in linked:
        a, b = pair
        up[root(a)] = root(b)
    for i in range(0, len(fps), 500):
        x, y = np.nonzero(np.bitwise_count(fps[i : i + 500, None] ^ fps[None]) <= 3)
        for a, b in zip(fps[i + x].tolist(), fps[y].tolist()):
            assert root(a) == root(b)
    groups = {root(x) for x in up}
    assert 2900 < len(groups) <= 3000


def test_components_long_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, n)}, 1001: 1000}


def test_near_copies(spark):
    assert limits(0.8) == (21, 48)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    base = [[rng.choice(words) for _ in range(rng.randint(150, 400))] for _ in range(60)]
    rows = [(i, " ".join(t), "x", 1) for i, t in enumerate(base)]
    for i in range(20):  # one changed word in a hundred: similarity about 0.9
        t = list(base[i])
        for k in range(50, len(t), 100):
            t[k] = "changed"
        rows.append((100 + i, " ".join(t), "x", 1))
    for i in range(20, 30):  # one in eight: far below 0.8
        t = list(base[i])
        for k in range(0, len(t), 8):
            t[k] = f"other{k}"
        rows.append((100 + i, " ".join(t), "x", 1))
    rows += [(200 + i, " ".join(base[i]), "y", 2) for i in range(5)] + [(-5, " ".join(base[7]).upper(), "z", 3)]
    rows += [(None, "only null", "x", 1), (None, "only null", "x", 1), (300, None, "x", 1), (301, "", "x", 1), (302, "short text", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, point int").repartition(3)
    got = near_copies(df, "doc_id", "text")
    assert got.columns == df.columns
    kept = sorted((r.doc_id for r in got.collect()), key=str)
    want = ({*range(60), *range(120, 130), -5, None, 300, 302} - {7})
    assert kept == sorted(want, key=str)
    assert near_copies(df.limit(0), "doc_id", "text").collect() == []


def words_of(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]


def exact_kept(rows, similarity=0.8):
    """The smallest id of each component of texts at the similarity or above, every pair compared."""
    sets = [(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) for i, w in ((i, t.lower().split()) for i, t in rows)]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if len(a & b) >= similarity * len(a | b) - 1e-9:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {root(i) for i in up}


def test_near_copies_leaves_texts_below_the_similarity(spark):
    rng = random.Random(12)
    rows = []
    for i in range(80):  # the last words changed: similarities from 0.6 to 0.95
        t = words_of(rng, rng.choice([60, 150, 400]))
        shared = int(len(t) * (0.75 + 0.22 * i / 80))
        rows += [(i, " ".join(t)), (1000 + i, " ".join(t[:shared] + words_of(rng, len(t) - shared)))]
    want = exact_kept(rows)
    assert 20 < len(want & set(range(1000, 1080))) < 60
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text")
    assert {r.doc_id for r in got.collect()} == want


def test_near_copies_finds_short_texts_and_pairs_at_the_similarity(spark, monkeypatch):
    """Pairs at 0.80 exactly, from 5 against 4 shingles on; small blocks, tasks and broadcasts take every path."""
    monkeypatch.setattr("gridspark.llm.simhash.BLOCK", 1, raising=False)
    monkeypatch.setattr("gridspark.llm.simhash.TASK_BYTES", 2000, raising=False)
    monkeypatch.setattr("gridspark.llm.simhash.BROADCAST_TEXTS", 10, raising=False)
    rng = random.Random(6)
    rows = []
    for n, less in ((9, 8), (29, 24), (104, 84)):
        for _ in range(100):
            t = words_of(rng, n)
            rows += [(len(rows), " ".join(t)), (len(rows) + 1, " ".join(t[:less]))]
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text")
    assert {r.doc_id for r in got.collect()} == set(range(0, 600, 2))


def test_sketches_never_overstate_the_difference_and_are_tight_for_usual_texts():
    rng = np.random.default_rng(8)
    for n, other in [(1, 1), (5, 2), (140, 25), (140, 60), (1000, 250), (20_000, 9_000), (0, 3)]:
        both = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 1 << 64, other, np.uint64)])) for _ in range(2))
        drawn = np.frombuffer(sketch(x) + sketch(y), np.uint64).reshape(2, -1)
        apart = int(least_apart(drawn, np.array([0]), np.array([1]))[0])
        assert apart <= len(np.setxor1d(x, y))
        if other <= 60:
            assert apart >= 0.8 * 2 * other  # 120 of 2,048 bits: 113 on average
        assert least_apart(drawn, np.array([1]), np.array([1]))[0] == 0


def test_few_edges_take_few_tasks(spark, monkeypatch):
    """The files of each round's tasks, not their rows, filled the disk where 211 partitions held a few thousand links."""
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(2000 + i, 2001 + i) for i in range(50)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    want = {x: root(x) for x in list(up) if root(x) != x}
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    stages = {}
    for few in (1 << 18, 0):
        monkeypatch.setattr("gridspark.llm.simhash.ONE_TASK", few, raising=False)
        sc.setJobGroup(f"components-{few}", "")
        got = components(df)
        sc.setLocalProperty("spark.jobGroup.id", None)
        stages[few] = {s for j in tracker.getJobIdsForGroup(f"components-{few}") for s in tracker.getJobInfo(j).stageIds}
        assert {r.node: r.root for r in got.collect()} == want
    assert 0 < len(stages[1 << 18]) <= 10 < len(stages[0])


def test_files_of_shuffles_that_are_not_used_again_go(spark):
    import time

    from gridspark.llm.common import cut, drop_unused

    store = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: store.getAllFiles().mkString(" ").count(".data")
    kept = [cut(spark.range(1000).repartition(9).groupBy((F.col("id") % 50).alias("k")).count()) for _ in range(4)]
    made, end = files(), time.time() + 20
    while files() > made // 2 and time.time() < end:  # a call may leave what the one after it takes
        drop_unused(spark)
        time.sleep(0.5)
    assert made >= 36 and files() <= made // 2
    assert [x.count() for x in kept] == [50] * 4
