import hashlib
import random

import pytest

from gridspark.llm.substrings import anchor_runs, merged, remove_repeats
from gridspark.llm.suffixes import suffix_array


def brute(rows, size):
    """(id, kept, removed, spans) of each row, by the definition."""
    least = {}
    key = lambda i: (i is None, i or 0)
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for p in range(len(b) - size + 1):
            s = b[p : p + size]
            at = (key(i), p)
            if s not in least or at < least[s]:
                least[s] = at
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if least[b[p : p + size]] < (key(i), p):
                gone[p : p + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, hashlib.sha256(kept).hexdigest(), sum(gone), spans))
    return sorted(out, key=str)


def ours(spark, rows, size):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove_repeats(df, "doc_id", "text", size).collect()
    for r in got:
        assert r.n_removed == sum(s.end - s.start for s in r.spans)
    return sorted(((r.doc_id, hashlib.sha256(bytes(r.kept)).hexdigest(), r.n_removed, r.n_spans) for r in got), key=str)


def test_suffix_array_small():
    rng = random.Random(1)
    for _ in range(3000):
        x = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 24))] + [0]
        assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])
    assert suffix_array([]) == []


def test_merged():
    import numpy as np

    from gridspark.llm.substrings import SPAN

    assert merged(np.array([(0, 0, 5, 5), (0, 0, 0, 3), (0, 0, 9, 4), (0, 0, 20, 1)], SPAN)) == [(0, 3), (5, 13), (20, 21)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé ") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    piece = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(6)]
    rows = []
    for i in range(40):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(piece)
            a = rng.randint(0, len(p) // 2)
            at = rng.randint(0, len(t))
            t = t[:at] + p[a : a + rng.randint(20, 150)] + t[at:]
        rows.append((i, t))
    rows += [(100 + i, rows[rng.randint(0, 39)][1]) for i in range(6)]
    for i in range(6):
        t = list(rows[7 + i][1])
        if t:
            t[len(t) // 2] = "Z"
        rows.append((200 + i, "".join(t)))
    rows += [(300, "xy" * 300), (301, "a" * 500), (302, "a" * 70), (303, ""), (304, None), (None, rows[3][1]), (None, "q" * 90)]
    rows += [rows[5], (5, rows[9][1] + "tail"), (-4, rows[12][1])]
    rng.shuffle(rows)
    for size in (20, 64):
        assert ours(spark, rows, size) == brute(rows, size)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, d int, blob string, spans int")
    assert remove_repeats(df, "doc_id", "text", 100).collect() == []
    df = spark.createDataFrame([(1, "x" * 150, 3, "b"), (2, "x" * 150, 4, "c")], "doc_id long, text string, d int, blob string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in remove_repeats(df, "doc_id", "text", 100).collect()}
    assert got == {1: (149, 1), 2: (150, 1)}


def test_anchors_cover_every_window():
    import numpy as np

    rng = np.random.default_rng(3)
    data = rng.integers(97, 101, 3000).astype(np.uint8)
    doc, h, p, q = anchor_runs(data, np.array([0, 1000, 1050]), np.array([1000, 1050, 3000]), 100, block=700)
    seen = np.zeros(3000, int)
    for a, b in zip(p, q):
        seen[a : b + 1] += 1
    want = np.zeros(3000, int)
    want[0:901] = 1
    want[1050:2901] = 1
    assert (seen == want).all()


def test_many_rows_of_a_null_id(spark):
    """Rows of null id are told apart by their text: the tables beside the texts stay as long as the input."""
    rng = random.Random(3)
    rows = [(None, f"{i:06d} " + "".join(rng.choice("abcdefgh") for _ in range(150))) for i in range(3000)] + [(None, "same " * 50)] * 3 + [(1, "same " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = remove_repeats(df, "doc_id", "text", 100, keep=["text"]).collect()
    assert len(got) == len(rows) and sum(r.n_removed == 250 for r in got) == 3 and sum(r.n_removed == 245 for r in got) == 1
    assert all(r.row.text[:7] == r.text[:7] for r in got if r.n_removed == 0)
