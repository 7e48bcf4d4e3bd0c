import hashlib
import random
from fractions import Fraction

from pyspark.sql import functions as F

from gridspark.llm.mixing import cycled_weights, mix, targets


def slow_targets(sizes, weights, percent, cap):
    """By the rule as stated: share by weight, cut at the cap, share the excess again."""
    names = sorted((x for x in sizes if x is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    t = dict.fromkeys(names, Fraction(0))
    left, open_ = Fraction(sum(sizes.values()) * percent, 100), set(names)
    while left > 0 and open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        left = Fraction(0)
        for s in list(open_):
            t[s] += share[s]
            if t[s] >= cap * sizes[s]:
                left += t[s] - cap * sizes[s]
                t[s] = Fraction(cap * sizes[s])
                open_.discard(s)
    return t


def slow_mix(rows, weights, percent=150, cap=2):
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    t = slow_targets(sizes, weights, percent, cap)
    key = lambda i: hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()
    extra = {}
    for s in sizes:
        whole = min(cap, t[s] // sizes[s]) if sizes[s] else 0
        budget = t[s] - whole * sizes[s] if whole < cap else 0
        by = {}
        for i, x, n in rows:
            if x == s:
                by[key(i)] = by.get(key(i), 0) + n
        run, chosen = 0, set()
        for k in sorted(by):
            if run + by[k] > budget:
                if budget - run >= Fraction(by[k], 2):
                    chosen.add(k)
                break
            run += by[k]
            chosen.add(k)
        extra[s] = (whole, chosen if whole < cap else set())
    return [(i, s, sizes[s], float(t[s]), int(extra[s][0]) + (key(i) in extra[s][1])) for i, s, _ in rows]


def test_targets(spark):
    rng = random.Random(4)
    for trial in range(8):
        sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 10**6]) * rng.randint(1, 9) for i in range(rng.randint(1, 9))}
        if trial % 2:
            sizes[None] = 50
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in targets(cycled_weights(df, [3, 1, 2])).collect()}
        want = slow_targets(sizes, [3, 1, 2], 150, 2)
        for s in sizes:
            assert abs(got[s] - float(want[s])) <= 1e-9 * max(1.0, float(want[s])), (trial, s)


def test_mix_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "é", "Z", None]), rng.choice([0, 1, 7, 30, 400])) for i in range(300)]
    rows += [(None, "a", 5), (None, "b", 5), (7, "a", 9), (7, "a", 9), (900, "zero", 0), (901, "one", 77777)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, source string, size long, b int").repartition(3)
    got = [(r.id, r.source, r.source_size, r.target, r.copies) for r in mix(df, [3, 1, 2]).collect()]
    want = slow_mix(rows, [3, 1, 2])
    assert [(x[0], x[1], x[2], round(x[3], 6), x[4]) for x in sorted(got, key=str)] == [(x[0], x[1], x[2], round(x[3], 6), x[4]) for x in sorted(want, key=str)]
    assert max(x[4] for x in got) <= 2
    assert mix(df.limit(0), [3, 1, 2]).isEmpty()


def test_deep_refinement(spark):
    df = spark.range(20000).select(F.col("id"), F.lit("x").alias("source"), F.lit(3).cast("long").alias("size"))
    got = mix(df, [3, 1, 2]).agg(F.sum(F.col("size") * F.col("copies"))).first()[0]
    assert abs(got - 90000) <= 3
