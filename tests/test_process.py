import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators.process import Process, map_chunks, map_positions, recommended_partitions
from gridspark.operators.scatter import bin_of, edges, histogram, interpolate, nearest, rotated
from gridspark.plans.catalog import Catalog
from gridspark.plans.dimension import Dimension
from gridspark.sources.ingest import from_array
from gridspark.streaming.arrivals import arrivals, compute_arrivals, windowed_means

DATA = np.random.default_rng(7).random((15, 14))
PARAMS = {"parm_1": 1, "parm_2": [1, 2, 3]}
DIMS = [Dimension("X", "nm", 5), Dimension("Y", "um", 3)], [Dimension("Bias", "V", 7), Dimension("Cycle", "", 2)]


@pytest.fixture()
def catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "tree"))
    c.write_main("/m/raw", from_array(spark, DATA, *DIMS))
    return c


def process(catalog, params=None, **more):
    return Process(catalog, "/m/raw", "Mean", params or PARAMS, fn=lambda s: float(np.mean(s)), result="double", **{"batches": 3} | more)


def partial(catalog, params, ids):
    """A run of which these positions are done."""
    run = catalog.create_results_group("/m/raw", "Mean", params)
    rows = catalog.spark.createDataFrame([(i, float(DATA[i].mean())) for i in ids], "pos_idx long, result double")
    rows.write.parquet(f"{catalog.folder(run)}/results/batch=old")
    rows.select("pos_idx").write.parquet(f"{catalog.folder(run)}/status/batch=old")
    return run


def check(p, run):
    got = sorted((r.pos_idx, r.result) for r in p.results(run).collect())
    assert [k for k, _ in got] == list(range(15)) and np.allclose([v for _, v in got], DATA.mean(axis=1))


def test_fresh_then_cached_then_override(catalog):
    p = process(catalog)
    assert np.isclose(p.test(4), DATA[4].mean()) and not p.complete and not p.partial
    run = p.compute()
    assert run == "/m/raw-Mean_000"
    check(p, run)
    again = process(catalog)
    assert again.complete == [run] and again.compute() == run
    assert process(catalog, {"parm_1": 2, "parm_2": [1, 2, 3]}).compute() == "/m/raw-Mean_001"
    other = process(catalog)
    assert other.compute(override=True) == "/m/raw-Mean_002"
    check(other, "/m/raw-Mean_002")


def test_resume(catalog):
    first, last = partial(catalog, PARAMS, range(11)), partial(catalog, PARAMS, range(7))
    p = process(catalog)
    assert p.partial == [first, last]
    with pytest.raises(ValueError):
        p.use_partial("/m/raw-Mean_009")
    assert p.compute() == last
    check(p, last)
    assert p.results(last).count() == 15
    q = process(catalog, batches=1)
    assert q.complete == [last] and q.partial == [first]
    q.use_partial(first)
    assert q.compute() == first
    check(q, first)


def test_batches_that_were_not_marked_do_not_count(catalog):
    run = partial(catalog, PARAMS, range(5))
    catalog.spark.createDataFrame([(9, 1e9)], "pos_idx long, result double").write.parquet(f"{catalog.folder(run)}/results/batch=lost")
    p = process(catalog)
    assert p.compute() == run
    check(p, run)


def test_old_marks_and_empty_runs(catalog):
    catalog.create_results_group("/m/raw", "Mean", PARAMS)
    assert process(catalog).partial == []
    old = catalog.create_results_group("/m/raw", "Mean", PARAMS)
    catalog.put(old, "group", catalog.get(old)["attrs"] | {"last_pixel": 15})
    assert process(catalog).complete == [old]


def test_expressions_and_results_elsewhere(catalog):
    e = F.aggregate("spectrum", F.lit(0.0), lambda a, v: a + v) / F.size("spectrum")
    p = Process(catalog, "/m/raw", "Mean", PARAMS, expression=e, target="/elsewhere", batches=2)
    run = p.compute()
    assert run == "/elsewhere/raw-Mean_000"
    check(p, run)
    with pytest.raises(ValueError):
        p.use_partial()
    with pytest.raises(IndexError):
        p.test(99)


def test_maps(spark):
    main = from_array(spark, DATA, *DIMS).main
    peaks = map_positions(main, lambda s: [float(x) for x in s if x > 0.9], "array<double>").collect()
    assert {r.pos_idx: r.result for r in peaks} == {i: [x for x in row if x > 0.9] for i, row in enumerate(DATA)}
    got = map_chunks(main, lambda rows: [float(r.max()) for r in rows], "double").collect()
    assert {r.pos_idx: r.result for r in got} == {i: row.max() for i, row in enumerate(DATA)}
    assert (recommended_partitions(10, 8), recommended_partitions(1000, 8), recommended_partitions(5, 8, lengthy=True)) == (1, 8, 5)
    with pytest.raises(ValueError):
        recommended_partitions(0, 8)


def test_histogram(spark):
    rng = np.random.default_rng(2)
    x, y, v = rng.integers(0, 50, 400) / 7.0, rng.random(400), rng.random(400)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, v)], "x double, y double, v double")
    got = histogram(df, "x", "y", "v", (9, 4)).collect()
    n, ex, ey = np.histogram2d(x, y, bins=(9, 4))
    total, _, _ = np.histogram2d(x, y, bins=(9, 4), weights=v)
    assert len(got) == 36
    for r in got:
        assert r.n == n[r.row, r.col]
        assert np.isnan(r.value) if not r.n else np.isclose(r.value, total[r.row, r.col] / r.n)
    one = spark.createDataFrame([(0.0,), (1.0,), (9.99,), (10.0,), (10.1,), (-1.0,)], "v double")
    assert [r.b for r in one.select(bin_of(F.col("v"), edges(0, 10, 5)).alias("b")).collect()] == [0, 0, 4, 4, None, None]


def test_nearest(spark):
    rng = np.random.default_rng(4)
    pts = [(i, float(a), float(b), float(i * 10)) for i, (a, b) in enumerate(rng.random((50, 2)))] + [(-1, 0.5, 0.5, -1.0), (-2, 0.5, 0.5, -2.0)]
    df = spark.createDataFrame(pts, "id long, x double, y double, v double")
    nodes = [(r, c, r / 4, c / 4) for r in range(5) for c in range(5)]
    got = {(r.row, r.col): r.id for r in nearest(df, "id", "x", "y", "v", nodes).collect()}
    assert got == {(r, c): min(((a - x) ** 2 + (b - y) ** 2, i) for i, a, b, _ in pts)[1] for r, c, x, y in nodes}
    with pytest.raises(NotImplementedError):
        interpolate(df, "x", "y", "v", nodes, "cubic")
    r, c = rotated(F.col("x"), F.col("y"))
    row = df.limit(1).select("x", "y", r.alias("r"), c.alias("c")).first()
    assert (row.r, row.c) == (-row.y, row.x)


def test_arrivals(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "pos_idx long, spectrum array<double>"
    e = F.array_max("spectrum")
    for lo, hi in ((0, 4), (4, 15)):
        spark.createDataFrame([(i, DATA[i].tolist()) for i in range(lo, hi)], schema).write.mode("append").parquet(src)
        compute_arrivals(arrivals(spark, src, schema), e, out, ck).awaitTermination()
        got = {r.pos_idx: r.result for r in spark.read.parquet(f"{out}/results").collect()}
        assert got == {i: DATA[i].max() for i in range(hi)}
        assert spark.read.parquet(f"{out}/status").count() == hi


def test_windowed_means(spark):
    rows = [("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:09:59", "a", 3.0), ("2024-01-01 00:10:00", "a", 9.0)]
    df = spark.createDataFrame(rows, "t string, k string, v double").withColumn("t", F.to_timestamp("t"))
    got = sorted((r.value, r.n) for r in windowed_means(df, "t", "v", ["k"]).collect())
    assert got == [(2.0, 2), (9.0, 1)]
