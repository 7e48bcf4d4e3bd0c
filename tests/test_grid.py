import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions.reductions import NAMES
from gridspark.operators.grid import Grid, reduce_cells, unfold
from gridspark.plans.dimension import Dimension
from gridspark.sources.export import dense, to_csv
from gridspark.sources.ingest import from_array, from_nd_array

X, Y = Dimension("X", "nm", [-750 + 50 * k for k in range(5)]), Dimension("Y", "um", [2 + 1.25 * k for k in range(3)])
BIAS, CYCLE = Dimension("Bias", "V", [2.5 * np.sin(np.pi * k / 7) for k in range(7)]), Dimension("Cycle", "", 2)
#: Axes Y, X, Cycle, Bias.
ND = np.random.default_rng(1).random((3, 5, 2, 7))


@pytest.fixture(scope="module")
def grid(spark):
    return from_array(spark, ND.reshape(15, 14), [X, Y], [BIAS, CYCLE], quantity="Current", units="A")


def nd(cells, names):
    found = {"X": X, "Y": Y, "Bias": BIAS, "Cycle": CYCLE}
    return dense(cells, [found[n] for n in names])


def test_description(grid):
    assert grid.shape == (15, 14) and grid.labels == ["X", "Y", "Bias", "Cycle"]
    assert grid.toggle_sorting().labels == ["Y", "X", "Cycle", "Bias"]
    assert "15 x 14, Current (A)" in repr(grid)
    assert grid.values("X")[1] == -700
    grid.check()
    with pytest.raises(ValueError):
        Grid(grid.main.limit(3), grid.pos_dims, grid.spec_dims).check()
    with pytest.raises(KeyError):
        grid.dim("Z")


def test_fold_and_unfold(grid):
    cells = grid.coords()
    assert np.array_equal(nd(cells, ["Y", "X", "Cycle", "Bias"]), ND)
    back = unfold(cells.drop("pos_idx", "spec_idx").repartition(5), grid.pos_dims, grid.spec_dims)
    assert np.array_equal(np.array([r.spectrum for r in back.orderBy("pos_idx").collect()]), ND.reshape(15, 14))
    flipped = unfold(cells, grid.pos_dims[::-1], grid.spec_dims[::-1])
    want = ND.transpose(1, 0, 3, 2).reshape(15, 14)
    assert np.array_equal(np.array([r.spectrum for r in flipped.orderBy("pos_idx").collect()]), want)


@pytest.mark.parametrize(
    "selectors, index",
    [
        ({"X": 3}, np.s_[:, 3, :, :]),
        ({"X": slice(1, 5, 2), "Bias": slice(None, 3)}, np.s_[:, 1:5:2, :, :3]),
        ({"Y": -1, "Cycle": 1}, np.s_[-1, :, 1, :]),
        ({"X": -2, "Y": 0, "Bias": 6, "Cycle": 0}, np.s_[0, -2, 0, 6]),
    ],
)
def test_grid_slices(grid, selectors, index):
    got = grid.slice(selectors)
    want = ND[index]
    ints = [k for k, v in selectors.items() if isinstance(v, int)]
    assert not {f"{k}_ind" for k in ints} & set(got.columns)
    assert sorted(r.value for r in got.collect()) == sorted(np.ravel(want))


def test_list_order_and_repeats(grid):
    got = grid.slice({"X": [4, 1, 4]}).orderBy("X_ord", "Y_ind", "Cycle_ind", "Bias_ind").collect()
    assert [r.value for r in got] == list(ND[:, [4, 1, 4]].transpose(1, 0, 2, 3).ravel())


def test_two_dimensional_slices(grid):
    assert sorted(r.pos_idx for r in grid.position_ids({"X": 3}).collect()) == [3, 8, 13]
    assert grid.spectral_ids({"Cycle": 1, "Bias": [5, 0, 0]}) == [7, 12]
    got = grid.slice({"X": [4, 1, 1], "Cycle": 1}, grid=False)
    assert sorted(r.value for r in got.collect()) == sorted(ND[:, [1, 4], 1].ravel())
    with pytest.raises(ValueError):
        grid.slice({"X": -1}, grid=False)
    for flag in (True, False):
        with pytest.raises(IndexError):
            grid.slice({"X": 5}, grid=flag)
        with pytest.raises(KeyError):
            grid.slice({"Q": 1}, grid=flag)
        with pytest.raises(TypeError):
            grid.slice({"X": "fd"}, grid=flag)
        with pytest.raises(TypeError):
            grid.slice({"X": 1.5}, grid=flag)
    assert grid.slice({"X": np.int64(2)}, grid=False).count() == 42


def test_dims_after_and_slice_grid(grid):
    pos, spec = grid.dims_after({"X": [1, 3], "Y": 2, "Bias": 1, "Cycle": 0})
    assert pos == (Dimension("X", "nm", [-700, -600]),) and spec[0].name == "arb."
    g = grid.slice_grid({"X": [3, 1], "Bias": slice(2, 5)})
    g.check()
    assert np.array_equal(dense(g.coords(), [g.dim(n) for n in ("Y", "X", "Cycle", "Bias")]), ND[:, [1, 3], :, 2:5])
    one = grid.slice_grid({"X": 0, "Y": 0})
    one.check()
    assert one.shape == (1, 14)


def test_filters_reach_the_scan(spark, grid, tmp_path):
    grid.main.write.parquet(str(tmp_path / "g"))
    stored = Grid.of(spark.read.parquet(str(tmp_path / "g")), grid.pos_dims, grid.spec_dims)
    plan = stored.slice({"X": 3, "Bias": 2})._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(X_ind), EqualTo(X_ind,3)]" in plan
    assert "Exchange" not in plan
    assert "Exchange" not in stored.reduce(["Bias", "Cycle"], "mean")._jdf.queryExecution().executedPlan().toString()


NUMPY = {n: getattr(np, n) for n in NAMES if n != "moment"}


@pytest.mark.parametrize("how", sorted(NUMPY))
def test_reductions(spark, how):
    data = ND.copy() - 0.4
    data[0, 0, 0, 0] = data[1, 2, 1, 3] = np.nan
    data[2, :, :, :] = np.nan
    data[1, 1, :, :] = 0
    g = from_array(spark, data.reshape(15, 14), [X, Y], [BIAS, CYCLE])
    with np.errstate(all="ignore"):
        for dims, axes, left in ((["X", "Bias"], (1, 3), ["Y", "Cycle"]), (["Bias", "Cycle"], (2, 3), ["Y", "X"])):
            got = nd(g.reduce(dims, how).withColumn("value", F.col("value").cast("double")), left)
            want = NUMPY[how](data, axis=axes).astype(float)
            assert np.allclose(got, want, equal_nan=True), (dims, got, want)


@pytest.mark.parametrize("how", ["prod", "nanprod"])
def test_products_beyond_doubles_on_the_way(spark, how):
    """The same by arrays and by cells, whatever the order."""
    steps = Dimension("Step", "", 3)
    data = np.array([[1e200, -1e200, 0.0], [1e200, -1e200, 1e-200], [-1e-200, 1e-200, 1e300], [1e200, -1e200, 2.0], [2.0, 3.0, 5.0], [np.inf, 0.0, 1.0]])
    want = np.array([0.0, -1e200, -1e-100, -np.inf, 30.0, np.nan])
    g = from_array(spark, data, [Dimension("X", "nm", 6)], [steps])
    for cells in (g.reduce(["Step"], how), reduce_cells(g.coords(), ["X_ind"], "value", how)):
        assert np.allclose([r.value for r in cells.orderBy("X_ind").collect()], want, rtol=1e-12, atol=0, equal_nan=True)


def test_reductions_refuse(grid):
    with pytest.raises(NotImplementedError):
        grid.reduce("X", "median")
    with pytest.raises(KeyError):
        grid.reduce("Z")
    with pytest.raises(ValueError):
        grid.reduce("X", "moment")


def test_moment_and_scalar(grid):
    got = nd(grid.reduce(["X", "Bias"], "moment", 3), ["Y", "Cycle"])
    assert np.allclose(got, ((ND - ND.mean(axis=(1, 3), keepdims=True)) ** 3).mean(axis=(1, 3)))
    (r,) = grid.reduce(["X", "Y", "Bias", "Cycle"], "moment", 2).collect()
    assert np.isclose(r.value, ND.var())
    assert np.isclose(grid.reduce(["X", "Y", "Bias", "Cycle"], "sum").first().value, ND.sum())


def test_reduce_grid(grid):
    g = grid.reduce_grid(["X", "Cycle"], "mean")
    g.check()
    assert np.allclose(dense(g.coords(), [Y, BIAS]), ND.mean(axis=(1, 2)))
    g = grid.reduce_grid(["Bias", "Cycle"], "max")
    assert g.spec_dims[0].name == "Single_Step"
    assert np.allclose(dense(g.coords(), [Y, X]), ND.max(axis=(2, 3)))
    grid.reduce_grid(["X", "Y", "Bias", "Cycle"], "max").check()


def test_complex_and_compound(spark):
    z = ND.reshape(15, 14) + 1j * ND[::-1].reshape(15, 14)
    g = from_array(spark, z, [X, Y], [BIAS, CYCLE])
    rows = g.plot_frame({"Bias": 0, "Cycle": 0}).collect()
    assert {r.component for r in rows} == {"magnitude", "phase"}
    assert np.allclose(sorted(r.value for r in rows if r.component == "magnitude"), sorted(np.abs(z[:, 0])))
    rgb = np.zeros((15, 14), [("r", "f4"), ("g", "f2"), ("b", "f8")])
    rgb["r"], rgb["b"] = 1.5, ND.reshape(15, 14)
    g = from_array(spark, rgb, [X, Y], [BIAS, CYCLE])
    assert dict(g.main.dtypes)["spectrum"] == "array<struct<r:float,g:float,b:double>>"
    flat = g.slice({"X": 1, "Y": 1, "Cycle": 0}, as_scalar=True, fields=["r", "b"])
    assert flat.count() == 14 and {r.component for r in flat.collect()} == {"r", "b"}
    with pytest.raises(NotImplementedError):
        g.plot_frame({"X": 1})


def test_nd_arrays(spark):
    x = Dimension("x", "", 2, dim_type="spatial")
    y = Dimension("y", "", 3, dim_type="Spatial")
    t = Dimension("t", "", 4, dim_type="temporal")
    a = np.arange(24.0).reshape(3, 4, 2)
    g = from_nd_array(spark, a, [y, t, x])
    assert [d.name for d in g.pos_dims] == ["y", "x"] and [d.name for d in g.spec_dims] == ["t"]
    assert np.array_equal(dense(g.coords(), [y, t, x]), a)


def test_array_types(spark):
    dims = ([Dimension("p", "", 2)], [Dimension("s", "", 3)])
    for dtype, want in (("u1", "smallint"), ("u2", "int"), ("u4", "bigint"), ("u8", "decimal(20,0)"), ("f2", "float"), ("f4", "float"), ("i8", "bigint"), ("c16", "struct<re:double,im:double>")):
        g = from_array(spark, np.ones((2, 3), dtype), *dims)
        assert dict(g.main.dtypes)["spectrum"] == f"array<{want}>", dtype
        assert g.coords().count() == 6
    with pytest.raises(ValueError):
        from_array(spark, np.ones((3, 3)), *dims)


@pytest.mark.parametrize("pos, spec", itertools.product([1, 2], [1, 2]))
def test_one_sided_shapes(spark, pos, spec):
    p = [Dimension(f"p{k}", "", 2 + k) for k in range(pos)]
    s = [Dimension(f"s{k}", "", 3 + k) for k in range(spec)]
    a = np.random.default_rng(pos + 2 * spec).random((int(np.prod([len(d) for d in p])), int(np.prod([len(d) for d in s]))))
    g = from_array(spark, a, p, s)
    want = a.reshape([len(d) for d in (*reversed(p), *reversed(s))])
    assert np.array_equal(dense(g.coords(), (*reversed(p), *reversed(s))), want)


def test_csv(grid, tmp_path):
    out = str(tmp_path / "csv")
    to_csv(grid, out)
    (part,) = (tmp_path / "csv").glob("part-*")
    lines = part.read_text().splitlines()
    assert len(lines) == 3 + 15 and lines[0].split(",")[:2] == ["", "Bias (V)"] and lines[2].startswith("X (nm),Y (um),---")
    assert np.allclose(np.array([x.split(",") for x in lines[3:]], float)[:, 2:], ND.reshape(15, 14))
    with pytest.raises(FileExistsError):
        to_csv(grid, out)
    to_csv(grid, out, force=True)
