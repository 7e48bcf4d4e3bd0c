import pytest

from gridspark.plans.dimension import Dimension, DimMode, check_sizes, chunk_shape, close, dim_table, indices_matrix, row_slices, validate_dimensions


def test_dimension():
    d = Dimension(" Bias ", "V", 3)
    assert (d.name, d.steps, len(d), d.label) == ("Bias", (0.0, 1.0, 2.0), 3, "Bias (V)")
    assert d == Dimension("Bias", "V", [0, 1, 2 + 1e-9], dim_type="other")
    assert not d == Dimension("Bias", "V", [0, 1, 2.1])
    assert not d == Dimension("Bias", "V", 3, mode=DimMode.DEPENDENT)
    with pytest.raises(TypeError):
        d == 5  # noqa: B015
    for bad in (0, -1, []):
        with pytest.raises(ValueError):
            Dimension("x", "", bad)
    with pytest.raises(TypeError):
        Dimension(5, "", 2)
    assert DimMode.DEFAULT < DimMode.INCOMPLETE < DimMode.DEPENDENT
    assert not close(float("nan"), 1.0)


def test_validate():
    d = Dimension("x", "", 2)
    assert validate_dimensions(d) == [d]
    with pytest.raises(TypeError):
        validate_dimensions([d, 5])
    with pytest.raises(ValueError):
        validate_dimensions([d, d])
    with pytest.raises(ValueError):
        check_sizes([3, 1])
    assert check_sizes([1]) == [1]


@pytest.mark.parametrize(
    "args, want",
    [(((16384, 65536), 4), (26, 100)), (((16384, 65536), 4, (3, 7)), (27, 98)), (((16384, 65536), 4, None, 50000), (56, 224)), (((16384, 65536), 4, (3, 7), 50000), (57, 224))],
)
def test_chunk_shape(args, want):
    assert chunk_shape(*args) == want


def test_chunk_shape_stops_at_the_shape():
    assert chunk_shape((2, 3), 1) == (2, 3)
    with pytest.raises(ValueError):
        chunk_shape((2, 3), 1, (1,))


def test_indices(spark):
    rows = [tuple(r) for r in indices_matrix(spark, [2, 3, 4]).orderBy("step").collect()]
    assert rows == [(k, k % 2, k // 2 % 3, k // 6) for k in range(24)]
    assert [tuple(r) for r in indices_matrix(spark, [1]).collect()] == [(0, 0)]


def test_dim_tables(spark):
    full = dim_table(spark, [Dimension("a", "", [5, 7]), Dimension("b", "", [1.5, 2.5, 3.5])]).orderBy("step").collect()
    assert [(r.a_ind, r.a_val, r.b_ind, r.b_val) for r in full] == [(k % 2, [5, 7][k % 2], k // 2, [1.5, 2.5, 3.5][k // 2]) for k in range(6)]
    sparse = dim_table(spark, [Dimension(n, "", v, mode=DimMode.INCOMPLETE) for n, v in (("a", [5, 7, 9]), ("b", [1, 2, 3]), ("c", [0, 0, 4]))]).collect()
    assert [(r.a_ind, r.a_val, r.b_ind, r.c_ind, r.c_val) for r in sparse] == [(0, 5, 0, 0, 0), (1, 7, 1, 1, 0), (2, 9, 2, 2, 4)]
    with pytest.raises(ValueError):
        dim_table(spark, [Dimension("a", "", 2, mode=DimMode.INCOMPLETE), Dimension("b", "", 3, mode=DimMode.INCOMPLETE)])
    for modes in ((DimMode.DEFAULT, DimMode.INCOMPLETE), (DimMode.DEPENDENT, DimMode.DEPENDENT)):
        with pytest.raises(NotImplementedError):
            dim_table(spark, [Dimension(n, "", 2, mode=m) for n, m in zip("ab", modes)])
    assert row_slices(["X"], 4) == {"X": ("X_ind", 4)}
    with pytest.raises(TypeError):
        row_slices("X")
