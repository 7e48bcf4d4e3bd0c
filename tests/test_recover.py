import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators.recover import change_counts, dimensionality, odometer, sort_order, unit_values, without_dims
from gridspark.plans.dimension import Dimension, dim_table


def as_table(spark, **columns):
    n = len(next(iter(columns.values())))
    names = list(columns)
    return spark.createDataFrame([(k, *[float(columns[c][k]) if c.endswith("_val") else int(columns[c][k]) for c in names]) for k in range(n)], "step long, " + ", ".join(f"{c} {'double' if c.endswith('_val') else 'int'}" for c in names))


def test_sizes_and_order(spark):
    t = dim_table(spark, [Dimension("Bias", "V", 7), Dimension("Cycle", "", 2)])
    assert dimensionality(t, ["Bias", "Cycle"]) == [7, 2]
    assert dimensionality(t, ["Bias", "Cycle"], [1, 0]) == [2, 7]
    with pytest.raises(ValueError):
        dimensionality(t, ["Bias", "Cycle"], [0, 0])
    assert sort_order(t, ["Bias", "Cycle"]) == [0, 1] and sort_order(t, ["Cycle", "Bias"]) == [1, 0]
    assert {r.dim: r.changes for r in change_counts(t, ["Bias_ind", "Cycle_ind"]).collect()} == {"Bias_ind": 14, "Cycle_ind": 2}
    both = as_table(spark, a_ind=range(3), b_ind=range(3))
    assert sort_order(both, ["a", "b"]) == [1, 0]


def test_unit_values(spark):
    t = dim_table(spark, [Dimension("X", "", [-750, -700, -650]), Dimension("Y", "", [2, 3.25])])
    assert unit_values(t, ["X", "Y"]) == {"X": [-750, -700, -650], "Y": [2, 3.25]}
    assert unit_values(t, ["X", "Y"], ["Y"]) == {"Y": [2, 3.25]}
    with pytest.raises(KeyError):
        unit_values(t, ["X", "Y"], ["Z"])
    # A slice need not start at 0.
    shifted = t.withColumn("X_ind", F.col("X_ind") + 4)
    assert unit_values(shifted, ["X"], ["X"])["X"] == [-750, -700, -650]


def test_unit_values_of_a_sparse_scan(spark):
    t = as_table(spark, X_ind=range(8), X_val=[50, 0, 300, 100, 50, 200, 0, 150], Y_ind=range(8), Y_val=range(8))
    assert unit_values(t, ["X", "Y"])["X"] == [50, 0, 300, 100, 50, 200, 0, 150]
    with pytest.raises(ValueError):
        unit_values(t, ["X", "Y"], incomplete=["X", "Y"])


def test_unit_values_of_an_aborted_scan(spark):
    n = 4 * 7 + 3
    t = as_table(spark, X_ind=[k % 7 for k in range(n)], X_val=[k % 7 for k in range(n)], Y_ind=[k // 7 for k in range(n)], Y_val=[k // 7 for k in range(n)])
    for wanted in (["X"], ["Y"], None):
        with pytest.raises(ValueError):
            unit_values(t, ["X", "Y"], wanted)


def test_unit_values_of_a_dependent_dimension(spark):
    f, r, d = np.meshgrid(range(3), range(5), range(7), indexing="ij")
    f, r, d = (a.transpose(2, 1, 0).ravel() for a in (f, r, d))
    field = (r != 0).astype(int)
    t = as_table(spark, Frequency_ind=f, Frequency_val=f, Repeats_ind=r, Repeats_val=r, Field_ind=field, Field_val=1 - field, DC_ind=d, DC_val=d)
    assert unit_values(t, ["Frequency", "Repeats", "Field", "DC"], ["Field"]) == {"Field": [1.0, 0.0]}


def test_first_index_must_be_least(spark):
    t = as_table(spark, X_ind=[1, 0, 1, 0], X_val=[1, 0, 1, 0])
    with pytest.raises(ValueError):
        unit_values(t, ["X"])


def test_odometer_on_a_wave(spark):
    up = list(range(0, 4)) + list(range(4, -4, -1)) + list(range(-4, 0))
    bias = [v + (0.001 if k > 8 else 0) for k, v in enumerate(up)]
    n = len(bias)
    t = as_table(spark, bias_val=bias * 6, field_val=([0] * n + [1] * n) * 3, cycle_val=sorted(list(range(3)) * 2 * n))
    got = odometer(t, ["bias_val", "field_val", "cycle_val"]).orderBy("step").collect()
    assert [(r.bias_val, r.field_val, r.cycle_val) for r in got] == [(k % n, k // n % 2, k // (2 * n)) for k in range(6 * n)]


def test_reduced_dims(spark):
    t = dim_table(spark, [Dimension("X", "", 5), Dimension("Y", "", [-2, 4, 10]), Dimension("Z", "", 2)])
    got = without_dims(t, ["X", "Y", "Z"], ["X", "Z"]).orderBy("step").collect()
    assert [tuple(r) for r in got] == [(0, 0, -2.0), (1, 1, 4.0), (2, 2, 10.0)]
    assert [tuple(r) for r in without_dims(t, ["X", "Y", "Z"], ["X", "Y", "Z"]).collect()] == [(0, 0, 0.0)]
    later = without_dims(t.where("X_ind > 1"), ["X", "Y", "Z"], ["X"])
    assert later.count() == 6
    with pytest.raises(KeyError):
        without_dims(t, ["X", "Y", "Z"], ["Q"])
