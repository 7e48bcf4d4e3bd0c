"""Text export of a grid, and dense arrays for small results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators.grid import Grid
from gridspark.plans.dimension import strides

#: Bytes of text beyond which an export asks to be forced.
GUARD = 15 << 20


def text_lines(grid: Grid) -> DataFrame:
    """(pos_idx, line): position values, then the spectrum, separated by commas."""
    from gridspark.plans.dimension import value_column

    number = lambda v: F.format_string("%.18e", v.cast("double"))
    pos = [number(value_column(F.col(f"{d.name}_ind"), d)) for d in grid.pos_dims]
    return grid.main.select("pos_idx", F.concat_ws(",", *pos, F.array_join(F.transform("spectrum", number), ",")).alias("line"))


def header_lines(grid: Grid) -> list[str]:
    """Descriptors and values of the spectroscopic dimensions, and a line of dashes."""
    blank = [""] * (len(grid.pos_dims) - 1)
    n = grid.shape[1]
    lines = []
    for d, stride in zip(grid.spec_dims, strides([len(x) for x in grid.spec_dims]), strict=True):
        lines.append(",".join([*blank, d.label, *[f"{d.steps[k // stride % len(d)]:.18e}" for k in range(n)]]))
    lines.append(",".join([d.label for d in grid.pos_dims] + ["-" * 10] * n))
    return lines


def to_csv(grid: Grid, path: str, force: bool = False) -> str:
    """A folder with one text file, rows by position. FileExistsError if it is there and not forced; ValueError above
    the guard if not forced. Lines are sorted in parallel and written by one task, as one file must be."""
    spark = grid.main.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) and not force:
        raise FileExistsError(path)
    n, width = grid.shape
    if n * (width + len(grid.pos_dims)) * 25 > GUARD and not force:
        raise ValueError(f"about {n * width * 25 >> 20} MB of text; force it to write it")
    head = spark.createDataFrame([(k - len(h), x) for h in [header_lines(grid)] for k, x in enumerate(h)], "pos_idx long, line string")
    out = head.union(text_lines(grid)).orderBy("pos_idx")
    out.select("line").coalesce(1).write.mode("overwrite").text(path)
    return path


def dense(cells: DataFrame, dims, value: str = "value") -> np.ndarray:
    """An array of a small coordinate frame, one axis per dimension in the given order. It is collected: for results."""
    shape = tuple(len(d) for d in dims)
    rows = cells.select(*[f"{d.name}_ind" for d in dims], F.col(value).cast("double").alias("v")).toPandas()
    out = np.full(shape, np.nan)
    out[tuple(rows[f"{d.name}_ind"].to_numpy() for d in dims)] = rows["v"].to_numpy()
    return out
