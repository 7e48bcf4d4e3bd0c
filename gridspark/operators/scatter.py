"""Rasters from scattered points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rotated(x: Column, y: Column) -> tuple[Column, Column]:
    """(row, column) of a point in image orientation."""
    return -y, x


def edges(lo: float, hi: float, bins: int) -> list[float]:
    """bins + 1 equal steps from lo to hi, both exact."""
    if bins < 1:
        raise ValueError("at least one bin")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins
    return [lo + k * step for k in range(bins)] + [hi]


def bin_of(v: Column, at: list[float]) -> Column:
    """The bin of a value by search among the edges: bins are open to the right, the last one is closed. Null outside."""
    found = F.size(F.filter(F.array(*map(F.lit, at)), lambda e: e <= v)) - 1
    inside = (v >= at[0]) & (v <= at[-1])
    return F.when(inside, F.least(found, F.lit(len(at) - 2)))


def histogram(points: DataFrame, x: str, y: str, value: str, shape: tuple[int, int], bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(row, col, n, value): the mean of the points in each bin; every bin has a row, empty ones NaN.

    Points combine map-side into at most shape[0] x shape[1] rows a task; bounds cost one more pass if not given."""
    if bounds is None:
        bounds = tuple(points.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first())
    x0, x1, y0, y1 = map(float, bounds)
    rows, cols = shape
    binned = points.select(bin_of(F.col(x).cast("double"), edges(x0, x1, rows)).alias("row"), bin_of(F.col(y).cast("double"), edges(y0, y1, cols)).alias("col"), F.col(value).cast("double").alias("v"))
    means = binned.where("row is not null and col is not null").groupBy("row", "col").agg(F.count("*").alias("n"), F.avg("v").alias("value"))
    every = points.sparkSession.range(rows * cols).select((F.floor(F.col("id") / cols)).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    # The binned side has a row per bin at most.
    out = every.join(means, ["row", "col"], "left")
    return out.select("row", "col", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("value", F.lit(float("nan"))).alias("value"))


def nearest(points: DataFrame, id: str, x: str, y: str, value: str, nodes: list[tuple[int, int, float, float]]) -> DataFrame:
    """(row, col, id, value) of the point nearest to each node (row, col, x, y); ties go to the smaller id.

    Each point is compared with the nodes of the raster, which the call lists, so their number does not grow with the
    data; a task keeps one best point per node."""
    listed = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(float(a)).alias("nx"), F.lit(float(b)).alias("ny")) for r, c, a, b in nodes])
    each = points.select(F.col(id).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(value).alias("value"), F.explode(listed).alias("g"))
    gap = (F.col("x") - F.col("g.nx")) * (F.col("x") - F.col("g.nx")) + (F.col("y") - F.col("g.ny")) * (F.col("y") - F.col("g.ny"))
    far = each.select("g.row", "g.col", gap.alias("d"), "id", "value")
    # Two aggregates of plain numbers, which combine by hash before the shuffle; the least distances are a row per node.
    least = far.groupBy("row", "col").agg(F.min("d").alias("least"))
    tied = far.join(F.broadcast(least), ["row", "col"]).where("d = least")
    return tied.groupBy("row", "col").agg(F.min("id").alias("__id"), F.min_by("value", "id").alias("value")).select("row", "col", F.col("__id").alias("id"), "value")


def interpolate(points: DataFrame, x: str, y: str, value: str, nodes, method: str):
    """linear and cubic interpolation need a triangulation that neither Spark nor numpy offers."""
    if method == "nearest":
        raise ValueError("use nearest()")
    raise NotImplementedError(f"{method} interpolation of scattered points needs scipy, which this library does not require")
