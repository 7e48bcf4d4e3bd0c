"""What index and value tables tell about their dimensions.

All of this works on dimension tables (a row per position or per spectroscopic step, not per cell). Windows over a whole
table run in one task: for position tables of a full grid, take the catalog's sizes instead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dimensionality(table: DataFrame, dims: list[str], order: list[int] | None = None) -> list[int]:
    """Distinct indices of each dimension, in the given order of dimensions."""
    if order is not None and sorted(order) != list(range(len(dims))):
        raise ValueError(f"{order} is no order of {len(dims)} dimensions")
    row = table.agg(*[F.count_distinct(f"{d}_ind").alias(d) for d in dims]).first()
    return [row[dims[k]] for k in (order if order is not None else range(len(dims)))]


def change_counts(table: DataFrame, columns: list[str], step: str = "step") -> DataFrame:
    """(dim, changes): how often each column differs from the row before; the first row follows the last."""
    w = Window.orderBy(step)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    differs = [(~F.col(c).eqNullSafe(F.coalesce(F.lag(c).over(w), F.last(c).over(whole)))).cast("long").alias(c) for c in columns]
    sums = table.select(*differs).agg(*[F.sum(c).alias(c) for c in columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).alias("changes")) for c in columns])).alias("x")).select("x.*")


def sort_order(table: DataFrame, dims: list[str], step: str = "step") -> list[int]:
    """Positions of the dimensions from the fastest to the slowest; of equals the later one comes first."""
    found = {r["dim"]: r["changes"] for r in change_counts(table, [f"{d}_ind" for d in dims], step).collect()}
    return sorted(range(len(dims)), key=lambda k: (-found[f"{dims[k]}_ind"], -k))


def unit_values(table: DataFrame, dims: list[str], wanted: list[str] | None = None, step: str = "step", incomplete: list[str] = ()) -> dict[str, list[float]]:
    """The value at each index of each dimension. Every dimension must repeat one tile, begun at its least index, a
    whole number of times; ValueError otherwise, and for dimensions that are marked incomplete."""
    unknown = set(wanted or ()) - set(dims)
    if unknown:
        raise KeyError(f"unknown dimensions {sorted(unknown)}")
    wanted = list(wanted or dims)
    if marked := sorted(set(wanted) & set(incomplete)):
        raise ValueError(f"{marked} are incomplete")
    w = Window.orderBy(step)
    found = {}
    for d in [x for x in dims if x not in incomplete]:
        ind = f"{d}_ind"
        rows = table.select((F.row_number().over(w) - 1).alias("t"), F.col(ind).alias("i"), F.col(f"{d}_val").alias("v"))
        rows = rows.withColumn("least", F.min("i").over(Window.partitionBy(F.lit(0))))
        rows = rows.withColumn("begin", (F.col("i") == F.col("least")) & ~F.lag("i", 1).over(Window.orderBy("t")).eqNullSafe(F.col("i")))
        n, first, period = rows.agg(F.count("*"), F.min_by(F.col("i") == F.col("least"), "t"), F.min(F.when(F.col("begin") & (F.col("t") > 0), F.col("t")))).first()
        if not first:
            raise ValueError(f"{d} does not begin at its least index")
        period = period or n
        tile = rows.where(F.col("t") < period).select(F.col("t").alias("k"), F.col("i").alias("j"))
        odd = rows.withColumn("k", F.col("t") % period).join(tile, "k").where("i <> j")
        if n % period or not odd.isEmpty():
            raise ValueError(f"{d} does not repeat one pattern")
        if d in wanted:
            found[d] = [r["v"] for r in rows.groupBy("i").agg(F.min_by("v", "t").alias("v")).orderBy("i").collect()]
    return found


def odometer(table: DataFrame, values: list[str], step: str = "step") -> DataFrame:
    """step and, for each value column, the index that counts its changes: at each step the slowest column that changed
    moves on by one and all faster ones start again. Columns are ordered by their own change counts."""
    counts = {r["dim"]: r["changes"] for r in change_counts(table, values, step).collect()}
    fast_first = sorted(values, key=lambda c: (-counts[c], -values.index(c)))
    w = Window.orderBy(step)
    moved = table.select(step, *[F.coalesce(F.col(c) != F.lag(c).over(w), F.lit(False)).alias(c) for c in values])
    out = moved
    for k, c in enumerate(fast_first):
        slower = [F.col(s) for s in fast_first[k + 1 :]]
        reset = slower[0] if slower else F.lit(False)
        for s in slower[1:]:
            reset = reset | s
        out = out.withColumn(f"__r{k}", F.sum(reset.cast("long")).over(w)).withColumn(f"__m{k}", (F.col(c) & ~reset).cast("long"))
    for k in range(len(fast_first)):
        out = out.withColumn(f"__i{k}", F.sum(f"__m{k}").over(Window.partitionBy(f"__r{k}").orderBy(step)))
    return out.select(step, *[F.col(f"__i{fast_first.index(c)}").alias(c) for c in values])


def without_dims(table: DataFrame, dims: list[str], drop: list[str], step: str = "step") -> DataFrame:
    """The dimension table once some dimensions are gone: rows at the least index of each, numbered anew. With none left,
    one row Single_Step of index and value 0."""
    if unknown := set(drop) - set(dims):
        raise KeyError(f"unknown dimensions {sorted(unknown)}")
    left = [d for d in dims if d not in drop]
    if not left:
        return table.sparkSession.range(1).select(F.col("id").alias(step), F.lit(0).alias("Single_Step_ind"), F.lit(0.0).cast("float").alias("Single_Step_val"))
    least = table.agg(*[F.min(f"{d}_ind").alias(f"__{d}") for d in drop])
    rows = table.join(F.broadcast(least)) if drop else table
    for d in drop:
        rows = rows.where(F.col(f"{d}_ind") == F.col(f"__{d}"))
    again = (F.row_number().over(Window.orderBy(step)) - 1).cast("long")
    return rows.select(again.alias(step), *[c for d in left for c in (f"{d}_ind", f"{d}_val")])
