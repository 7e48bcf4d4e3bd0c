"""Dimensions and the arithmetic of their indices. Nothing here touches data; it describes what plans are built from."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from enum import IntEnum
from math import isclose, prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class DimMode(IntEnum):
    """DEFAULT: a full grid axis; INCOMPLETE: sparse, spiral or aborted; DEPENDENT: varies with another dimension."""

    DEFAULT = 0
    INCOMPLETE = 1
    DEPENDENT = 2


@dataclass(frozen=True, eq=False)
class Dimension:
    """A named axis with a value per step. `values` may be a number of steps, which stands for 0, 1, 2, ..."""

    name: str
    units: str
    values: Sequence[float] | int
    quantity: str = "generic"
    dim_type: str = "unknown"
    mode: DimMode = DimMode.DEFAULT
    steps: tuple[float, ...] = field(init=False)

    def __post_init__(self):
        for what in ("name", "units", "quantity", "dim_type"):
            text = getattr(self, what)
            if not isinstance(text, str):
                raise TypeError(f"{what} must be a string, not {type(text).__name__}")
            object.__setattr__(self, what, text.strip())
        if not self.name:
            raise ValueError("a dimension needs a name")
        if not isinstance(self.mode, DimMode):
            raise TypeError("mode must be a DimMode")
        if isinstance(self.values, int):
            if self.values < 1:
                raise ValueError("a dimension has at least one step")
            steps = tuple(float(x) for x in range(self.values))
        else:
            steps = tuple(float(x) for x in self.values)
            if not steps:
                raise ValueError("a dimension has at least one step")
        object.__setattr__(self, "steps", steps)

    def __len__(self) -> int:
        return len(self.steps)

    def __eq__(self, other) -> bool:
        """Equal name, quantity, units, mode and close values; the type of the dimension does not count."""
        if not isinstance(other, Dimension):
            raise TypeError(f"a Dimension cannot equal a {type(other).__name__}")
        same = (self.name, self.quantity, self.units, self.mode, len(self)) == (other.name, other.quantity, other.units, other.mode, len(other))
        return same and all(close(a, b) for a, b in zip(self.steps, other.steps, strict=True))

    __hash__ = None

    @property
    def label(self) -> str:
        return f"{self.name} ({self.units})"


def close(a: float, b: float) -> bool:
    """Within 1e-8 plus 1e-5 of b."""
    return isclose(a, b, rel_tol=0, abs_tol=1e-8 + 1e-5 * abs(b)) if a == a and b == b else False


def validate_dimensions(dims, kind: str = "Position") -> list[Dimension]:
    found = [dims] if isinstance(dims, Dimension) else list(dims)
    if not found or not all(isinstance(d, Dimension) for d in found):
        raise TypeError(f"{kind} dimensions must be one or more Dimension objects")
    if len({d.name for d in found}) < len(found):
        raise ValueError(f"{kind} dimensions need different names")
    return found


def strides(sizes: Sequence[int]) -> list[int]:
    """Steps after which each index moves on, the first dimension being the fastest."""
    out, run = [], 1
    for n in sizes:
        out.append(run)
        run *= n
    return out


def check_sizes(sizes: Sequence[int]) -> list[int]:
    found = [int(n) for n in sizes]
    if not found or any(n < 1 for n in found):
        raise ValueError("sizes must be positive")
    if len(found) > 1 and 1 in found:
        raise ValueError("a dimension of one step stands alone or not at all")
    return found


def index_columns(step: Column, dims: Sequence[Dimension]) -> dict[str, Column]:
    """`<dim>_ind` of each dimension at a step of the full grid, as arithmetic that needs no join."""
    found = {}
    for d, stride in zip(dims, strides([len(d) for d in dims]), strict=True):
        found[f"{d.name}_ind"] = ((F.call_function("div", step, F.lit(stride)) if stride > 1 else step) % len(d)).cast("int")
    return found


def value_column(index: Column, dim: Dimension) -> Column:
    """The dimension's value (single precision) at an index."""
    steps = dim.steps
    first, gap = float(steps[0]), float(steps[1]) - float(steps[0]) if len(steps) > 1 else 0.0
    # Even steps are arithmetic, to the last bit, so that a plan does not hold them.
    if all(first + k * gap == x for k, x in enumerate(steps)):
        return (F.lit(first) + index.cast("double") * F.lit(gap)).cast("float")
    return F.element_at(F.array(*[F.lit(x) for x in steps]), index + 1).cast("float")


def indices_matrix(spark: SparkSession, sizes: Sequence[int], step: str = "step") -> DataFrame:
    """One row per cell of the grid: step, d0, d1, ...; d0 is the fastest."""
    sizes = check_sizes(sizes)
    k = F.col("id")
    columns = [((F.call_function("div", k, F.lit(s)) if s > 1 else k) % n).cast("long").alias(f"d{i}") for i, (s, n) in enumerate(zip(strides(sizes), sizes, strict=True))]
    return spark.range(prod(sizes)).select(k.alias(step), *columns)


def dim_table(spark: SparkSession, dims: Sequence[Dimension], step: str = "step") -> DataFrame:
    """Index and value of each dimension at each step: a full grid for DEFAULT dimensions (first fastest), side by side
    for INCOMPLETE ones, which need equal lengths. Modes do not mix, and DEPENDENT ones cannot be written."""
    dims = validate_dimensions(dims)
    modes = {d.mode for d in dims}
    if len(modes) > 1 or DimMode.DEPENDENT in modes:
        raise NotImplementedError("only dimensions that are all complete or all incomplete can be written")
    if DimMode.INCOMPLETE in modes:
        if len({len(d) for d in dims}) > 1:
            raise ValueError("incomplete dimensions need equal numbers of values")
        rows = F.arrays_zip(*[F.array(*[F.lit(x) for x in d.steps]).alias(d.name) for d in dims])
        one = spark.range(1).select(F.posexplode(rows).alias("k", "x"))
        pairs = [c for d in dims for c in (F.col("k").alias(f"{d.name}_ind"), F.col("x")[d.name].cast("float").alias(f"{d.name}_val"))]
        return one.select(F.col("k").cast("long").alias(step), *pairs)
    base = spark.range(prod(len(d) for d in dims)).withColumnRenamed("id", step)
    indexed = base.select(step, *[v.alias(k) for k, v in index_columns(F.col(step), dims).items()])
    pairs = [c for d in dims for c in (F.col(f"{d.name}_ind"), value_column(F.col(f"{d.name}_ind"), d).alias(f"{d.name}_val"))]
    return indexed.select(step, *pairs)


def row_slices(names: Sequence[str], last: int | None = None) -> dict[str, tuple[str, int | None]]:
    """For each dimension its index column and the step it ends at (None: all): what a saved hyperslab needs."""
    if isinstance(names, str) or not all(isinstance(n, str) for n in names):
        raise TypeError("names of dimensions are strings")
    return {n: (f"{n}_ind", last) for n in names}


def chunk_shape(shape: Sequence[int], item_bytes: int, unit: Sequence[int] | None = None, limit: int = 10_240) -> tuple[int, ...]:
    """A storage chunk of about `limit` bytes: units are added along the axis covered least (the last such axis of
    equals gives way to the first), until the chunk passes the limit."""
    shape = tuple(int(n) for n in shape)
    unit = tuple(int(n) for n in unit) if unit is not None else (1,) * len(shape)
    if len(unit) != len(shape) or any(n < 1 for n in (*shape, *unit)) or item_bytes < 1:
        raise ValueError("shape, unit and item size must be positive and fit each other")
    chunk = tuple(min(u, n) for u, n in zip(unit, shape, strict=True))
    while True:
        open_ = [k for k in range(len(shape)) if chunk[k] < shape[k]]
        if prod(chunk) * item_bytes > limit or not open_:
            return chunk
        k = max(open_, key=lambda i: shape[i] / chunk[i])
        chunk = tuple(min(shape[i], n + unit[i]) if i == k else n for i, n in enumerate(chunk))
