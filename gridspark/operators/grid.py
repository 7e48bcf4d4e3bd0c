"""A gridded dataset: one row per position, its values in an array, its indices in columns of their own.

Columns of `main`: pos_idx, <dimension>_ind of each position dimension, spectrum (an array, one element per
spectroscopic step). Position indices are stored, so that slices reach the scan as filters; spectroscopic indices are
arithmetic on the element's number. Dimensions are listed in file order; the first is the fastest.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.functions.reductions import MOMENT, NAMES, over_array, reduction
from gridspark.plans.dimension import Dimension, DimMode, index_columns, strides, validate_dimensions, value_column

Selector = int | slice | Sequence[int]


def even(picked: Sequence[int]) -> range | None:
    """Ascending indices in even steps, as a range."""
    if isinstance(picked, range):
        return picked if picked.step > 0 else picked[::-1]
    step = picked[1] - picked[0] if len(picked) > 1 else 1
    found = range(picked[0], picked[-1] + 1, step) if picked and step > 0 else None
    return found if found is not None and list(found) == list(picked) else None


def among(index: Column, picked: Sequence[int]) -> Column:
    """Whether an index is one of these: bounds, which a scan can use, wherever they lie in even steps."""
    steps = even(picked)
    if steps is None or not len(steps):
        return index.isin(list(picked))
    if len(steps) == 1:
        return index == steps[0]
    inside = (index >= steps[0]) & (index <= steps[-1])
    return inside if steps.step == 1 else inside & ((index - steps[0]) % steps.step == 0)


def rank_among(index: Column, picked: Sequence[int]) -> Column:
    """The place of an index among ascending ones."""
    steps = even(picked)
    if steps is None or not len(steps):
        return F.array_position(F.array(*map(F.lit, picked)), index) - 1
    return F.call_function("div", index.cast("long") - steps[0], F.lit(steps.step))


@dataclass(frozen=True)
class Grid:
    main: DataFrame
    pos_dims: tuple[Dimension, ...]
    spec_dims: tuple[Dimension, ...]
    quantity: str = "generic"
    units: str = "a. u."
    name: str = "main"
    sorted_dims: bool = False

    @classmethod
    def of(cls, main: DataFrame, pos_dims, spec_dims, **more) -> Grid:
        pos, spec = tuple(validate_dimensions(pos_dims)), tuple(validate_dimensions(spec_dims, "Spectroscopic"))
        if len({d.name for d in pos + spec}) < len(pos + spec):
            raise ValueError("dimensions need different names")
        need = ["pos_idx", "spectrum", *[f"{d.name}_ind" for d in pos]]
        if missing := [k for k in need if k not in main.columns]:
            raise ValueError(f"columns {missing} are missing")
        return cls(main.select("pos_idx", *[f"{d.name}_ind" for d in pos], "spectrum"), pos, spec, **more)

    @classmethod
    def from_wide(cls, df: DataFrame, pos_idx: Column, spectrum: Column, pos_dims, spec_dims, **more) -> Grid:
        """A grid from any table with a row per position, numbered in the full grid with the first dimension fastest.
        Where some of the full grid are missing, mark the dimensions INCOMPLETE."""
        pos = validate_dimensions(pos_dims)
        base = df.select(pos_idx.cast("long").alias("pos_idx"), spectrum.alias("spectrum"))
        return cls.of(base.select("pos_idx", *[v.alias(k) for k, v in index_columns(F.col("pos_idx"), pos).items()], "spectrum"), pos, spec_dims, **more)

    # Description.
    @property
    def dims(self) -> tuple[Dimension, ...]:
        return self.pos_dims + self.spec_dims

    @property
    def shape(self) -> tuple[int, int]:
        return prod(map(len, self.pos_dims)), prod(map(len, self.spec_dims))

    @property
    def labels(self) -> list[str]:
        """Names of all dimensions: file order, or from the slowest to the fastest where sorted."""
        if self.sorted_dims:
            return [d.name for d in (*reversed(self.pos_dims), *reversed(self.spec_dims))]
        return [d.name for d in self.dims]

    def toggle_sorting(self) -> Grid:
        """The other order of dimensions. It only changes the order of columns; no data moves."""
        return replace(self, sorted_dims=not self.sorted_dims)

    def dim(self, name: str) -> Dimension:
        for d in self.dims:
            if d.name == name:
                return d
        raise KeyError(f"no dimension {name!r}; there are {[d.name for d in self.dims]}")

    def is_position(self, name: str) -> bool:
        return any(d.name == name for d in self.pos_dims)

    def values(self, name: str) -> list[float]:
        return list(self.dim(name).steps)

    @property
    def incomplete(self) -> bool:
        """Whether positions of the full grid may be missing, as where a measurement was aborted."""
        return any(d.mode == DimMode.INCOMPLETE for d in self.pos_dims)

    def check(self, positions: int | None = None) -> None:
        """ValueError unless rows and array lengths are what the dimensions say. Incomplete positions may be fewer: as
        many as `positions`, where it is known, each another one of the full grid. One pass over lengths and numbers only."""
        n, p = self.shape
        want = positions if self.incomplete else n
        size, at = F.size("spectrum"), F.col("pos_idx")
        rows, ids, first, last, least, most = self.main.agg(F.count("*"), F.count_distinct(at), F.min(at), F.max(at), F.min(size), F.max(size)).first()
        if ids != rows or (want is not None and rows != want) or (rows and (least != p or most != p)):
            known = "" if want is None or want == n else f", {want} positions of them written"
            raise ValueError(f"{rows} rows of {least} to {most} values, {ids} positions, where dimensions say {n} x {p}{known}")
        if rows and not 0 <= first <= last < n:
            raise ValueError(f"positions {first} to {last}, where dimensions say 0 to {n - 1}")

    def __repr__(self) -> str:
        n, p = self.shape
        lines = [f"{self.name}: {n} x {p}, {self.quantity} ({self.units})"]
        for what, dims in (("positions", self.pos_dims), ("spectroscopic", self.spec_dims)):
            lines += [f"  {what}: " + ", ".join(f"{d.label}: {len(d)}" for d in (reversed(dims) if self.sorted_dims else dims))]
        return "\n".join(lines)

    # Coordinates.
    def coords(self, values: bool = False, spec_ids: list[int] | None = None, pos: Column | None = None) -> DataFrame:
        """One row per cell: pos_idx, spec_idx, <dimension>_ind..., value, and with `values` <dimension>_val.

        Positions are filtered before, and array elements picked before the array is exploded."""
        rows = self.main if pos is None else self.main.where(pos)
        held = ["pos_idx", *[f"{d.name}_ind" for d in self.pos_dims]]
        if spec_ids is None:
            rows = rows.select(*held, F.posexplode("spectrum").alias("spec_idx", "value"))
        else:
            picks = F.array(*map(F.lit, spec_ids)) if spec_ids else F.array().cast("array<int>")
            pairs = F.transform(picks, lambda k: F.struct(k.alias("spec_idx"), F.element_at("spectrum", k + 1).alias("value")))
            rows = rows.select(*held, F.explode(pairs).alias("__x")).select(*held, "__x.spec_idx", "__x.value")
        for k, v in index_columns(F.col("spec_idx"), self.spec_dims).items():
            rows = rows.withColumn(k, v)
        out = rows.select("pos_idx", "spec_idx", *[f"{n}_ind" for n in self.labels], "value")
        if values:
            out = out.select("*", *[value_column(F.col(f"{d.name}_ind"), d).alias(f"{d.name}_val") for d in self.dims])
        return out

    # Slices.
    def _picked(self, name: str, selector: Selector, grid: bool) -> Sequence[int]:
        """The indices that a selector picks, in its order."""
        n = len(self.dim(name))
        if isinstance(selector, slice):
            return range(n)[selector]
        if isinstance(selector, str) or not (hasattr(selector, "__index__") or hasattr(selector, "__iter__")):
            raise TypeError(f"{name}: select by an integer, a slice or a list of integers")
        asked = [selector.__index__()] if hasattr(selector, "__index__") else [x.__index__() for x in selector]
        if not grid and any(k < 0 for k in asked):
            raise ValueError(f"{name}: no negative indices here")
        if any(not -n <= k < n for k in asked):
            raise IndexError(f"{name}: indices go to {n - 1}")
        picked = [k % n for k in asked]
        return picked if grid else sorted(set(picked))

    def selection(self, selectors: dict[str, Selector], grid: bool = True) -> tuple[Column | None, list[int] | None]:
        """(condition on stored position columns, element numbers) of a slice; None where all are taken."""
        where, allowed = None, None
        for name, selector in selectors.items():
            picked = self._picked(name, selector, grid)
            if self.is_position(name):
                this = among(F.col(f"{name}_ind"), picked)
                where = this if where is None else where & this
            else:
                k = [d.name for d in self.spec_dims].index(name)
                stride, size, chosen = strides([len(d) for d in self.spec_dims])[k], len(self.spec_dims[k]), set(picked)
                source = range(self.shape[1]) if allowed is None else allowed
                allowed = [i for i in source if i // stride % size in chosen]
        return where, allowed

    def slice(self, selectors: dict[str, Selector], grid: bool = True, as_scalar: bool = False, fields: list[str] | None = None) -> DataFrame:
        """The cells a slice keeps. With `grid`, an integer drops its dimension, negative indices count from the end, and
        a list keeps its order and repeats in <dimension>_ord; without, lists are sets and negative indices an error.
        `as_scalar` turns compound values into one row per field."""
        where, ids = self.selection(selectors, grid)
        out = self.coords(spec_ids=ids, pos=where)
        spark = self.main.sparkSession
        for name, selector in selectors.items() if grid else ():
            if hasattr(selector, "__index__"):
                out = out.drop(f"{name}_ind")
            elif not isinstance(selector, slice):
                # As long as the list in the call, whatever the data.
                order = spark.createDataFrame(list(enumerate(self._picked(name, selector, True))), f"{name}_ord int, {name}_ind int")
                out = out.join(F.broadcast(order), f"{name}_ind")
        if not grid:
            drop = [d.name for d in self.dims if d.name in selectors and len(self._picked(d.name, selectors[d.name], False)) == 1]
            out = out.drop(*[f"{n}_ind" for n in drop])
        if as_scalar and fields:
            parts = F.array(*[F.struct(F.lit(f).alias("component"), F.col("value")[f].cast("double").alias("value")) for f in fields])
            held = [k for k in out.columns if k != "value"]
            out = out.select(*held, F.explode(parts).alias("__x")).select(*held, "__x.component", "__x.value")
        return out

    def position_ids(self, selectors: dict[str, Selector]) -> DataFrame:
        """pos_idx of the positions a slice keeps."""
        where, _ = self.selection({k: v for k, v in selectors.items() if self.is_position(k)}, grid=False)
        for k in selectors:
            self.dim(k)
        return (self.main if where is None else self.main.where(where)).select("pos_idx")

    def spectral_ids(self, selectors: dict[str, Selector]) -> list[int]:
        _, ids = self.selection({k: v for k, v in selectors.items() if not self.is_position(k)}, grid=False)
        return list(range(self.shape[1])) if ids is None else ids

    def dims_after(self, selectors: dict[str, Selector]) -> tuple[tuple[Dimension, ...], tuple[Dimension, ...]]:
        """Position and spectroscopic dimensions of a slice; those of one step go, and a side without any gets arb."""
        sides = []
        for dims in (self.pos_dims, self.spec_dims):
            left = []
            for d in dims:
                picked = self._picked(d.name, selectors[d.name], False) if d.name in selectors else range(len(d))
                if len(picked) > 1:
                    left.append(replace(d, values=[d.steps[k] for k in picked]))
            sides.append(tuple(left) or (Dimension("arb.", "a. u.", [1]),))
        return sides[0], sides[1]

    def slice_grid(self, selectors: dict[str, Selector], name: str | None = None) -> Grid:
        """A slice as a grid of its own: positions are numbered again, arrays shortened, unselected sides kept."""
        where, ids = self.selection(selectors, grid=False)
        # What stands for no dimension gets names that columns can have.
        sides = zip(self.dims_after(selectors), ("arb", "arb_spec"), strict=True)
        pos, spec = (tuple(replace(d, name=name_) if d.name == "arb." else d for d in dims) for dims, name_ in sides)
        rows = self.main if where is None else self.main.where(where)
        number = F.lit(0).cast("long")
        for d, stride in zip(pos, strides([len(d) for d in pos]), strict=True):
            if any(d.name == x.name for x in self.pos_dims):
                picked = self._picked(d.name, selectors[d.name], False) if d.name in selectors else range(len(d))
                rank = rank_among(F.col(f"{d.name}_ind"), picked)
                rows = rows.withColumn(f"__{d.name}", rank.cast("int"))
                number = number + rank * stride
            else:
                rows = rows.withColumn(f"__{d.name}", F.lit(0))
        spectrum = F.col("spectrum") if ids is None else F.transform(F.array(*map(F.lit, ids)), lambda k: F.element_at("spectrum", k + 1))
        main = rows.select(number.alias("pos_idx"), *[F.col(f"__{d.name}").alias(f"{d.name}_ind") for d in pos], spectrum.alias("spectrum"))
        return Grid(main, pos, spec, self.quantity, self.units, name or f"{self.name}-slice")

    # Reductions.
    def reduce(self, dims: str | Sequence[str], how: str = "mean", order: int | None = None) -> DataFrame:
        """One row per cell of the dimensions that are left: <dimension>_ind..., value. Partial aggregation happens
        before the shuffle; where exactly all spectroscopic dimensions go, arrays are folded where they are."""
        dims = [dims] if isinstance(dims, str) else list(dims)
        for d in dims:
            self.dim(d)
        if how not in NAMES:
            raise NotImplementedError(f"reduction {how!r}; known: {', '.join(NAMES)}")
        left = [n for n in self.labels if n not in dims]
        if set(dims) == {d.name for d in self.spec_dims} and (folded := over_array(how, F.col("spectrum"))) is not None:
            return self.main.select(*[f"{n}_ind" for n in left], folded.alias("value"))
        return reduce_cells(self.coords(), [f"{n}_ind" for n in left], "value", how, order)

    def reduce_grid(self, dims: str | Sequence[str], how: str = "mean", order: int | None = None, name: str | None = None) -> Grid:
        """A reduction as a grid of its own."""
        dims = [dims] if isinstance(dims, str) else list(dims)
        cells = self.reduce(dims, how, order).withColumn("value", F.col("value").cast("double"))
        single = (Dimension("Single_Step", "a. u.", [0]),)
        pos = tuple(d for d in self.pos_dims if d.name not in dims) or single
        spec = tuple(d for d in self.spec_dims if d.name not in dims) or single
        if pos[0].name == spec[0].name:
            spec = (replace(single[0], name="Single_Step_2"),)
        for d in (*pos, *spec):
            if d.name.startswith("Single_Step"):
                cells = cells.withColumn(f"{d.name}_ind", F.lit(0))
        return Grid(unfold(cells, pos, spec), pos, spec, self.quantity, self.units, name or f"{self.name}-Reduce")

    # Physical coordinates of a plot.
    def plot_frame(self, selectors: dict[str, Selector] | None = None, kinds: str = "real") -> DataFrame:
        """Tidy rows (x, y, component, value) of a slice with one or two dimensions left; complex values become
        magnitude and phase, compound ones a component per field. Nothing is rendered."""
        selectors = selectors or {}
        pos, spec = self.dims_after(selectors)
        left = [d for d in (*pos, *spec) if d.name != "arb."]
        if len(left) > 2 or not left:
            raise NotImplementedError(f"{len(left)} dimensions are left; slice to one or two")
        out = self.slice(selectors, grid=False)
        x, *y = [value_column(F.col(f"{d.name}_ind"), self.dim(d.name)) for d in left]
        kind = out.schema["value"].dataType
        if kind.typeName() == "struct":
            names = kind.fieldNames()
            if set(names) == {"re", "im"}:
                parts = {"magnitude": F.hypot("value.re", "value.im"), "phase": F.atan2("value.im", "value.re")}
            else:
                parts = {n: F.col("value")[n].cast("double") for n in names}
        else:
            parts = {kinds: F.col("value").cast("double")}
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("component"), v.alias("value")) for k, v in parts.items()])).alias("__x")
        return out.select(x.alias("x"), (y[0] if y else F.lit(None).cast("float")).alias("y"), each).select("x", "y", "__x.*")


def reduce_cells(cells: DataFrame, by: list[str], value: str, how: str, order: int | None = None) -> DataFrame:
    """by..., value: a reduction of any table of cells. A moment takes the mean of its group first; both steps share one
    shuffle by the group's keys."""
    if how != MOMENT:
        return cells.groupBy(*by).agg(reduction(how, F.col(value)).alias("value"))
    if order is None or order < 0:
        raise ValueError("a moment needs an order, 0 or more")
    v = F.col(value).cast("double")
    keys = by or [F.lit(0).alias("__all")]
    centred = cells.withColumn("__d", v - F.avg(v).over(Window.partitionBy(*by)) if by else v)
    if not by:
        mean = cells.agg(F.avg(v).alias("__m"))
        centred = cells.join(F.broadcast(mean)).withColumn("__d", v - F.col("__m"))
    out = centred.groupBy(*keys).agg(F.avg(F.pow("__d", F.lit(float(order)))).alias("value"))
    return out if by else out.drop("__all")


def unfold(cells: DataFrame, pos_dims: Sequence[Dimension], spec_dims: Sequence[Dimension], value: str = "value") -> DataFrame:
    """The wide table (pos_idx, <dimension>_ind..., spectrum) of a coordinate frame: the inverse of coords()."""
    number = lambda dims: sum((F.col(f"{d.name}_ind").cast("long") * s for d, s in zip(dims, strides([len(d) for d in dims]), strict=True)), F.lit(0).cast("long"))
    rows = cells.select(number(pos_dims).alias("pos_idx"), number(spec_dims).alias("__k"), *[F.col(f"{d.name}_ind").cast("int").alias(f"{d.name}_ind") for d in pos_dims], F.col(value).alias("__v"))
    keys = ["pos_idx", *[f"{d.name}_ind" for d in pos_dims]]
    # A position's array is one row of the result, so its cells must meet; positions are dealt over all tasks.
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__k", "__v"))).alias("__a"))
    return packed.select(*keys, F.transform("__a", lambda x: x["__v"]).alias("spectrum"))
