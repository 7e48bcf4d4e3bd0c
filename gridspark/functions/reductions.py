"""The closed set of reductions, as builders of aggregate columns.

Missing cells are NaN, never null. The plain reductions let NaN through, the nan ones skip it; a group of nothing but NaN
gives NaN (0 for nansum, 1 for nanprod). Results are double, those of all and any boolean."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def real(v: Column) -> Column:
    """v where it is a number, else null, which aggregates skip."""
    return F.when(~F.isnan(v), v)


def _skipping(f: Callable[[Column], Column], empty: float = NAN) -> Callable[[Column], Column]:
    return lambda v: F.coalesce(f(real(v)), F.lit(empty))


def ln(v: Column) -> Column:
    """The natural logarithm: -Infinity of 0 and NaN below it, where Spark's is null."""
    return F.when(v == 0, F.lit(-float("inf"))).when(v < 0, F.lit(NAN)).otherwise(F.log(v))


def _whole_product(running: Column, size: Column, negatives: Column) -> Column:
    """A product from the running one, the sum of ln of magnitudes and the number of negative values.

    A running product may leave the doubles' range though the whole lies inside, or meet a 0 when it is infinite, as the
    order has it; so it counts only where the sum agrees."""
    by_size = F.when(negatives % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0)) * F.exp(size)
    return F.when(F.abs(ln(F.abs(running)) - size) < 1e-9, running).otherwise(by_size)


def product(v: Column) -> Column:
    return _whole_product(F.product(v), F.sum(ln(F.abs(v))), F.sum((v < 0).cast("long")))


REDUCTIONS: dict[str, Callable[[Column], Column]] = {
    "all": lambda v: F.bool_and(v != 0),
    "any": lambda v: F.bool_or(v != 0),
    "max": F.max,
    "min": lambda v: F.when(F.bool_or(F.isnan(v)), F.lit(NAN)).otherwise(F.min(v)),
    "mean": F.avg,
    "sum": F.sum,
    "prod": product,
    "std": F.stddev_pop,
    "var": F.var_pop,
    "nanmax": _skipping(F.max),
    "nanmin": _skipping(F.min),
    "nanmean": _skipping(F.avg),
    "nanstd": _skipping(F.stddev_pop),
    "nanvar": _skipping(F.var_pop),
    "nansum": _skipping(F.sum, 0.0),
    "nanprod": _skipping(product, 1.0),
}
#: Needs the group's mean first, so it is not one aggregate.
MOMENT = "moment"
NAMES = (*REDUCTIONS, MOMENT)


def reduction(name: str, v: Column) -> Column:
    if name not in REDUCTIONS:
        raise NotImplementedError(f"reduction {name!r}; known: {', '.join(NAMES)}")
    return REDUCTIONS[name](v.cast("double"))


def over_array(name: str, a: Column) -> Column | None:
    """The reduction of one array of numbers without exploding it, or None where there is no such form."""
    d = a.cast("array<double>")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    numbers = F.filter(d, lambda v: ~F.isnan(v))

    def product_of(x: Column) -> Column:
        running = F.aggregate(x, F.lit(1.0), lambda acc, v: acc * v)
        return _whole_product(running, total(F.transform(x, lambda v: ln(F.abs(v)))), F.size(F.filter(x, lambda v: v < 0)))

    def variance(x: Column) -> Column:
        # Count, mean and sum of squared gaps, one element at a time.
        def step(a: Column, v: Column) -> Column:
            n = a["n"] + 1.0
            m = a["m"] + (v - a["m"]) / n
            return F.struct(n.alias("n"), m.alias("m"), (a["s"] + (v - a["m"]) * (v - m)).alias("s"))

        zero = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "m", "s")])
        return F.aggregate(x, zero, step, lambda a: F.when(a["n"] > 0, a["s"] / a["n"]).otherwise(F.lit(NAN)))

    forms = {
        "mean": lambda: total(d) / F.size(d),
        "sum": lambda: total(d),
        "max": lambda: F.array_max(d),
        "min": lambda: F.when(F.exists(d, F.isnan), F.lit(NAN)).otherwise(F.array_min(d)),
        "prod": lambda: product_of(d),
        "all": lambda: F.forall(d, lambda v: v != 0),
        "any": lambda: F.exists(d, lambda v: v != 0),
        "nansum": lambda: total(numbers),
        "nanmean": lambda: F.when(F.size(numbers) > 0, total(numbers) / F.size(numbers)).otherwise(F.lit(NAN)),
        "nanmax": lambda: F.coalesce(F.array_max(numbers), F.lit(NAN)),
        "nanmin": lambda: F.coalesce(F.array_min(numbers), F.lit(NAN)),
        "var": lambda: variance(d),
        "std": lambda: F.sqrt(variance(d)),
        "nanvar": lambda: variance(numbers),
        "nanstd": lambda: F.sqrt(variance(numbers)),
        "nanprod": lambda: product_of(numbers),
    }
    return forms[name]() if name in forms else None


def magnitude(z: Column) -> Column:
    """Of a complex value struct(re, im)."""
    return F.hypot(z["re"], z["im"])


def phase(z: Column) -> Column:
    return F.atan2(z["im"], z["re"])


def flatten_real(value: Column, fields: list[str]) -> Column:
    """A compound or complex array as one array of reals: all of the first field, then all of the next."""
    return F.concat(*[F.transform(value, lambda x, f=f: x[f].cast("double")) for f in fields])


def scaled(values: Column, most: Column) -> Column:
    """Values divided by the power of ten of their greatest magnitude, for axes."""
    return values / F.pow(F.lit(10.0), F.floor(F.log10(most)))
