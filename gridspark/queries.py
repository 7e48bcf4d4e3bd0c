"""The library's operators over the shared tables, with the same results in DuckDB SQL.

Cubes: E, the embeddings as positions X (20) x Y and steps Bias (8) x Cycle (8), first dimension fastest; L, line items by
flag and status against line number; V, events by day and type, or by user. Keys come out as long, values as double
rounded to six digits (four for prices), so that the order of summation does not show."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.reductions import ln, over_array, reduction
from gridspark.operators.grid import Grid, reduce_cells, unfold
from gridspark.operators.process import Process, map_positions, moving_mean, pending
from gridspark.operators.recover import change_counts, dimensionality, odometer, without_dims
from gridspark.operators.scatter import histogram, nearest
from gridspark.plans.catalog import GROUP, Catalog, matches
from gridspark.plans.dimension import Dimension, DimMode, dim_table, indices_matrix
from gridspark.streaming.arrivals import windowed_means

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The embedding cube in SQL.
E = """(SELECT vec_id, vec_id // 20 AS y, vec_id % 20 AS x, k // 8 AS cyc, k % 8 AS bias, k, CAST(v AS DOUBLE) AS v
 FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings))"""
BIAS = [round(-2.0 + 0.5 * k, 3) for k in range(8)]
CYCLE = [float(k) for k in range(8)]
NAMED = {"X_ind": "x", "Y_ind": "y", "Bias_ind": "bias", "Cycle_ind": "cyc"}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str) -> Grid:
    df = table(spark, sf_dir, "embeddings")
    n, last = df.agg(F.count("*"), F.max("vec_id")).first()
    rows = (last or 0) // 20 + 1
    # Seldom a multiple of 20: then the raster ends within a line.
    mode = DimMode.DEFAULT if n == 20 * rows else DimMode.INCOMPLETE
    pos = [Dimension("X", "nm", [50.0 * k for k in range(20)], mode=mode), Dimension("Y", "nm", [25.0 * k for k in range(rows)], mode=mode)]
    return Grid.from_wide(df, F.col("vec_id"), F.col("embedding"), pos, [Dimension("Bias", "V", BIAS), Dimension("Cycle", "", CYCLE)], quantity="Current", units="nA")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Short names, long keys, rounded double values."""
    out = []
    for k, kind in df.dtypes:
        c = F.col(k)
        if k == "value" and kind != "boolean":
            c = F.round(c.cast("double"), digits)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias({"value": "v"}.get(k, NAMED.get(k, k))))
    return df.select(*out)


# Scans and slices.
@query(f"SELECT vec_id AS pos_idx, k AS spec_idx, x, y, bias, cyc, round(v, 6) AS v FROM {E}")
def e01_scan_long(spark, sf_dir):
    return tidy(cube(spark, sf_dir).coords())


@query(f"SELECT vec_id AS pos_idx, k AS spec_idx, y, bias, cyc, round(v, 6) AS v FROM {E} WHERE x = 3")
def e02_slice_int(spark, sf_dir):
    return tidy(cube(spark, sf_dir).slice({"X": 3}))


@query(f"SELECT vec_id AS pos_idx, k AS spec_idx, x, y, bias, cyc, round(v, 6) AS v FROM {E} WHERE x >= 1 AND x < 5 AND (x - 1) % 2 = 0")
def e03_slice_range_step(spark, sf_dir):
    return tidy(cube(spark, sf_dir).slice({"X": slice(1, 5, 2)}))


@query(f"SELECT vec_id AS pos_idx, k AS spec_idx, x, bias, cyc, round(v, 6) AS v FROM {E} WHERE x IN (1, 2, 4) AND y = 3 AND bias IN (1, 4)")
def e04_slice_list(spark, sf_dir):
    return tidy(cube(spark, sf_dir).slice({"X": [4, 1, 2, 2], "Y": [3], "Bias": [1, 4]}, grid=False))


@query(f"SELECT vec_id AS pos_idx, k AS spec_idx, y, bias, cyc, round(v, 6) AS v FROM {E} WHERE x = 18")
def e05_slice_negative(spark, sf_dir):
    return tidy(cube(spark, sf_dir).slice({"X": -2}))


@query(f"SELECT vec_id AS pos_idx, k AS spec_idx, round(v, 6) AS v FROM {E} WHERE x = 3 AND y = 2 AND bias = 5 AND cyc = 7")
def e06_slice_all_dims(spark, sf_dir):
    return tidy(cube(spark, sf_dir).slice({"X": 3, "Y": 2, "Bias": 5, "Cycle": 7}))


@query(f"SELECT vec_id AS pos_idx, k AS spec_idx, y, bias, cyc, CAST(o.i AS BIGINT) AS \"X_ord\", x, round(v, 6) AS v FROM {E} JOIN (VALUES (0, 7), (1, 2), (2, 7), (3, 19)) o(i, w) ON x = o.w")
def e06b_slice_list_order(spark, sf_dir):
    return tidy(cube(spark, sf_dir).slice({"X": [7, 2, 7, -1]}))


@query("SELECT vec_id AS pos_idx FROM embeddings WHERE vec_id % 20 IN (1, 2, 4) AND vec_id // 20 = 3")
def e07_position_ids(spark, sf_dir):
    return cube(spark, sf_dir).position_ids({"X": [1, 2, 4], "Y": 3})


@query("SELECT k AS spec_idx FROM range(64) r(k) WHERE k % 8 IN (1, 4) AND k // 8 < 3")
def e08_spectral_ids(spark, sf_dir):
    ids = cube(spark, sf_dir).spectral_ids({"Bias": [1, 4], "Cycle": slice(0, 3)})
    return spark.createDataFrame([(k,) for k in ids], "spec_idx long")


@query(f"""SELECT name, size FROM (SELECT 'X' AS name, count(DISTINCT x) AS size FROM {E} WHERE x IN (1, 2) AND y = 3 UNION ALL SELECT 'Y', count(DISTINCT y) FROM {E} WHERE x IN (1, 2) AND y = 3
 UNION ALL SELECT 'Bias', count(DISTINCT bias) FROM {E} UNION ALL SELECT 'Cycle', count(DISTINCT cyc) FROM {E} WHERE cyc >= 5) WHERE size >= 2""")
def e09_dims_after_slice(spark, sf_dir):
    pos, spec = cube(spark, sf_dir).dims_after({"X": [1, 2], "Y": 3, "Cycle": slice(5, None)})
    return spark.createDataFrame([(d.name, len(d)) for d in (*pos, *spec)], "name string, size long")


# Reductions over the embedding cube.
_E_REDUCTIONS = {
    "e10_reduce_mean": (["Bias"], "mean", "vec_id // 20 AS y, vec_id % 20 AS x, cyc", "avg(v)", "vec_id, cyc"),
    "e11_reduce_std": (["X", "Cycle"], "std", "y, bias", "stddev_pop(v)", "y, bias"),
    "e12_reduce_var": (["X", "Cycle"], "var", "y, bias", "var_pop(v)", "y, bias"),
    "e13_reduce_min": (["Y", "Bias"], "min", "x, cyc", "min(v)", "x, cyc"),
    "e14_reduce_max": (["Y", "Bias"], "max", "x, cyc", "max(v)", "x, cyc"),
    "e15_reduce_sum": (["Y", "Bias"], "sum", "x, cyc", "sum(v)", "x, cyc"),
    "e22_reduce_to_scalar": (["X", "Y", "Bias", "Cycle"], "mean", "", "avg(v)", ""),
}


def _reducer(name: str, dims: list[str], how: str, keys: str, agg: str, by: str) -> None:
    def f(spark, sf_dir):
        return tidy(cube(spark, sf_dir).reduce(dims, how))

    f.__name__ = name
    query(f"SELECT {keys}{', ' if keys else ''}round({agg}, 6) AS v FROM {E}{' GROUP BY ' + by if by else ''}")(f)


for _name, _spec in _E_REDUCTIONS.items():
    _reducer(_name, *_spec)


@query(f"SELECT y, bias, round(exp(sum(ln(abs(v * 10)))) * CASE WHEN sum(CASE WHEN v < 0 THEN 1 ELSE 0 END) % 2 = 1 THEN -1 ELSE 1 END, 6) AS v FROM {E} WHERE x < 3 AND cyc < 3 GROUP BY y, bias")
def e16_reduce_prod(spark, sf_dir):
    cells = cube(spark, sf_dir).slice({"X": slice(0, 3), "Cycle": slice(0, 3)})
    return tidy(reduce_cells(cells.withColumn("value", F.col("value").cast("double") * 10), ["Y_ind", "Bias_ind"], "value", "prod"))


@query(f"SELECT y, bias, round(sum(ln(abs(v * 10))), 6) AS v, CAST(CASE WHEN sum(CASE WHEN v < 0 THEN 1 ELSE 0 END) % 2 = 1 THEN -1 ELSE 1 END AS BIGINT) AS sign FROM {E} GROUP BY y, bias")
def e16b_reduce_prod_all(spark, sf_dir):
    """Over all of X and Cycle; as ln of the size and sign, since the product itself would round to 0."""
    cells = cube(spark, sf_dir).coords()
    out = reduce_cells(cells.withColumn("value", F.col("value").cast("double") * 10), ["Y_ind", "Bias_ind"], "value", "prod")
    return tidy(out.withColumns({"value": F.log(F.abs("value")), "sign": F.signum("value").cast("long")}))


def _truth(how: str, least: float) -> Query:
    def f(spark, sf_dir):
        cells = cube(spark, sf_dir).coords()
        cells = cells.withColumn("value", F.when(F.abs(F.col("value").cast("double")) >= least, F.col("value").cast("double")).otherwise(0.0))
        return tidy(reduce_cells(cells, ["pos_idx", "Cycle_ind"], "value", how))

    f.__name__ = {"all": "e17_reduce_all", "any": "e18_reduce_any"}[how]
    return query(f"SELECT vec_id AS pos_idx, cyc, bool_{'and' if how == 'all' else 'or'}(abs(v) >= {least}) AS v FROM {E} GROUP BY vec_id, cyc")(f)


_truth("all", 0.01)
_truth("any", 0.2)

_HOLES = "CASE WHEN event_id % 2 = 0 OR user_id < 20 THEN 'NaN'::DOUBLE ELSE value END"
_NAN_SQL = {"nanmax": "max(r)", "nanmin": "min(r)", "nanmean": "avg(r)", "nanstd": "stddev_pop(r)", "nanvar": "var_pop(r)", "nansum": "sum(r)", "nanprod": "exp(sum(ln(r)))"}
_EMPTY = {"nansum": "0.0", "nanprod": "1.0"}


def _holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nan = F.lit(float("nan"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.when((F.col("event_id") % 2 == 0) | (F.col("user_id") < 20), nan).otherwise(F.col("value")).alias("value"))


def _nan_query(how: str) -> None:
    def f(spark, sf_dir):
        out = reduce_cells(_holes(spark, sf_dir), ["user_id"], "value", how)
        return tidy(out.withColumn("value", ln(F.col("value"))) if how == "nanprod" else out)

    f.__name__ = f"e19_reduce_{how}"
    value = f"coalesce({_NAN_SQL[how]}, {_EMPTY.get(how, chr(39) + 'NaN' + chr(39) + '::DOUBLE')})"
    query(f"SELECT user_id, round({'ln(' + value + ')' if how == 'nanprod' else value}, 6) AS v FROM (SELECT user_id, CASE WHEN NOT isnan(h) THEN h END AS r FROM (SELECT user_id, {_HOLES} AS h FROM events)) GROUP BY user_id")(f)


for _how in _NAN_SQL:
    _nan_query(_how)


@query(f"SELECT user_id, round(CASE WHEN bool_or(isnan(h)) THEN 'NaN'::DOUBLE ELSE min(h) END, 6) AS v FROM (SELECT user_id, {_HOLES} AS h FROM events) GROUP BY user_id")
def e19_reduce_min_with_nan(spark, sf_dir):
    return tidy(reduce_cells(_holes(spark, sf_dir), ["user_id"], "value", "min"))


@query(f"SELECT y, bias, round(avg(pow(v - m, 3)), 6) AS v FROM (SELECT *, avg(v) OVER (PARTITION BY y, bias) AS m FROM {E}) GROUP BY y, bias")
def e20_reduce_moment3(spark, sf_dir):
    return tidy(cube(spark, sf_dir).reduce(["X", "Cycle"], "moment", 3))


@query("SELECT vec_id // 20 AS y, vec_id % 20 AS x, round(list_avg(list_transform(embedding, lambda a: CAST(a AS DOUBLE))), 6) AS v FROM embeddings")
def e21_reduce_all_spectral(spark, sf_dir):
    """All spectroscopic dimensions go: arrays are folded where they are, without a shuffle."""
    return tidy(cube(spark, sf_dir).reduce(["Bias", "Cycle"], "mean"))


# Recovery of dimensions.
def spectral_table(spark: SparkSession) -> DataFrame:
    return dim_table(spark, [Dimension("Bias", "V", BIAS), Dimension("Cycle", "", CYCLE)])


@query(f"SELECT dim, size FROM (SELECT 'X' AS dim, count(DISTINCT x) AS size FROM {E} UNION ALL SELECT 'Y', count(DISTINCT y) FROM {E} UNION ALL SELECT 'Bias', count(DISTINCT bias) FROM {E} UNION ALL SELECT 'Cycle', count(DISTINCT cyc) FROM {E})")
def e23_dimensionality(spark, sf_dir):
    g = cube(spark, sf_dir)
    found = {d: n for side, names in ((g.main, ["X", "Y"]), (spectral_table(spark), ["Bias", "Cycle"])) for d, n in zip(names, dimensionality(side, names), strict=True)}
    return spark.createDataFrame(list(found.items()), "dim string, size long")


@query("""WITH t AS (SELECT k, k % 8 AS b, k // 8 AS c FROM range(64) r(k)), w AS (SELECT b <> coalesce(lag(b) OVER (ORDER BY k), (SELECT b FROM t WHERE k = 63)) AS db, c <> coalesce(lag(c) OVER (ORDER BY k), (SELECT c FROM t WHERE k = 63)) AS dc FROM t)
SELECT 'Bias_ind' AS dim, count(*) FILTER (db) AS changes FROM w UNION ALL SELECT 'Cycle_ind', count(*) FILTER (dc) FROM w""")
def e24_change_counts(spark, sf_dir):
    return change_counts(spectral_table(spark), ["Bias_ind", "Cycle_ind"])


@query("SELECT k AS i, -2.0::DOUBLE + 0.5::DOUBLE * k AS v FROM range(8) r(k)")
def e25_unit_values(spark, sf_dir):
    from gridspark.operators.recover import unit_values

    found = unit_values(spectral_table(spark), ["Bias", "Cycle"], ["Bias"])["Bias"]
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(found)], "i long, v double")


@query("SELECT k AS step, k % 8 AS \"Bias_val\", k // 8 AS \"Cycle_val\" FROM range(64) r(k)")
def e26_odometer(spark, sf_dir):
    return odometer(spectral_table(spark), ["Bias_val", "Cycle_val"])


@query("SELECT k AS step, k % 4 AS d0, k // 4 % 3 AS d1, k // 12 AS d2 FROM range(60) r(k)")
def e27_indices_matrix(spark, sf_dir):
    return indices_matrix(spark, [4, 3, 5])


@query("SELECT k AS step, k % 8 AS bias, round(-2.0::DOUBLE + 0.5::DOUBLE * (k % 8), 6) AS \"Bias_val\", k // 8 AS cyc, CAST(k // 8 AS DOUBLE) AS \"Cycle_val\" FROM range(64) r(k)")
def e27b_dim_table(spark, sf_dir):
    out = tidy(spectral_table(spark))
    return out.withColumns({k: F.col(k).cast("double") for k in ("Bias_val", "Cycle_val")})


# Changes of shape.
@query("SELECT vec_id AS pos_idx, vec_id % 20 AS x, vec_id // 20 AS y, k AS spec_idx, round(CAST(v AS DOUBLE), 6) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)")
def e28_unfold(spark, sf_dir):
    """Folded to cells, dealt anew, and packed again; read back element by element."""
    g = cube(spark, sf_dir)
    wide = unfold(g.coords().drop("pos_idx", "spec_idx"), g.pos_dims, g.spec_dims)
    return tidy(wide.select("pos_idx", "X_ind", "Y_ind", F.posexplode("spectrum").alias("spec_idx", "value")))


@query("SELECT k AS step, k AS cyc, CAST(k AS DOUBLE) AS \"Cycle_val\" FROM range(8) r(k)")
def e29_reduced_dims(spark, sf_dir):
    return tidy(without_dims(spectral_table(spark), ["Bias", "Cycle"], ["Bias"])).withColumn("Cycle_val", F.col("Cycle_val").cast("double"))


@query(f"SELECT y, cyc, round(max(v), 6) AS v FROM {E} WHERE x IN (1, 2, 4) AND bias >= 4 GROUP BY y, cyc")
def e30_slice_then_reduce(spark, sf_dir):
    g = cube(spark, sf_dir).slice_grid({"X": [1, 2, 4], "Bias": slice(4, None)})
    return tidy(g.reduce(["X", "Bias"], "max"))


@query(f"SELECT vec_id AS pos_idx, k AS spec_idx, x, y, bias, cyc, round(v, 6) AS v, x * 50.0::DOUBLE AS \"X_val\", y * 25.0::DOUBLE AS \"Y_val\", -2.0::DOUBLE + 0.5::DOUBLE * bias AS \"Bias_val\", CAST(cyc AS DOUBLE) AS \"Cycle_val\" FROM {E}")
def e31_join_dims(spark, sf_dir):
    out = tidy(cube(spark, sf_dir).coords(values=True))
    return out.withColumns({k: F.col(k).cast("double") for k in out.columns if k.endswith("_val")})


@query(f"SELECT x * 50.0::DOUBLE AS x, y * 25.0::DOUBLE AS y, 'real' AS component, round(v, 6) AS v FROM {E} WHERE bias = 2 AND cyc = 1")
def e32_plot_frame(spark, sf_dir):
    out = cube(spark, sf_dir).plot_frame({"Bias": 2, "Cycle": 1})
    return tidy(out).withColumns({k: F.col(k).cast("double") for k in ("x", "y")})


@query(f"SELECT y, bias, round(avg(v), 6) AS v FROM {E} GROUP BY y, bias")
def e33_reduce_to_grid(spark, sf_dir):
    return tidy(cube(spark, sf_dir).reduce_grid(["X", "Cycle"], "mean").coords()).select("y", "bias", "v")


@query(f"SELECT vec_id AS pos_idx, round(sqrt(a.v * a.v + b.v * b.v), 6) AS magnitude, round(atan2(b.v, a.v), 6) AS phase FROM (SELECT vec_id, v FROM {E} WHERE k = 0) a JOIN (SELECT vec_id, v FROM {E} WHERE k = 1) b USING (vec_id)")
def e34_complex(spark, sf_dir):
    from gridspark.functions.reductions import magnitude, phase

    z = F.struct(F.element_at("spectrum", 1).cast("double").alias("re"), F.element_at("spectrum", 2).cast("double").alias("im"))
    rows = cube(spark, sf_dir).main.select("pos_idx", z.alias("z"))
    return rows.select("pos_idx", F.round(magnitude(F.col("z")), 6).alias("magnitude"), F.round(phase(F.col("z")), 6).alias("phase"))


# Line items and events.
_L = "lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber"


def _line_query(name: str, how: str, column: str, agg: str) -> None:
    def f(spark, sf_dir):
        cells = table(spark, sf_dir, "lineitem")
        return tidy(reduce_cells(cells, ["l_returnflag", "l_linestatus", "l_linenumber"], column, how), 4)

    f.__name__ = name
    query(f"SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS BIGINT) AS l_linenumber, round({agg}, 4) AS v FROM {_L}")(f)


_line_query("l01_mean", "mean", "l_extendedprice", "avg(l_extendedprice)")
_line_query("l02_sum", "sum", "l_quantity", "sum(l_quantity)")
_line_query("l03_max", "max", "l_extendedprice", "max(l_extendedprice)")
_line_query("l04_std", "std", "l_discount", "stddev_pop(l_discount)")


@query("SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS BIGINT) AS l_linenumber, round((m - lo) / (hi - lo), 6) AS v FROM (SELECT *, min(m) OVER () AS lo, max(m) OVER () AS hi FROM (SELECT l_returnflag, l_linestatus, l_linenumber, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2, 3))")
def l05_normalised(spark, sf_dir):
    cells = reduce_cells(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_extendedprice", "mean")
    ends = cells.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    out = cells.join(F.broadcast(ends))
    return tidy(out.withColumn("value", (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).drop("lo", "hi"))


@query("SELECT day, event_type, round(avg(value), 6) AS v FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, value FROM events) GROUP BY day, event_type")
def v01_day_type_mean(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"), "event_type", "value")
    return tidy(reduce_cells(e, ["day", "event_type"], "value", "mean"))


@query("SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS v FROM events")
def v02_moving_mean(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return tidy(e.select("event_id", "user_id", moving_mean(e, "value", ["user_id"], ["ts", "event_id"]).alias("value")))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY event_type")
def v03_completion(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return tidy(e.groupBy("event_type").agg(F.count("*").alias("n"), reduction("sum", F.col("value")).alias("value")), 4)


@query("SELECT CAST(time_bucket(INTERVAL '6 hours', ts) AS VARCHAR) AS start, event_type, count(*) AS n, round(avg(value), 6) AS v FROM events GROUP BY 1, 2")
def v04_windowed_mean(spark, sf_dir):
    out = windowed_means(table(spark, sf_dir, "events"), "ts", "value", ["event_type"], "6 hours")
    return tidy(out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")))


# Rasters.
@query("""WITH b AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_discount) AS y0, max(l_discount) AS y1 FROM lineitem),
g AS (SELECT r, c, x0, x1, y0, y1 FROM range(10) a(r), range(5) d(c), b),
ex AS (SELECT k, CASE WHEN k = 10 THEN x1 ELSE x0 + k * ((x1 - x0) / 10) END AS e FROM range(11) q(k), b), ey AS (SELECT k, CASE WHEN k = 5 THEN y1 ELSE y0 + k * ((y1 - y0) / 5) END AS e FROM range(6) q(k), b),
lx AS (SELECT list(e ORDER BY k) AS l FROM ex), ly AS (SELECT list(e ORDER BY k) AS l FROM ey),
p AS (SELECT least(len(list_filter(lx.l, lambda e: e <= l_quantity)) - 1, 9) AS r, least(len(list_filter(ly.l, lambda e: e <= l_discount)) - 1, 4) AS c, l_extendedprice AS v FROM lineitem, lx, ly)
SELECT g.r AS row, g.c AS col, count(p.v) AS n, round(coalesce(avg(p.v), 'NaN'::DOUBLE), 4) AS v FROM g LEFT JOIN p ON g.r = p.r AND g.c = p.c GROUP BY g.r, g.c""")
def g01_histogram(spark, sf_dir):
    return tidy(histogram(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", (10, 5)), 4)


_NODES = [(r, c, 10.0 * r, 0.03 * c) for r in range(6) for c in range(4)]


@query(f"""WITH n(r, c, nx, ny) AS (VALUES {', '.join(f'({r}, {c}, {x}::DOUBLE, {y}::DOUBLE)' for r, c, x, y in _NODES)}),
p AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS x, l_discount AS y FROM lineitem)
SELECT CAST(r AS BIGINT) AS row, CAST(c AS BIGINT) AS col, arg_min(id, {{'d': (x - nx) * (x - nx) + (y - ny) * (y - ny), 'i': id}}) AS id FROM p, n GROUP BY r, c""")
def g02_nearest(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return tidy(nearest(p, "id", "l_quantity", "l_discount", "l_extendedprice", _NODES)).drop("v")


# Processing and the catalog.
@query("SELECT vec_id AS pos_idx, round(list_avg(list_transform(embedding, lambda a: CAST(a AS DOUBLE))), 6) AS v FROM embeddings")
def p01_process_mean(spark, sf_dir):
    out = map_positions(cube(spark, sf_dir).main, lambda s: float(s.astype("float64").mean()), "double")
    return tidy(out.withColumnRenamed("result", "value"))


@query("SELECT vec_id AS pos_idx FROM embeddings WHERE vec_id % 2 = 1")
def p02_pending(spark, sf_dir):
    main = cube(spark, sf_dir).main
    return pending(main, main.where("pos_idx % 2 = 0")).select("pos_idx")


@query("SELECT CAST(a AS BIGINT) AS id, b AS same FROM (VALUES (0, true), (1, true), (2, false), (3, false), (4, true)) s(a, b)")
def p03_param_match(spark, sf_dir):
    have = {"a": 1.2345, "b": [1, 2, 3], "c": ["x", "y"]}
    want = [{"a": 1.2345 + 1e-9}, {"b": [1, 2, 3.0000001], "d": None}, {"b": [1, 2]}, {"e": 1}, {"c": ["x", "y"]}]
    return spark.createDataFrame([(i, matches(have, w)) for i, w in enumerate(want)], "id long, same boolean")


_GROUPS = [("/m/raw-Fit_000", "raw-Fit_000"), ("/m/raw-Fit_004", "raw-Fit_004"), ("/m/raw-Fitter_000", "raw-Fitter_000"), ("/m/other-Fit_009", "other-Fit_009")]


@query(f"SELECT name FROM (VALUES {', '.join(f'({chr(39)}{p}{chr(39)}, {chr(39)}{n}{chr(39)})' for p, n in _GROUPS)}) g(path, name) WHERE regexp_matches(name, '^raw-Fit_[0-9]+$')")
def c01_results_groups(spark, sf_dir):
    held = catalog_of_groups(spark)
    return spark.createDataFrame([(r["name"],) for r in held.results_groups("/m/raw", "Fit")], "name string")


@query("SELECT 'raw-Fit_005' AS name")
def c02_next_index(spark, sf_dir):
    return spark.createDataFrame([(catalog_of_groups(spark).next_name("/m", "raw-Fit"),)], "name string")


def scratch(spark: SparkSession) -> Catalog:
    """An empty catalog in a new folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    return Catalog(spark, f"{base or tempfile.mkdtemp(prefix='gridspark-')}/tree-{uuid.uuid4().hex}")


def catalog_of_groups(spark: SparkSession) -> Catalog:
    found = scratch(spark)
    for path, _ in _GROUPS:
        found.put(path, GROUP, {})
    return found


def stored(spark: SparkSession, sf_dir: str) -> tuple[Catalog, str]:
    """The embedding cube, written as a main dataset."""
    found = scratch(spark)
    return found, found.write_main("/m/raw", cube(spark, sf_dir))


@query(f"SELECT x, y, bias, cyc, round(v, 6) AS v FROM {E}")
def k01_write_and_open(spark, sf_dir):
    """Written, catalogued, opened and checked, then unfolded."""
    held, path = stored(spark, sf_dir)
    return tidy(held.open(path, check=True).coords()).select("x", "y", "bias", "cyc", "v")


@query(f"SELECT x, y, bias, cyc, round(v, 6) AS v FROM {E} WHERE y BETWEEN 3 AND 9 AND bias IN (1, 3, 5)")
def k02_stored_slice(spark, sf_dir):
    """Bounds on a stored column, which reach the scan."""
    held, path = stored(spark, sf_dir)
    return tidy(held.open(path).slice({"Y": slice(3, 10), "Bias": slice(1, 7, 2)})).select("x", "y", "bias", "cyc", "v")


@query(f"SELECT x, y, round(stddev_pop(v), 6) AS v FROM {E} GROUP BY x, y")
def k03_stored_std(spark, sf_dir):
    """The deviation over all steps, folded where the arrays are."""
    held, path = stored(spark, sf_dir)
    return tidy(held.open(path).reduce(["Bias", "Cycle"], "std")).select("x", "y", "v")


@query("SELECT vec_id AS pos_idx, 0 AS n FROM embeddings")
def k04_create_empty(spark, sf_dir):
    held, path = stored(spark, sf_dir)
    held.create_empty(path, "int", "/m/zeros")
    rows = spark.read.parquet(held.folder("/m/zeros"))
    return rows.select(F.col("pos_idx").cast("long").alias("pos_idx"), F.aggregate("spectrum", F.lit(0), lambda a, x: a + F.abs(x)).cast("int").alias("n"))


@query("SELECT vec_id AS pos_idx, round(list_avg(list_transform(embedding, lambda a: CAST(a AS DOUBLE))), 6) AS v FROM embeddings")
def p04_compute(spark, sf_dir):
    """A run of its own, then the same again: the second finds the first complete."""
    held, path = stored(spark, sf_dir)
    mean = over_array("mean", F.col("spectrum"))
    first = Process(held, path, "Mean", {"order": 1}, expression=mean).compute()
    again = Process(held, path, "Mean", {"order": 1}, expression=mean)
    if again.compute() != first:
        raise AssertionError("a complete run was not found")
    return tidy(again.results().withColumnRenamed("result", "value"))


@query("SELECT * FROM (VALUES ('/m/raw'), ('/m/zeros')) s(path)")
def c03_all_main(spark, sf_dir):
    held, path = stored(spark, sf_dir)
    held.create_empty(path, "int", "/m/zeros")
    held.create_results_group(path, "Fit")
    return spark.createDataFrame([(x,) for x in held.all_main()], "path string")


@query("SELECT * FROM (VALUES ('raw'), ('raw-Fit_000')) s(name)")
def c04_source_of(spark, sf_dir):
    """A group of results, found by name, and the dataset that it is from."""
    held, path = stored(spark, sf_dir)
    group = held.create_results_group(path, "Fit", {"order": 2})
    (found,) = held.check_for_old(path, "Fit", {"order": 2})
    return spark.createDataFrame([(held.source_of(group).rsplit("/", 1)[-1],), (found["name"],)], "name string")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over Bias of the embedding cube."""
    return tidy(cube(spark, sf_dir).reduce("Bias", "mean"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
