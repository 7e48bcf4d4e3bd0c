"""From arrays, images and text matrices to grids."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.grid import Grid
from gridspark.plans.catalog import Catalog, book_keeping, flatten_attrs, join_path
from gridspark.plans.dimension import Dimension, validate_dimensions

RESERVED = ("Position_Indices", "Position_Values", "Spectroscopic_Indices", "Spectroscopic_Values", "Raw_Data")
#: Kernels of down-sampling that are expressed here; others need an image library.
KERNELS = ("box", "nearest")
_ddl = {"b": "tinyint", "h": "smallint", "i": "int", "l": "bigint", "q": "bigint", "f": "float", "d": "double", "B": "smallint", "H": "int", "I": "bigint", "L": "decimal(20,0)", "Q": "decimal(20,0)", "e": "float", "?": "boolean"}


def element_type(dtype: np.dtype) -> str:
    """The Spark type that holds every value of a numpy type; unsigned types take the next wider one."""
    if dtype.names:
        return "struct<" + ",".join(f"{n}:{element_type(dtype[n])}" for n in dtype.names) + ">"
    if dtype.kind == "c":
        return "struct<re:double,im:double>"
    if dtype.char not in _ddl:
        raise TypeError(f"no type for {dtype}")
    return _ddl[dtype.char]


def _plain(x):
    """A numpy value as what Spark takes for its element type."""
    if isinstance(x, np.void):
        return {n: _plain(x[n]) for n in x.dtype.names}
    if isinstance(x, complex | np.complexfloating):
        return {"re": float(x.real), "im": float(x.imag)}
    if isinstance(x, np.uint64):
        return Decimal(int(x))
    return x.item() if hasattr(x, "item") else x


def from_array(spark: SparkSession, data: np.ndarray, pos_dims, spec_dims, **more) -> Grid:
    """A grid of a two-dimensional array in the driver's memory: rows are positions, columns spectroscopic steps."""
    data = np.asarray(data)
    pos, spec = validate_dimensions(pos_dims), validate_dimensions(spec_dims, "Spectroscopic")
    if data.ndim != 2:
        raise ValueError("the array must have two dimensions")
    want = (int(np.prod([len(d) for d in pos])), int(np.prod([len(d) for d in spec])))
    if data.shape != want:
        raise ValueError(f"an array of {data.shape}, where dimensions say {want}")
    kind = element_type(data.dtype)
    if data.dtype.kind in "fiub" and data.dtype.char not in "LQ":
        flat = pa.array(data.astype({"e": "f4", "B": "i2", "H": "i4", "I": "i8"}.get(data.dtype.char, data.dtype)).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(data) + 1) * want[1], pa.int32()), flat)
        df = spark.createDataFrame(pa.table({"pos_idx": pa.array(np.arange(len(data))), "spectrum": lists}))
    else:
        rows = [(i, [_plain(x) for x in row]) for i, row in enumerate(data)]
        df = spark.createDataFrame(rows, f"pos_idx long, spectrum array<{kind}>")
    return Grid.from_wide(df, F.col("pos_idx"), F.col("spectrum").cast(f"array<{kind}>"), pos, spec, **more)


def translate(catalog: Catalog, data, name: str, quantity: str, units: str, pos_dims, spec_dims, translator: str = "ArrayTranslator", params: dict | None = None, extra: dict | None = None) -> str:
    """One measurement into a new tree: /Measurement_NNN with its parameters, /Channel_NNN, Raw_Data and extra arrays.
    data: a two-dimensional array, or a DataFrame (pos_idx, spectrum). Returns the main dataset's path."""
    for what in (name, quantity, units, translator):
        if not isinstance(what, str):
            raise TypeError("names, quantity and units are strings")
    if taken := [k for k in extra or {} if k in RESERVED]:
        raise KeyError(f"{taken} are names of the format itself")
    spark = catalog.spark
    if isinstance(data, DataFrame):
        grid = Grid.from_wide(data, F.col("pos_idx"), F.col("spectrum"), pos_dims, spec_dims, quantity=quantity, units=units, name="Raw_Data")
    else:
        grid = from_array(spark, data, pos_dims, spec_dims, quantity=quantity, units=units, name="Raw_Data")
    catalog.put("/", "group", book_keeping() | {"data_type": name, "translator": translator})
    channel = catalog.create_indexed_group(catalog.create_indexed_group("/", "Measurement", flatten_attrs(params or {})), "Channel")
    path = catalog.write_main(join_path(channel, "Raw_Data"), grid)
    for key, value in (extra or {}).items():
        a = np.asarray(value)
        df = value if isinstance(value, DataFrame) else spark.createDataFrame([(i, _plain(x)) for i, x in enumerate(a.ravel())], f"k long, value {element_type(a.dtype)}")
        catalog.write_table(join_path(channel, key), df, {"shape": list(a.shape)} if not isinstance(value, DataFrame) else {})
    return path


# Images: rows (y, x, value).
def read_image(spark: SparkSession, path: str, grey: bool = True) -> DataFrame:
    """(y, x, value) of an image file, or of a text matrix (.txt: blanks, .csv: commas) one line per row."""
    if path.endswith((".txt", ".csv")):
        return read_matrix(spark, path, "," if path.endswith(".csv") else r"\s+")
    image = spark.read.format("image").load(path).select("image.*")
    h, w, n = F.col("height"), F.col("width"), F.col("nChannels")
    at = image.select(w.alias("w"), n.alias("n"), F.col("data").alias("data"), F.explode(F.sequence(F.lit(0), h * w - 1)).alias("k"))
    byte = lambda j: F.conv(F.hex(F.substring("data", F.col("k") * F.col("n") + 1 + j, F.lit(1))), 16, 10).cast("double")
    # Samples are blue, green, red; grey by the usual luma weights.
    value = F.when(F.col("n") < 3, byte(F.lit(0))).otherwise(F.floor(byte(F.lit(2)) * 0.299 + byte(F.lit(1)) * 0.587 + byte(F.lit(0)) * 0.114 + 0.5)) if grey else byte(F.lit(0))
    return at.select(F.floor(F.col("k") / F.col("w")).cast("int").alias("y"), (F.col("k") % F.col("w")).cast("int").alias("x"), value.alias("value"))


def read_matrix(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(y, x, value) of a text matrix in one file; `whole` keeps its lines in order."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s) != "")).alias("y", "line"))
    return lines.select("y", F.posexplode(F.split(F.trim("line"), separator)).alias("x", "v")).select("y", "x", F.col("v").cast("double").alias("value"))


def resample(pixels: DataFrame, factor: int | tuple[int, int], kernel: str = "box") -> DataFrame:
    """Pixels binned by (rows, columns): the mean of each block, or its first pixel."""
    by, bx = (factor, factor) if isinstance(factor, int) else factor
    if by < 1 or bx < 1:
        raise ValueError("bin factors are positive")
    if kernel not in KERNELS:
        raise NotImplementedError(f"kernel {kernel!r} needs an image library; here: {KERNELS}")
    block = [F.floor(F.col("y") / by).cast("int").alias("y"), F.floor(F.col("x") / bx).cast("int").alias("x")]
    if kernel == "nearest":
        return pixels.where((F.col("y") % by == 0) & (F.col("x") % bx == 0)).select(*block, "value")
    return pixels.groupBy(*block).agg(F.avg("value").alias("value"))


def normalised(pixels: DataFrame) -> DataFrame:
    """Values moved and scaled to 0..1; a flat image becomes 0."""
    ends = pixels.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return pixels.join(F.broadcast(ends)).select("y", "x", F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)).cast("float").alias("value"))


def image_grid(pixels: DataFrame, height: int, width: int, **more) -> Grid:
    """An image as a grid of one spectroscopic step; Y is the fastest position dimension."""
    dims = [Dimension("Y", "a. u.", height), Dimension("X", "a. u.", width)]
    rows = pixels.select((F.col("x") * height + F.col("y")).cast("long").alias("p"), F.array("value").alias("s"))
    return Grid.from_wide(rows, F.col("p"), F.col("s"), dims, [Dimension("arb", "a. u.", [1])], **more)


def translate_image(catalog: Catalog, path: str, factor: int | tuple[int, int] = 1, kernel: str = "box", normalise: bool = False) -> str:
    pixels = read_image(catalog.spark, path)
    if factor != 1:
        pixels = resample(pixels, factor, kernel)
    if normalise:
        pixels = normalised(pixels)
    height, width, least, most = pixels.agg(F.max("y") + 1, F.max("x") + 1, F.min("value"), F.max("value")).first()
    grid = image_grid(pixels, height, width)
    return translate(catalog, grid.main.select("pos_idx", "spectrum"), "Image", "Intensity", "a. u.", grid.pos_dims, grid.spec_dims, "ImageTranslator", {"image_min": float(least), "image_max": float(most), "normalized": normalise, "image_binning_size": list(factor) if not isinstance(factor, int) else [factor] * 2})


def spatial_split(dims: Sequence[Dimension]) -> tuple[list[Dimension], list[Dimension]]:
    """(position, spectroscopic) dimensions of an N-dimensional array: spatial ones are positions, all others not."""
    pos = [d for d in dims if d.dim_type.lower() == "spatial"]
    spec = [d for d in dims if d.dim_type.lower() != "spatial"]
    one = Dimension("arb.", "a. u.", [1])
    return pos or [one], spec or [one]


def from_nd_array(spark: SparkSession, data: np.ndarray, dims: Sequence[Dimension], **more) -> Grid:
    """A grid of an N-dimensional array with one Dimension per axis."""
    data = np.asarray(data)
    if data.shape != tuple(len(d) for d in dims):
        raise ValueError(f"an array of {data.shape}, where dimensions say {tuple(len(d) for d in dims)}")
    pos, spec = spatial_split(dims)
    axis = {d.name: k for k, d in enumerate(dims)}
    order = [axis[d.name] for d in (*reversed(pos), *reversed(spec)) if d.name in axis]
    n = int(np.prod([len(d) for d in pos]))
    return from_array(spark, data.transpose(order).reshape(n, -1), pos, spec, **more)
