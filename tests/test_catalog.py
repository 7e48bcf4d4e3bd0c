import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators.grid import Grid
from gridspark.operators.process import Process
from gridspark.plans.catalog import Catalog, flatten_attrs, matches, validate_dims_against
from gridspark.plans.dimension import Dimension, DimMode
from gridspark.sources.export import dense
from gridspark.sources.ingest import from_array, image_grid, normalised, read_image, resample, translate, translate_image

POS = [Dimension("X", "nm", 5), Dimension("Y", "um", 3)]
SPEC = [Dimension("Bias", "V", 7), Dimension("Cycle", "", 2)]
DATA = np.random.default_rng(3).random((15, 14))


@pytest.fixture()
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "tree"))


def test_matches():
    have = {"a": 1.2345, "b": [1, 2, 3], "c": ["x", "y"], "d": "t", "e": True}
    for want, same in (
        ({}, True), (None, True), ({"a": 1.2345000001}, True), ({"a": 1.3}, False), ({"b": [1, 2, 3.0]}, True), ({"b": [1, 2]}, False), ({"c": ["x", "z"]}, False),
        ({"d": "t", "q": None}, True), ({"q": 1}, False), ({"a": "1.2345"}, False), ({"e": True}, True), ({"e": 1}, False),
    ):
        assert matches(have, want) is same, want
    assert flatten_attrs({"a": {"b": 1, "c": {"d": 2}}, "e": 3}) == {"a-b": 1, "a-c-d": 2, "e": 3}


def test_groups_and_trees(catalog):
    assert catalog.all_main() == [] and catalog.tree() == []
    catalog.put("/", "group")
    m = catalog.create_indexed_group("/", "Measurement")
    assert m == "/Measurement_000" and catalog.create_indexed_group("/", "Measurement_") == "/Measurement_001"
    catalog.put("/Measurement_007", "group")
    assert catalog.create_indexed_group("/", "Measurement") == "/Measurement_008"
    catalog.put(f"{m}/raw", "main", {"quantity": "Q", "units": "u", "pos_dims": [1], "spec_dims": [1]})
    r = catalog.create_results_group(f"{m}/raw", "Fitter", {"p": 1})
    assert r == f"{m}/raw-Fitter_000" and catalog.create_results_group(f"{m}/raw", "Fit", {"p": 2}) == f"{m}/raw-Fit_000"
    assert [x["path"] for x in catalog.results_groups(f"{m}/raw", "Fit")] == [f"{m}/raw-Fit_000"]
    assert len(catalog.results_groups(f"{m}/raw", "Fit", contains=True)) == 2
    assert [x["path"] for x in catalog.check_for_old(f"{m}/raw", "Fitter", {"p": 1})] == [r] and catalog.check_for_old(f"{m}/raw", "Fitter", {"p": 5}) == []
    assert catalog.source_of(r) == f"{m}/raw"
    with pytest.raises(ValueError):
        catalog.source_of("/a-b-c_000")
    assert catalog.tree(m) == ["raw", "raw-Fit_000", "-----------", "raw-Fitter_000", "--------------"]
    assert catalog.tree(m, relative=True) == ["raw", "raw-Fit_000", "raw-Fitter_000"]
    assert "  raw" in catalog.tree() and [x["path"] for x in catalog.find("raw")] == [f"{m}/raw"]
    assert [x["name"] for x in catalog.among(["raw"], [f"{m}/raw", r])] == ["raw"]
    catalog.delete(f"{m}/raw")
    assert not catalog.exists(f"{m}/raw") and catalog.all_main() == []
    with pytest.raises(KeyError):
        catalog.get(f"{m}/raw")


def test_main_datasets(spark, catalog):
    grid = from_array(spark, DATA, POS, SPEC, quantity="Current", units="A")
    path = catalog.write_main("/m/my-data", grid, {"note": "n"})
    assert path == "/m/my_data" and catalog.all_main() == [path]
    back = catalog.open(path, check=True)
    assert (back.quantity, back.units) == ("Current", "A") and list(back.pos_dims) == POS
    assert np.array_equal(dense(back.coords(), [*reversed(POS), *reversed(SPEC)]), DATA.reshape(3, 5, 2, 7))
    with pytest.raises(KeyError):
        catalog.write_main("/m/my_data", grid)
    empty = catalog.create_empty(path, "float", "/m/zeros", {"k": 1})
    zeros = catalog.open(empty)
    assert dict(zeros.main.dtypes)["spectrum"] == "array<float>" and zeros.coords().agg(F.sum("value")).first()[0] == 0
    assert catalog.create_empty(path, "float", "/m/zeros") == empty
    catalog.create_empty(path, "double", "/m/zeros")
    assert dict(catalog.open(empty).main.dtypes)["spectrum"] == "array<double>"
    catalog.copy_attrs(path, empty)
    assert catalog.get(empty)["attrs"]["quantity"] == "Current"
    catalog.write_table("/m/plain", grid.main)
    with pytest.raises(TypeError):
        catalog.open("/m/plain")
    catalog.link_as_main("/m/plain", POS, SPEC, "Q", "u")
    assert catalog.open("/m/plain").units == "u"
    validate_dims_against((15, 14), POS, False)
    with pytest.raises(ValueError):
        validate_dims_against((15, 14), POS)


def test_aborted_measurement(spark, catalog):
    """31 of 5 x 7 positions: fewer than the full grid are accepted where dimensions are incomplete, and only these."""
    axes = (("X", 7), ("Y", 5))
    data = np.random.default_rng(4).random((31, 14))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(data)], "k long, a array<double>")
    sparse = lambda df, mode: Grid.from_wide(df, F.col("k"), F.col("a"), [Dimension(n, "um", size, mode=mode) for n, size in axes], SPEC)
    path = catalog.write_main("/m/aborted", sparse(rows, DimMode.INCOMPLETE))
    back = catalog.open(path, check=True)
    assert back.shape == (35, 14) and back.main.count() == 31 and {d.mode for d in back.pos_dims} == {DimMode.INCOMPLETE}
    assert catalog.get(path)["attrs"]["rows"] == 31
    held = {(r.X_ind, r.Y_ind): r.spectrum for r in back.main.collect()}
    assert held == {(k % 7, k // 7): x.tolist() for k, x in enumerate(data)}
    with pytest.raises(ValueError, match="31 rows"):
        catalog.open(catalog.write_main("/m/full", sparse(rows, DimMode.DEFAULT)), check=True)
    mean = lambda: Process(catalog, path, "Mean", {}, fn=lambda s: float(np.mean(s)), batches=2)
    run = mean().compute()
    assert mean().complete == [run]
    # A position that comes twice, one past the grid, short arrays, and rows lost after they were written.
    for name, df in (("twice", rows.union(rows.limit(1))), ("past", rows.withColumn("k", F.col("k") + 10)), ("short", rows.withColumn("a", F.slice("a", 1, 13)))):
        with pytest.raises(ValueError):
            catalog.open(catalog.write_main(f"/m/{name}", sparse(df, DimMode.INCOMPLETE)), check=True)
    back.main.where("pos_idx < 30").write.parquet(catalog.folder("/m/other"))
    catalog.put("/m/other", "main", catalog.get(path)["attrs"])
    with pytest.raises(ValueError, match="30 rows.*31 positions"):
        catalog.open("/m/other", check=True)


def test_regions(spark, catalog):
    grid = from_array(spark, DATA, POS, SPEC)
    path = catalog.write_main("/m/a", grid)
    other = catalog.write_main("/m/b", grid.reduce_grid(["Y"], "mean"))
    catalog.save_region(path, "even_rows", "pos_idx % 2 = 0")
    catalog.save_region(path, "first_line", "Y_ind = 0")
    assert catalog.region(path, "even_rows").count() == 8
    assert catalog.copy_regions(path, other) == ["even_rows"]


def test_translate(catalog):
    path = translate(catalog, DATA, "Test", "Current", "nA", POS, SPEC, params={"a": 1, "b": {"c": 2}}, extra={"dset_1": np.arange(5), "dset_2": np.arange(25.0).reshape(5, 5)})
    assert path == "/Measurement_000/Channel_000/Raw_Data"
    assert catalog.get("/Measurement_000")["attrs"]["b-c"] == 2 and catalog.get("/")["attrs"]["data_type"] == "Test"
    assert catalog.get("/Measurement_000/Channel_000/dset_2")["attrs"]["shape"] == [5, 5]
    assert catalog.open(path, check=True).quantity == "Current"
    with pytest.raises(KeyError):
        translate(catalog, DATA, "Test", "Q", "u", POS, SPEC, extra={"Raw_Data": [1]})
    with pytest.raises(TypeError):
        translate(catalog, DATA, 5, "Q", "u", POS, SPEC)


def test_images(spark, catalog, tmp_path):
    a = np.random.default_rng(5).integers(0, 256, (12, 8)).astype(float)
    np.savetxt(tmp_path / "a.csv", a, delimiter=",")
    np.savetxt(tmp_path / "a.txt", a)
    for name in ("a.csv", "a.txt"):
        px = read_image(spark, str(tmp_path / name))
        got = np.zeros((12, 8))
        for r in px.collect():
            got[r.y, r.x] = r.value
        assert np.array_equal(got, a)
    means = {(r.y, r.x): r.value for r in resample(px, (3, 2)).collect()}
    assert all(np.isclose(means[y, x], a[3 * y : 3 * y + 3, 2 * x : 2 * x + 2].mean()) for y in range(4) for x in range(4))
    assert {(r.y, r.x): r.value for r in resample(px, 2, "nearest").collect()}[1, 1] == a[2, 2]
    with pytest.raises(NotImplementedError):
        resample(px, 2, "bicubic")
    ends = normalised(px).agg(F.min("value"), F.max("value")).first()
    assert tuple(ends) == (0.0, 1.0)
    g = image_grid(px, 12, 8)
    g.check()
    assert [r.spectrum[0] for r in g.main.orderBy("pos_idx").collect()] == list(a.T.ravel())
    path = translate_image(catalog, str(tmp_path / "a.csv"), 2, normalise=True)
    assert catalog.open(path, check=True).shape == (24, 1)


def test_png(spark, tmp_path):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    a = np.arange(6 * 5, dtype=np.uint8).reshape(6, 5) * 8
    raw = b"".join(b"\0" + row.tobytes() for row in a)
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    got = {(r.y, r.x): r.value for r in read_image(spark, str(tmp_path / "a.png")).collect()}
    assert got == {(y, x): float(a[y, x]) for y in range(6) for x in range(5)}
