import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as registry
from gridspark import queries as grid_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return "null"
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(grid_queries.queries()))
def test_against_sql(spark, sf, duck, name):
    got = grid_queries.queries()[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows or name == "e06_slice_all_dims"
    sql = grid_queries.oracle_sql()[name]
    found = duck.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert rows == want


@pytest.mark.parametrize("rows", [57, 7])
def test_last_line_cut_short(spark, sf, tmp_path, rows, name="k01_write_and_open"):
    """Embeddings whose number is no multiple of the 20 positions of a line."""
    con = duckdb.connect()
    con.execute(f"copy (from '{sf}/embeddings.parquet' where vec_id < {rows}) to '{tmp_path}/embeddings.parquet'")
    con.execute(f"create view embeddings as from '{tmp_path}/embeddings.parquet'")
    got = grid_queries.queries()[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({grid_queries.oracle_sql()[name]})").fetchall()
    assert len(want) == 64 * rows
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_products_with_zeros_and_beyond_doubles(spark, tmp_path):
    """Groups with a 0, also beside a product that is infinite without it, and one that leaves the range on its way only."""
    name = "e19_reduce_nanprod"
    groups = {20: [3.0, 0.0, 2.0], 21: [1e200, 1e200, 0.0], 22: [1e200, 1e200, 1e-200], 23: [1e-200, 1e-200, 1e300], 24: [1e200, 1e200], 25: [2.0, 5.0], 26: [math.nan]}
    rows = [(2 * k + 1, u, v) for k, (u, v) in enumerate((u, v) for u, vs in groups.items() for v in vs)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as from '{tmp_path}/events.parquet/*.parquet'")
    want = dict(con.execute(grid_queries.oracle_sql()[name]).fetchall())
    assert want[20] == want[21] == -math.inf and want[24] == math.inf and want[26] == 0
    assert {r["user_id"]: r["v"] for r in grid_queries.queries()[name](spark, str(tmp_path)).collect()} == want


def test_registry(spark):
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.entry(spark).count() > 0


def test_works_without_the_text_operators(tmp_path):
    """The library and the entry module import where gridspark/llm and corpus_pipeline.py are not."""
    here = os.path.dirname(os.path.abspath(registry.__file__))
    subprocess.run(["cp", "-r", f"{here}/gridspark", f"{here}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/gridspark/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q) and len(q) > 40; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
