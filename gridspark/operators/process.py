"""A function applied to every position, with results that outlive an interrupted run.

A run is a results group. Positions are computed in batches; each batch's results are written, then its positions are
marked in the status table. A run that is asked for again - same dataset, tool and parameters - is returned if all its
positions are marked, else goes on with those that are not. Batches written but not marked are overwritten."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.operators.grid import Grid
from gridspark.plans.catalog import Catalog, join_path

#: Batches of one run: their number bounds the jobs that the driver starts.
BATCHES = 16


def map_positions(main: DataFrame, fn: Callable, result: str) -> DataFrame:
    """(pos_idx, result) of fn(spectrum) for each position, in Arrow batches; `result` is its type in DDL."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"pos_idx": b["pos_idx"], "result": [fn(x) for x in b["spectrum"]]})

    return main.select("pos_idx", "spectrum").mapInPandas(run, f"pos_idx long, result {result}")


def map_chunks(main: DataFrame, fn: Callable[[list], list], result: str) -> DataFrame:
    """As map_positions, for a function of a list of spectra that gives a list as long, in the same order."""

    def run(batches):
        for b in batches:
            out = list(fn(list(b["spectrum"])))
            if len(out) != len(b):
                raise ValueError(f"{len(out)} results for {len(b)} positions")
            yield pd.DataFrame({"pos_idx": b["pos_idx"], "result": out})

    return main.select("pos_idx", "spectrum").mapInPandas(run, f"pos_idx long, result {result}")


def pending(main: DataFrame, status: DataFrame) -> DataFrame:
    """Rows of positions that the status table (pos_idx) does not mark."""
    return main.join(status.select("pos_idx").distinct(), "pos_idx", "left_anti")


def moving_mean(df: DataFrame, value: str, partition: list[str], order: list[str], rows: int = 5) -> Column:
    """The mean of this and the rows - 1 rows before it."""
    return F.avg(value).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(1 - rows, 0))


def recommended_partitions(jobs: int, cores: int, lengthy: bool = False, per_core: int = 20) -> int:
    """Tasks for so many jobs: all cores for long ones, otherwise no more than leave each task `per_core` jobs."""
    if jobs < 1 or cores < 1:
        raise ValueError("jobs and cores are positive")
    return min(jobs, cores) if lengthy else max(1, min(cores, jobs // per_core))


class Process:
    """Subclass or call with `fn` (spectrum -> value), or with `expression` (a Column of `spectrum`), which stays in the
    JVM. `result` is the value's type in DDL."""

    name = "Process"
    result = "double"

    def __init__(self, catalog: Catalog, source: str, name: str | None = None, params: dict | None = None, fn: Callable | None = None, expression: Column | None = None, result: str | None = None, target: str | None = None, batches: int = BATCHES):
        self.catalog, self.source, self.params, self.target = catalog, join_path(source), params or {}, target
        self.name, self.result = name or self.name, result or self.result
        if not isinstance(self.params, dict):
            raise TypeError("params is a dictionary")
        self.grid: Grid = catalog.open(source)
        self.fn, self.expression, self.batches = fn or self.map_function, expression, max(1, batches)
        self.run: str | None = None
        found = catalog.check_for_old(self.source, self.name, self.params, target)
        done = {r["path"]: self._marked(r["path"]) for r in found}
        total = self.grid.shape[0]
        if self.grid.incomplete:
            total = catalog.get(self.source)["attrs"].get("rows", total)
        self.complete = [p for p, n in done.items() if n >= total]
        self.partial = [p for p, n in done.items() if 0 < n < total]

    def map_function(self, spectrum):
        raise NotImplementedError("give fn or expression, or override map_function")

    def test(self, position: int = 0):
        """The function's value at one position; nothing is written."""
        row = self._computed(self.grid.main.where(F.col("pos_idx") == position)).first()
        if row is None:
            raise IndexError(f"no position {position}")
        return row["result"]

    def use_partial(self, run: str | None = None) -> None:
        """Chooses the partial run to go on with: the last, if none is named."""
        if not self.partial:
            raise ValueError("there is no partial run")
        chosen = join_path(run) if run else self.partial[-1]
        if chosen not in self.partial:
            raise ValueError(f"{chosen} is none of {self.partial}")
        self.run = chosen

    def compute(self, override: bool = False) -> str:
        """The run's path: a complete one as it is, a partial one gone on with, or a new one."""
        if not override and self.run is None:
            if self.complete:
                self.run = self.complete[-1]
                return self.run
            if self.partial:
                self.use_partial()
        if override or self.run is None:
            self.run = self.catalog.create_results_group(self.source, self.name, self.params, self.target)
        width = -(-self.grid.shape[0] // self.batches)
        left = pending(self.grid.main, self.status(self.run))
        numbers = [r[0] for r in left.select(F.floor(F.col("pos_idx") / width).alias("b")).distinct().orderBy("b").collect()]  # at most `batches`
        for b in numbers:
            # The range is a filter on a stored column, so a batch reads its own part of the source.
            rows = left.where((F.col("pos_idx") >= b * width) & (F.col("pos_idx") < (b + 1) * width))
            self._write(b, rows)
        return self.run

    def _write(self, batch: int, rows: DataFrame) -> None:
        # Named by what was done before, so that a later run of the same range does not replace marked results.
        number = f"{batch:06d}-{self._marked(self.run):012d}"
        at = f"{self.catalog.folder(self.run)}/results/batch={number}"
        self._computed(rows).write.mode("overwrite").parquet(at)
        written = self.catalog.spark.read.parquet(at).select("pos_idx")
        written.write.mode("overwrite").parquet(f"{self.catalog.folder(self.run)}/status/batch={number}")

    def _computed(self, rows: DataFrame) -> DataFrame:
        if self.expression is not None:
            return rows.select("pos_idx", self.expression.cast(self.result).alias("result"))
        return map_positions(rows, self.fn, self.result)

    def _read(self, run: str, what: str, schema: str) -> DataFrame:
        spark = self.catalog.spark
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.catalog.folder(run)}/{what}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(path.toString())

    def status(self, run: str) -> DataFrame:
        """Positions of a run that are done; a run that only says how far it came (`last_pixel`) counts up to there."""
        marked = self._read(run, "status", "pos_idx long, batch string")
        last = self.catalog.get(run)["attrs"].get("last_pixel")
        if last is not None and marked.isEmpty():
            return self.catalog.spark.range(int(last)).withColumnRenamed("id", "pos_idx")
        return marked.select("pos_idx")

    def _marked(self, run: str) -> int:
        return self.status(run).distinct().count()

    def results(self, run: str | None = None) -> DataFrame:
        """(pos_idx, result) of marked batches."""
        run = run or self.run
        schema = f"pos_idx long, result {self.result}, batch string"
        done = self._read(run, "status", "pos_idx long, batch string").select("batch").distinct()
        return self._read(run, "results", schema).join(F.broadcast(done), "batch", "left_semi").select("pos_idx", "result")
