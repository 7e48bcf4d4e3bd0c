"""HDF5 files as a Spark data source, where h5py is installed: format("grid_hdf5"), options path, dataset, rows.

Each task reads a block of rows: (pos_idx, spectrum)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Rows(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.dataset, self.rows = options["path"], options["dataset"], int(options.get("rows", 10_000))

    def _open(self):
        try:
            import h5py
        except ImportError as e:
            raise ImportError("reading HDF5 needs h5py, which is not installed") from e
        return h5py.File(self.path, "r")

    def partitions(self):
        with self._open() as f:
            n = f[self.dataset].shape[0]
        return [Rows(a, min(n, a + self.rows)) for a in range(0, n, self.rows)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        with self._open() as f:
            for i, row in enumerate(f[self.dataset][partition.start : partition.stop], partition.start):
                yield i, [float(x) for x in row]


class GridHdf5(DataSource):
    @classmethod
    def name(cls) -> str:
        return "grid_hdf5"

    def schema(self) -> str:
        return "pos_idx long, spectrum array<double>"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)
