"""The catalog: what datasets, groups and runs there are, with their attributes.

Metadata only, one row per object and change, in Parquet under <root>/_catalog; the latest change of a path counts.
Values of attributes are JSON."""

from __future__ import annotations

import json
import math
import platform
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.plans.dimension import Dimension, DimMode, close

SCHEMA = "path string, parent string, name string, kind string, attrs string, version long"
LIBRARY_VERSION = "0.1"
GROUP, MAIN, TABLE, VIEW = "group", "main", "table", "view"


def join_path(*parts: str) -> str:
    return "/" + "/".join(p.strip("/") for p in parts if p.strip("/"))


def split_path(path: str) -> tuple[str, str]:
    head, _, tail = join_path(path).rpartition("/")
    return head or "/", tail


def matches(have: dict, want: dict | None) -> bool:
    """Whether `have` holds everything in `want`: numbers and arrays of numbers closely, all else exactly. None in
    `want` is skipped, a key that is missing is a mismatch."""
    for key, new in (want or {}).items():
        if new is None:
            continue
        if key not in have:
            return False
        old = have[key]
        if isinstance(new, list | tuple):
            if not isinstance(old, list | tuple) or len(old) != len(new) or not all(_same(a, b) for a, b in zip(old, new, strict=True)):
                return False
        elif not _same(old, new):
            return False
    return True


def _same(a, b) -> bool:
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    return close(float(a), float(b)) if number(a) and number(b) else type(a) is type(b) and a == b


def flatten_attrs(attrs: dict, prefix: str = "") -> dict:
    """Nested dictionaries as one level, keys joined by a dash."""
    out = {}
    for k, v in attrs.items():
        key = f"{prefix}-{k}" if prefix else str(k)
        out |= flatten_attrs(v, key) if isinstance(v, dict) else {key: v}
    return out


def book_keeping() -> dict:
    return {"library_version": LIBRARY_VERSION, "timestamp": time.strftime("%Y_%m_%d-%H_%M_%S"), "machine_id": platform.node(), "platform": platform.platform()}


def dims_to_json(dims) -> list[dict]:
    return [{"name": d.name, "units": d.units, "values": list(d.steps), "quantity": d.quantity, "dim_type": d.dim_type, "mode": int(d.mode)} for d in dims]


def dims_from_json(found: list[dict]) -> list[Dimension]:
    return [Dimension(x["name"], x["units"], x["values"], x["quantity"], x["dim_type"], DimMode(x["mode"])) for x in found]


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _there(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_catalog")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def objects(self) -> DataFrame:
        """The latest row of every object that was not deleted."""
        if not self._there():
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/_catalog")
        last = rows.groupBy("path").agg(F.max_by(F.struct("parent", "name", "kind", "attrs", "version"), "version").alias("x"))
        return last.select("path", "x.*").where("kind <> 'deleted'")

    def put(self, path: str, kind: str, attrs: dict | None = None) -> None:
        path = join_path(path)
        parent, name = split_path(path)
        row = (path, parent, name, kind, json.dumps(attrs or {}), time.time_ns())
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/_catalog")

    def delete(self, path: str) -> None:
        self.put(path, "deleted")

    def rows(self, where=None) -> list[dict]:
        found = self.objects() if where is None else self.objects().where(where)
        return [{**r.asDict(), "attrs": json.loads(r["attrs"])} for r in found.orderBy("path").collect()]

    def get(self, path: str) -> dict:
        if not (found := self.rows(F.col("path") == join_path(path))):
            raise KeyError(f"nothing at {join_path(path)}")
        return found[0]

    def exists(self, path: str) -> bool:
        return not self.objects().where(F.col("path") == join_path(path)).isEmpty()

    def under(self, parent: str):
        p = join_path(parent)
        return F.lit(True) if p == "/" else (F.col("path") == p) | F.col("path").startswith(p + "/")

    # Search.
    def all_main(self, parent: str = "/") -> list[str]:
        return [r["path"] for r in self.rows(self.under(parent) & (F.col("kind") == MAIN))]

    def find(self, name: str, parent: str = "/") -> list[dict]:
        return self.rows(self.under(parent) & (F.col("name") == name))

    def among(self, names: list[str], paths: list[str]) -> list[dict]:
        """The objects of `paths` with one of these names."""
        return self.rows(F.col("path").isin([join_path(p) for p in paths]) & F.col("name").isin(names))

    def tree(self, parent: str = "/", relative: bool = False, main_only: bool = False) -> list[str]:
        """One line per object: its relative path, or its name indented by depth with dashes under groups."""
        base = join_path(parent)
        depth0 = 0 if base == "/" else base.count("/")
        lines = []
        for r in self.rows(self.under(parent)):
            if r["path"] == base or (main_only and r["kind"] not in (MAIN, GROUP)):
                continue
            inner = r["path"][len(base) :].strip("/") if base != "/" else r["path"].strip("/")
            if relative:
                lines.append(inner)
                continue
            pad = "  " * (r["path"].count("/") - depth0 - 1)
            lines.append(pad + r["name"])
            if r["kind"] == GROUP:
                lines.append(pad + "-" * len(r["name"]))
        return lines

    # Indexed groups.
    def next_name(self, parent: str, prefix: str) -> str:
        """prefix_NNN with the number after the greatest there is; gaps are not filled."""
        prefix = prefix.strip()
        if not prefix:
            raise ValueError("a group needs a name")
        prefix = prefix if prefix.endswith("_") else prefix + "_"
        number = F.regexp_extract("name", r"_(\d+)$", 1)
        same = (F.col("parent") == join_path(parent)) & F.col("name").startswith(prefix) & (F.length(F.col("name")) == F.length(number) + len(prefix))
        last = self.objects().where(same & (number != "")).agg(F.max(number.cast("int"))).first()[0]
        return f"{prefix}{0 if last is None else last + 1:03d}"

    def create_indexed_group(self, parent: str, prefix: str, attrs: dict | None = None) -> str:
        path = join_path(parent, self.next_name(parent, prefix.replace("-", "_") if "-" in prefix else prefix))
        self.put(path, GROUP, book_keeping() | (attrs or {}))
        return path

    def create_results_group(self, source: str, tool: str, params: dict | None = None, parent: str | None = None) -> str:
        """<source>-<tool>_NNN beside the source (or in `parent`), with what it was made from and with."""
        if "-" in tool:
            tool = tool.replace("-", "_")
        where, name = split_path(source)
        parent = where if parent is None else parent
        path = join_path(parent, self.next_name(parent, f"{name}-{tool.strip()}"))
        self.put(path, GROUP, book_keeping() | {"source": join_path(source), "tool": tool, "params": params or {}})
        return path

    def results_groups(self, source: str, tool: str, parent: str | None = None, contains: bool = False) -> list[dict]:
        """Groups of results of a dataset and tool: exactly these, or with `contains` by parts of their names."""
        where, name = split_path(source)
        here = (F.col("parent") == join_path(parent if parent is not None else where)) & (F.col("kind") == GROUP)
        if contains:
            return self.rows(here & F.col("name").contains(name) & F.col("name").contains(tool))
        return [r for r in self.rows(here & F.col("name").startswith(f"{name}-{tool}_")) if r["attrs"].get("source", join_path(source)) == join_path(source)]

    def check_for_old(self, source: str, tool: str, params: dict | None = None, parent: str | None = None) -> list[dict]:
        """Groups of results with the same parameters."""
        return [r for r in self.results_groups(source, tool, parent) if matches(r["attrs"].get("params", {}), params)]

    def source_of(self, group: str) -> str:
        """The dataset that a <source>-<tool>_NNN group comes from."""
        where, name = split_path(group)
        if name.count("-") != 1:
            raise ValueError(f"{name!r} is not named <source>-<tool>_NNN")
        found = join_path(where, name.split("-")[0])
        if not self.exists(found):
            raise KeyError(f"nothing at {found}")
        return found

    # Datasets.
    def folder(self, path: str) -> str:
        return f"{self.root}{join_path(path)}"

    def write_table(self, path: str, df: DataFrame, attrs: dict | None = None, kind: str = TABLE, counted: bool = False) -> str:
        """A table at a free path. With `counted`, its attribute `rows` is what was written, as the files' footers say."""
        path = join_path(path)
        if self.exists(path):
            raise KeyError(f"{path} is taken")
        df.write.mode("overwrite").parquet(self.folder(path))
        if counted:
            attrs = (attrs or {}) | {"rows": self.spark.read.schema(df.schema).parquet(self.folder(path)).count()}
        self.put(path, kind, attrs)
        return path

    def write_main(self, path: str, grid, attrs: dict | None = None) -> str:
        """A grid as a main dataset, sorted by position so that files and row groups hold ranges of them."""
        parent, name = split_path(path)
        path = join_path(parent, name.replace("-", "_"))
        for what in (grid.quantity, grid.units):
            if not isinstance(what, str):
                raise TypeError("quantity and units are strings")
        rows = grid.main.repartitionByRange("pos_idx").sortWithinPartitions("pos_idx")
        found = {"quantity": grid.quantity, "units": grid.units, "pos_dims": dims_to_json(grid.pos_dims), "spec_dims": dims_to_json(grid.spec_dims)}
        return self.write_table(path, rows, (attrs or {}) | book_keeping() | found, MAIN, counted=True)

    def open(self, path: str, check: bool = False):
        """The grid at a path. With `check`, rows and array lengths are counted."""
        from gridspark.operators.grid import Grid

        r = self.get(path)
        if not is_main(r):
            raise TypeError(f"{r['path']} is no main dataset")
        a = r["attrs"]
        found = Grid.of(self.spark.read.parquet(self.folder(path)), dims_from_json(a["pos_dims"]), dims_from_json(a["spec_dims"]), quantity=a["quantity"], units=a["units"], name=r["name"])
        if check:
            found.check(a.get("rows"))
        return found

    def create_empty(self, source: str, dtype: str, path: str, attrs: dict | None = None) -> str:
        """A dataset of the source's shape with zeros of another element type; one of the same kind is used again."""
        a = self.get(source)["attrs"]
        path = join_path(path)
        if self.exists(path):
            if self.get(path)["attrs"].get("dtype") == dtype:
                self.put(path, MAIN, self.get(path)["attrs"] | (attrs or {}))
                return path
            self.delete(path)
        width = math.prod(len(d["values"]) for d in a["spec_dims"])
        zeros = self.spark.read.parquet(self.folder(source)).withColumn("spectrum", F.array_repeat(F.lit(0).cast(dtype), width))
        return self.write_table(path, zeros, a | {"dtype": dtype} | (attrs or {}), MAIN)

    def copy_attrs(self, source: str, target: str, names: tuple[str, ...] = ("quantity", "units")) -> None:
        have, r = self.get(source)["attrs"], self.get(target)
        self.put(target, r["kind"], r["attrs"] | {k: have[k] for k in names})

    def link_as_main(self, path: str, pos_dims, spec_dims, quantity: str, units: str) -> None:
        """Makes a table (pos_idx, <dimension>_ind..., spectrum) a main dataset."""
        r = self.get(path)
        self.put(path, MAIN, r["attrs"] | {"pos_dims": dims_to_json(pos_dims), "spec_dims": dims_to_json(spec_dims), "quantity": quantity, "units": units})

    # Saved regions: named conditions on positions.
    def save_region(self, path: str, name: str, condition: str) -> None:
        self.put(join_path(path, f"@{name}"), VIEW, {"condition": condition, "of": join_path(path)})

    def region(self, path: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self.folder(path)).where(self.get(join_path(path, f"@{name}"))["attrs"]["condition"])

    def copy_regions(self, source: str, target: str) -> list[str]:
        """Copies saved regions whose columns the target has; returns their names."""
        have = self.spark.read.parquet(self.folder(target))
        copied = []
        for r in self.rows((F.col("parent") == join_path(source)) & (F.col("kind") == VIEW)):
            try:
                have.where(r["attrs"]["condition"]).schema  # noqa: B018 - resolves the columns
            except Exception as e:
                if type(e).__name__ != "AnalysisException":
                    raise
                continue
            self.save_region(target, r["name"][1:], r["attrs"]["condition"])
            copied.append(r["name"][1:])
        return copied

    def temporary(self, kind: str) -> str:
        return f"{self.root}/_tmp/{kind}-{uuid.uuid4().hex}"


def is_main(row: dict) -> bool:
    """Whether a catalog row describes a main dataset in full."""
    a = row["attrs"]
    texts = all(isinstance(a.get(k), str) for k in ("quantity", "units"))
    return row["kind"] == MAIN and texts and bool(a.get("pos_dims")) and bool(a.get("spec_dims"))


def validate_dims_against(shape: tuple[int, int], dims, spectroscopic: bool = True) -> None:
    n = math.prod(len(d) for d in dims)
    if n != shape[1 if spectroscopic else 0]:
        raise ValueError(f"dimensions make {n} steps, the data have {shape[1 if spectroscopic else 0]}")
