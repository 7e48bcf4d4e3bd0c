"""Helpers shared by the text operators: column access, lineage cuts, joins on hot keys, packed rows."""

from __future__ import annotations

import gc
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rule: code points 32 and 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
#: A word: a maximal run of other characters.
WORD = r"[^\x20\x09-\x0D]+"


def c(name: str) -> Column:
    """A top-level column of exactly this name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: spark.checkpoint.dir. Where it is unset a local session gets a temporary one
    (tests); on a cluster that is an error, as a folder of one machine would not be seen by the others."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gridspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: later reads survive the loss of any executor."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def drop_unused(spark: SparkSession) -> None:
    """Spark deletes the files of shuffles and checkpoints only once the driver's JVM has collected what stood for them, and
    a driver with free memory does that late. This asks for it: everything that lies behind a cut and is not used again goes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows so few that one task may hold them all.
FEW_ROWS = 10_000


def hot_keys(df: DataFrame, key: str, share: int = 200) -> list:
    """Keys that hold more than 1/share of df's rows: share values at most, whatever the size of df; none of few rows."""
    total = df.count()
    if total <= FEW_ROWS:
        return []
    counts = df.groupBy(key).count()
    return [r[0] for r in counts.where(F.col("count") * share > total).select(key).collect() if r[0] is not None]


def salted_join(many: DataFrame, one: DataFrame, key: str, hot: list, how: str = "left", salts: int = 64) -> DataFrame:
    """many joined to one (a row per key) on key. Rows of hot keys are dealt over `salts` tasks, and only the
    rows of `one` with those keys (as many as `hot` has, at most) are copied for each salt."""
    if not hot:
        return many.join(one, key, how)
    is_hot = F.col(key).isin(hot)
    spread = F.pmod(F.xxhash64(*[c(x) for x in many.columns]), F.lit(salts)).cast("int")
    left = many.withColumn("__salt", F.when(is_hot, spread).otherwise(0))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = one.withColumn("__salt", F.explode(every))
    return left.join(right, [key, "__salt"], how).drop("__salt")


def total_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts."""
    return df.agg(F.sum(F.octet_length(c(text)).cast("long"))).first()[0] or 0


def about_bytes(df: DataFrame, text: str) -> int:
    """Roughly the bytes of all texts, to choose a number of tasks: twice the files' size where the plan knows it (text
    packs to about half), else counted."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 2 * known if known < 1 << 60 else total_bytes(df, text)


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on rows of this session go to Python workers by BATCH_BYTES at most, or the session's own limit if
    that is lower. Spark's defaults (10,000 rows or 64 MB) take that memory several times over, in the JVM and in the
    worker. No result depends on it."""
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(run):
    """A batch function that gives memory back to the system when its task ends: workers are used again by other stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def lean_group(run):
    """As `lean`, for a function of a group's table."""

    def wrapped(table):
        try:
            return run(table)
        finally:
            release()

    return wrapped


def release() -> None:
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pack(bucket: np.ndarray, records: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """Rows (kind, bucket, blob): the records of each bucket as one binary value, in no order."""
    order = np.argsort(bucket, kind="stable")
    b, r = bucket[order], records[order]
    at = np.flatnonzero(np.diff(b)) + 1
    first = np.r_[0, at] if len(b) else np.zeros(0, np.int64)
    blobs = [x.tobytes() for x in np.split(r, at)] if len(b) else []
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(first), kind, np.int32)), pa.array(b[first].astype(np.int64)), pa.array(blobs, pa.binary())],
        names=["kind", "bucket", "blob"],
    )


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string array, null as empty, with bytes shared with the array where possible."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = int(offsets[0]) if len(offsets) else 0
    hi = int(offsets[-1]) if len(offsets) else 0
    return data[lo:hi], offsets[:-1] - lo, offsets[1:] - lo
