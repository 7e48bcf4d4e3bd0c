"""Token counts as delta-maintained rollups.

A rollup is a folder with two logs, both partitioned by batch: `deltas` (signed sums per key) and `commits` (one row per
finished batch). A batch of changes - inserts (+), deletes (-), revisions (the old count out, the new one in) - is
summed per source, language and tokenizer version and written as one partition, then committed. Writing a batch again
replaces its partition, and a committed batch is not written again, so retries and replays change nothing. Totals add
up the deltas of committed batches; ``compact`` folds them into one and remembers their names.

Sums are map-side combined, so one key with most of the rows costs no more than others. Nulls: a null source or
language is a key of its own; a null text counts 0 tokens and 1 document; a null change kind or a null tokenizer version
is an error, raised before anything is written. Keys whose documents and tokens cancel out stay out of the totals. Repeated
rows of one batch each count. An empty batch can be committed.
"""

from __future__ import annotations

import hashlib
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.tokenize import encoder

#: The batch that compaction writes.
BASE = "base"
KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
SIGNS = {"insert": 1, "delete": -1}


def words(text: Column) -> Column:
    """Tokenizer words/1: runs of characters other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def words_and_marks(text: Column) -> Column:
    """Tokenizer words/2: runs of letters and digits, and every other character that is not white space by itself."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]")), F.lit(0)).cast("long")


TOKENIZERS = {"words/1": words, "words/2": words_and_marks}


def library_tokenizer(path: str) -> tuple:
    """(version, count) of a tokenizer file: its name and the start of its digest, and a function of a text column."""
    with open(path, "rb") as f:
        version = f"{os.path.basename(path)}@{hashlib.sha256(f.read()).hexdigest()[:12]}"

    def count(texts: pd.Series) -> pd.Series:
        enc = encoder(path, special_strings=True)
        return pd.Series([len(x) // enc.dtype.itemsize for x in enc.encode([t if isinstance(t, str) else "" for t in texts])], dtype="int64")

    return version, lambda text: F.pandas_udf(count, "long")(text.cast("string"))


def inserts(df: DataFrame, source: Column, lang: Column, tokenizer: str, tokens: Column) -> DataFrame:
    """Changes (change, source, lang, tokenizer, tokens) that add a document each."""
    return df.select(F.lit("insert").alias("change"), source.cast("string").alias("source"), lang.cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), tokens.cast("long").alias("tokens"))


def deletes(df: DataFrame, source: Column, lang: Column, tokenizer: str, tokens: Column) -> DataFrame:
    return inserts(df, source, lang, tokenizer, tokens).withColumn("change", F.lit("delete"))


def revisions(df: DataFrame, source: Column, lang: Column, old: tuple[str, Column], new: tuple[str, Column]) -> DataFrame:
    """Changes that take each document's old count out and put its new one in; versions may differ. One pass over df."""
    one = lambda change, x: F.struct(F.lit(change).alias("change"), F.lit(x[0]).alias("tokenizer"), x[1].cast("long").alias("tokens"))
    both = df.select(source.cast("string").alias("source"), lang.cast("string").alias("lang"), F.explode(F.array(one("delete", old), one("insert", new))).alias("x"))
    return both.select("x.change", "source", "lang", "x.tokenizer", "x.tokens")


class Rollup:
    """Totals kept in a folder that all executors and the driver share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def committed(self, batch: str) -> bool:
        if self._exists(f"{self.path}/commits/batch={batch}/_SUCCESS"):
            return True
        base = f"{self.path}/commits/batch={BASE}"
        return self._exists(f"{base}/_SUCCESS") and not self.spark.read.schema("id string").parquet(base).where(F.col("id") == batch).isEmpty()

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch; False if it was committed before, and then nothing is done."""
        if not batch or any(not (x.isalnum() or x in "-_.") for x in batch):
            raise ValueError(f"a batch is named by letters, digits, '-', '_' and '.': {batch!r}")
        if batch == BASE:
            raise ValueError(f"{BASE!r} is the name that compaction uses")
        if self.committed(batch):
            return False
        known = F.col("change").isin(*SIGNS) & F.col("tokenizer").isNotNull()
        sign = F.when(known, F.when(F.col("change") == "insert", 1).otherwise(-1)).otherwise(F.raise_error(F.lit("unknown change, or no tokenizer version")))
        signed = changes.select(*KEYS, sign.cast("long").alias("docs"), (sign * F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))
        sums = signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")
        self.spark.range(1).select(F.lit(batch).alias("id")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches."""
        if not self._exists(f"{self.path}/commits"):
            return self.spark.createDataFrame([], DELTA)
        done = self.spark.read.schema("id string, batch string").parquet(f"{self.path}/commits").select("batch").distinct()
        deltas = self.spark.read.schema(DELTA + ", batch string").parquet(f"{self.path}/deltas")
        summed = deltas.join(done, "batch", "left_semi").groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return summed.where("docs <> 0 or tokens <> 0")

    def compact(self, into: str) -> Rollup:
        """The same totals as the only batch of a new folder; later batches go there. It names the batches that it holds,
        so that they are not taken again."""
        fresh = Rollup(self.spark, into)
        self.totals().write.mode("overwrite").parquet(f"{fresh.path}/deltas/batch={BASE}")
        base = self.spark.range(1).select(F.lit(BASE).alias("id"))
        held = base.union(self.spark.read.schema("id string, batch string").parquet(f"{self.path}/commits").select("id")) if self._exists(f"{self.path}/commits") else base
        held.distinct().coalesce(1).write.mode("overwrite").parquet(f"{fresh.path}/commits/batch={BASE}")
        return fresh
