"""Mixing sources to target weights with hash-threshold histograms.

Each document has a fixed pseudo-random key, the hex MD5 of its id. A source with target t and size s is taken
floor(t / s) times whole; for the rest, documents whose key lies below a threshold of the source are taken once more.
The threshold is found without sorting: sizes are summed by source and the first digits of the key, the bucket where the
running sum passes the budget is the boundary, and only that bucket is summed again by the next digits. When a bucket
holds one key, it goes in if that comes nearer to the budget.

Weights: targets share `total` in proportion to weight, none above `cap` times its source's size; what is cut off is
shared again among the others, which in the end means: sources in ascending order of cap / weight are capped as long as
their share of what is left exceeds their cap.

Rows: a null source is a source of its own; null text has size 0; a null id hashes as an empty string. Rows of equal id
share a key and are taken together. A source of size 0 has target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.llm.common import c, cut, hot_keys, salted_join

#: Hex digits by which one level refines the last; 32 digits in all.
DIGITS = 3
#: Sources up to which the table of targets is broadcast.
BROADCAST_SOURCES = 10_000


def key_of(id: Column, seed: str = "") -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(id.cast("string"), F.lit(""))))


def cycled_weights(sizes: DataFrame, weights: list[int]) -> DataFrame:
    """sizes (source, source_size) with weight: sources by code point, null last, take the weights in turn."""
    # One row per source, so one task; documents are never here.
    n = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int")))


def targets(weighted: DataFrame, percent: int = 150, cap: int = 2) -> DataFrame:
    """weighted (source, source_size, weight: integers) with target. Sums stay integers up to one last division."""
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    everything = Window.partitionBy(F.lit(0))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    w = weighted.select(
        "*",
        F.sum("source_size").over(everything).alias("__all"),
        (F.sum("weight").over(everything) - zero(F.sum("weight").over(before))).alias("__w"),
        zero(F.sum("source_size").over(before)).alias("__s"),
    )
    # Times 100, what is left for this source and those after it, if all before it are capped.
    left = F.col("__all") * percent - F.col("__s") * (100 * cap)
    capped = F.col("source_size") * (100 * cap) * F.col("__w") <= left * F.col("weight")
    w = w.withColumn("__capped", capped)
    # The first source that is not capped fixes the share for itself and all after it.
    first = F.min(F.when(~F.col("__capped"), F.struct(F.col("source_size") / F.col("weight"), "__s", "__w"))).over(everything)
    w = w.withColumn("__first", first)
    share = (F.col("weight") * (F.col("__all") * percent - F.col("__first.__s") * (100 * cap))).cast("double") / (F.col("__first.__w") * 100)
    target = F.when(F.col("__capped") | F.col("__first").isNull(), (F.col("source_size") * cap).cast("double")).otherwise(share)
    return w.withColumn("target", target).drop("__all", "__w", "__s", "__capped", "__first")


def named(source: Column) -> Column:
    """A source's name in joins, where null must meet null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def plan(sized: DataFrame, weights: list[int], percent: int = 150, cap: int = 2, seed: str = "") -> DataFrame:
    """sized (id, source, size long) to one row per source: s, source_size, target, whole (copies of every document),
    below (documents with a key below it are taken once more)."""
    rows = sized.select(named(F.col("source")).alias("s"), "source", "size", key_of(F.col("id"), seed).alias("key"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = targets(cycled_weights(sizes, weights), percent, cap).select(named(F.col("source")).alias("s"), "source_size", "target")
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    found = cut(found.withColumn("whole", whole))
    open_ = found.where(F.col("whole") < cap)
    budget = F.col("target") - F.col("whole") * F.col("source_size")
    return found.join(thresholds(rows.select("s", "key", "size"), open_.select("s", budget.alias("budget"))), "s", "left")


def take(rows: DataFrame, id: Column, source: Column, planned: DataFrame, seed: str = "") -> DataFrame:
    """rows with source_size, target and copies: how often each is taken. Rows pass where they are; nothing is sorted."""
    rows = rows.withColumn("__s", named(source)).withColumn("__key", key_of(id, seed))
    planned = cut(planned.withColumnRenamed("s", "__s"))
    if planned.count() <= BROADCAST_SOURCES:
        both = rows.join(F.broadcast(planned), "__s", "left")
    else:
        both = salted_join(rows, planned, "__s", hot_keys(rows, "__s"))
    more = F.coalesce(F.col("__key") < F.col("below"), F.lit(False)).cast("int")
    return both.withColumn("copies", F.col("whole") + more).drop("__s", "__key", "whole", "below")


def mix(sized: DataFrame, weights: list[int], percent: int = 150, cap: int = 2, seed: str = "") -> DataFrame:
    """sized (id, source, size long, and any other columns) with source_size, target, copies: how often each row is
    taken, at most `cap`."""
    return take(sized, F.col("id"), F.col("source"), plan(sized, weights, percent, cap, seed), seed)


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(s, below): each source's extra documents are those with key < below (every key is below "~")."""
    base = None
    found: DataFrame | None = None
    for level in range(1, 32 // DIGITS + 2):
        digits = min(32, level * DIGITS)
        bucket = F.substring("key", 1, digits)
        if base is None:
            inside, state = rows, budgets.withColumn("base", F.lit(0).cast("long"))
        else:
            # Only rows of boundary buckets: joined on source and bucket, so a large source is dealt over its buckets.
            inside = rows.withColumn("last", F.substring("key", 1, (level - 1) * DIGITS)).join(base.select("s", "last"), ["s", "last"], "left_semi")
            state = base.select("s", "budget", "base")
        sums = inside.groupBy("s", bucket.alias("b")).agg(F.sum("size").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("s").orderBy("b"))
        run = state.join(sums, "s").withColumn("upto", F.col("base") + upto)
        # The first bucket that passes the budget, if any.
        edge = run.where("upto > budget").groupBy("s", "budget").agg(F.min(F.struct("b", "upto", "n", "lo", "hi")).alias("e"))
        edge = cut(edge.select("s", "budget", "e.*").withColumn("base", F.col("upto") - F.col("n")))
        none = state.join(edge.select("s"), "s", "left_anti").select("s", F.lit("~").alias("below"))
        # A bucket of one key is settled: in, if that comes nearer.
        one = edge.where("lo = hi").select("s", F.when(F.col("budget") - F.col("base") >= F.col("n") / 2.0, F.concat("lo", F.lit("!"))).otherwise(F.col("lo")).alias("below"))
        done = none.union(one)
        found = done if found is None else found.union(done)
        base = edge.where("lo <> hi").select("s", "budget", "base", F.col("b").alias("last"))
        if base.isEmpty():
            break
    return found
