"""Chat formatting of reply trees.

Nodes are messages that name their parent. Iterative self-joins double each node's pointer towards its root (so a tree of
depth d takes log2(d) joins), which gives depth and summed score; leaves are ranked within their tree by score, ties by
node, and the best `top` kept; the same pointer tables then expand each kept leaf to its whole path, and each path
becomes one conversation.

The template writes a turn as ``### role: text</turn>`` and a line feed. In texts and roles, ``\\``, ``</turn>`` and
``###`` (in roles ``:`` too) get a backslash before them, so that marks never occur in a text and ``parse`` gives every
turn back. Loss spans are code point ranges of the formatted string, one for each trained turn's text.

Rows: a null role or text is empty; a null score is 0; a parent that is null or not there makes a root; a null tree is
a tree of its own; nodes with a null id are rows without replies, each one a node however often it is repeated; several rows of one (tree, node) are an error, and so
is a cycle. A conversation is one output row, so its turns meet in one task; conversations themselves are spread.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.llm.common import c, cut

BEGIN, COLON, END = "### ", ": ", "</turn>"
_text = re.compile(r"\\|</turn>|###")
_role = re.compile(r"\\|</turn>|###|:")
_escaped = re.compile(r"\\(\\|</turn>|###|:)")
_end = re.compile(r"\\(?:\\|</turn>|###)|</turn>")
_colon = re.compile(r"\\(?:\\|</turn>|###|:)|: ")


def escape(text: str, marks: re.Pattern = _text) -> str:
    return marks.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: m[1], text)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted string of (role, text) turns and its loss spans."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = BEGIN + escape(role, _role) + COLON, escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string."""
    turns, at = [], 0

    def upto(pattern: re.Pattern, mark: str) -> str:
        nonlocal at
        for m in pattern.finditer(formatted, at):
            if m[0] == mark:
                found = formatted[at : m.start()]
                at = m.end()
                return found
        raise ValueError(f"no {mark!r} after {at}")

    while at < len(formatted):
        if not formatted.startswith(BEGIN, at):
            raise ValueError(f"no turn at {at}")
        at += len(BEGIN)
        role = unescape(upto(_colon, COLON))
        text = unescape(upto(_end, END))
        at += 1
        turns.append((role, text))
    return turns


def masked_text(formatted: str, spans: list[tuple[int, int]]) -> str:
    """The text under the loss mask, unescaped."""
    return "".join(unescape(formatted[a:b]) for a, b in spans)


def jumps(nodes: DataFrame, n: int) -> tuple[list[DataFrame], DataFrame]:
    """Pointer tables (v, to), the k-th 2^k steps towards the root, and (v, depth, total) over all nodes.

    nodes: v, up (null for a root), score; n of them, so more than log2(n) + 1 rounds mean a cycle."""
    tables = []
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = cut(nodes.select("v", F.col("up").alias("to"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("score").alias("total")))
    for _ in range(n.bit_length() + 2):
        open_ = state.where("to is not null")
        if open_.isEmpty():
            return tables, state.select("v", "depth", "total")
        tables.append(open_.select("v", "to"))
        # Only nodes that have not met their root are joined; those that have stay as they are.
        far = state.select(F.col("v").alias("to"), F.col("to").alias("__next"), F.col("depth").alias("__d"), F.col("total").alias("__t"))
        stepped = open_.join(far, "to").select("v", F.col("__next").alias("to"), (F.col("depth") + F.col("__d")).alias("depth"), (F.col("total") + F.col("__t")).alias("total"))
        state = cut(state.where("to is null").unionByName(stepped).coalesce(parts))
    raise ValueError("reply pointers run in a cycle")


def paths(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, score, depth, v): the nodes of the `top` best root-to-leaf paths of each tree (None: all).

    nodes: tree, v (unique), up, score."""
    known = nodes.select(F.col("v").alias("up"), F.lit(True).alias("__there"))
    nodes = cut(nodes.join(known, "up", "left").select("tree", "v", F.when(F.col("__there"), F.col("up")).alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    n, most = nodes.groupBy("v").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most > 1:
        raise ValueError("several rows of one node")
    tables, ends = jumps(nodes, n)
    leaves = nodes.join(nodes.select(F.col("up").alias("v")).where("v is not null").distinct(), "v", "left_anti").join(ends, "v")
    order = Window.partitionBy("tree").orderBy(F.desc("total"), "v")
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    found = cut(ranked.select("tree", F.col("v").alias("leaf"), "rank", F.col("total").alias("score"), "depth", "v"))
    for table in reversed(tables):
        more = found.join(table, "v").select("tree", "leaf", "rank", "score", "depth", F.col("to").alias("v"))
        found = cut(found.unionByName(more))
    return found.drop("depth").join(ends.select("v", "depth"), "v")


def format_paths(df: DataFrame, tree: Column, node: Column, parent: Column, role: Column, text: Column, score: Column, top: int | None = 1, trained: str = "assistant") -> DataFrame:
    """One row for each of the `top` best paths of each tree: tree, leaf, rank, score, n_turns, formatted, loss_spans.

    tree and leaf keep their types; node and parent are of one type, unique within a tree."""
    # Its length before a name keeps trees and nodes apart whatever they are called.
    key = lambda x: F.coalesce(F.concat(F.char_length(x.cast("string")).cast("string"), F.lit("="), x.cast("string")), F.lit("null"))
    rows = df.select(tree.alias("tree"), node.alias("node"), role.cast("string").alias("role"), text.cast("string").alias("text"), score.cast("double").alias("score"), parent.alias("parent"))
    v = F.when(F.col("node").isNotNull(), F.concat_ws("/", key(F.col("tree")), F.col("node").cast("string")))
    v = F.coalesce(v, F.concat(key(F.col("tree")), F.lit("?"), F.monotonically_increasing_id().cast("string")))
    up = F.when(F.col("parent").isNotNull(), F.concat_ws("/", key(F.col("tree")), F.col("parent").cast("string")))
    rows = cut(rows.withColumn("v", v).withColumn("up", up))
    found = paths(rows.select(key(F.col("tree")).alias("tree"), "v", "up", "score"), top)
    turns = found.select("leaf", "rank", F.col("score").alias("total"), "depth", "v").join(rows.select("v", "role", "text"), "v")
    each = turns.groupBy("leaf", "rank", "total").agg(F.sort_array(F.collect_list(F.struct("depth", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    each = each.join(rows.select(F.col("v").alias("leaf"), "tree", "node"), "leaf").select("tree", F.col("node").alias("leaf"), "rank", F.col("total").alias("score"), "turns")
    out = each.drop("turns").withColumn("n_turns", F.lit(0).cast("long")).withColumn("formatted", F.lit("")).withColumn("loss_spans", F.expr("cast(null as array<struct<start: long, end: long>>)")).schema

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            made = [(len(t), *render([(x["role"], x["text"]) for x in t], trained)) for t in batch.column(4).to_pylist()]
            columns = [
                pa.array([x[0] for x in made], pa.int64()),
                pa.array([x[1] for x in made], pa.string()),
                pa.array([[{"start": a, "end": b} for a, b in x[2]] for x in made], kind),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], names=[*batch.schema.names[:4], "n_turns", "formatted", "loss_spans"])

    return each.mapInArrow(run, out)


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """Plain conversations as reply trees of one branch: each turn answers the one before (nulls first, ties by role and
    text). conv_id, n_turns, formatted, loss_spans."""
    rows = df.select(c(conv).alias("conv"), c(turn).alias("turn"), c(role).alias("role"), c(text).alias("text"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    rows = rows.withColumn("n", F.row_number().over(order).cast("long"))
    out = format_paths(rows, F.col("conv"), F.col("n"), F.when(F.col("n") > 1, F.col("n") - 1), F.col("role"), F.col("text"), F.lit(0.0), 1, trained)
    return out.select(F.col("tree").alias(conv), "n_turns", "formatted", "loss_spans")


def read_back(formatted: DataFrame, id: str) -> DataFrame:
    """id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: all from the formatted strings."""
    rows = formatted.select(id, "formatted", "loss_spans")
    out = rows.select(id).withColumn("n_turns", F.lit(0).cast("long")).withColumn("turns_sha256", F.lit("")).withColumn("loss_chars", F.lit(0).cast("long")).withColumn("loss_sha256", F.lit("")).withColumn("formatted_chars", F.lit(0).cast("long")).schema

    def digest(x: str) -> str:
        return hashlib.sha256(x.encode("utf-8")).hexdigest()

    def run(batches):
        for batch in batches:
            made = []
            for s, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(s)
                loss = masked_text(s, [(x["start"], x["end"]) for x in spans])
                made.append((len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(s)))
            cols = list(zip(*made, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(cols, kinds, strict=True))], names=out.fieldNames())

    return rows.mapInArrow(run, out)
