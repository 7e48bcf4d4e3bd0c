import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gridspark.llm.chat import format_conversations, format_paths, masked_text, parse, read_back, render
from gridspark.llm.queries import op6_chat_trees

PARTS = ["\\", "</turn>", "### ", "###", "#", "<", "/turn>", ": ", ":", "\n", "a", "é", "\U0001f600", "\\### Assistant: </turn> ok"]


def test_template_is_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        turns = [("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 3))) if rng.random() < 0.3 else rng.choice(["user", "assistant"]), "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 4))]
        s, spans = render(turns)
        assert parse(s) == turns
        assert masked_text(s, spans) == "".join(t for r, t in turns if r == "assistant")
        assert s.replace("\\</turn>", "").replace("\\\\", "").count("</turn>") <= s.count("</turn>")
    with pytest.raises(ValueError):
        parse("### user: no end")


def rows_of(formatted):
    return {(r.tree, r.leaf): (r.rank, round(r.score, 6), parse(r.formatted)) for r in formatted.collect()}


def slow_paths(nodes, top):
    by, kids = {}, set()
    for t, v, up, role, text, s in nodes:
        by[t, v] = (up, role or "", text or "", s or 0.0)
    for (t, _), (up, *_) in by.items():
        if (t, up) in by:
            kids.add((t, up))
    found = {}
    for t, v in by:
        if (t, v) in kids:
            continue
        path, x = [], v
        while x is not None and (t, x) in by:
            path.append(by[t, x])
            x = by[t, x][0]
        found.setdefault(t, []).append((-sum(p[3] for p in path), f"={t}/{v}" if t is not None else f"null/{v}", v, [(p[1], p[2]) for p in reversed(path)]))
    return {(t, v): (k + 1, round(-s, 6), turns) for t, x in found.items() for k, (s, _, v, turns) in enumerate(sorted(x, key=lambda y: y[:2])[:top])}


def test_trees_against_brute_force(spark):
    rng = random.Random(2)
    nodes = []
    for t in [1, 2, 3, None]:
        for v in range(rng.randint(1, 40)):
            nodes.append((t, v, rng.randint(0, v - 1) if v and rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice([*PARTS, None]), rng.choice([0.0, 1.0, 0.5, None])))
    nodes += [(9, v, v - 1 if v else None, "user", f"m{v}", 1.0) for v in range(70)] + [(10, 5, 77, "user", "dangling", 1.0)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double").repartition(3)
    c = F.col
    for top in (2, None):
        got = rows_of(format_paths(df, c("tree"), c("node"), c("parent"), c("role"), c("text"), c("score"), top))
        assert got == slow_paths(nodes, top or 10**9)


def test_cycles_and_double_nodes(spark):
    c = F.col
    args = (c("tree"), c("node"), c("parent"), c("role"), c("text"), c("score"))
    schema = "tree long, node long, parent long, role string, text string, score double"
    with pytest.raises(ValueError):
        format_paths(spark.createDataFrame([(1, 1, 2, "u", "x", 0.0), (1, 2, 1, "u", "y", 0.0)], schema), *args)
    with pytest.raises(ValueError):
        format_paths(spark.createDataFrame([(1, 1, None, "u", "x", 0.0), (1, 1, None, "u", "y", 0.0)], schema), *args)
    assert format_paths(spark.createDataFrame([], schema), *args).collect() == []


def test_conversations(spark, sf):
    rows = [(1, 0, "system", "s"), (1, 2, "assistant", None), (1, 1, "user", "### x"), (2, None, None, "a"), (2, 0, "assistant", "</turn>"), (2, 0, "assistant", "</turn>"), (None, 0, "user", "n"), (3, 0, "assistant", "long " * 50000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, tree string, v int")
    got = {r.conv_id: parse(r.formatted) for r in format_conversations(df).collect()}
    assert got == {1: [("system", "s"), ("user", "### x"), ("assistant", "")], 2: [("", "a"), ("assistant", "</turn>"), ("assistant", "</turn>")], None: [("user", "n")], 3: [("assistant", "long " * 50000)]}
    assert read_back(format_conversations(df.limit(0)), "conv_id").collect() == []


def test_query_against_brute_force(spark, sf):
    got = {r.conv_id: r for r in op6_chat_trees(spark, sf).collect()}
    by = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    odd = "\\### Assistant: </turn> ok"
    by[-7] = [("user", odd), ("assistant", odd)]
    assert set(got) == set(by)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for k, turns in by.items():
        r = got[k]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), sha(loss), len(render(turns)[0]))
