import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridspark.llm.rollup import TOKENIZERS, Rollup, deletes, inserts, revisions


def totals(r):
    return sorted(((x.source, x.lang, x.tokenizer, x.docs, x.tokens) for x in r.totals().collect()), key=str)


def test_tokenizers(spark):
    rows = [(None,), ("",), ("a b",), ("é-l’x  12\x0b!?",), ("\x1c q",), ("漢字。かな",)]
    df = spark.createDataFrame(rows, "text string").select("text", *[f(F.col("text")).alias(k) for k, f in TOKENIZERS.items()])
    for r in df.collect():
        t = r.text or ""
        assert r["words/1"] == len(re.findall(r"[^\x20\x09-\x0D]+", t))
        assert r["words/2"] == len(re.findall(r"[^\W_]+|[^\x20\x09-\x0D\w]|_", t))


def test_batches_against_brute_force(spark, tmp_path):
    rng = random.Random(1)
    r = Rollup(spark, str(tmp_path / "r"))
    assert totals(r) == []
    c = F.col
    docs, want = {}, Counter()
    for b in range(5):
        new = [(rng.choice(["s", "t", None]), rng.choice(["en", None]), rng.choice([None, 0, 3, 8])) for _ in range(rng.randint(0, 9))]
        gone = [docs.pop(k) for k in list(docs)[: rng.randint(0, 3)]]
        df = spark.createDataFrame(new, "source string, lang string, n int")
        changes = inserts(df, c("source"), c("lang"), "v1", c("n"))
        if gone:
            old = spark.createDataFrame(gone, "source string, lang string, n int")
            changes = changes.union(deletes(old, c("source"), c("lang"), "v1", c("n")))
        for k, x in enumerate(new):
            docs[b, k] = x
        assert r.apply(f"b{b}", changes)
        assert not r.apply(f"b{b}", changes)
    count = Counter()
    tokens = Counter()
    for s, lang, n in docs.values():
        count[s, lang] += 1
        tokens[s, lang] += n or 0
    want = sorted(((*k, "v1", count[k], tokens[k]) for k in count), key=str)
    assert totals(r) == want
    live = spark.createDataFrame(list(docs.values()), "source string, lang string, n int")
    again = r.compact(str(tmp_path / "c"))
    assert totals(again) == want
    again.apply("re", revisions(live, c("source"), c("lang"), ("v1", c("n")), ("v2", c("n") * 2)))
    assert totals(again) == sorted(((*k, "v2", count[k], 2 * tokens[k]) for k in count), key=str)


def test_uncommitted_batches_do_not_count(spark, tmp_path):
    r = Rollup(spark, str(tmp_path))
    df = spark.createDataFrame([("s", "en", 5)], "source string, lang string, n int")
    ins = inserts(df, F.col("source"), F.col("lang"), "v1", F.col("n"))
    r.apply("a", ins)
    spark.createDataFrame([("s", "en", "v1", 7, 7)], "source string, lang string, tokenizer string, docs long, tokens long").write.parquet(f"{r.path}/deltas/batch=broken")
    assert totals(r) == [("s", "en", "v1", 1, 5)]
    assert r.apply("broken", ins)
    assert totals(r) == [("s", "en", "v1", 2, 10)]
    assert r.apply("empty", ins.limit(0)) and totals(r) == [("s", "en", "v1", 2, 10)]
    with pytest.raises(Exception):
        r.apply("bad", ins.withColumn("change", F.lit("upsert")))
    with pytest.raises(ValueError):
        r.apply("../x", ins)
    assert not r.committed("bad") and totals(r) == [("s", "en", "v1", 2, 10)]
