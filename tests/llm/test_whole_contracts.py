"""Cases that the other tests leave out: special strings, replays after compaction, keys that look alike, clashing names."""

import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from gridspark.llm import queries as q
from gridspark.llm.chat import format_paths
from gridspark.llm.rollup import Rollup, inserts
from gridspark.llm.simhash import near_duplicates
from gridspark.llm.tokenize import Encoder


def test_special_strings_are_the_library_s():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["a<|endoftext|>b", "<|endoftext|>", "plain words here", "x <|endoftext|> y  z", "<|endoftext", ""]
    enc = Encoder(path, special_strings=True)
    got = [list(memoryview(x).cast(enc.code)) for x in enc.encode(texts)]
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] and len(got[0]) == 3


def test_replay_after_compaction(spark, tmp_path):
    rows = spark.createDataFrame([("s", "en", 5)], "source string, lang string, n long")
    changes = inserts(rows, F.col("source"), F.col("lang"), "t", F.col("n"))
    r = Rollup(spark, str(tmp_path / "a"))
    assert r.apply("a", changes) and r.apply("b", changes)
    r = r.compact(str(tmp_path / "b"))
    assert not r.apply("a", changes) and not r.apply("b", changes) and r.apply("c", changes)
    r = r.compact(str(tmp_path / "c"))
    assert not r.apply("a", changes) and not r.apply("c", changes)
    assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "t", 3, 15)]
    with pytest.raises(ValueError):
        r.apply("base", changes)


def test_rollup_of_library_tokenizers(spark, sf):
    names = ["byte_bpe_50k.json", "word_bpe_49k.json"]
    a, b = (Tokenizer.from_file(public_tokenizers.path(x)) for x in names)
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if r.source is None and r.lang != "en":
            continue
        k = (r.source, r.lang, names[r.lang == "en"])
        n = len((b if r.lang == "en" else a).encode(r.text or "", add_special_tokens=False).ids)
        d, t = want.get(k, (0, 0))
        want[k] = (d + 1, t + n)
    got = {(r.source, r.lang, r.tokenizer.split("@")[0]): (r.docs, r.tokens) for r in q.rollup_tokenizers(spark, sf).collect()}
    assert got == want


def test_trees_and_nodes_with_slashes_stay_apart(spark):
    rows = [("a/1", "2", None, "user", "x"), ("a", "1/2", None, "user", "y"), ("a", None, None, "user", "z"), ("a", None, None, "user", "z")]
    df = spark.createDataFrame(rows, "tree string, node string, parent string, role string, text string")
    out = format_paths(df, F.col("tree"), F.col("node"), F.col("parent"), F.col("role"), F.col("text"), F.lit(0.0), None)
    assert sorted(r.formatted for r in out.collect()) == [f"### user: {x}</turn>\n" for x in "xyzz"]


def test_an_id_named_like_a_result(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "fp long, text string")
    assert sorted((r.fp, r.component_id) for r in near_duplicates(df, "fp", "text").collect()) == [(1, 1), (2, 1)]


def test_mix_with_columns_named_like_its_own(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("target", F.lit("mine")).withColumn("copies", F.lit(7))
    out = pipeline.source_mix(spark, docs, sf)
    assert out.columns == docs.columns and {(r.target, r.copies) for r in out.select("target", "copies").distinct().collect()} == {("mine", 7)}


def test_op1_against_plain_counts(spark, sf):
    """The query's languages and scores, from profiles counted one text at a time."""
    import zlib
    from collections import Counter

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()

    def ranks(texts):
        n = Counter()
        for t in texts:
            words = "".join(x if x.isalpha() else " " for x in t.lower()).split()
            for w in words:
                n.update(w)
                p = f" {w} "
                n.update(p[i : i + 2] for i in range(len(p) - 1))
                n.update(p[i : i + 3] for i in range(len(p) - 2))
        return {g: r for r, g in enumerate(sorted(n, key=lambda g: (-n[g], len(g), g))[:400])}

    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learned = {k: ranks([r.text for r in docs if r.lang == k and r.text and not out(r.doc_id)]) for k in {r.lang for r in docs if r.lang}}
    got = {r.doc_id: r for r in q.op1_rank_order_langid(spark, sf).collect()}
    agree = 0
    for d in docs:
        r, mine = got[d.doc_id], ranks([d.text or ""])
        assert r.held_out == out(d.doc_id)
        if not mine:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        far, name = min((sum(abs(x - p[g]) if g in p else 400 for g, x in mine.items()), k) for k, p in learned.items())
        agree += r.lang_pred == name and abs(r.score - (1 - far / (400 * len(mine)))) < 1e-9
    assert agree == sum(1 for d in docs if any(x.isalpha() for x in d.text or ""))
