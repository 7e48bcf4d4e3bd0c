import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The documents before and after each stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(-1, None, "en", "src0", 0), (-2, "12 34 !!", None, "src1", 8), (None, docs.first().text, "fr", None, 5)]
    out = [docs.union(spark.createDataFrame(extra, docs.schema)).checkpoint()]
    for _, stage in pipeline.STAGES:
        out.append(stage(spark, out[-1], sf).checkpoint())
    return out


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_language_keeps_prose(stages):
    before, after = stages[0], stages[1]
    gone = before.join(after, "doc_id", "left_anti").where("doc_id is not null")
    assert {r.doc_id for r in gone.collect()} == {-1, -2}


def test_one_of_each_group_stays(stages):
    before, after = stages[1], stages[2]
    texts = [r.text for r in after.collect()]
    assert len(set(texts)) == len(texts)
    first = {}
    for r in before.where("doc_id is not null").collect():
        first[r.text] = min(first.get(r.text, r.doc_id), r.doc_id)
    kept = {r.doc_id for r in after.collect()}
    assert kept <= set(first.values()) and len(kept) > 0.7 * len(first)

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    left = [shingles(t) for t in texts]
    close = sum(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(left) for b in left[:i])
    assert close == 0


def test_passages(spark, stages):
    from gridspark.llm.substrings import remove_repeats

    want = {r.doc_id: r for r in remove_repeats(stages[2], "doc_id", "text", 100).collect()}
    got = {r.doc_id: r for r in stages[3].collect()}
    assert set(got) == {k for k, r in want.items() if r.n_removed < r.n_bytes or not r.n_removed}
    for r in stages[2].collect():
        if r.doc_id in got:
            g = got[r.doc_id]
            assert (g.lang, g.source) == (r.lang, r.source)
            assert g.text == bytes(want[r.doc_id].kept).decode("utf-8", "ignore")
            assert g.n_chars == (len(g.text) if want[r.doc_id].n_removed else r.n_chars)


def test_mix_and_pieces(spark, sf, stages):
    n = {r.doc_id: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert max(n.values()) <= 2 and set(n) <= {r.doc_id for r in stages[3].collect()}
    assert stages[5].count() == stages[4].count() and stages[5].where("not round_trip").isEmpty()
    assert stages[5].agg(F.sum("n_tokens")).first()[0] > 0


def test_empty(spark, sf, stages):
    none = stages[0].limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_language_rejects_what_is_like_no_learned_language(spark, sf):
    rng = random.Random(4)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(200))
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem."
    odd = [noise, finnish, polish, "xqzj " * 200]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.union(spark.createDataFrame([(-1 - i, t, None, "src0", len(t)) for i, t in enumerate(odd)], docs.schema))
    kept = pipeline.language(spark, rows, sf)
    assert {r.doc_id for r in rows.join(kept, "doc_id", "left_anti").collect()} == {-1, -2, -3, -4}


def test_workers_get_few_texts_at_a_time(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.createDataFrame([(i, "word " * 4000) for i in range(1500)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    before = spark.conf.get(key)
    try:
        for name, stage in pipeline.STAGES:
            spark.conf.unset(key)
            stage(spark, docs.withColumns({"lang": F.lit("en"), "source": F.lit("x"), "n_chars": F.lit(20000)}).limit(3), None)
            most = max(r.n for r in docs.mapInArrow(held, "n long").collect())
            assert most <= 250 or name == "source_mix", (name, most)
    finally:
        spark.conf.set(key, before)
