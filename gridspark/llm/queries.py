"""One query per operator, over whole tables of sf_dir. ``queries()`` and ``oracle_sql()`` feed the entry module."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import sql
from gridspark.llm.chat import format_conversations, read_back
from gridspark.llm.common import cut, shared_dir, word_count
from gridspark.llm.langid import fit, predict
from gridspark.llm.media import describe, metadata, store_text
from gridspark.llm.mixing import mix
from gridspark.llm.pieces import encode_texts
from gridspark.llm.records import read_records, write_records
from gridspark.llm.rollup import TOKENIZERS, Rollup, deletes, inserts, library_tokenizer, revisions
from gridspark.llm.rules import risk_controlled
from gridspark.llm.simhash import near_duplicates
from gridspark.llm.substrings import remove_repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    profiles = fit(docs.where("not held_out"), "text", "lang")
    found = docs.select("doc_id", "held_out", predict(F.col("text"), profiles).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document comes in by tokenizer words/1 and is then revised to words/2; both batches are sent twice."""
    docs = table(spark, sf_dir, "documents")
    text, source, lang = F.col("text"), F.col("source"), F.col("lang")
    old, new = ("words/1", TOKENIZERS["words/1"](text)), ("words/2", TOKENIZERS["words/2"](text))
    rollup = Rollup(spark, folder(spark, "rollup"))
    for _ in range(2):
        rollup.apply("ingest", inserts(docs, source, lang, *old))
        rollup.apply("upgrade", revisions(docs, source, lang, old, new))
    return rollup.totals()


def op3_sentencepiece_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = encode_texts(docs, "text", public_tokenizers.path("piece_bpe_32k.model"), {"doc_id": F.col("doc_id")})
    return out.select("doc_id", "n_tokens", "n_bytes_fallback", "ids_crc32", "round_trip")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stratum by the tests that the SQL states; rules_small_strata has the sequences of small ones."""
    out = risk_controlled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text", "lang", sequences=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def rules_small_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of op4 where strata too small for it test sequences of rule sets."""
    out = risk_controlled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text", "lang")
    return out.select("doc_id", "base_failed", "kept")


def rollup_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come in by one library tokenizer, English ones are revised to another, those without a source are
    deleted; a compaction and a replay of each batch change nothing."""
    docs = table(spark, sf_dir, "documents")
    text, source, lang = F.col("text"), F.col("source"), F.col("lang")
    (a, by_a), (b, by_b) = (library_tokenizer(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    counted = cut(docs.select("source", "lang", by_a(text).alias("a"), F.when(lang == "en", by_b(text)).alias("b")))
    batches = {
        "ingest": inserts(counted, source, lang, a, F.col("a")),
        "upgrade": revisions(counted.where("lang = 'en'"), source, lang, (a, F.col("a")), (b, F.col("b"))),
        "forget": deletes(counted.where("source is null and lang is distinct from 'en'"), source, lang, a, F.col("a")),
    }
    rollup = Rollup(spark, folder(spark, "rollup"))
    for name in ("ingest", "upgrade", "ingest"):
        rollup.apply(name, batches[name])
    rollup = rollup.compact(folder(spark, "rollup"))
    for name, changes in batches.items():
        rollup.apply(name, changes)
    return rollup.totals()


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = cut(docs.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size")))
    out = mix(sized, weights=[3, 1, 2], percent=150, cap=2)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(planted)), "conv_id")


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder that all executors share."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark, "media")
    stored = metadata(store_text(table(spark, sf_dir, "documents"), "doc_id", "text", at), at)
    return describe(stored, at).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), F.col("digest").alias("media_sha256"), "feature", "width", "height"
    )


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark, "records")
    index = write_records(table(spark, sf_dir, "documents"), "doc_id", "text", at, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, special_strings=True)
    return read_records(index, at).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", 100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", width=3, radius=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_rank_order_langid, op2_token_rollup, op3_sentencepiece_wfst, op4_quality_rules, op5_source_mix, op6_chat_trees, op7_media_columns, op8_token_records, op9_suffix_dedup, op10_simhash_near_dedup, rules_small_strata, rollup_tokenizers)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
