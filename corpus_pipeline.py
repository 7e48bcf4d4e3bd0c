"""A text pipeline of five stages over `documents`, each on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import cut, shared_dir, small_batches, word_count
from gridspark.llm.langid import FOLDS, UNKNOWN, fit_folds, fold_of, least_scores, predict, scores_enough
from gridspark.llm.mixing import plan, take
from gridspark.llm.pieces import encode_texts
from gridspark.llm.simhash import near_copies
from gridspark.llm.substrings import remove_repeats

#: SQL cannot express n-gram ranks, fingerprints or pieces; the stages are tested against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; a text without letters, or like none of them, goes."""
    small_batches(spark)
    profiles, *others = fit_folds(docs, "text", "lang", fold_of(F.col("text")), FOLDS)
    enough = scores_enough(F.col("text"), F.col("__p.score"), least_scores(docs, "text", "lang", others))
    return docs.withColumn("__p", predict(F.col("text"), profiles)).where((F.col("__p.lang") != UNKNOWN) & enough).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five-word shingles, similarity 0.8): the smallest id."""
    small_batches(spark)
    return near_copies(docs, "doc_id", "text", width=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 100-byte strings that start earlier; a document that nothing is left of goes."""
    small_batches(spark)
    others = [k for k in docs.columns if k not in ("doc_id", "text", "n_chars")]
    out = remove_repeats(docs, "doc_id", "text", 100, keep=[*others, "n_chars"])
    out = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("row.n_chars"))
    made = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": n_chars} | {k: F.col("row")[k] for k in others}
    return out.select(*[made[k].alias(k) for k in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at target weights: a document comes as often as the mix takes it, twice at most."""
    sized = cut(docs.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size")))
    rows = docs.select(F.struct("*").alias("row"))  # whatever other columns are called
    taken = take(rows, F.col("row.doc_id"), F.col("row.source"), plan(sized, weights=[3, 1, 2]))
    return taken.where("copies > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each text, with whether they decode to it."""
    small_batches(spark)
    keep = {k: F.col(k) for k in ("doc_id", "lang", "source")}
    return encode_texts(docs, "text", public_tokenizers.path("piece_bpe_32k.model"), keep).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_crc32", "round_trip")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to a folder that all executors share, and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
