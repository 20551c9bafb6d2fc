"""A training-corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of documents; n_chars follows text where a stage changes it.

Defined cases: null and letterless texts go in the first stage; rows with null or shared doc_ids are rows of their own, of
which near copies go; exact repeats keep one row; an empty table gives an empty table; columns beyond doc_id, text and
lang are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontam, langid, simhash, suffixdedup
from millrace.llm.common import free_name, written
from millrace.llm.queries import tokenizer_file

#: A document goes if its language is undetermined or its mean posterior is under this.
MIN_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the word-level field decides; those without letters, or undecided, go."""
    model = langid.fit(docs.where(~langid.held_out()))
    names = free_name("predicted_lang", docs), free_name("predicted_score", docs)
    labelled = langid.predict(docs, model, names)
    return labelled.where((F.col(names[0]) != langid.UNKNOWN) & (F.col(names[1]) >= MIN_SCORE)).drop(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each SimHash group: the one with the smallest doc_id, nulls last, then by a digest of the text."""
    return simhash.survivors(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings that also start in a document with a smaller doc_id; a text left without letters or digits goes."""
    return _renumbered(suffixdedup.remove_text(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages; a document that is mostly such passages goes."""
    return _renumbered(decontam.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the SHA-256 of the text that they decode to."""
    return bpe.encode_and_decode(docs, tokenizer_file("byte_bpe_50k.tiktoken")).withColumn("n_tokens", F.size("ids"))


def _renumbered(docs: DataFrame) -> DataFrame:
    kept = docs.where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


STAGES = [
    ("language_id", language_id),
    ("simhash_near_duplicates", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("benchmark_decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
