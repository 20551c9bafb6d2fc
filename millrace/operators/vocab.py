"""Controlled vocabularies: key tables from (code, name, synonym) rows with packed synonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text as T


def key_table(vocab: DataFrame, order: str | None = None) -> DataFrame:
    """(key, canonical, code): one row per folded name or valid synonym.

    A name beats a synonym; among equals the last row by `order` wins (by name where no order is given).
    """
    base = vocab.select(F.trim("name").alias("canonical"), "code", F.coalesce("synonym", F.lit("")).alias("synonym"), (F.col(order) if order else F.col("name")).alias("_o")).where(~T.is_missing(F.col("canonical"), "vocabulary"))
    names = base.select(T.fold(F.col("canonical")).alias("key"), "canonical", "code", "_o", F.lit(1).alias("_p"))
    syns = base.select(F.explode(F.split("synonym", ";")).alias("s"), "canonical", "code", "_o").where(T.valid_synonym(F.col("s"))).select(T.fold(F.col("s")).alias("key"), "canonical", "code", "_o", F.lit(0).alias("_p"))
    best = W.partitionBy("key").orderBy(F.desc("_p"), F.desc("_o"), "canonical", "code")
    return names.union(syns).withColumn("_r", F.row_number().over(best)).where("_r = 1").select("key", "canonical", "code")


def prune_synonyms(vocab: DataFrame) -> DataFrame:
    """Drops synonyms that confuse: word-and-number pairs, one or two plain words, and names of other rows."""
    names = vocab.select(T.fold(F.col("name")).alias("key")).distinct().withColumn("hit", F.lit(True))
    parts = vocab.select("code", "name", F.posexplode(F.split(F.coalesce("synonym", F.lit("")), ";")).alias("pos", "s")).withColumn("s", F.trim("s")).where("s <> ''")
    confusing = F.col("s").rlike("^[A-Za-z]+ [0-9]+$") | F.col("s").rlike("^[A-Za-z]+( [A-Za-z]+)?$")
    kept = parts.where(~confusing).withColumn("key", T.fold(F.col("s"))).join(names, "key", "left").where("hit IS NULL")
    packed = kept.groupBy("code", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), ";").alias("synonym"))
    return vocab.select("code", "name").join(packed, ["code", "name"], "left").select("code", "name", F.coalesce("synonym", F.lit("")).alias("synonym"))
