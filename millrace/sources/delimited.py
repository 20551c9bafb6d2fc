"""Tolerant readers of delimited files. Every column is a string; a missing cell is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ID_NAMES = ("run_accession", "run", "id", "sample_id", "sample", "accession", "srr", "doc_id", "key")
TEXT_NAMES = ("summary", "text")


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """Key list: trimmed, blanks gone."""
    return spark.read.text(path).select(F.trim("value").alias("run_accession")).where("run_accession <> ''")


def delimiter_of(spark: SparkSession, path: str) -> str:
    """Tab if the first line has one, else comma."""
    first = spark.read.text(path).limit(1).collect()
    return "\t" if first and "\t" in first[0][0] else ","


def read_table(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """All-string table with a header; malformed lines are dropped, byte-order marks repaired."""
    df = spark.read.csv(path, sep=sep or delimiter_of(spark, path), header=True, mode="DROPMALFORMED", escape='"', multiLine=False)
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns]).na.fill("")


def two_columns(df: DataFrame, key: str | None = None, text: str | None = None) -> DataFrame:
    """(run_accession, text) by the columns named, by known names, or the first two; empty rows go."""
    names = {c.lower(): c for c in df.columns}
    k = key or next((names[n] for n in ID_NAMES if n in names), df.columns[0])
    t = text or next((names[n] for n in TEXT_NAMES if n in names and names[n] != k), df.columns[1])
    return df.select(F.trim(k).alias("run_accession"), F.trim(t).alias("text")).where("run_accession <> '' and text <> ''")


def aliased_table(df: DataFrame, order: str | None = None) -> DataFrame:
    """(id, text): known id and text names, else the other cells joined, else ids ROW_000001 by order."""
    from millrace.operators.sample import numbered

    names = {c.lower(): c for c in df.columns}
    ids = [F.nullif(F.trim(names[n]), F.lit("")) for n in ID_NAMES if n in names]
    texts = [F.nullif(F.trim(names[n]), F.lit("")) for n in TEXT_NAMES if n in names]
    others = [F.nullif(F.trim(c), F.lit("")) for c in df.columns if c.lower() not in ID_NAMES and c != order]
    text = F.coalesce(*texts, F.concat_ws(" ", *others)) if texts else F.concat_ws(" ", *others)
    rows = numbered(df, [order] if order else df.columns)
    made = F.format_string("ROW_%06d", F.col("rn"))
    return rows.select((F.coalesce(*ids, made) if ids else made).alias("id"), text.alias("text"))


def split_last(df: DataFrame, line: str = "value", sep: str = ",", keep: list[str] = ()) -> DataFrame:
    """(prompt, output) of lines split at their last separator; a line without one is all prompt."""
    c = F.col(line)
    return df.select(*keep, F.when(c.contains(sep), F.regexp_extract(c, rf"(?s)^(.*)\{sep}[^\{sep}]*$", 1)).otherwise(c).alias("prompt"), F.when(c.contains(sep), F.element_at(F.split(c, rf"\{sep}"), -1)).otherwise("").alias("output"))


def join_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """One text of the non-empty cells."""
    return df.withColumn("text", F.concat_ws(" ", *[F.nullif(F.trim(c), F.lit("")) for c in columns]))
