"""Model calls behind one interface, prompts, and metrics of answers.

A Backend completes prompts and embeds texts; RuleBackend is a deterministic stand-in. Decoding, training and
quantising on GPUs are a backend's business and not the engine's.
"""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Backend(Protocol):
    def complete(self, prompts: list[str]) -> list[tuple[str, list[float]]]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class RuleBackend:
    """Answers with the first listed value that occurs in the prompt, else unknown; embeds by hashed letter pairs."""

    def __init__(self, values: list[str], dims: int = 16):
        self.values, self.dims = values, dims

    def complete(self, prompts):
        return [(v, [-0.1]) if (v := next((x for x in self.values if x in p.lower()), None)) else ("unknown", [-1.0]) for p in prompts]

    def embed(self, texts):
        import zlib

        out = []
        for t in texts:
            v = [0.0] * self.dims
            for i in range(len(t) - 1):
                v[zlib.crc32(t[i: i + 2].encode()) % self.dims] += 1.0
            out.append(v)
        return out


def build_prompt(run: Column, summary: Column, field: str, definition: str, candidates: Column | None = None) -> Column:
    parts = [F.lit("Record: "), run.cast("string"), F.lit("\nSummary: "), summary, F.lit(f"\nField: {field} ({definition})")]
    if candidates is not None:
        parts += [F.lit("\nCandidates: "), F.array_join(candidates, " | ")]
    return F.concat(*parts, F.lit('\nAnswer: "'))


def prompt_run(p: Column) -> Column:
    return F.regexp_extract(p, r"^Record: ([^\n]*)\n", 1)


def prompt_summary(p: Column) -> Column:
    return F.regexp_extract(p, r"(?s)\nSummary: (.*)\nField: ", 1)


def complete(df: DataFrame, prompt: str, backend: Backend) -> DataFrame:
    """df with answer and logprobs; prompts go to the backend in batches."""
    from pyspark.sql.types import ArrayType, DoubleType, StructType

    schema = StructType(list(df.schema.fields)).add("answer", "string").add("logprobs", ArrayType(DoubleType()))

    def run(batches):
        for pdf in batches:
            answers = backend.complete(pdf[prompt].tolist())
            yield pdf.assign(answer=[a for a, _ in answers], logprobs=[p for _, p in answers])
    return df.mapInPandas(run, schema)


def embed(c: Column, backend: Backend) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(backend.embed(texts.fillna("").tolist()))
    return run(c)


def perplexity(df: DataFrame, key: str, logprob: str = "logprob") -> DataFrame:
    """Mean negative log-likelihood and its exponential per key."""
    return df.groupBy(key).agg((-F.avg(logprob)).alias("nll")).withColumn("ppl", F.exp("nll"))


def entropy_of_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Entropy (nats) of a column's values per key."""
    n = df.groupBy(key, value).count()
    s = n.groupBy(key).agg(F.sum("count").alias("t"), F.sum(F.col("count") * F.log(F.col("count").cast("double"))).alias("l"))
    return s.select(key, (F.log(F.col("t").cast("double")) - F.col("l") / F.col("t")).alias("entropy"))


def parse_answers(df: DataFrame, key: str, body: str) -> DataFrame:
    """Long rows (key, field, value, nll, ppl) of an inference JSON; empty or broken bodies give no row."""
    m = F.from_json(F.col(body), "map<string,map<string,string>>")
    j = df.select(key, m.alias("m")).where("m is not null")
    run = F.try_element_at("m", F.col(key).cast("string"))
    rows = j.select(key, "m", F.explode(run).alias("field", "raw"))
    text = F.coalesce(F.array_join(F.from_json("raw", "array<string>"), "; "), F.col("raw"))
    metric = lambda name: F.expr(f"try_element_at(try_element_at(m, '{name}'), field)").try_cast("double")
    return rows.select(key, "field", F.when(F.coalesce(F.trim(text), F.lit("")) == "", "unknown").otherwise(F.trim(text)).alias("value"), metric("nll").alias("nll"), metric("ppl").alias("ppl"))
