"""Sinks: several formats, upserts, resume and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.resolve import keep_last

FORMATS = ("csv", "tsv", "json", "parquet")


def export(df: DataFrame, path: str, formats: tuple[str, ...] = FORMATS) -> dict[str, str]:
    """Writes df under path/<format>; returns what failed by format, and raises only if csv does.

    xlsx and feather are for small results at the edge: export_edge().
    """
    failed = {}
    for f in formats:
        try:
            w = df.write.mode("overwrite")
            if f in ("csv", "tsv"):
                w.csv(f"{path}/{f}", header=True, sep="," if f == "csv" else "\t", quoteAll=False, escape='"')
            else:
                w.format(f).save(f"{path}/{f}")
        except Exception as e:
            if f == "csv":
                raise
            failed[f] = str(e)
    return failed


def export_edge(df: DataFrame, path: str, max_rows: int = 100_000) -> None:
    """feather or xlsx of a result of at most max_rows rows; more rows raise ValueError."""
    pdf = df.limit(max_rows + 1).toPandas()
    if len(pdf) > max_rows:
        raise ValueError("too many rows for a single file")
    pdf.to_feather(path) if path.endswith(".feather") else pdf.to_excel(path, index=False)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both, the latest by order per key."""
    return keep_last(old.unionByName(new), key, order)


def first_writer(shards: list[DataFrame], key: str) -> DataFrame:
    """Union of shard results; the first shard that has a key keeps it."""
    rows = None
    for i, s in enumerate(shards):
        s = s.withColumn("_arrival", F.lit(-i))
        rows = s if rows is None else rows.unionByName(s)
    return keep_last(rows, key, "_arrival").drop("_arrival")


def todo(keys: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return keys.join(done.select(key).distinct(), key, "left_anti")


def resume_append(spark: SparkSession, work: DataFrame, path: str, key: str, run) -> None:
    """Runs run(rows not yet at path) and appends the result; a batch is visible only when committed."""
    try:
        done = spark.read.parquet(path)
        work = todo(work, done, key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
    run(work).write.mode("append").parquet(path)


def shard_of(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Every n-th row of the keys' order, as shard."""
    from millrace.operators.sample import numbered

    return numbered(df, [key]).withColumn("shard", F.pmod(F.col("rn") - 1, F.lit(shards)).cast("int")).drop("rn")


def html_table(df: DataFrame, columns: list[str], classes: dict[str, str], max_rows: int = 1000) -> str:
    """HTML of at most max_rows rows; classes names the column that holds a cell's class."""
    cell = lambda c: F.concat(F.lit('<td class="'), F.coalesce(F.col(classes[c]), F.lit("missing")) if c in classes else F.lit(""), F.lit('">'), F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</td>"))
    rows = df.orderBy(columns[0]).limit(max_rows).select(F.concat(F.lit("<tr>"), *[cell(c) for c in columns], F.lit("</tr>"))).collect()
    return "<table><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>" + "".join(r[0] for r in rows) + "</table>"
