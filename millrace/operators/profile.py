"""Counts, distributions and classification reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text as T


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value) of the columns as text; missing is empty. One pass, no union."""
    cells = ", ".join(f"'{c}', cast(`{c}` as string)" for c in columns)
    rows = df.select(F.expr(f"stack({len(columns)}, {cells}) as (field, value)"))
    return rows.select("field", F.coalesce(T.missing_to_null(F.col("value"), "profiling"), F.lit("")).alias("value"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return long_form(df, columns).groupBy("field", "value").agg(F.count("*").alias("n"))


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    x, y = (F.coalesce(T.missing_to_null(F.col(c), "profiling"), F.lit("")) for c in (a, b))
    return df.where((x != "") | (y != "")).groupBy(F.concat_ws("|", x, y).alias("pair")).agg(F.count("*").alias("n"))


def bucket_counts(df: DataFrame, field: str, metric: str, confident: float, medium: float) -> DataFrame:
    return df.groupBy(field, T.bucket(F.col(metric), confident, medium).alias("bucket")).agg(F.count("*").alias("n"))


def floor_percentiles(df: DataFrame, by: str, value: str, qs: dict[str, float]) -> DataFrame:
    """n, mean, median and floor-index percentiles v[floor(q (n - 1))] per group, from exact counts of distinct values."""
    c = df.where(F.col(value).isNotNull()).groupBy(by, value).count()
    w = W.partitionBy(by)
    r = c.withColumn("_upto", F.sum("count").over(w.orderBy(value))).withColumn("_n", F.sum("count").over(w))
    at = lambda q: F.min(F.when(F.col("_upto") >= F.floor(F.lit(q) * (F.col("_n") - 1)) + 1, F.col(value)))
    middle = (F.min(F.when(F.col("_upto") >= F.floor((F.col("_n") - 1) / 2) + 1, F.col(value))) + F.min(F.when(F.col("_upto") >= F.floor(F.col("_n") / 2) + 1, F.col(value)))) / 2
    return r.groupBy(by).agg(F.max("_n").alias("n"), (F.sum(F.col(value) * F.col("count")) / F.max("_n")).alias("mean"), middle.alias("median"), *[at(q).alias(name) for name, q in qs.items()])


def category_profile(df: DataFrame, columns: list[str], top: int = 50) -> DataFrame:
    """Non-missing and distinct counts of each field, and its top values as 'v (n); ...' by falling count, then value."""
    c = value_counts(df, columns).where("value <> ''")
    r = c.withColumn("_r", F.row_number().over(W.partitionBy("field").orderBy(F.desc("n"), "value")))
    item = F.when(F.col("_r") <= top, F.struct("_r", F.concat(F.col("value"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t")))
    return r.groupBy("field").agg(F.sum("n").alias("filled"), F.count("*").alias("distinct_values"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "; ").alias("profile"))


def shares(df: DataFrame, label: str) -> DataFrame:
    c = df.groupBy(label).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def top_counts(df: DataFrame, column: str, k: int, first: str | None = None) -> DataFrame:
    """k most frequent values; ties by first place where an order is given, else by value."""
    c = df.groupBy(column).agg(F.count("*").alias("n"), F.min(first or column).alias("_f"))
    return c.orderBy(F.desc("n"), "_f").limit(k).select(column, "n")


def accuracy(df: DataFrame, by: str, ok: str) -> DataFrame:
    """Accuracy per category, and the unweighted mean of categories as 'MEAN'."""
    a = df.groupBy(by).agg(F.avg(F.col(ok).cast("double")).alias("accuracy"))
    return a.union(a.agg(F.lit("MEAN").alias(by), F.avg("accuracy").alias("accuracy")))


def confusion(df: DataFrame, ref: str, pred: str) -> DataFrame:
    return df.groupBy(ref, pred).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, ref: str, pred: str) -> DataFrame:
    """Precision, recall and F1 of each class; absent denominators give 0."""
    c = confusion(df, ref, pred)
    both = c.select(F.col(ref).alias("label"), F.col("n").alias("r"), F.lit(0).alias("p"), F.when(F.col(ref) == F.col(pred), F.col("n")).otherwise(0).alias("t")).union(
        c.select(F.col(pred), F.lit(0), F.col("n"), F.lit(0)))
    s = both.groupBy("label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("r").alias("r"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return s.select("label", ratio(F.col("t"), F.col("p")).alias("precision"), ratio(F.col("t"), F.col("r")).alias("recall"), ratio(2 * F.col("t"), F.col("p") + F.col("r")).alias("f1"))


def class_weights(df: DataFrame, label: str, root: bool = False) -> DataFrame:
    """Inverse-frequency weights that sum to the number of classes, or inverse-root ones with mean 1."""
    c = df.groupBy(label).agg(F.count("*").alias("n"))
    raw = 1 / (F.sqrt("n") if root else F.col("n").cast("double"))
    whole = W.partitionBy()
    return c.withColumn("_w", raw).select(label, "n", (F.col("_w") / F.avg("_w").over(whole)).alias("weight"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n, density) of values in [low, high]; the last bin is closed."""
    width = (high - low) / bins
    b = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    c = df.where(F.col(value).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return c.withColumn("density", F.col("n") / (F.sum("n").over(W.partitionBy()) * width))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """(value, share at most value), one row per distinct value.

    The running sum is over distinct values; sums of ranges come first, so no task sees all values.
    """
    from millrace.operators.sample import numbered

    c = df.where(F.col(value).isNotNull()).groupBy(value).count()
    rows = numbered(c, [value]).withColumn("_p", F.floor((F.col("rn") - 1) / 65536))
    sums = rows.groupBy("_p").agg(F.sum("count").alias("_s"))
    before = sums.withColumn("_b", F.coalesce(F.sum("_s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_t", F.sum("_s").over(W.partitionBy()))
    inside = W.partitionBy("_p").orderBy("rn").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("_c", F.sum("count").over(inside)).join(before, "_p").select(value, ((F.col("_b") + F.col("_c")) / F.col("_t")).alias("ecdf"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Mann-Whitney AUC with tie-averaged ranks, from counts of distinct scores."""
    from millrace.operators.sample import numbered

    c = df.groupBy(score).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum((~F.col(label)).cast("bigint")).alias("neg"))
    rows = numbered(c, [score]).withColumn("_p", F.floor((F.col("rn") - 1) / 65536))
    sums = rows.groupBy("_p").agg(F.sum("neg").alias("_s"))
    before = sums.withColumn("_b", F.coalesce(F.sum("_s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inside = W.partitionBy("_p").orderBy("rn").rowsBetween(W.unboundedPreceding, -1)
    j = rows.withColumn("_c", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(before, "_p")
    return j.agg((F.sum(F.col("pos") * (F.col("_b") + F.col("_c") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))
