"""Text-pair metrics and match decisions."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T


def chrf_of(a: str, b: str, low: int = 2, high: int = 6, beta: float = 2.0) -> float:
    """Mean F-beta of the character n-gram overlaps of two texts, spaces removed.

    Grams of n characters are numbered from those of n - 1, so a text costs some numbers per character and no string per gram.
    """
    a, b = (re.sub(r"\s", "", t or "", flags=re.ASCII) for t in (a, b))
    ids = np.unique(np.frombuffer((a + b).encode("utf-32-le"), np.uint32), return_inverse=True)[1].astype(np.int64)
    x, y = ids[: len(a)], ids[len(a):]
    base, gx, gy, total = int(ids.max(initial=0)) + 1, x, y, 0.0
    for n in range(1, high + 1):
        if n > 1:
            gx, gy = gx[:-1] * base + x[n - 1:], gy[:-1] * base + y[n - 1:]
            ids = np.unique(np.concatenate([gx, gy]), return_inverse=True)[1]
            gx, gy = ids[: len(gx)], ids[len(gx):]
        if not len(gx) or not len(gy):
            break
        kinds = int(max(gx.max(), gy.max())) + 1
        same = int(np.minimum(np.bincount(gx, minlength=kinds), np.bincount(gy, minlength=kinds)).sum())
        if n >= low and same:
            precise, recall = same / len(gy), same / len(gx)
            total += (1 + beta**2) * precise * recall / (beta**2 * precise + recall)
    return total / (high - low + 1)


def chrf(df: DataFrame, key: str, a: str, b: str, low: int = 2, high: int = 6, beta: float = 2.0) -> DataFrame:
    """(key, chrf): chrf_of() of every row, 6 decimals; a null text counts as empty. No shuffle."""
    @F.pandas_udf("double")
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([chrf_of(x, y, low, high, beta) for x, y in zip(left, right)], dtype="float64")

    return df.select(key, F.round(score(F.col(a), F.col(b)), 6).alias("chrf"))


def tokens(c: Column) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"), 0)


def jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    n = F.size(F.array_union(x, y))
    return F.round(F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / n), 6)


def dice(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    n = F.size(x) + F.size(y)
    return F.round(F.when(n == 0, 0.0).otherwise(2 * F.size(F.array_intersect(x, y)) / n), 6)


def coverage_f1(a: Column, b: Column) -> Column:
    """F1 of two category sets."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    n = F.size(x) + F.size(y)
    return F.when(n == 0, 0.0).otherwise(2 * F.size(F.array_intersect(x, y)) / n)


def order_agreement(a: Column, b: Column) -> Column:
    """Share of pairs of common items that stand in the same order; 1 for fewer than two."""
    common = F.filter(F.array_distinct(a), lambda x: F.array_contains(b, x))
    at = F.transform(common, lambda x: F.array_position(b, x))
    good = F.aggregate(F.transform(at, lambda p, i: F.size(F.filter(F.slice(at, i + 2, F.size(at)), lambda q: q > p))), F.lit(0), lambda s, x: s + x)
    n = F.size(common)
    return F.when(n < 2, 1.0).otherwise(good / (n * (n - 1) / 2))


def composite(sim: Column, cov: Column, order: Column) -> Column:
    return 0.45 * sim + 0.35 * cov + 0.20 * order


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def structural_auc(steps: int = 20):
    """Column function of two texts: mean share of common structure over growing prefixes."""
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            x, y = (x or "").split(), (y or "").split()
            if not x or not y:
                return 1.0 if not x and not y else 0.0
            shares = []
            for s in range(1, steps + 1):
                p, q = x[: max(1, len(x) * s // steps)], y[: max(1, len(y) * s // steps)]
                shares.append(lcs_length(p, q) / max(len(p), len(q)))
            return round(sum(shares) / steps, 6)
        return pd.Series([one(x, y) for x, y in zip(a, b)])
    return run


def category_match(pred: Column, ref: Column, cosine: Column, threshold: float, days: bool = False) -> Column:
    """Match of one value: NULL where there is no reference; absent values equal absent ones; else exact, one day apart, or near."""
    p, r = F.trim(F.lower(pred)), F.trim(F.lower(ref))
    na = lambda c: c.isin(*T.POLICIES["evaluation"])
    near = F.coalesce(cosine > threshold, F.lit(False))
    if days:
        near = near | F.coalesce(F.abs(T.duration_days(p) - T.duration_days(r)) <= 1, F.lit(False))
    return F.when(r.isNull() | (r == ""), None).when(na(r), na(p) | p.isNull()).when(p.isNull() | (p == "") | na(p), False).when(p.rlike(r"(with|and|of|for|,|-)\s*$"), False).otherwise((p == r) | near)


def duration_match(pred: Column, ref: Column, cosine: Column, threshold: float = 0.38) -> Column:
    """Durations within half a day or 15 %, or near texts."""
    a, b = T.duration_days(pred), T.duration_days(ref)
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(0.5), 0.15 * b), F.lit(False)) | F.coalesce(cosine >= threshold, F.lit(False))


def validate(df: DataFrame, key: str, edges: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(key, valid): for each rule (from, to), the row's pair of values is an edge; a missing value breaks no rule."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("from_attr"), F.col(a).cast("string").alias("from_val"), F.lit(b).alias("to_attr"), F.col(b).cast("string").alias("to_val")) for a, b in rules])).alias("p")
    asked = df.select(key, pairs).select(key, "p.*").where("from_val is not null and to_val is not null")
    broken = asked.join(edges, ["from_attr", "from_val", "to_attr", "to_val"], "left_anti").select(key).distinct().withColumn("_b", F.lit(True))
    return df.select(key).join(broken, key, "left").select(key, F.col("_b").isNull().alias("valid"))
