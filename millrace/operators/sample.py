"""Ranks, samples, splits and balancing. Randomness is a hash of seed and key, so results repeat and can be checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.lineage import cut


def hash_order(key: Column | str, seed: int = 42) -> Column:
    """Repeatable random order of a key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def numbered(df: DataFrame, order: list, to: str = "rn") -> DataFrame:
    """df with its row number by order, from 1: ranges are sorted in parallel and get the sizes before them."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ids = cut(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_m", F.monotonically_increasing_id()))
    ids = ids.withColumn("_p", F.shiftright("_m", 33))
    sizes = ids.groupBy("_p").count()
    before = sizes.withColumn("_b", F.coalesce(F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")  # a row per partition
    return ids.join(F.broadcast(before), "_p").withColumn(to, F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_p", "_m", "_b")


def capped(df: DataFrame, group: str, cap: int, order: Column) -> DataFrame:
    """At most cap rows per group, the first by order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("_r") <= cap).drop("_r")


def multi_capped(df: DataFrame, key: str, caps: dict[str, int], total: int | None = None, bucket: str | None = None, seed: int = 42) -> DataFrame:
    """Greedy sample in hash order under several caps at once, per bucket.

    A row refused by one cap uses up none of the others, which is sequential; a bucket is one task. Without a bucket all
    rows are one, so give one for large inputs.
    """
    schema = df.schema

    def greedy(pdf):
        used, keep = [{} for _ in caps], []
        for i, row in enumerate(pdf[names].itertuples(index=False)):
            values = [getattr(row, c) for c in caps]
            if (total is None or len(keep) < total) and all(u.get(v, 0) < cap for u, v, cap in zip(used, values, caps.values())):
                keep.append(i)
                for u, v in zip(used, values):
                    u[v] = u.get(v, 0) + 1
        return pdf.iloc[keep][names]

    names = df.columns

    def run(pdf):
        import hashlib

        at = pdf[key].map(lambda k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest())
        return greedy(pdf.assign(_h=at).sort_values("_h", kind="stable").drop(columns="_h"))
    return df.withColumn("_bucket", F.col(bucket) if bucket else F.lit(0)).groupBy("_bucket").applyInPandas(run, schema)


def topped_up(df: DataFrame, key: str, caps: dict[str, int], bucket: str, per_bucket: int, total: int, seed: int = 42) -> DataFrame:
    """Equal targets per bucket, then a top-up from the remainder in hash order."""
    first = cut(multi_capped(df, key, caps, per_bucket, bucket, seed))
    rest = df.join(first.select(key), key, "left_anti").orderBy(hash_order(key, seed)).limit(max(0, total - first.count()))
    return first.unionByName(rest)


def quotas(counts: DataFrame, n: int, by: str, size: str = "count") -> DataFrame:
    """Largest-remainder shares of n in proportion to size, capped by it; ties go by label."""
    whole = W.partitionBy()  # a row per label
    q = counts.withColumn("_x", F.lit(n) * F.col(size) / F.sum(size).over(whole)).withColumn("quota", F.floor("_x"))
    q = q.withColumn("_left", F.lit(n) - F.sum("quota").over(whole)).withColumn("_r", F.row_number().over(W.orderBy(F.desc(F.col("_x") - F.col("quota")), by)))
    return q.withColumn("quota", F.least(F.col(size), F.col("quota") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0)).cast("bigint")).select(by, size, "quota")


def stratified(df: DataFrame, key: str, by: str, n: int, seed: int = 42) -> DataFrame:
    q = quotas(df.groupBy(by).count(), n, by).select(by, "quota")
    r = df.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(hash_order(key, seed), key)))
    return r.join(q, by).where(F.col("_r") <= F.col("quota")).drop("_r", "quota")


def equalised(df: DataFrame, key: str, by: str, labels: list[str], extra: str | None = None, reserve: int = 0, seed: int = 42) -> DataFrame:
    """Each of labels cut to the rarest one's count, plus the extra label's rows beyond a reserve, as many at most."""
    counts = df.where(F.col(by).isin(*labels)).groupBy(by).count().agg(F.min("count").alias("_n"))
    r = df.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(hash_order(key, seed), key)))
    j = r.join(F.broadcast(counts))  # one row
    keep = F.col(by).isin(*labels) & (F.col("_r") <= F.col("_n"))
    if extra is not None:
        keep = keep | ((F.col(by) == extra) & (F.col("_r") > reserve) & (F.col("_r") <= reserve + F.col("_n")))
    return j.where(keep).drop("_r", "_n")


def round_robin(df: DataFrame, key: str, by: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, one of each label in turn (labels by falling size, then name)."""
    r = df.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(hash_order(key, seed), key))).withColumn("_s", F.count("*").over(W.partitionBy(by)))
    return r.orderBy("_r", F.desc("_s"), by).limit(n).drop("_r", "_s")


def integrate(old: DataFrame, new: DataFrame, key: str, by: str, target: int, seed: int = 42) -> DataFrame:
    """target rows: new ones up to half of it, then old ones, both in turn over labels."""
    add = cut(round_robin(new, key, by, target // 2, seed))
    return add.unionByName(round_robin(old, key, by, max(0, target - add.count()), seed))


def family_split(labels: DataFrame, family: str, label: str, ratios=(0.5, 0.25, 0.25), names=("train", "val", "test"), seed: int = 7) -> DataFrame:
    """Disjoint split of labels within each family, sizes rounded; the last part takes the rest."""
    w = W.partitionBy(family)
    r = labels.withColumn("_r", F.row_number().over(w.orderBy(hash_order(label, seed), label))).withColumn("_n", F.count("*").over(w))
    a, b = F.round(F.col("_n") * ratios[0]), F.round(F.col("_n") * ratios[0]) + F.round(F.col("_n") * ratios[1])
    return r.withColumn("part", F.when(F.col("_r") <= a, names[0]).when(F.col("_r") <= b, names[1]).otherwise(names[2])).drop("_r", "_n")


def label_groups(counts: list[tuple[str, int]], ratios=(0.6, 0.2, 0.2)) -> dict[str, int]:
    """Whole labels to groups near the ratios: the largest label first, to the group furthest below its share. A label list is small."""
    total = sum(n for _, n in counts) or 1
    filled, out = [0] * len(ratios), {}
    for label, n in sorted(counts, key=lambda x: (-x[1], x[0])):
        g = max(range(len(ratios)), key=lambda i: (ratios[i] * total - filled[i], -i))
        filled[g] += n
        out[label] = g
    return out


def multiset_counts(n_labels: int, total: int, seed: int) -> list[int]:
    """Random counts of at least 1 with a fixed total."""
    import random

    if total < n_labels:
        raise ValueError("total is less than the number of labels")
    rng = random.Random(seed)
    cuts = sorted(rng.sample(range(1, total), n_labels - 1)) if n_labels > 1 else []
    return [b - a for a, b in zip([0, *cuts], [*cuts, total])]


def equal_quota(labels: DataFrame, by: str, total: int) -> DataFrame:
    """total dealt equally over distinct labels; the first by name take the remainder."""
    d = labels.select(by).distinct().withColumn("_r", F.row_number().over(W.orderBy(by))).withColumn("_n", F.count("*").over(W.partitionBy()))
    return d.select(by, (F.floor(F.lit(total) / F.col("_n")) + F.when(F.col("_r") <= F.lit(total) % F.col("_n"), 1).otherwise(0)).cast("bigint").alias("quota"))


def sequential_split(df: DataFrame, key: str, sizes: list[tuple[str, int]], seed: int = 42) -> DataFrame:
    """df with part: the first rows in hash order to each named size in turn; the rest NULL. Too few rows raise."""
    rows = numbered(df.withColumn("_h", hash_order(key, seed)), ["_h", key]).drop("_h")
    if rows.count() < sum(n for _, n in sizes):
        raise ValueError("too few rows for the split")
    part, at = F.lit(None).cast("string"), 0
    for name, n in sizes:
        part = F.when((F.col("rn") > at) & (F.col("rn") <= at + n), name).otherwise(part)
        at += n
    return rows.withColumn("part", part).drop("rn")


def quantile_split(df: DataFrame, score: str, edges=(0.2, 0.8), min_gap: float = 0.02) -> DataFrame:
    """OOD, MID, ID by score quantiles; two ways at the median where the quantiles are closer than min_gap."""
    q = df.agg(F.percentile(score, F.array(F.lit(edges[0]), F.lit(0.5), F.lit(edges[1]))).alias("_q"))
    j = df.join(F.broadcast(q))  # one row
    s, lo, mid, hi = F.col(score), F.col("_q")[0], F.col("_q")[1], F.col("_q")[2]
    three = F.when(s >= hi, "ID").when(s <= lo, "OOD").otherwise("MID")
    return j.withColumn("part", F.when(hi - lo < min_gap, F.when(s >= mid, "ID").otherwise("OOD")).otherwise(three)).drop("_q")


def augmented(df: DataFrame, key: str, prompt: str, lines: list[str], ratio: float = 0.35, seed: int = 42) -> DataFrame:
    """df and, for a share of its rows chosen by hash, a copy whose prompt has a noise line."""
    h = F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("bigint")
    chosen = df.where(h % 1000 < int(ratio * 1000))
    noise = F.element_at(F.array(*map(F.lit, lines)), (h % len(lines) + 1).cast("int"))
    return df.withColumn("augmented", F.lit(False)).unionByName(chosen.withColumn(prompt, F.concat_ws("\n", prompt, noise)).withColumn("augmented", F.lit(True)))


def weighted_with_replacement(df: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """n draws in proportion to weight: stratified points on the cumulative weights, each row counting those in its range."""
    rows = numbered(df, [key])
    parts = rows.withColumn("_p", F.floor((F.col("rn") - 1) / 4096))
    sums = parts.groupBy("_p").agg(F.sum(weight).alias("_s"))
    before = sums.withColumn("_b", F.coalesce(F.sum("_s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).withColumn("_t", F.sum("_s").over(W.partitionBy()))
    inside = W.partitionBy("_p").orderBy("rn").rowsBetween(W.unboundedPreceding, 0)
    j = parts.withColumn("_c", F.sum(weight).over(inside)).join(before, "_p")
    end = (F.col("_b") + F.col("_c")) / F.col("_t") * n
    jitter = F.lit((seed * 2654435761 % 1000) / 1000)
    drawn = (F.ceil(end - jitter) - F.ceil(end - F.col(weight) / F.col("_t") * n - jitter)).cast("int")
    return j.withColumn("_n", drawn).where("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*df.columns)


def greedy_non_overlap(spans: Column) -> Column:
    """Spans (start, end, ...) that a sweep by start, longest first, keeps without overlap."""
    s = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    empty = F.slice(s, 1, 0)
    return F.aggregate(s, empty, lambda acc, x: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["end"] <= x["start"]), F.concat(acc, F.array(x))).otherwise(acc))


def run_limited(tokens: Column, limit: int) -> Column:
    """Tokens without the ones beyond limit in a run of equals."""
    idx = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    def ok(x):
        before = F.slice(tokens, F.greatest(x["i"] - limit + 1, F.lit(1)), F.least(x["i"], F.lit(limit)))
        return ~((x["i"] >= limit) & F.forall(before, lambda b: b == x["t"]))
    return F.transform(F.filter(idx, ok), lambda x: x["t"])


def char_windows(df: DataFrame, key: str, text: str, size: int, step: int) -> DataFrame:
    """(key, start, piece): windows of size characters every step."""
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))).alias("start")
    return df.select(key, text, at).select(key, "start", F.substr(F.col(text), F.col("start") + 1, F.lit(size)).alias("piece"))
