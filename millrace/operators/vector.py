"""Statistics of embedding distributions over ARRAY<FLOAT> columns.

What is linear in a set (centroids, mean distances, silhouettes) is computed from sums. What needs all pairs goes through
block_pairs(): both sides are hashed into blocks, a task multiplies one pair of blocks and returns a few numbers for each
row, and a second aggregate joins the blocks' answers. Neither pairs nor whole sets are ever materialised.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.profile import auc, ecdf, histogram  # noqa: F401  (distribution reports share them)

BLOCK_ROWS = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def unit(a: Column) -> Column:
    """Unit vector; NaN counts as 0, the zero vector stays."""
    clean = F.transform(a, lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x.cast("double")))
    n = F.sqrt(F.aggregate(clean, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(clean, lambda x: F.when(n > 0, x / n).otherwise(0.0))


def _partial_sums(batches):
    """(group, n, total) of a task's rows (group, vector)."""
    held: dict = {}
    for batch in batches:
        groups, vectors = batch.column(0).dictionary_encode(null_encoding="encode"), batch.column(1)
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
        values = pc.fill_null(vectors.flatten(), 0.0).to_numpy()
        starts, codes = np.cumsum(sizes) - sizes, groups.indices.to_numpy()
        names = groups.dictionary.to_pylist()
        for size in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == size)
            total, n = np.zeros((len(names), size)), np.bincount(codes[rows], minlength=len(names))
            np.add.at(total, codes[rows], values[starts[rows][:, None] + np.arange(size)])
            for k in np.flatnonzero(n):
                count, was = held.get(names[k], (0, np.zeros(0)))
                both = np.zeros(max(size, len(was)))
                both[:size] += total[k]
                both[: len(was)] += was
                held[names[k]] = (count + int(n[k]), both)
    schema = pa.schema([("group", batch.schema.field(0).type), ("n", pa.int64()), ("total", pa.list_(pa.float64()))]) if held else None
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), schema.field(0).type), pa.array([n for n, _ in held.values()]), pa.array([t.tolist() for _, t in held.values()], schema.field(2).type)], schema=schema)


def vector_sum(df: DataFrame, vector: str, by: str | None = None) -> DataFrame:
    """(by, n, total): sums by place of the vectors of each group; a task sends one row per group that it meets.

    Null and empty vectors don't count, a null component adds nothing, shorter vectors are filled up with zeros.
    """
    group = F.col(by) if by else F.lit(0)
    rows = df.select(group.alias("group"), F.col(vector).cast("array<double>").alias("vector"))
    parts = rows.mapInArrow(_partial_sums, f"group {rows.schema['group'].dataType.simpleString()}, n bigint, total array<double>")
    p = parts.select("group", "n", F.posexplode("total").alias("pos", "x")).groupBy("group", "pos").agg(F.sum("x").alias("s"), F.sum("n").alias("n"))
    out = p.groupBy("group").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("total"))
    return out.withColumnRenamed("group", by) if by else out.drop("group")


def centroid(df: DataFrame, vector: str, by: str | None = None) -> DataFrame:
    """(by, centroid): the normalised mean of the unit vectors."""
    s = vector_sum(df.withColumn(vector, unit(F.col(vector))), vector, by)
    return s.select(*([by] if by else []), unit(F.col("total")).alias("centroid"))


def centroid_similarity(df: DataFrame, vector: str, reference: DataFrame, to: str = "similarity") -> DataFrame:
    """df with its cosine to the centroid of reference (one row)."""
    return df.join(F.broadcast(centroid(reference, vector).withColumnRenamed("centroid", "_c"))).withColumn(to, cosine(F.col(vector), F.col("_c"))).drop("_c")


def _blocks(rows: int) -> int:
    return max(1, math.ceil(rows / BLOCK_ROWS))


def block_pairs(left: DataFrame, right: DataFrame, key: str, vector: str, per_block, schema: str, left_blocks: int | None = None, right_blocks: int | None = None) -> DataFrame:
    """per_block(left ids, left matrix, right ids, right matrix) -> DataFrame for every pair of blocks."""
    p = left_blocks or _blocks(left.count())
    q = right_blocks or _blocks(right.count())
    side = lambda df, n: df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("own"))
    a = side(left, p).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(q - 1)))).select(F.col("own").alias("i"), F.col("other").alias("j"), "id", "v")
    b = side(right, q).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(p - 1)))).select(F.col("other").alias("i"), F.col("own").alias("j"), "id", "v")

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        m = lambda d: np.array(d["v"].tolist(), dtype=np.float64).reshape(len(d), -1)
        if not len(x) or not len(y):
            return pd.DataFrame(per_block(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros((0, 1))))
        return pd.DataFrame(per_block(x["id"].to_numpy(), m(x), y["id"].to_numpy(), m(y)))
    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(run, schema)


def _units(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def neighbours(left: DataFrame, right: DataFrame, key: str, vector: str, k: int, metric: str = "cosine") -> DataFrame:
    """(id, other, score): the k nearest of right for each of left, the row itself left out; higher scores are nearer."""
    def per_block(a, x, b, y):
        if not len(a):
            return {"id": [], "other": [], "score": []}
        s = _units(x) @ _units(y).T if metric == "cosine" else -np.sqrt(np.maximum(((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T), 0))
        s = np.where(a[:, None] == b[None], -np.inf, s)
        top = np.argsort(-s, axis=1, kind="stable")[:, : min(k, len(b))]
        score = np.take_along_axis(s, top, 1).ravel()
        out = {"id": np.repeat(a, top.shape[1]), "other": b[top].ravel(), "score": score}
        keep = np.isfinite(score)
        return {c: v[keep] for c, v in out.items()}

    rows = block_pairs(left, right, key, vector, per_block, "id bigint, other bigint, score double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), "other"))), 1, k)
    return rows.groupBy("id").agg(best.alias("b")).select("id", F.explode("b").alias("x")).select("id", F.col("x.other").alias("other"), (-F.col("x.d")).alias("score"))


def proximity(df: DataFrame, reference: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """(key, score): half the cosine to the reference's centroid, half the mean of the k nearest cosines."""
    near = neighbours(df, reference, key, vector, k).groupBy("id").agg(F.avg("score").alias("knn"))
    return centroid_similarity(df, vector, reference).join(near, F.col(key) == F.col("id")).select(key, (0.5 * F.col("similarity") + 0.5 * F.col("knn")).alias("score"))


def loo_accuracy(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Leave-one-out accuracy of the nearest neighbour's label."""
    near = neighbours(df, df, key, vector, 1)
    own, other = df.select(F.col(key).alias("id"), F.col(label).alias("_a")), df.select(F.col(key).alias("other"), F.col(label).alias("_b"))
    return near.join(own, "id").join(other, "other").agg(F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("accuracy"))


def knn_two_sample(df: DataFrame, key: str, vector: str, label: str, k: int = 5) -> DataFrame:
    """Share of the k nearest by Euclidean distance with a row's own label."""
    near = neighbours(df, df, key, vector, k, "euclidean")
    own, other = df.select(F.col(key).alias("id"), F.col(label).alias("_a")), df.select(F.col(key).alias("other"), F.col(label).alias("_b"))
    return near.join(own, "id").join(other, "other").agg(F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("same"))


def mmd_rbf(left: DataFrame, right: DataFrame, key: str, vector: str, sigma: float) -> DataFrame:
    """Unbiased squared maximum mean discrepancy with a Gaussian kernel."""
    def total(name):
        def per_block(a, x, b, y):
            if not len(a):
                return {"part": [], "s": [], "n": []}
            d = np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0)
            kern = np.exp(-d / (2 * sigma**2))
            mask = (a[:, None] != b[None]) if name != "xy" else np.ones_like(kern, bool)
            return {"part": [name], "s": [float(kern[mask].sum())], "n": [int(mask.sum())]}
        return per_block
    schema = "part string, s double, n bigint"
    rows = block_pairs(left, left, key, vector, total("xx"), schema).union(block_pairs(right, right, key, vector, total("yy"), schema)).union(block_pairs(left, right, key, vector, total("xy"), schema))
    mean = lambda p: F.sum(F.when(F.col("part") == p, F.col("s"))) / F.sum(F.when(F.col("part") == p, F.col("n")))
    return rows.agg((mean("xx") + mean("yy") - 2 * mean("xy")).alias("mmd2"))


def median_sigma(df: DataFrame, key: str, vector: str, rows: int = 2000) -> float:
    """Median distance over at most rows vectors, those with the smallest hashes (the bound is the documented sample)."""
    x = np.array([r[0] for r in df.orderBy(F.xxhash64(key), key).limit(rows).select(vector).collect()], dtype=np.float64)
    if len(x) < 2:
        return 1.0
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0))
    return float(np.median(d[np.triu_indices(len(x), 1)])) or 1.0


def silhouette(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean silhouette by cosine distance over two or more groups, from the groups' vector sums."""
    u = df.withColumn("_u", unit(F.col(vector)))
    groups = vector_sum(u.select(label, "_u"), "_u", label)
    table = groups.agg(F.collect_list(F.struct(F.col(label).alias("l"), "n", "total")).alias("_g"))  # a row per label
    j = u.join(F.broadcast(table))
    own = F.filter("_g", lambda g: g["l"] == F.col(label))[0]
    a = F.when(own["n"] > 1, (own["n"] - dot(F.col("_u"), own["total"])) / (own["n"] - 1))
    b = F.array_min(F.transform(F.filter("_g", lambda g: g["l"] != F.col(label)), lambda g: 1 - dot(F.col("_u"), g["total"]) / g["n"]))
    s = j.select(a.alias("a"), b.alias("b")).select(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("s"))
    return s.agg(F.avg("s").alias("silhouette"))


def near_duplicate_rate(left: DataFrame, right: DataFrame, key: str, vector: str, threshold: float = 0.995) -> DataFrame:
    """rate, max and mean of the nearest cosine in right."""
    n = neighbours(left, right, key, vector, 1)
    return n.agg(F.avg((F.col("score") >= threshold).cast("double")).alias("rate"), F.max("score").alias("max_cos"), F.avg("score").alias("mean_cos"))


def kde(df: DataFrame, value: str, points: int = 100) -> DataFrame:
    """(x, density): Gaussian kernel density with Silverman's width on a grid, normalised to sum 1."""
    s = df.agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    grid = df.sparkSession.range(points).join(F.broadcast(s)).select("id", (F.col("lo") + F.col("id") * (F.col("hi") - F.col("lo")) / (points - 1)).alias("x"), (1.06 * F.col("sd") * F.pow("n", F.lit(-0.2))).alias("h"))
    packed = grid.agg(F.collect_list(F.struct("id", "x", "h")).alias("g"))  # points values
    hits = df.select(value).join(F.broadcast(packed)).select(value, F.explode("g").alias("g"))
    d = hits.groupBy("g.id", "g.x").agg(F.sum(F.exp(-F.pow((F.col(value) - F.col("g.x")) / F.col("g.h"), 2) / 2)).alias("s"))
    from pyspark.sql import Window as W

    return d.select("id", "x", (F.col("s") / F.sum("s").over(W.partitionBy())).alias("density"))


def ks(df: DataFrame, value: str, label: str) -> DataFrame:
    """Kolmogorov-Smirnov statistic, its asymptotic p and the difference of medians of two samples (label true or false)."""
    from millrace.operators.sample import numbered
    from pyspark.sql import Window as W

    c = df.groupBy(value).agg(F.count_if(label).alias("a"), F.count_if(~F.col(label)).alias("b"))
    rows = numbered(c, [value]).withColumn("_p", F.floor((F.col("rn") - 1) / 65536))
    sums = rows.groupBy("_p").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    upto = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("_p", F.coalesce(F.sum("sa").over(upto), F.lit(0)).alias("ba"), F.coalesce(F.sum("sb").over(upto), F.lit(0)).alias("bb"), F.sum("sa").over(W.partitionBy()).alias("na"), F.sum("sb").over(W.partitionBy()).alias("nb"))
    w = W.partitionBy("_p").orderBy("rn").rowsBetween(W.unboundedPreceding, 0)
    j = rows.withColumn("ca", F.sum("a").over(w)).withColumn("cb", F.sum("b").over(w)).join(before, "_p")
    stat = j.agg(F.max(F.abs((F.col("ba") + F.col("ca")) / F.col("na") - (F.col("bb") + F.col("cb")) / F.col("nb"))).alias("d"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    med = df.agg((F.percentile(F.when(F.col(label), F.col(value)), 0.5) - F.percentile(F.when(~F.col(label), F.col(value)), 0.5)).alias("median_diff"))
    en = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    lam = (en + 0.12 + 0.11 / en) * F.col("d")
    p = F.lit(0.0)
    for k in range(1, 101):
        p = p + 2 * (-1) ** (k - 1) * F.exp(-2 * k * k * lam * lam)
    return stat.join(F.broadcast(med)).select("d", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(lam < 0.2, 1.0).otherwise(p))).alias("p"), "median_diff")


def nearest_centre(df: DataFrame, key: str, vector: str, centres: DataFrame, max_centres: int = 10_000) -> DataFrame:
    """(key, centre, similarity): the centre(label, centroid) with the largest cosine; more than max_centres raise."""
    rows = centres.limit(max_centres + 1).collect()
    if len(rows) > max_centres:
        raise ValueError("too many centres")
    packed = df.sparkSession.createDataFrame([([tuple(r) for r in rows],)], f"c array<struct<label:{centres.schema[0].dataType.simpleString()},v:array<double>>>")
    j = df.join(F.broadcast(packed)).select(key, F.array_max(F.transform("c", lambda c: F.struct(F.coalesce(cosine(F.col(vector), c["v"]), F.lit(-2.0)).alias("s"), (-c["label"]).alias("neg")))).alias("b"))
    return j.select(key, (-F.col("b.neg")).alias("centre"), F.col("b.s").alias("similarity"))


def c2st_auc(df: DataFrame, key: str, vector: str, label: str, folds: int = 3) -> DataFrame:
    """Classifier two-sample test: mean AUC of a logistic regression over hashed folds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(array_to_vector(unit(F.col(vector))).alias("features"), F.col(label).cast("double").alias("label"), F.pmod(F.xxhash64(key), F.lit(folds)).alias("fold"))
    out = None
    for f in range(folds):
        model = LogisticRegression(maxIter=30, regParam=0.01).fit(rows.where(F.col("fold") != f))
        scored = model.transform(rows.where(F.col("fold") == f)).select(F.round(vector_to_array("probability")[1], 9).alias("s"), (F.col("label") > 0.5).alias("l"))
        one = auc(scored, "s", "l")
        out = one if out is None else out.union(one)
    return out.agg(F.avg("auc").alias("auc"))


def js_divergence(df: DataFrame, a: str, b: str, eps: float = 1e-12) -> DataFrame:
    """Jensen-Shannon divergence of two aligned histograms (columns of counts)."""
    from pyspark.sql import Window as W

    w = W.partitionBy()  # a row per bin
    n = df.select((F.coalesce(F.col(a), F.lit(0)) + eps).alias("p"), (F.coalesce(F.col(b), F.lit(0)) + eps).alias("q"))
    n = n.select((F.col("p") / F.sum("p").over(w)).alias("p"), (F.col("q") / F.sum("q").over(w)).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    return n.agg(F.sum(0.5 * F.col("p") * F.log(F.col("p") / F.col("m")) + 0.5 * F.col("q") * F.log(F.col("q") / F.col("m"))).alias("js"))


def leakage_report(train: DataFrame, other: DataFrame, key: str, vector: str, content: str | None = None, sigma: float | None = None) -> DataFrame:
    """One row on other against train.

    overlap, overlap_ratio: distinct contents (vectors, if no column is named) in both, and their share of other's; rate, max_cos,
    mean_cos: nearest cosines in train; centroid_cos; auc: of the cosine to train's centroid; loo_accuracy, mmd2, silhouette: of
    the two sets as labels, with keys that differ over both. sigma is the median distance of a sample if not given. score_densities() has the curves.
    """
    content = content or vector
    c = centroid(train, vector).withColumnRenamed("centroid", "a").join(F.broadcast(centroid(other, vector).withColumnRenamed("centroid", "b")))
    both = train.select(key, vector, F.lit(0).alias("side_of_row")).union(other.select(key, vector, F.lit(1)))
    sides = train.select(F.col(content).alias("c"), F.lit(0).alias("s")).union(other.select(F.col(content).alias("c"), F.lit(1))).where("c is not null").groupBy("c").agg(F.min("s").alias("low"), F.max("s").alias("high"))
    shared = F.count_if(F.col("low") < F.col("high"))
    parts = [
        sides.agg(shared.alias("overlap"), (shared / F.greatest(F.lit(1), F.count_if(F.col("high") == 1))).alias("overlap_ratio")),
        near_duplicate_rate(other, train, key, vector),
        auc(centroid_similarity(both, vector, train).select("similarity", (F.col("side_of_row") == 0).alias("inside")), "similarity", "inside").select("auc"),
        loo_accuracy(both, key, vector, "side_of_row"),
        mmd_rbf(train, other, key, vector, median_sigma(both, key, vector) if sigma is None else sigma).select("mmd2"),
        silhouette(both, vector, "side_of_row").select("silhouette"),
    ]
    out = c.select(cosine(F.col("a"), F.col("b")).alias("centroid_cos"))
    for part in parts:  # one row each
        out = out.join(F.broadcast(part))
    return out


def score_densities(train: DataFrame, other: DataFrame, vector: str, points: int = 100) -> DataFrame:
    """(side, id, density): curves of the cosine to train's centroid, of train and of other, each over its own range."""
    sides = [kde(centroid_similarity(d, vector, train), "similarity", points).select(F.lit(n).alias("side"), "id", "density") for n, d in (("train", train), ("other", other))]
    return sides[0].union(sides[1])


def verdict(pair_median: Column, auc_deltas: list[Column], ks_p: Column) -> tuple[Column, Column]:
    """(representative, ks_passes): a pair median of 0.65 and every AUC within 0.05; the KS test is told but does not decide."""
    ok = pair_median >= 0.65
    for d in auc_deltas:
        ok = ok & (F.abs(d) <= 0.05)
    return ok, ks_p > 0.05


def threshold_clusters(vectors: dict[str, list[float]], threshold: float = 0.6) -> dict[str, str]:
    """Label to the medoid of its cluster: labels join, by name, the first cluster with a member at least that near. For a label list."""
    names = sorted(vectors)
    x = _units(np.array([vectors[n] for n in names], dtype=float).reshape(len(names), -1))
    s, clusters = x @ x.T, []
    for i in range(len(names)):
        home = next((c for c in clusters if s[i, c].max() >= threshold), None)
        clusters.append([i]) if home is None else home.append(i)
    return {names[i]: names[max(c, key=lambda m: (s[m, c].sum(), -m))] for c in clusters for i in c}


def threshold_sweep(df: DataFrame, similarity: str, ok: str, low: float = 0.30, high: float = 0.80, step: float = 0.05) -> DataFrame:
    """(threshold, accuracy) by falling accuracy, the lowest threshold first on ties."""
    n = round((high - low) / step) + 1
    grid = F.explode(F.array(*[F.lit(round(low + i * step, 2)) for i in range(n)])).alias("threshold")
    return df.select(similarity, ok, grid).groupBy("threshold").agg(F.avg(((F.col(similarity) >= F.col("threshold")) & F.col(ok)).cast("double")).alias("accuracy")).orderBy(F.desc("accuracy"), "threshold")


def pca(df: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("f"))
    return PCA(k=k, inputCol="f", outputCol="p").fit(rows).transform(rows).select(key, vector_to_array("p").alias("point"))
