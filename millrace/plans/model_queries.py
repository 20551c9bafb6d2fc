"""Queries of sampling, vectors, text-pair metrics, spans, synthesis and model seams."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import infer as I
from millrace.operators import metrics as M
from millrace.operators import profile as P
from millrace.operators import sample as A
from millrace.operators import spans as N
from millrace.operators import styles as L
from millrace.operators import synth as Y
from millrace.operators import vector as V

from . import samples as S
from .registry import query, sql_of, table

# --- sampling -------------------------------------------------------------------------------------------------------

_H = "md5('42:' || {})"


@query("smp1_single_cap", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY md5('42:' || l_linenumber), l_linenumber) AS r FROM lineitem) t WHERE r <= 2")
def smp1(spark, sf):
    return A.capped(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 2, F.struct(A.hash_order("l_linenumber"), "l_linenumber"))


@query("smp1_multi_cap")
def smp1m(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    return A.multi_capped(d, "o_orderkey", {"o_custkey": 1, "o_orderpriority": 300}, total=1000, bucket="o_orderstatus")


@query("smp2_bucketed_top_up")
def smp2(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return A.topped_up(d, "o_orderkey", {"o_custkey": 1}, "o_orderstatus", 100, 400)


_QUOTA = "SELECT lang, n, CAST(least(n, q + CASE WHEN row_number() OVER (ORDER BY x - q DESC, lang) <= 100 - sum(q) OVER () THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM (SELECT lang, n, 100.0 * n / sum(n) OVER () AS x, floor(100.0 * n / sum(n) OVER ()) AS q FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) a) b"


@query("smp3_stratified", f"SELECT d.doc_id, d.lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents) d JOIN ({_QUOTA}) q ON q.lang = d.lang WHERE d.r <= q.quota")
def smp3(spark, sf):
    return A.stratified(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang", 100)


@query("smp4_equalised", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents) d WHERE lang IN ('de', 'es', 'fr') AND r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents WHERE lang IN ('de', 'es', 'fr') GROUP BY lang) z) OR lang = 'en' AND r > 10 AND r <= 10 + (SELECT min(n) FROM (SELECT count(*) AS n FROM documents WHERE lang IN ('de', 'es', 'fr') GROUP BY lang) z)")
def smp4(spark, sf):
    return A.equalised(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang", ["de", "es", "fr"], "en", 10)


@query("smp5_label_groups")
def smp5(spark, sf):
    c = [(r[0], r[1]) for r in table(spark, sf, "documents").groupBy("source").count().collect()]  # a label list
    return spark.createDataFrame(sorted(A.label_groups(c).items()), "source string, part int")


_RR = "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS s FROM documents) t ORDER BY r, s DESC, source LIMIT 50"


@query("smp6_round_robin", _RR)
def smp6(spark, sf):
    return A.round_robin(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", "source", 50)


@query("smp7_integrate")
def smp7(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return A.integrate(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "doc_id", "source", 60)


@query("smp8_family_split", "SELECT p_brand, p_type, CASE WHEN r <= round(n * 0.5) THEN 'train' WHEN r <= round(n * 0.5) + round(n * 0.25) THEN 'val' ELSE 'test' END AS part FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY md5('7:' || p_type), p_type) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM (SELECT DISTINCT p_brand, p_type FROM part) d) t")
def smp8(spark, sf):
    return A.family_split(table(spark, sf, "part").select("p_brand", "p_type").distinct(), "p_brand", "p_type")


@query("smp9_multiset_counts")
def smp9(spark, sf):
    n = table(spark, sf, "nation").orderBy("n_name").select("n_name").collect()  # a label list
    return spark.createDataFrame(list(zip([r[0] for r in n], A.multiset_counts(len(n), 500, 42))), "n_name string, n int")


@query("smp10_equal_quota", "SELECT n_name, CAST(floor(107 / n) + CASE WHEN r <= 107 % n THEN 1 ELSE 0 END AS BIGINT) AS quota FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS r, count(*) OVER () AS n FROM nation) t")
def smp10(spark, sf):
    return A.equal_quota(table(spark, sf, "nation"), "n_name", 107)


@query("smp11_sequential_split", "SELECT c_custkey, CASE WHEN r <= 30 THEN 'test' WHEN r <= 80 THEN 'val' END AS part FROM (SELECT c_custkey, row_number() OVER (ORDER BY md5('42:' || c_custkey), c_custkey) AS r FROM customer) t")
def smp11(spark, sf):
    return A.sequential_split(table(spark, sf, "customer").select("c_custkey"), "c_custkey", [("test", 30), ("val", 50)]).select("c_custkey", "part")


@query("smp12_quantile_split", "SELECT event_id, CASE WHEN value >= hi THEN 'ID' WHEN value <= lo THEN 'OOD' ELSE 'MID' END AS part FROM events, (SELECT quantile_cont(value, 0.2) AS lo, quantile_cont(value, 0.8) AS hi FROM events) q")
def smp12(spark, sf):
    return A.quantile_split(table(spark, sf, "events").select("event_id", "value"), "value").select("event_id", "part")


@query("smp13_augmented")
def smp13(spark, sf):
    return A.augmented(table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("prompt")), "id", "prompt", ["noise one", "noise two"])


@query("smp14_weighted")
def smp14(spark, sf):
    return A.weighted_with_replacement(table(spark, sf, "customer").select("c_custkey", F.abs("c_acctbal").alias("w")), "c_custkey", "w", 200)


@query("win5_running_caps")
def win5(spark, sf):
    return A.multi_capped(table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"), "l_partkey", "l_suppkey", "l_returnflag"), "k", {"l_partkey": 2, "l_suppkey": 20}, bucket="l_returnflag")


# --- vectors --------------------------------------------------------------------------------------------------------

_U = "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


def _emb(spark, sf):
    return table(spark, sf, "embeddings")


def _halves(spark, sf):
    e = _emb(spark, sf)
    return e.where("label % 2 = 0"), e.where("label % 2 = 1")


_PAIR = f"(SELECT a.vec_id AS id, b.vec_id AS other, a.label AS la, b.label AS lb, list_cosine_similarity(a.e, b.e) AS c, list_distance(a.e, b.e) AS d FROM {_U} a, {_U} b WHERE a.vec_id <> b.vec_id) p"
_CENT = "(SELECT array_agg(m ORDER BY i) AS c FROM (SELECT i, avg(e[i] / n) AS m FROM (SELECT e, sqrt(list_dot_product(e, e)) AS n, unnest(generate_series(1, len(e))) AS i FROM {u} u WHERE {w}) x GROUP BY i) y)"


def _cent(w="true"):
    return _CENT.format(u=_U, w=w)


@query("vec1_unit_cosine", f"SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(list_cosine_similarity(e, (SELECT e FROM {_U} z WHERE vec_id = 0)), 6) AS cos0 FROM {_U} u")
def vec1(spark, sf):
    e = _emb(spark, sf)
    zero = e.where("vec_id = 0").select(F.col("embedding").alias("z"))
    return e.join(F.broadcast(zero)).select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.dot(V.unit(F.col("embedding")), V.unit(F.col("z"))), 6).alias("cos0"))


@query("vec2_centroid", f"SELECT CAST(i AS INTEGER) AS pos, round(c[i] / sqrt(list_dot_product(c, c)), 6) AS x FROM (SELECT c, unnest(generate_series(1, len(c))) AS i FROM {_cent()} k) t")
def vec2(spark, sf):
    return V.centroid(_emb(spark, sf), "embedding").select(F.posexplode("centroid").alias("p", "x")).select((F.col("p") + 1).alias("pos"), F.round("x", 6).alias("x"))


@query("vec3_centroid_similarity", f"SELECT vec_id, round(list_cosine_similarity(e, c), 6) AS similarity FROM {_U} u, {_cent('label % 2 = 0')} k")
def vec3(spark, sf):
    return V.centroid_similarity(_emb(spark, sf), "embedding", _halves(spark, sf)[0]).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("vec4_auc_vs_train", f"SELECT round((sum(r) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 5) AS auc FROM (SELECT label % 2 = 0 AS pos, row_number() OVER (ORDER BY list_cosine_similarity(e, c)) AS r FROM {_U} u, {_cent('label % 2 = 0')} k) t")
def vec4(spark, sf):
    s = V.centroid_similarity(_emb(spark, sf), "embedding", _halves(spark, sf)[0])
    return P.auc(s.select("similarity", (F.col("label") % 2 == 0).alias("pos")), "similarity", "pos").select(F.round("auc", 5).alias("auc"))


@query("vec5_auc_pooled_centre", f"SELECT round((sum(r) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 5) AS auc FROM (SELECT label % 2 = 0 AS pos, row_number() OVER (ORDER BY list_cosine_similarity(e, c)) AS r FROM {_U} u, {_cent()} k) t")
def vec5(spark, sf):
    s = V.centroid_similarity(_emb(spark, sf), "embedding", _emb(spark, sf))
    return P.auc(s.select("similarity", (F.col("label") % 2 == 0).alias("pos")), "similarity", "pos").select(F.round("auc", 5).alias("auc"))


@query("vec6_proximity", f"SELECT vec_id, round(0.5 * list_cosine_similarity(u.e, k.c) + 0.5 * n.knn, 5) AS score FROM {_U} u, {_cent('label % 2 = 0')} k, (SELECT id, avg(c) AS knn FROM (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY c DESC) AS r FROM {_PAIR} WHERE lb % 2 = 0 AND la % 2 = 1) q WHERE r <= 5 GROUP BY id) n WHERE u.vec_id = n.id")
def vec6(spark, sf):
    a, b = _halves(spark, sf)
    return V.proximity(b, a, "vec_id", "embedding").select("vec_id", F.round("score", 5).alias("score"))


@query("vec7_loo_accuracy", f"SELECT round(avg(CASE WHEN la % 2 = lb % 2 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (SELECT id, la, arg_max(lb, c) AS lb FROM {_PAIR} GROUP BY id, la) t")
def vec7(spark, sf):
    return V.loo_accuracy(_emb(spark, sf).withColumn("side", F.col("label") % 2), "vec_id", "embedding", "side").select(F.round("accuracy", 6).alias("accuracy"))


@query("vec8_knn_two_sample", f"SELECT round(avg(CASE WHEN la % 2 = lb % 2 THEN 1.0 ELSE 0.0 END), 6) AS same FROM (SELECT la, lb, row_number() OVER (PARTITION BY id ORDER BY d) AS r FROM {_PAIR}) t WHERE r <= 5")
def vec8(spark, sf):
    return V.knn_two_sample(_emb(spark, sf).withColumn("side", F.col("label") % 2), "vec_id", "embedding", "side").select(F.round("same", 6).alias("same"))


@query("vec9_mmd", f"SELECT round(avg(exp(-d * d / 200)) FILTER (WHERE la % 2 = 0 AND lb % 2 = 0) + avg(exp(-d * d / 200)) FILTER (WHERE la % 2 = 1 AND lb % 2 = 1) - 2 * avg(exp(-d * d / 200)) FILTER (WHERE la % 2 = 0 AND lb % 2 = 1), 6) AS mmd2 FROM {_PAIR}")
def vec9(spark, sf):
    a, b = _halves(spark, sf)
    return V.mmd_rbf(a, b, "vec_id", "embedding", 10.0).select(F.round("mmd2", 6).alias("mmd2"))


@query("vec10_silhouette", f"SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM (SELECT id, avg(1 - c) FILTER (WHERE la % 2 = lb % 2) AS a, avg(1 - c) FILTER (WHERE la % 2 <> lb % 2) AS b FROM {_PAIR} GROUP BY id) t")
def vec10(spark, sf):
    return V.silhouette(_emb(spark, sf).withColumn("side", F.col("label") % 2), "embedding", "side").select(F.round("silhouette", 6).alias("silhouette"))


@query("vec11_near_duplicates", f"SELECT round(avg(CASE WHEN m >= 0.995 THEN 1.0 ELSE 0.0 END), 6) AS rate, round(max(m), 6) AS max_cos, round(avg(m), 6) AS mean_cos FROM (SELECT id, max(c) AS m FROM {_PAIR} WHERE la % 2 = 1 AND lb % 2 = 0 GROUP BY id) t")
def vec11(spark, sf):
    a, b = _halves(spark, sf)
    return V.near_duplicate_rate(b, a, "vec_id", "embedding").select(*[F.round(c, 6).alias(c) for c in ("rate", "max_cos", "mean_cos")])


@query("vec12_kde", "SELECT id, round(s / sum(s) OVER (), 8) AS density FROM (SELECT id, sum(exp(-power((value - x) / h, 2) / 2)) AS s FROM (SELECT id, lo + id * (hi - lo) / 49 AS x, 1.06 * sd * power(n, -0.2) AS h FROM (SELECT count(value) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi FROM events) q, (SELECT unnest(generate_series(0, 49)) AS id) g) k, events GROUP BY id) t")
def vec12(spark, sf):
    return V.kde(table(spark, sf, "events"), "value", 50).select("id", F.round("density", 8).alias("density"))


@query("vec13_ks", "SELECT round(max(abs(a / na - b / nb)), 6) AS d, round(max(ma - mb), 6) AS median_diff FROM (SELECT value, CAST(sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY value) AS DOUBLE) AS a, CAST(sum(CASE WHEN user_id % 2 = 1 THEN 1 ELSE 0 END) OVER (ORDER BY value) AS DOUBLE) AS b, count(*) FILTER (WHERE user_id % 2 = 0) OVER () AS na, count(*) FILTER (WHERE user_id % 2 = 1) OVER () AS nb FROM events) t, (SELECT median(value) FILTER (WHERE user_id % 2 = 0) AS ma, median(value) FILTER (WHERE user_id % 2 = 1) AS mb FROM events) m")
def vec13(spark, sf):
    return V.ks(table(spark, sf, "events").select("value", (F.col("user_id") % 2 == 0).alias("left")), "value", "left").select(F.round("d", 6).alias("d"), F.round("median_diff", 6).alias("median_diff"))


@query("vec14_nearest_centre")
def vec14(spark, sf):
    e = _emb(spark, sf)
    return V.nearest_centre(e, "vec_id", "embedding", V.centroid(e, "embedding", "label").select(F.col("label").cast("bigint"), "centroid")).select("vec_id", "centre", F.round("similarity", 6).alias("similarity"))


@query("vec15_c2st_auc")
def vec15(spark, sf):
    return V.c2st_auc(_emb(spark, sf).withColumn("side", F.col("label") % 2), "vec_id", "embedding", "side")


@query("vec16_pair_quartiles", f"SELECT round(quantile_cont(c, 0.5), 6) AS median, round(quantile_cont(c, 0.25), 6) AS q1, round(quantile_cont(c, 0.75), 6) AS q3 FROM (SELECT list_cosine_similarity(a.e, b.e) AS c FROM {_U} a JOIN {_U} b ON b.vec_id = a.vec_id + 1) t")
def vec16(spark, sf):
    e = _emb(spark, sf)
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id").select(V.cosine(F.col("embedding"), F.col("b")).alias("c"))
    return j.agg(*[F.round(F.percentile("c", q), 6).alias(n) for n, q in (("median", 0.5), ("q1", 0.25), ("q3", 0.75))])


@query("vec17_qq", "SELECT i AS pct, round(a[i], 6) AS a, round(b[i], 6) AS b FROM (SELECT " + ", ".join(f"[{', '.join(f'quantile_cont(value, {i / 100}) FILTER (WHERE user_id % 2 = {side})' for i in range(1, 100))}] AS {n}" for side, n in ((0, "a"), (1, "b"))) + " FROM events) q, (SELECT unnest(generate_series(1, 99)) AS i) g")
def vec17(spark, sf):
    e = table(spark, sf, "events")
    q = F.array(*[F.lit(i / 100) for i in range(1, 100)])
    r = e.agg(*[F.percentile(F.when(F.col("user_id") % 2 == side, F.col("value")), q).alias(n) for side, n in ((0, "a"), (1, "b"))])
    z = r.select(F.posexplode(F.arrays_zip("a", "b")).alias("pos", "z"))
    return z.select((F.col("pos") + 1).cast("bigint").alias("pct"), F.round("z.a", 6).alias("a"), F.round("z.b", 6).alias("b"))


_AUC = sql_of("vec4_auc_vs_train")


@query("vec18_leakage_report", f"""SELECT round(list_cosine_similarity(a.c, b.c), 6) AS centroid_cos, m.*, u.auc, l.accuracy AS loo_accuracy, d.mmd2, w.silhouette, o.overlap, round(o.overlap / o.n, 6) AS overlap_ratio
FROM {_cent('label % 2 = 0')} a, {_cent('label % 2 = 1')} b, (SELECT round(avg(CASE WHEN m >= 0.995 THEN 1.0 ELSE 0.0 END), 6) AS rate, round(max(m), 6) AS max_cos, round(avg(m), 6) AS mean_cos FROM (SELECT id, max(c) AS m FROM {_PAIR} WHERE la % 2 = 1 AND lb % 2 = 0 GROUP BY id) t) m,
({_AUC}) u, ({sql_of('vec7_loo_accuracy')}) l, ({sql_of('vec9_mmd')}) d, ({sql_of('vec10_silhouette')}) w,
(SELECT count(DISTINCT e) FILTER (WHERE label % 2 = 1 AND e IN (SELECT e FROM {_U} x WHERE label % 2 = 0)) AS overlap, count(DISTINCT e) FILTER (WHERE label % 2 = 1) AS n FROM {_U} y) o""")
def vec18(spark, sf):
    a, b = _halves(spark, sf)
    r = V.leakage_report(a, b, "vec_id", "embedding", sigma=10.0).withColumnRenamed("accuracy", "loo_accuracy")
    return r.select("overlap", *[F.round(c, 5 if c == "auc" else 6).alias(c) for c in ("centroid_cos", "rate", "max_cos", "mean_cos", "auc", "loo_accuracy", "mmd2", "silhouette", "overlap_ratio")])


@query("vec19_verdict", "SELECT event_id, value / 10 >= 0.65 AND abs(value / 100 - 0.1) <= 0.05 AS representative, value > 0.05 AS ks_passes FROM events")
def vec19(spark, sf):
    ok, passes = V.verdict(F.col("value") / 10, [F.col("value") / 100 - 0.1], F.col("value"))
    return table(spark, sf, "events").select("event_id", ok.alias("representative"), passes.alias("ks_passes"))


@query("vec20_label_clusters")
def vec20(spark, sf):
    rows = V.centroid(_emb(spark, sf), "embedding", "label").collect()  # a label list
    return spark.createDataFrame(sorted(V.threshold_clusters({str(r[0]): list(r[1]) for r in rows}).items()), "label string, canonical string")


@query("vec21_nearest_label")
def vec21(spark, sf):
    e = _emb(spark, sf)
    c = V.centroid(e, "embedding", "label").select(F.col("label").cast("bigint"), "centroid")
    return V.nearest_centre(e, "vec_id", "embedding", c).select("vec_id", "centre")


@query("vec22_threshold_sweep", "SELECT threshold, round(avg(CASE WHEN value / 20 >= threshold AND user_id % 2 = 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM events, (SELECT unnest([0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80]::DOUBLE[]) AS threshold) g GROUP BY threshold")
def vec22(spark, sf):
    d = table(spark, sf, "events").select((F.col("value") / 20).alias("s"), (F.col("user_id") % 2 == 0).alias("ok"))
    return V.threshold_sweep(d, "s", "ok").select("threshold", F.round("accuracy", 6).alias("accuracy"))


@query("vec24_pca")
def vec24(spark, sf):
    return V.pca(_emb(spark, sf), "vec_id", "embedding").select("vec_id", F.round(F.abs(F.col("point")[0]), 5).alias("x"), F.round(F.abs(F.col("point")[1]), 5).alias("y"))


@query("mth6_js_divergence", "SELECT round(sum(0.5 * p * ln(p / m) + 0.5 * q * ln(q / m)), 8) AS js FROM (SELECT p, q, (p + q) / 2 AS m FROM (SELECT (a + 1e-12) / sum(a + 1e-12) OVER () AS p, (b + 1e-12) / sum(b + 1e-12) OVER () AS q FROM (SELECT event_type, CAST(count(*) FILTER (WHERE user_id % 2 = 0) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE user_id % 2 = 1) AS DOUBLE) AS b FROM events GROUP BY event_type) x) y) z")
def mth6(spark, sf):
    h = table(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("user_id") % 2 == 0).alias("a"), F.count_if(F.col("user_id") % 2 == 1).alias("b"))
    return V.js_divergence(h, "a", "b").select(F.round("js", 8).alias("js"))


# --- text-pair metrics ----------------------------------------------------------------------------------------------

def _turns(spark, sf):
    c = table(spark, sf, "conversations")
    a, b = (c.where(F.col("turn") == t).select("conv_id", F.col("text").alias(n)) for t, n in ((0, "a"), (1, "b")))
    return a.join(b, "conv_id")


_TURNS = "(SELECT a.conv_id, a.text AS a, b.text AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1) t"
_SET = "list_distinct(regexp_extract_all(lower({}), '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]'))"


@query("met1_chrf", f"""WITH g AS (SELECT conv_id, n, side, x[i:i + n - 1] AS g FROM (SELECT conv_id, n, side, x, unnest(generate_series(1, length(x) - n + 1)) AS i FROM (SELECT conv_id, 0 AS side, regexp_replace(a, '\\s', '', 'g') AS x FROM {_TURNS} UNION ALL SELECT conv_id, 1, regexp_replace(b, '\\s', '', 'g') FROM {_TURNS}) s, (SELECT unnest([2, 3, 4, 5, 6]) AS n) k WHERE length(x) >= n) q),
c AS (SELECT conv_id, n, g, count(*) FILTER (WHERE side = 0) AS ca, count(*) FILTER (WHERE side = 1) AS cb FROM g GROUP BY conv_id, n, g),
f AS (SELECT conv_id, n, CAST(sum(least(ca, cb)) AS DOUBLE) AS m, CAST(sum(ca) AS DOUBLE) AS na, CAST(sum(cb) AS DOUBLE) AS nb FROM c GROUP BY conv_id, n)
SELECT t.conv_id, round(coalesce(s.s, 0.0) / 5, 6) AS chrf FROM {_TURNS} LEFT JOIN (SELECT conv_id, sum(CASE WHEN m > 0 THEN 5 * (m / nb) * (m / na) / (4 * (m / nb) + (m / na)) ELSE 0 END) AS s FROM f GROUP BY conv_id) s ON s.conv_id = t.conv_id""")
def met1(spark, sf):
    return M.chrf(_turns(spark, sf), "conv_id", "a", "b")


@query("met2_jaccard", f"SELECT conv_id, round(CAST(len(list_intersect({_SET.format('a')}, {_SET.format('b')})) AS DOUBLE) / len(list_distinct(list_concat({_SET.format('a')}, {_SET.format('b')}))), 6) AS jaccard FROM {_TURNS}")
def met2(spark, sf):
    return _turns(spark, sf).select("conv_id", M.jaccard(F.col("a"), F.col("b")).alias("jaccard"))


@query("met3_structural_auc")
def met3(spark, sf):
    return _turns(spark, sf).select("conv_id", M.structural_auc()(F.col("a"), F.col("b")).alias("auc_struct"))


@query("met4_dice", f"SELECT conv_id, round(2.0 * len(list_intersect({_SET.format('a')}, {_SET.format('b')})) / (len({_SET.format('a')}) + len({_SET.format('b')})), 6) AS dice FROM {_TURNS}")
def met4(spark, sf):
    return _turns(spark, sf).select("conv_id", M.dice(F.col("a"), F.col("b")).alias("dice"))


@query("met5_order_agreement", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE round(2.0 / 3, 6) END AS agreement FROM documents")
def met5(spark, sf):
    k = F.col("doc_id") % 3
    arr = lambda *x: F.array(*map(F.lit, x))
    b = F.when(k == 0, arr(1, 2, 3, 9)).when(k == 1, arr(3, 2, 1)).otherwise(arr(1, 3, 2))
    return table(spark, sf, "documents").select("doc_id", F.round(M.order_agreement(arr(1, 2, 3), b), 6).alias("agreement"))


@query("met6_7_coverage_composite", "SELECT doc_id, round(f, 6) AS coverage, round(0.45 * 0.5 + 0.35 * f + 0.2, 6) AS score FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 / 3 ELSE 0.0 END AS f FROM documents) t")
def met67(spark, sf):
    k = F.col("doc_id") % 3
    arr = lambda *x: F.array(*map(F.lit, x))
    f = M.coverage_f1(arr("AGE", "SEX"), F.when(k == 0, arr("SEX", "AGE")).when(k == 1, arr("AGE")).otherwise(arr("ORGAN")))
    return table(spark, sf, "documents").select("doc_id", F.round(f, 6).alias("coverage"), F.round(M.composite(F.lit(0.5), f, F.lit(1.0)), 6).alias("score"))


_CASES = [("male", "male", 0.0), ("Female", "female", 0.1), ("x", "", 0.9), ("other", "not applicable", 0.0), ("skin", "dermis", 0.8), ("skin with", "skin", 0.99), ("24 h", "1 day", 0.0), ("3 days", "9 days", 0.2)]


def _cases(spark, sf):
    i = F.col("doc_id")
    p, r = S.pick(i, [c[0] for c in _CASES]), S.pick(i, [c[1] for c in _CASES])
    c = F.element_at(F.array(*[F.lit(c[2]) for c in _CASES]), (i % len(_CASES) + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", p.alias("p"), r.alias("r"), c.alias("c"))


@query("met8_category_match", "SELECT doc_id, list_extract([true, true, NULL, true, true, false, true, false], CAST(doc_id % 8 AS INTEGER) + 1) AS matched FROM documents")
def met8(spark, sf):
    return _cases(spark, sf).select("doc_id", M.category_match(F.col("p"), F.col("r"), F.col("c"), 0.45, days=True).alias("matched"))


@query("met9_soft_accuracy", "SELECT label, round(avg(CASE WHEN list_cosine_similarity(e, (SELECT e FROM " + _U + " z WHERE vec_id = 0)) >= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM " + _U + " u GROUP BY label")
def met9(spark, sf):
    e = _emb(spark, sf)
    zero = e.where("vec_id = 0").select(F.col("embedding").alias("z"))
    j = e.join(F.broadcast(zero)).select("label", (V.cosine(F.col("embedding"), F.col("z")) >= 0.1).alias("ok"))
    return j.groupBy("label").agg(F.round(F.avg(F.col("ok").cast("double")), 6).alias("accuracy"))


@query("met10_duration_match", "SELECT doc_id, list_extract([false, false, true, false, true, true, true, false], CAST(doc_id % 8 AS INTEGER) + 1) AS matched FROM documents")
def met10(spark, sf):
    return _cases(spark, sf).select("doc_id", M.duration_match(F.col("p"), F.col("r"), F.col("c")).alias("matched"))


@query("met11_validate", "SELECT c_custkey, c_nationkey % 2 = 0 OR c_mktsegment = 'BUILDING' AS valid FROM customer")
def met11(spark, sf):
    c = table(spark, sf, "customer")
    every = c.select(F.lit("c_nationkey").alias("from_attr"), F.col("c_nationkey").cast("string").alias("from_val"), F.lit("c_mktsegment").alias("to_attr"), F.col("c_mktsegment").alias("to_val")).distinct()
    return M.validate(c, "c_custkey", every.where("cast(from_val as int) % 2 = 0 or to_val = 'BUILDING'"), [("c_nationkey", "c_mktsegment")])


# --- spans ----------------------------------------------------------------------------------------------------------

_NOTES = ["A 54 years old male with melanoma of the skin, treated 24 h.", "No carcinoma. SK-MEL-28 bulk, resistant.", "Methods\nsingle-cell, lung\nContact\nblood", "", "plain words"]


def _with_cell(cells):
    """The whole text of a document, and below it an invented cell, so that rare branches are met."""
    return F.concat_ws("\n", "text", S.pick(F.col("doc_id"), cells))


def _noted(spark, sf):
    return table(spark, sf, "documents").select("doc_id", _with_cell(_NOTES).alias("t"))


def _tagged(spark, sf):
    return _noted(spark, sf).withColumn("s", N.tag()(F.col("t")))


def _shown(c):
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["category"])), " ")


@query("spn1_rule_tags")
def spn1(spark, sf):
    return _tagged(spark, sf).select("doc_id", _shown(F.col("s")).alias("spans"))


@query("spn2_coerce", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '0:4:A' ELSE '2:9:B' END AS spans FROM documents")
def spn2(spark, sf):
    s = lambda a, b, c: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("category"))
    arr = F.when(F.col("doc_id") % 2 == 0, F.array(s(0, 4, "A"), s(5, 5, "B"), s(1, 3, ""))).otherwise(F.array(s(9, 2, "A"), s(2, 9, "B")))
    return table(spark, sf, "documents").select("doc_id", _shown(N.coerce(arr)).alias("spans"))


@query("spn3_section_filter")
def spn3(spark, sf):
    return _tagged(spark, sf).withColumn("q", N.sections()(F.col("t"))).select("doc_id", _shown(N.filter_sections(F.col("s"), F.col("q"))).alias("spans"))


@query("str49_sections")
def str49(spark, sf):
    return _noted(spark, sf).select("doc_id", F.explode(N.sections()(F.col("t"))).alias("x")).select("doc_id", "x.start", "x.end", "x.weight")


@query("spn4_negation_filter")
def spn4(spark, sf):
    cues = N.tag((("NEG", N.NEGATIONS),))
    return _tagged(spark, sf).withColumn("n", cues(F.col("t"))).select("doc_id", _shown(N.filter_negated(F.col("s"), F.col("n"))).alias("spans"))


@query("spn5_acronym_guard")
def spn5(spark, sf):
    return _tagged(spark, sf).select("doc_id", _shown(N.acronym_guard(F.col("s"), F.col("t"))).alias("spans"))


@query("spn6_overlaps", "SELECT doc_id, '0:9:A 9:12:B' AS spans FROM documents")
def spn6(spark, sf):
    s = lambda a, b, c: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("category"))
    return table(spark, sf, "documents").select("doc_id", _shown(N.resolve_overlaps(F.array(s(9, 12, "CHUNK"), s(0, 5, "C"), s(0, 9, "A"), s(9, 12, "B"), s(4, 10, "D")))).alias("spans"))


@query("spn7_enrich_codes")
def spn7(spark, sf):
    codes = N.tag((("CHUNK", r"\b[A-Za-z]+-?\d+\b|\b\d+ [a-z]\b"),))
    return _tagged(spark, sf).withColumn("k", codes(F.col("t"))).select("doc_id", _shown(N.enrich(F.col("s"), F.col("k"))).alias("spans"))


@query("spn8_masked_text")
def spn8(spark, sf):
    return _tagged(spark, sf).select("doc_id", N.synthesis(N.resolve_overlaps(F.col("s"))).alias("mask"))


@query("win6_non_overlap", "SELECT doc_id, '0-5 5-9' AS kept FROM documents")
def win6(spark, sf):
    s = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    k = A.greedy_non_overlap(F.array(s(5, 9), s(0, 5), s(0, 2), s(4, 6)))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(k, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), " ").alias("kept"))


# --- synthesis ------------------------------------------------------------------------------------------------------

_MASKED = ["__AGE__ 54 and __AGE__ 33 years. The patient had skin lesions here. __SEX__", "Melanoma of skin was treated for a long time. It came back after nine months.", "[1] skin  , lung ;; end -", ""]


def _masked(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.pick(F.col("doc_id"), _MASKED).alias("t"))  # as in the SQL of str38 and str43


def _texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", _with_cell(_MASKED).alias("t"))


for _name, _fn in (("str37_39_term_markers", lambda: Y.replace_terms({"skin": "ORGAN", "melanoma": "DISEASE", "skin lesions": "DISEASE"}, {"ORGAN": 1})), ("str40_value_collapse", Y.collapse_values),
                   ("str41_mention_limit", Y.limit_mentions), ("str42_insert_missing", lambda: Y.insert_missing(["AGE", "ORGAN"])), ("str45_win8_number_scrub", lambda: Y.scrub_numbers("__age__"))):
    query(_name)(lambda spark, sf, fn=_fn: _texts(spark, sf).select("doc_id", fn()(F.col("t")).alias("text")))


@query("str38_mask_clean_up", "SELECT doc_id, list_extract(['__AGE__ 54 and __AGE__ 33 years. The patient had skin lesions here. __SEX__', 'Melanoma of skin was treated for a long time. It came back after nine months.', 'skin, lung; end', ''], CAST(doc_id % 4 AS INTEGER) + 1) AS text FROM documents")
def str38(spark, sf):
    return _masked(spark, sf).select("doc_id", Y.clean_mask(F.col("t")).alias("text"))


@query("str43_study_prefixes", "SELECT doc_id, list_extract(['__AGE__ 54 and __AGE__ 33 years. Study: The patient had skin lesions here. __SEX__', 'Study: Melanoma of skin was treated for a long time. It came back after nine months.', 'Study: [1] skin  , lung ;; end -', ''], CAST(doc_id % 4 AS INTEGER) + 1) AS text FROM documents")
def str43(spark, sf):
    return _masked(spark, sf).select("doc_id", Y.study_prefixes(F.col("t")).alias("text"))


@query("str44_guarded_rewrite")
def str44(spark, sf):
    d = _texts(spark, sf).withColumn("n", Y.collapse_values()(F.col("t")))
    return d.select("doc_id", Y.guarded(F.col("n"), F.col("t"), M.jaccard(F.col("n"), F.col("t")), 0.5).alias("text"))


@query("str46_phrase_sanitiser")
def str46(spark, sf):
    return _texts(spark, sf).select("doc_id", Y.sanitise_phrase(["skin", "melanoma", "lung"])(F.col("t"), F.array(F.lit("skin"))).alias("text"))


@query("jsn2_first_object")
def jsn2(spark, sf):
    return table(spark, sf, "documents").select("doc_id", Y.first_object(S.pick(F.col("doc_id"), ['noise {"a": {"b": "}"}} tail {', "{broken", "none", '{{"x": 1}']) ).alias("block"))


_VALUES = {"disease": ["melanoma", "carcinoma"], "organ": ["skin", "lung"], "sex": ["male", "female"]}
_EDGES = [("disease", "melanoma", "organ", "skin"), ("disease", "carcinoma", "organ", "lung"), ("disease", "carcinoma", "organ", "skin")]


@query("syn1_2_5_6_coherent_records")
def syn2(spark, sf):
    n = table(spark, sf, "documents").count()
    return Y.generate(spark, n, _VALUES, _EDGES, ["A {sex} donor with {disease}.", "{organ} sample: {disease}."])


@query("syn3_repair", f"SELECT doc_id, treatment, CASE WHEN treatment IN ('unknown', 'none') THEN 'not applicable' ELSE '3 days' END AS treatment_time FROM (SELECT doc_id, {S.pick_sql('doc_id', S.TREATMENTS)} AS treatment FROM documents) t")
def syn3(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", S.pick(F.col("doc_id"), S.TREATMENTS).alias("treatment"), F.lit("3 days").alias("treatment_time"), F.lit("x").alias("response"), F.lit("bulk").alias("sequencing_source"), F.lit("polyA").alias("library_selection"))
    return Y.repair(d).select("doc_id", "treatment", "treatment_time")


@query("syn4_value_injection")
def syn4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(Y.inject_value(F.col("text"), F.col("source"), F.col("doc_id"))).alias("text_md5"))


@query("syn7_styles")
def syn7(spark, sf):
    return table(spark, sf, "documents").select("doc_id", L.styles(forbidden=("untreated",))(F.concat(F.lit("treated with drug "), F.col("source"), F.lit(" for five days")), F.col("doc_id")).alias("text"))


@query("syn8_prompt_table", "SELECT 'Record: ' || doc_id || chr(10) || 'Summary: ' || source || chr(10) || 'Field: ' || f AS prompt, o AS output FROM (SELECT doc_id, source, 'lang' AS f, lang AS o FROM documents UNION ALL SELECT doc_id, source, 'source', source FROM documents) t")
def syn8(spark, sf):
    d = table(spark, sf, "documents").withColumn("summary", F.col("source"))
    return Y.prompt_table(d, "doc_id", "summary", ["lang", "source"])


@query("syn9_constant_label", "SELECT text AS prompt, 'unknown' AS output FROM benchmark")
def syn9(spark, sf):
    return Y.constant_label(table(spark, sf, "benchmark"), "text")


@query("mdl1_4_rule_backend")
def mdl1(spark, sf):
    d = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", I.build_prompt(F.col("conv_id"), F.col("text"), "word", "first known word").alias("prompt"))
    return I.complete(d, "prompt", I.RuleBackend([" the ", " que ", " der "])).select("conv_id", "turn", "answer")


@query("vec23_backend_embedding")
def vec23(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", I.embed(F.col("text"), I.RuleBackend([])).alias("embedding"))


@query("str17_trim_cascade")
def str17c(spark, sf):
    from millrace.operators.context import trimmed

    return table(spark, sf, "documents").select("doc_id", F.md5(trimmed(120)(F.col("text"))).alias("text_md5"))
