"""URL filter: domain and path rules first, then gradient-boosted trees on lexical features of the URL.

Features: lengths, depth, digit and symbol ratios, character entropy, parameters, and statistics of the host's suffix
and labels, for training rows from the other folds. The trees (logistic loss, histogram splits, Newton leaves) are fitted
on at most train_rows labelled URLs, taken by the smallest hashes of the URL, so the fit is bounded and repeatable; every
URL is judged.

Defined cases: a null URL or one without "://" has empty host and path, matches no rule and is judged by the trees on its
text (null: empty); an empty table stays empty; repeated rows repeat; other columns are not carried. Without labelled
URLs of both kinds the trees answer the majority label (allow if there is none).
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

TRAIN_ROWS = 20_000
FOLDS = 5
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "symbol_ratio", "entropy", "host_entropy", "params",
            "query_length", "host_digits", "host_hyphens", "longest_label", "longest_segment", "vowel_ratio", "https", "suffix_length", "suffix_rate", "domain_rate")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; rules are (host + path prefix, verdict)."""
    rule = verdict = F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tested first
        domain, _, prefix = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _entropy(s: str) -> float:
    if not s:
        return 0.0
    _, n = np.unique(np.frombuffer(s.encode("utf-8", "replace"), np.uint8), return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


_URL = re.compile(r"(?:([^:/?#]*)://)?([^/?#]*)([^?#]*)(\?[^#]*)?")


def features(url: str | None, rates: dict[str, float]) -> list[float]:
    url = url or ""
    scheme, host, path, query = (x or "" for x in _URL.match(url).groups())
    host = host.lower()
    labels = [x for x in host.split(".") if x]
    segments = [x for x in path.split("/") if x]
    suffix, domain = (labels[-1] if labels else ""), ".".join(labels[-2:])
    n = max(1, len(url))
    return [len(url), len(host), len(path), len(segments), len(labels), sum(c.isdigit() for c in url) / n, sum(not c.isalnum() for c in url) / n,
            _entropy(url), _entropy(host), query.count("=") + query.count("&"), len(query), sum(c.isdigit() for c in host), host.count("-"),
            max(map(len, labels), default=0), max(map(len, segments), default=0), sum(c in "aeiou" for c in host) / max(1, len(host)),
            float(scheme.lower() == "https"), len(suffix), rates.get("." + suffix, rates[""]), rates.get(domain, rates[""])]


class BoostedTrees:
    """Gradient-boosted trees for a 0/1 label."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, least: int = 10, penalty: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.penalty = trees, depth, rate, bins, least, penalty
        self.base, self.model = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.base = math.log(p / (1 - p))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.trees if 0 < y.sum() < len(y) else 0):
            q = 1 / (1 + np.exp(-score))
            tree = self._grow(codes, y - q, q * (1 - q), np.arange(len(y)), 0)
            self.model.append(tree)
            score += self.rate * self._apply(tree, x)
        return self

    def _grow(self, codes, g, h, rows, level):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = total_g / (total_h + self.penalty)
        if level == self.depth or len(rows) < 2 * self.least:
            return leaf
        best = (1e-6, None, None)
        for f in range(codes.shape[1]):
            c = codes[rows, f]
            size = len(self.edges[f]) + 1
            sums = [np.cumsum(np.bincount(c, w, size))[:-1] for w in (g[rows], h[rows], None)]
            if not len(sums[0]):
                continue
            gain = sums[0] ** 2 / (sums[1] + self.penalty) + (total_g - sums[0]) ** 2 / (total_h - sums[1] + self.penalty) - total_g**2 / (total_h + self.penalty)
            gain[(sums[2] < self.least) | (len(rows) - sums[2] < self.least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        _, f, k = best
        if f is None:
            return leaf
        left = codes[rows, f] <= k
        return f, float(self.edges[f][k]), self._grow(codes, g, h, rows[left], level + 1), self._grow(codes, g, h, rows[~left], level + 1)

    def _apply(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, edge, low, high = tree
        out, left = np.empty(len(x)), x[:, f] <= edge
        out[left], out[~left] = self._apply(low, x[left]), self._apply(high, x[~left])
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.model:
            score += self.rate * self._apply(tree, x)
        return 1 / (1 + np.exp(-score))


def smoothed_rates(urls: list[str | None], y: np.ndarray, prior: float = 20.0) -> dict[str, float]:
    """Block rates of host suffixes (".x") and two-label domains, drawn towards the overall rate at ""."""
    mean = float(y.mean()) if len(y) else 0.0
    sums: dict[str, list[float]] = {}
    for url, label in zip(urls, y):
        labels = [x for x in (_URL.match(url or "").group(2) or "").lower().split(".") if x]
        for key in {"." + (labels[-1] if labels else ""), ".".join(labels[-2:])} - {""}:
            s = sums.setdefault(key, [0.0, 0.0])
            s[0] += label
            s[1] += 1
    return {"": mean} | {k: (a + prior * mean) / (n + prior) for k, (a, n) in sums.items()}


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[BoostedTrees, dict[str, float]]:
    """Trees from labelled(url, block 0/1), fitted on the train_rows distinct rows with the smallest hashes."""
    known = labelled.where("block is not null").select("url", F.col("block").cast("int").alias("block")).distinct()
    rows = hash_sample(known, train_rows, "url", "block").collect()
    urls, y = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    fold = np.array([zlib.crc32((u or "").encode("utf-8", "replace")) % FOLDS for u in urls], int)
    x = np.zeros((len(urls), len(FEATURES)))
    for k in range(FOLDS):  # a row's suffix rates come from the other folds
        others = smoothed_rates([u for u, f in zip(urls, fold) if f != k], y[fold != k])
        for i in np.flatnonzero(fold == k):
            x[i] = features(urls[i], others)
    model = BoostedTrees()
    return (model.fit(x, y) if len(y) else model), smoothed_rates(urls, y)


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: BoostedTrees, rates: dict[str, float], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """id, host, path, rule, verdict and block_score of every row."""
    shared = pages.sparkSession.sparkContext.broadcast((model, rates))

    @F.pandas_udf("double")
    def score(urls):
        import pandas as pd

        trees, known = shared.value
        if not len(urls):
            return pd.Series([], dtype=float)
        return pd.Series(trees.predict(np.array([features(u, known) for u in urls], float)))

    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    rows = pages.select(id_col, host.alias("host"), path.alias("path"), score(F.col(url_col)).alias("block_score"))
    return rows.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("block_score") > threshold, "block").otherwise("allow")).alias("verdict"), "block_score")
