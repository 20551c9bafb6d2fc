"""Template-based synthesis over constraint edges, masks and prompts.

Generation is seeded by row id, so partitions need no common state; balanced choice counts within a batch.
"""

from __future__ import annotations

import random
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.sample import hash_order


def surface_variants(c: Column) -> Column:
    """Distinct surface forms: case, separators, common short forms."""
    forms = [c, F.lower(c), F.upper(c), F.replace(c, F.lit(" "), F.lit("-")), F.replace(c, F.lit("-"), F.lit(" ")), F.replace(c, F.lit(" "), F.lit("_")), F.replace(c, F.lit("carcinoma"), F.lit("cancer")), F.replace(c, F.lit("therapy"), F.lit("tx"))]
    return F.array_distinct(F.array(*forms))


def inject_value(text: Column, value: Column, key: Column, seed: int = 42) -> Column:
    """value put between words of text, at a place that the key's hash gives."""
    words = F.split(text, " ")
    at = F.pmod(F.conv(F.substring(hash_order(key, seed), 1, 7), 16, 10).cast("bigint"), F.size(words) + 1).cast("int")
    return F.array_join(F.concat(F.slice(words, 1, at), F.array(value), F.slice(words, at + 1, F.size(words))), " ")


def prompt_table(df: DataFrame, run: str, summary: str, fields: list[str]) -> DataFrame:
    """One (prompt, output) row per field of a wide row."""
    cells = ", ".join(f"'{f}', cast(`{f}` as string)" for f in fields)
    rows = df.select(run, summary, F.expr(f"stack({len(fields)}, {cells}) as (field, output)"))
    return rows.select(F.concat(F.lit("Record: "), F.col(run).cast("string"), F.lit("\nSummary: "), F.col(summary), F.lit("\nField: "), F.col("field")).alias("prompt"), F.coalesce("output", F.lit("unknown")).alias("output"))


def constant_label(df: DataFrame, prompt: str, label: str = "unknown") -> DataFrame:
    return df.select(F.col(prompt).alias("prompt"), F.lit(label).alias("output"))


def repair(df: DataFrame) -> DataFrame:
    """No treatment: no time, no response. A library of small RNA fits no single-cell source."""
    none = F.lower("treatment").isin("unknown", "none", "not applicable")
    return df.withColumns({
        "treatment_time": F.when(none, "not applicable").otherwise(F.col("treatment_time")), "response": F.when(none, "not applicable").otherwise(F.col("response")),
        "library_selection": F.when((F.col("sequencing_source") == "single cell") & (F.col("library_selection") == "small RNA"), "polyA").otherwise(F.col("library_selection"))})


def merge_edges(*edges: DataFrame) -> DataFrame:
    """Union of constraint edges (from_attr, from_val, to_attr, to_val)."""
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.distinct()


def allowed(df: DataFrame, from_attr: str, to_attr: str, edges: DataFrame) -> DataFrame:
    """df with allowed: the sorted values of to_attr that its from_attr permits (empty if none)."""
    e = edges.where((F.col("from_attr") == from_attr) & (F.col("to_attr") == to_attr)).groupBy("from_val").agg(F.array_sort(F.collect_set("to_val")).alias("allowed"))
    return df.join(e, F.col(from_attr) == F.col("from_val"), "left").drop("from_val").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))


class Balancer:
    """Least-used choice; ties go to the first value."""

    def __init__(self):
        self.used: dict[tuple[str, str], int] = {}

    def pick(self, name: str, values: list[str]) -> str:
        v = min(values, key=lambda x: (self.used.get((name, x), 0), values.index(x)))
        self.used[name, v] = self.used.get((name, v), 0) + 1
        return v


#: Records that are balanced among themselves: blocks of ids, so that the result does not depend on partitions.
BALANCED_ROWS = 4096


def generate(spark, n: int, values: dict[str, list[str]], edges: list[tuple[str, str, str, str]], templates: list[str], seed: int = 42) -> DataFrame:
    """n coherent records (run_accession, fields, phrase): each field in turn takes the value that its edges allow and its block of
    BALANCED_ROWS records has used least.

    A template's {field} marks take surfaces of the values; a field without a mark is appended, so the phrase covers all.
    """
    by_pair: dict[tuple[str, str], dict[str, set[str]]] = {}
    for a, x, b, y in edges:
        by_pair.setdefault((a, b), {}).setdefault(x, set()).add(y)
    fields = list(values)

    def record(i: int, bal: Balancer) -> dict:
        rng, rec = random.Random(f"{seed}:{i}"), {}
        for f in fields:
            ok = [v for v in values[f] if all(v in by_pair[a, f].get(rec[a], ()) for a in rec if (a, f) in by_pair)]
            rec[f] = bal.pick(f, ok) if ok else "unknown"
        text = templates[rng.randrange(len(templates))]
        for f in fields:
            shown = rng.choice([rec[f], rec[f].lower(), rec[f].upper()])
            text = text.replace("{" + f + "}", shown) if "{" + f + "}" in text else f"{text} {f}: {shown}."
        return {"run_accession": f"SYN{i:09d}", **rec, "phrase": text}

    def run(batches):
        for pdf in batches:
            for block in pdf["id"].tolist():
                bal = Balancer()
                ids = range(block * BALANCED_ROWS, min(n, (block + 1) * BALANCED_ROWS))
                yield pd.DataFrame([record(i, bal) for i in ids], columns=["run_accession", *fields, "phrase"])
    return spark.range(-(-n // BALANCED_ROWS)).mapInPandas(run, "run_accession string, " + ", ".join(f"{f} string" for f in fields) + ", phrase string")


def _udf(fn):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fn(t))
    return run


def replace_terms(terms: dict[str, str], limits: dict[str, int] | None = None):
    """Column function: terms, longest first, become their category's marker, at most limits[category] times."""
    pattern = re.compile(r"(?i)(?<!\w)(" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + r")(?!\w)")
    to = {t.lower(): c for t, c in terms.items()}

    def one(text):
        left = dict(limits or {})

        def sub(m):
            c = to[m.group(1).lower()]
            if c in left:
                if left[c] <= 0:
                    return m.group(0)
                left[c] -= 1
            return f"__{c}__"
        return pattern.sub(sub, text)
    return _udf(one)


_MARK = re.compile(r"__([A-Z_]+?)__")


def limit_mentions(limit: int = 1):
    """Column function: of each category's markers only the limit nearest to the middle of the text stay."""
    def one(text):
        marks: dict[str, list] = {}
        for m in _MARK.finditer(text):
            marks.setdefault(m.group(1), []).append(m.span())
        drop = [s for spans in marks.values() for s in sorted(spans, key=lambda s: (abs((s[0] + s[1]) / 2 - len(text) / 2), s))[limit:]]
        for a, b in sorted(drop, reverse=True):
            text = text[:a] + text[b:]
        return re.sub(r" {2,}", " ", text).strip()
    return _udf(one)


def insert_missing(categories: list[str]):
    """Column function: markers that are absent go behind the sentences, in turn."""
    def one(text):
        have = set(_MARK.findall(text))
        parts = re.split(r"(?<=[.!?])\s+", text)
        for i, c in enumerate(c for c in categories if c not in have):
            parts[i % len(parts)] += f" __{c}__"
        return " ".join(parts)
    return _udf(one)


def collapse_values(limit: int = 4):
    """Column function: up to limit value-like words right after a marker go."""
    value = re.compile(r"(__[A-Z_]+?__)((?:[ :=,]+[\w.+-]*\d[\w.+-]*){1,%d})" % limit)
    return _udf(lambda t: value.sub(r"\1", t))


def scrub_numbers(keyword: str, window: int = 4):
    """Column function: numbers within window words of a keyword go."""
    def one(text):
        words = text.split(" ")
        near = {j for i, w in enumerate(words) if keyword in w.lower() for j in range(i - window, i + window + 1) if j != i}
        return " ".join(w for i, w in enumerate(words) if not (i in near and re.fullmatch(r"\W*\d+(?:\.\d+)?\W*", w)))
    return _udf(one)


def sanitise_phrase(surfaces: list[str]):
    """Column function (text, own values): vocabulary surfaces that the record does not have go."""
    pattern = re.compile(r"(?i)(?<!\w)(" + "|".join(re.escape(s) for s in sorted(surfaces, key=len, reverse=True)) + r")(?!\w)")

    @F.pandas_udf("string")
    def run(texts: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else re.sub(r" {2,}", " ", pattern.sub(lambda m: m.group(0) if o is not None and m.group(0).lower() in {x.lower() for x in o} else "", t)).strip() for t, o in zip(texts, own)])
    return run


def clean_mask(c: Column) -> Column:
    """Stateless mask clean-up: numbered brackets, spaces before marks, repeated marks and edge dashes."""
    c = F.regexp_replace(c, r"\[[0-9]+\]", " ")
    c = F.regexp_replace(c, r"\s+([.,;:])", "$1")
    c = F.regexp_replace(c, r"([.,;:])[.,;:]+", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^[\s,;:-]+|[\s,;:-]+$", ""), r"\s+", " "))


def study_prefixes(c: Column, prefix: str = "Study:") -> Column:
    """Sentences of five words or more without a marker get a prefix, never two in a row."""
    parts = F.split(c, r"(?<=[.!?])\s+")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("last"))

    def step(a, s):
        due = (F.size(F.split(s, " ")) >= 5) & ~s.rlike("__[A-Z_]+__") & ~a["last"]
        return F.struct(F.concat(a["out"], F.array(F.when(due, F.concat(F.lit(prefix + " "), s)).otherwise(s))).alias("out"), due.alias("last"))
    return F.array_join(F.aggregate(parts, start, step, lambda a: a["out"]), " ")


def guarded(new: Column, old: Column, metric: Column, least: float, max_growth: float = 1.5) -> Column:
    """A rewrite where the metric and the length hold, else the original."""
    return F.when((metric >= least) & (F.length(new) <= max_growth * F.length(old)) & (F.length(new) > 0), new).otherwise(old)


def first_object(c: Column) -> Column:
    """First balanced {...} of noisy text, quotes respected; NULL if none closes."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            start = (t or "").find("{")
            while start >= 0:
                depth, quoted, skip = 0, False, False
                for i in range(start, len(t)):
                    ch = t[i]
                    if skip:
                        skip = False
                    elif quoted:
                        skip, quoted = ch == "\\", ch != '"'
                    elif ch == '"':
                        quoted = True
                    elif ch in "{}":
                        depth += 1 if ch == "{" else -1
                        if not depth:
                            return t[start: i + 1]
                start = t.find("{", start + 1)
            return None
        return texts.map(one)
    return run(c)
