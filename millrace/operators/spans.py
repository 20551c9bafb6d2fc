"""Spans over texts: array<struct<start int, end int, category string>>.

Spark has no match offsets, so tagging is one Arrow UDF; all that follows works on the arrays.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,category:string>>"
# fixed values: patterns of the categories that rules can tag
RULES = (
    ("AGE", r"(?i)\b\d{1,3}(?:\.\d+)?\s*(?:years?|yrs?|months?|weeks?)(?:\s+old)?\b"), ("SEX", r"(?i)\b(?:male|female|man|woman)\b"),
    ("TREATMENT_TIME", r"(?i)\b\d+\s*(?:h|hrs?|hours?|days?|d)\b"), ("SOURCE", r"(?i)\b(?:single[- ]cell|bulk|spatial)\b"),
    ("LIBRARY", r"(?i)\b(?:poly[- ]?a|ribo[- ]?zero|exome capture|small rna)\b"), ("BIOPSY_TYPE", r"(?i)\b(?:primary|metasta(?:sis|tic))\b"),
    ("RESPONSE", r"(?i)\b(?:responders?|resistant|sensitive)\b"), ("ORGAN", r"(?i)\b(?:skin|lung|liver|brain|blood|breast)\b"),
    ("DISEASE", r"(?i)\b(?:melanoma|carcinoma|leuk[a]?emia|lymphoma)\b"), ("CELL_LINE", r"\b[A-Z]{1,4}-?[A-Z]*-?\d{2,4}[A-Z]?\b"),
)
NEGATIONS = r"(?i)\b(?:no|not|without|absence of|negative for|never)\b"
SECTION_WEIGHTS = {"title": 1.0, "abstract": 0.9, "summary": 0.9, "methods": 0.6, "protocol": 0.5, "contact": 0.2, "references": 0.2}


def tag(rules=RULES):
    """Column function text -> spans of all rules' matches."""
    compiled = [(name, re.compile(p)) for name, p in rules]

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else sorted(({"start": m.start(), "end": m.end(), "category": n} for n, p in compiled for m in p.finditer(t)), key=lambda s: (s["start"], -s["end"], s["category"])))
    return run


def coerce(spans: Column) -> Column:
    """Spans with a category and an end after their start."""
    return F.filter(spans, lambda s: (s["end"] > s["start"]) & s["category"].isNotNull() & (s["category"] != ""))


def resolve_overlaps(spans: Column) -> Column:
    """Sweep by start, longest first, plain CHUNK last: a span that overlaps a kept one goes."""
    chunk = lambda s: F.when(s["category"] == "CHUNK", 1).otherwise(0)
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(chunk(a) - chunk(b))
    s = F.array_sort(spans, order)
    return F.aggregate(s, F.slice(s, 1, 0), lambda acc, x: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["end"] <= x["start"]), F.concat(acc, F.array(x))).otherwise(acc))


def filter_sections(spans: Column, sections: Column, least: float = 0.5) -> Column:
    """Spans outside sections(start, end, weight) of low weight."""
    return F.filter(spans, lambda s: ~F.exists(sections, lambda q: (q["start"] <= s["start"]) & (s["start"] < q["end"]) & (q["weight"] < least)))


def filter_negated(spans: Column, cues: Column, window: int = 40) -> Column:
    """Spans without a negation cue that ends within window characters before them."""
    return F.filter(spans, lambda s: ~F.exists(cues, lambda c: (c["end"] <= s["start"]) & (s["start"] - c["end"] <= window)))


def acronym_guard(spans: Column, text: Column) -> Column:
    """First span of each category and upper-cased fragment."""
    frag = lambda s: F.upper(F.substr(text, s["start"] + 1, s["end"] - s["start"]))
    return F.filter(spans, lambda s, i: ~F.exists(F.slice(spans, 1, i), lambda p: (p["category"] == s["category"]) & (frag(p) == frag(s))))


def enrich(spans: Column, codes: Column) -> Column:
    """Adds codes(start, end) that touch no span, as CHUNK."""
    free = F.filter(codes, lambda c: ~F.exists(spans, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    return F.concat(spans, F.transform(free, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit("CHUNK").alias("category"))))


def synthesis(spans: Column) -> Column:
    """Masked text of spans in order: numbered gaps between category names."""
    s = F.array_sort(spans, lambda a, b: a["start"] - b["start"])
    return F.array_join(F.transform(s, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["category"])), " ")


def acronyms(text: Column) -> Column:
    """array<struct<short, long>> of 'long form (ABC)'."""
    p = F.lit(r"([A-Za-z]+(?: [a-z]+)*) \(([A-Z]{2,})\)")
    return F.zip_with(F.regexp_extract_all(text, p, 2), F.regexp_extract_all(text, p, 1), lambda s, g: F.struct(s.alias("short"), g.alias("long")))


def sections(weights=None):
    """Column function text -> array<struct<start, end, weight>> by heading lines; text before the first heading weighs 0.8."""
    known = weights or SECTION_WEIGHTS

    @F.pandas_udf("array<struct<start:int,end:int,weight:double>>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            out, at, weight, begin = [], 0, 0.8, 0
            for line in (t or "").split("\n"):
                head = line.strip().rstrip(":").lower()
                if head in known:
                    if at > begin:
                        out.append({"start": begin, "end": at, "weight": weight})
                    weight, begin = known[head], at
                at += len(line) + 1
            if t and at > begin:
                out.append({"start": begin, "end": at, "weight": weight})
            return out
        return texts.map(one)
    return run


def tag_windows(df, key: str, text: str, backend, size: int = 2000, step: int = 1800):
    """(key, spans): a backend tags windows of the text; offsets are shifted to the whole text and repeats dropped.

    The backend answers each window with lines 'start end CATEGORY'; lines that are not so are ignored.
    """
    from millrace.operators.infer import complete
    from millrace.operators.sample import char_windows

    answers = complete(char_windows(df, key, text, size, step), "piece", backend)
    line = F.lit(r"(?m)^(\d+) (\d+) ([A-Z_]+)$")
    part = lambda g: F.regexp_extract_all("answer", line, g)
    hits = answers.select(key, "start", F.explode(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))).alias("x"))
    span = F.struct((F.col("x.a").cast("int") + F.col("start")).alias("start"), (F.col("x.b").cast("int") + F.col("start")).alias("end"), F.col("x.c").alias("category"))
    spans = hits.groupBy(key).agg(F.array_sort(F.collect_set(span)).alias("spans"))
    return df.select(key).join(spans, key, "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
