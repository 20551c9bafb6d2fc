"""Scalar text functions: Column -> Column, inside whole-stage code where Spark allows it.

Missing values are NULL inside the engine; a policy names which sentinels count as missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = " "
# fixed values: sentinels of each missing-value policy
POLICIES = {
    "extraction": ("unknown", "not applicable", "missing", "n/a", "na", "none", ""),
    "normalisation": ("unknown", "missing", "n/a", "na", "none", ""),
    "profiling": ("", "none", "null", "na", "n/a", "nan", "unk", "unknown", "not applicable", "not_applicable"),
    "vocabulary": ("nan", "none", "null", ""),
    "evaluation": ("not applicable", "not_applicable", "other"),
}
# fixed values: words too general to be a synonym
GENERIC_SYNONYMS = (
    "node", "lymph", "lymph node", "lymph nodes", "tissue", "organ", "gland", "blood", "plasma", "cell", "cells", "cell line", "sample", "specimen",
    "biopsy", "organism", "organ part", "anatomical location", "body", "human", "mouse", "rat", "disease", "cancer", "tumor", "carcinoma", "infection", "normal", "control",
)
# fixed values: words too general to be a candidate
GENERIC_TOKENS = (
    "cell", "cells", "line", "cancer", "tumor", "normal", "human", "mouse", "rat", "wildtype", "wt", "control", "sample", "treated", "treated cells",
    "immortalized", "immortal", "in vitro", "primary", "junior", "jake", "ears", "bob", "princess", "ashes", "fisher", "center",
)
# fixed values: phrases of an assay where a treatment is expected
ASSAY_PHRASES = ("single cell", "singlecell", "rna seq", "rnaseq", "rna sequencing", "sequencing", "scrna", "sc rna", "sc rnaseq", "transcriptome", "transcriptomics")
# fixed values: phrases of each library selection, in the order in which classes win; ~ is a place where a separator may stand
LIBRARY_PHRASES = {
    "polyA": ("poly~a", "oligo~d~t", "truseq~mrna", "smarter~mrna"),
    "inverse rRNA": ("ribo~minus", "ribo~dep", "ribo~zero", "deplete~ribosom", "rrna~deple", "rrna~minus", "rrna removal"),
    "hybrid selection": ("hybrid~selection", "exon~capture", "exome~capture", "rna~exome", "bait", "capture-based", "targeted transcriptome", "sureselect"),
    "small RNA": ("truseq~small", "size~fraction", "small~rna", "mirna", "micro~rna"),
}
# fixed values: phrases of each sequencing source, as above; the last of a pair lie up to 10 characters behind the first
SOURCE_PHRASES = {
    "spatial": ("visium", "geomx", "merfish", "hdst", "slide~seq", "nanostring", ("spatial", ("transcriptomic", "sequencing", "rna~seq", "st-seq"))),
    "single cell": ("single~cell", "single~nucleus", "scrna", "10x", "drop~seq", "smart~seq", "fluidigm", "indrop", "seq~well", "c1 platform", "microwell"),
    "bulk": ("bulk", "whole~transcriptome", "wta", "rna~seq"),
}


def phrase_pattern(phrases: tuple, separator: str, reach: int = 10) -> str:
    """Pattern that finds any of the phrases, without case."""
    def one(p):
        if isinstance(p, tuple):
            return f"{one(p[0])}.{{0,{reach}}}(?:{'|'.join(map(one, p[1]))})"
        return p.replace("~", separator)
    return "(?i)" + "|".join(map(one, phrases))


LIBRARY_CLASSES = tuple((name, phrase_pattern(p, r"[.\s-]?")) for name, p in LIBRARY_PHRASES.items())
SOURCE_CLASSES = tuple((name, phrase_pattern(p, r"[\s-]?")) for name, p in SOURCE_PHRASES.items())


def fold(c: Column) -> Column:
    """Lower-cased, trimmed, no-break spaces folded: the key of every vocabulary lookup."""
    return F.lower(F.trim(F.replace(c, F.lit(NBSP), F.lit(" "))))


def is_missing(c: Column, policy: str = "normalisation") -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*POLICIES[policy])


def missing_to_null(c: Column, policy: str = "normalisation") -> Column:
    return F.when(~is_missing(c, policy), F.trim(c))


def sanitise(c: Column) -> Column:
    """White space of any kind to single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def spaced(c: Column) -> Column:
    """Lower-cased ASCII words between double spaces: a word is found by ' word ' without word boundaries."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(c), "[^a-z0-9]+", "  "), F.lit(" "))


def plain(c: Column) -> Column:
    """Lower-cased ASCII letters and digits between single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def first_class(c: Column, classes, default: str | None = "") -> Column:
    """Name of the first class whose pattern occurs."""
    out = F.lit(default)
    for name, pattern in reversed(list(classes)):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def tag_value(c: Column, tag: str) -> Column:
    """First value of <TAG>tag</TAG><VALUE>..</VALUE>; an underscore in tag also stands for a space."""
    return F.trim(F.regexp_extract(c, rf"(?i)<TAG>{tag.replace('_', '[_ ]')}</TAG>\s*<VALUE>([^<]+)</VALUE>", 1))


def attribute(c: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(c, rf'(?i){name}="([^"]+)"', 1))


# fixed values: literal words removed from record metadata, in this order
SCRUB_WORDS = ("TAG", "VALUE", "SAMPLE ATTRIBUTE", "SCIENTIFIC NAME", "SAMPLE NAME", "EXTERNAL ID", "PRIMARY ID", "External Id", "DESCRIPTION", "STUDY", "LINK", "URL", "ATTRIBUTE")
SCRUB_WORDS_AFTER_DATE = ("ENA FIRST PUBLIC", "ENA LAST UPDATE", "ENA last update", "ENA first public", "ArrayExpress", "LABEL", "XREF", "SAMPLE")
PUNCTUATION = r"[!-/:-@\[-`{-~]+"


def scrub(c: Column) -> Column:
    """Ordered removal of punctuation, markup words and dates from record metadata; blank text becomes empty."""
    c = F.regexp_replace(c, PUNCTUATION, " ")
    for w in SCRUB_WORDS:
        c = F.replace(c, F.lit(w), F.lit(" "))
    c = F.regexp_replace(c, "[0-9]{4} [0-9]{2} [0-9]{2}", " ")
    for w in SCRUB_WORDS_AFTER_DATE:
        c = F.replace(c, F.lit(w), F.lit(" "))
    c = F.regexp_replace(c, " +", " ")
    return F.when(c.rlike("^ *$"), "").otherwise(c)


def drop_accessions(c: Column) -> Column:
    """Words that are run, project or study accessions go, whatever punctuation they wear."""
    keep = F.filter(F.split(sanitise(c), " "), lambda w: ~F.upper(F.regexp_replace(w, r"""^[.,;:()\[\]{}<>"']+""", "")).rlike(r"^([SDE]RR|[SDE]RP[0-9]|PRJ[A-Z]{2}[0-9])"))
    return F.array_join(keep, " ")


def row_context(columns: list[Column]) -> Column:
    """One text of the cells that do not speak of accessions, without sequence file names."""
    cells = F.filter(F.array(*[F.coalesce(c, F.lit("")) for c in columns]), lambda x: ~F.lower(x).rlike("(run|study|experiment|sample) accession"))
    return F.trim(F.regexp_replace(F.array_join(cells, " "), r"\S+?\.fastq\.gz", ""))


def code_format(c: Column) -> Column:
    """_ to :, + to ;, and an unknown code to the sentinel."""
    return F.regexp_replace(F.translate(c, "_+", ":;"), r"UBERON:unknown", "unknown")


def code_prefix(c: Column) -> Column:
    """Prefix of an anatomy code in one form, white space removed, junk to NULL."""
    fixed = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)uberon[_:]", "UBERON:"), r"\s+", "")
    return F.when(~is_missing(c, "vocabulary"), fixed)


def split_values(c: Column, pattern: str = "[;,]") -> Column:
    """Non-empty parts of a packed cell, folded to trimmed text, in order."""
    return F.filter(F.transform(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit(NBSP), F.lit(" ")), pattern), lambda x: F.trim(x)), lambda x: x != "")


def _parts(c: Column, one) -> Column:
    parts = F.array_distinct(F.transform(F.split(c, "[;,/|]"), lambda p: one(F.lower(F.trim(p)))))
    known = F.array_join(parts, "; ")
    return F.when(c.isNull() | (F.trim(c) == ""), "unknown").when(F.forall(parts, lambda p: p == "unknown"), "unknown").otherwise(known)


def normal_sex(c: Column) -> Column:
    return _parts(c, lambda s: F.when(s.isin("m", "male", "man"), "male").when(s.isin("f", "female", "woman"), "female").otherwise("unknown"))


def normal_cell_type(c: Column) -> Column:
    def one(s):
        words = plain(s)
        return (F.when(s.isin(*POLICIES["normalisation"]), "unknown").when(words.rlike("^t ?(cells?|lymphocytes?)$"), "t-cell")
                .when(words.rlike("^b ?(cells?|lymphocytes?)$"), "b-cell").otherwise(words))
    return _parts(c, one)


_NUM = r"([0-9]{1,3}(?:\.[0-9]+)?)"
# fixed values: age grammar; (pattern over dash-free lower-case text, unit letters), first hit wins
AGE_RULES = (
    (rf"^{_NUM}\s*(?:years?|yrs?|y)\s*(?:([0-9]{{1,2}}(?:\.[0-9]+)?)\s*)?(?:months?|mos?|m)?(?:[^a-z0-9_]|$)", "Y"),
    (rf"^{_NUM}\s*(?:months?|mos?)(?:[^a-z0-9_]|$)", "MO"),
    (rf"^{_NUM}\s*(?:weeks?|wks?)(?:[^a-z0-9_]|$)", "WK"),
    (rf"^{_NUM}\s*(?:days?|d)(?:[^a-z0-9_]|$)", "D"),
    (rf"(?:^|[^a-z0-9_]){_NUM}\s*(?:years?|yrs?|y)\s*old(?:[^a-z0-9_]|$)", "Y"),
    (rf"(?:^|[^a-z0-9_]){_NUM}\s*(?:yo|y\s*/\s*o)(?:[^a-z0-9_]|$)", "Y"),
    (rf"^{_NUM}$", "Y"),
)


def normal_age(c: Column) -> Column:
    """Age as nY, nYmMO, nMO, nWK or nD; 'unknown' where nothing fits."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[‐-―-]+", " "), r"\s+", " "))
    out = F.lit("unknown")
    for pattern, unit in reversed(AGE_RULES):
        n = F.regexp_extract(s, pattern, 1)
        value = F.concat(n, F.lit(unit))
        if pattern == AGE_RULES[0][0]:
            m = F.regexp_extract(s, pattern, 2)
            value = F.when((m != "") & ~m.rlike(r"^0+(\.0+)?$"), F.concat(n, F.lit("Y"), m, F.lit("MO"))).otherwise(value)
        out = F.when(s.rlike(pattern), value).otherwise(out)
    return F.when(is_missing(c), "unknown").otherwise(out)


def age_parts(c: Column) -> Column:
    """array<struct<n double, unit string>> of a normal age; empty if it can't be read (a bare number is years)."""
    s = F.lower(F.trim(c))
    one = rf"^{_NUM}(y|mo|wk|d)?$"
    two = rf"^{_NUM}y([0-9]{{1,2}}(?:\.[0-9]+)?)mo$"
    part = lambda n, u: F.struct(n.cast("double").alias("n"), u.alias("unit"))
    num = lambda p, g: F.regexp_extract(s, p, g).try_cast("double")
    unit = F.regexp_extract(s, one, 2)
    return (F.when(s.rlike(two), F.array(part(num(two, 1), F.lit("y")), part(num(two, 2), F.lit("mo"))))
            .when(s.rlike(one), F.array(part(num(one, 1), F.when(unit == "", "y").otherwise(unit)))).otherwise(F.array().cast("array<struct<n:double,unit:string>>")))


AGE_MENTION = r"([0-9]{1,3}(?:\.[0-9]+)?)\s*(years?|yrs?|y|months?|mos?|weeks?|wks?|days?|d)(?:[^a-z0-9_]|$)"
AGE_LABEL = r"(?:^|[^a-z0-9_])(?:gestational age|aged?|years? old|months? old|weeks? old|days? old)\s*[:=]?\s*([0-9]{1,3}(?:\.[0-9]+)?)"
AGE_YO = r"(?:^|[^a-z0-9_])([0-9]{1,2})\s*(?:y/o|yo)(?:[^a-z0-9_]|$)"


def age_mentions(text: Column) -> Column:
    """Every age that a text states, as array<struct<n, unit>>; a labelled number without a unit is in years."""
    t = F.lower(text)
    numbers, units = F.regexp_extract_all(t, F.lit(AGE_MENTION), 1), F.regexp_extract_all(t, F.lit(AGE_MENTION), 2)
    short = lambda u: F.when(u.startswith("mo"), "mo").when(u.startswith("w"), "wk").otherwise(F.substring(u, 1, 1))
    stated = F.zip_with(numbers, units, lambda n, u: F.struct(n.cast("double").alias("n"), short(u).alias("unit")))
    years = lambda p: F.transform(F.regexp_extract_all(t, F.lit(p), 1), lambda n: F.struct(n.cast("double").alias("n"), F.lit("y").alias("unit")))
    return F.concat(stated, years(AGE_LABEL), years(AGE_YO))


def age_confirmed(age: Column, text: Column) -> Column:
    """Whether every part of an age is stated in text, within 1e-6; an unreadable age passes."""
    said = age_mentions(F.coalesce(text, F.lit("")))
    return F.forall(age_parts(age), lambda p: F.exists(said, lambda m: (m["unit"] == p["unit"]) & (F.abs(m["n"] - p["n"]) < 1e-6)))


def assay_like(c: Column) -> Column:
    """Whether a treatment names an assay: spaced or run together."""
    hits = [plain(c).contains(p) | compact(c).contains(p.replace(" ", "")) for p in ASSAY_PHRASES]
    return ~is_missing(c) & reduce(lambda a, b: a | b, hits)


def clean_answer(c: Column) -> Column:
    """A model's answer: one line, cut at the first quote, one trailing mark off; nothing left is unknown."""
    s = F.trim(F.regexp_replace(c, r"\s+", " "))
    s = F.trim(F.regexp_replace(F.trim(F.substring_index(s, '"', 1)), r"[,;}\]]$", ""))
    return F.when(F.coalesce(s, F.lit("")) == "", "unknown").otherwise(s)


def safe_double(c: Column) -> Column:
    """A number, or the first number in the text; sentinels and texts without one are NULL."""
    return F.when(~is_missing(c, "profiling"), F.coalesce(F.trim(c).try_cast("double"), F.regexp_extract(c, r"-?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")))


def metric_or_na(c: Column) -> Column:
    """Six decimals of a finite number, else 'not applicable'."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.format_string("%.6f", c)).otherwise("not applicable")


def bucket(c: Column, confident: float, medium: float) -> Column:
    """Confidence bucket of a metric; NULL, NaN and negative values are missing."""
    return F.when(c.isNull() | F.isnan(c) | (c < 0), "missing").when(c <= confident, "confident").when(c <= medium, "medium").otherwise("uncertain")


def valid_synonym(c: Column) -> Column:
    """Three letters or a digit, two alphanumerics, and no general word."""
    s = F.trim(F.replace(c, F.lit(NBSP), F.lit(" ")))
    letters, digits = F.length(F.regexp_replace(s, "[^A-Za-z]", "")), F.length(F.regexp_replace(s, "[^0-9]", ""))
    return F.coalesce(~F.lower(s).isin(*POLICIES["vocabulary"]) & ((digits > 0) | (letters >= 3)) & (letters + digits >= 2) & ~plain(s).isin(*GENERIC_SYNONYMS), F.lit(False))


def candidate_token(c: Column) -> Column:
    letters, digits = F.length(F.regexp_replace(c, "[^A-Za-z]", "")), F.length(F.regexp_replace(c, "[^0-9]", ""))
    return ~F.lower(c).isin(*GENERIC_TOKENS) & (((letters >= 2) & (digits > 0)) | (letters >= 6))


def code_token(c: Column) -> Column:
    """At least three letters and three digits."""
    return (F.length(F.regexp_replace(c, "[^A-Za-z]", "")) >= 3) & (F.length(F.regexp_replace(c, "[^0-9]", "")) >= 3)


def split_candidates(c: Column) -> Column:
    """Distinct candidates of a packed list, brackets and quotes off, in order."""
    s = F.regexp_replace(F.trim(c), r"^[\[\](){}]+|[\[\](){}]+$", "")
    parts = F.transform(F.split(s, "[,;|/]"), lambda p: F.regexp_replace(F.trim(p), r"""^['"]+|['"]+$""", ""))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def candidate_pattern(c: Column) -> Column:
    """Pattern of a candidate whose runs of letters and digits may be apart by space, dash, slash or underscore."""
    runs = F.regexp_extract_all(c, F.lit("[A-Za-z]+|[0-9]+"), 0)
    return F.concat(F.lit("(?i)"), F.array_join(runs, r"[\s_/-]*"))


def slug(c: Column, limit: int = 80) -> Column:
    """File-name form; over the limit it is cut and ends in a short digest."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_-]+", "_"), "_{2,}", "_"), "^_+|_+$", "")
    return F.when(s == "", "unnamed").when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, limit - 9), F.lit("_"), F.substring(F.md5(s), 1, 8)))


# fixed values: number words of durations, and days of each unit by its names
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14,
    "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "few": 3, "couple": 2,
    "un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9, "dix": 10, "onze": 11, "douze": 12, "treize": 13, "quatorze": 14,
    "quinze": 15, "seize": 16, "dix-sept": 17, "dix sept": 17, "dix-huit": 18, "dix huit": 18, "dix-neuf": 19, "dix neuf": 19, "vingt": 20, "quelques": 3,
}
UNIT_DAYS = {
    ("minute", "minutes", "min", "mins"): 1 / 1440, ("hour", "hours", "hr", "hrs", "h", "heure", "heures"): 1 / 24, ("day", "days", "d", "jour", "jours"): 1.0,
    ("week", "weeks", "wk", "wks", "w", "semaine", "semaines"): 7.0, ("month", "months", "mo", "mos", "m", "mois"): 30.0, ("year", "years", "yr", "yrs", "y"): 365.0,
}
DURATION = (r"(?:^|[^a-z0-9.,-])([0-9]+(?:[.,][0-9]+)?|" + "|".join(sorted(NUMBER_WORDS, key=lambda w: (-len(w), w))) + r")\s*(?:of\s+)?("
            + "|".join(sorted((n for names in UNIT_DAYS for n in names), key=lambda w: (-len(w), w))) + r")(?:[^a-z]|$)")


def duration_days(c: Column) -> Column:
    """First duration of a text in days (months of 30, years of 365), in digits or in English or French words; a fortnight is 14."""
    t = F.replace(F.replace(F.lower(c), F.lit("½"), F.lit("0.5")), F.lit("demi"), F.lit("0.5"))
    n, u = F.regexp_extract(t, DURATION, 1), F.regexp_extract(t, DURATION, 2)
    words = F.create_map(*[F.lit(x) for w, k in NUMBER_WORDS.items() for x in (w, float(k))])
    number = F.coalesce(F.replace(n, F.lit(","), F.lit(".")).try_cast("double"), F.try_element_at(words, n))
    days = F.lit(None).cast("double")
    for names, one in UNIT_DAYS.items():
        days = F.when(u.isin(*names), number * one).otherwise(days)
    return F.when(t.contains("fortnight") | t.contains("quinzaine"), F.lit(14.0)).otherwise(days)


def duration_text(c: Column) -> Column:
    """The duration in its canonical unit: hours under 2 days, days under 21, weeks under 90, else months; other texts trimmed."""
    d = duration_days(c)
    whole = lambda x, unit: F.concat(F.bround(x).cast("bigint").cast("string"), F.lit(unit))
    return (F.when(d.isNull(), F.trim(c)).when(d < 2, whole(d * 24, " hours")).when(d < 21, whole(d, " days")).when(d < 90, whole(d / 7, " weeks")).otherwise(whole(d / 30, " months")))


def json_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def loose_key(c: Column) -> Column:
    """Letters and digits with their case: equality without punctuation."""
    return F.regexp_replace(c, "[^A-Za-z0-9]+", "")


def canonical_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(c, F.lit("﻿"), F.lit("")), r"\s+", " "))


def closed_value(c: Column, names: list[str], aliases: dict[str, str]) -> Column:
    """Closed-set value: alias, exact, one- or two-word head, then the longest name contained; else NULL."""
    s = plain(c)
    two = F.substring_index(s, " ", 2)
    one = F.substring_index(s, " ", 1)
    out = F.lit(None).cast("string")
    for n in sorted(names, key=lambda n: (len(n), n)):
        out = F.when(s.contains(n), n).otherwise(out)
    for head in (one, two, s):
        for n in names:
            out = F.when(head == n, n).otherwise(out)
    for a, n in aliases.items():
        out = F.when(s == a, n).otherwise(out)
    return out
