"""Invented cells that queries deal to rows by id, so that every branch of a rule meets whole tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AGES = ["54", "54 years", "12y 6mo", "12 years 6 months", "6 months", "3 wks", "10 d", "34-year old", "aged 7 yo", "adult", "", "unknown", "71.5 yr", "8 days old", "2Y0MO", "77 y/o", "n/a", "male 40 years old"]
SEXES = ["male", "F", "Female; male", "man", "woman/m", "unknown", "", "x", "m|unknown", "none"]
CELLS = ["T cells", "t-cell", "B lymphocytes", "CD8+ T cell, B cell", "fibroblast", "", "unknown", "NK cells/T cell", "tcell;tcells"]
TREATMENTS = ["RNA-seq", "vemurafenib 24 h", "single-cell", "none", "dabrafenib for 3 days", "scRNA", "Total transcriptomics", "5 hours heat", "unknown", "untreated with control"]
SYNONYMS = ["lymph node", "ab", "a1", "Skin", "none", "7", "SK-MEL-2", "cell line", "x y z", "", "nan", "melanoma"]
CANDIDATES = ["[A375; SK-MEL-28]", "'WM115' | \"WM115\"", "HeLa/HEK293", "", "(MCF7)", "A375,A375", "SK MEL 28;A-375"]
CODES = ["UBERON_0002097", "uberon:0002 097", "DOID_1909+DOID_2", "UBERON:unknown", "nan", "", "none", "Uberon_1"]
TITLES = ["poly-A library", "ribo zero depletion", "exome capture panel", "small RNA prep", "miRNA and polyA", "plain library", "rRNA depletion", "SureSelect bait"]
SOURCES = ["10x single cell", "spatial transcriptomics of skin", "bulk RNA-seq", "whole transcriptome", "visium slide", "amplicon", "smart-seq2", "metastatic blood draw"]
DURATIONS = ["24 h", "3 days", "2 weeks", "a fortnight", "6 months", "1 year", "90 min", "none", "", "48hrs then 2 d"]
NUMBERS = ["1.5", "-2", "about 3.25 units", "nan", "unknown", "", "n/a", "7e2", "none 4", "not applicable"]
ANSWERS = ["melanoma\",", "skin\n tissue", "", "  ", "male}", "a \"b\" c", "lung;", "primary]"]
VALUES = ["PolyA", "poly a selected", "Inverse rRNA kit", "ribo", "hybrid selection", "capture hybrid selection now", "small rna seq", "other", "nothing", ""]


def pick(key: Column, values: list[str]) -> Column:
    """The value of a row: values in turn by key."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def pick_sql(key: str, values: list[str]) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{quoted}], CAST({key} % {len(values)} AS INTEGER) + 1)"


def in_sql(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"
