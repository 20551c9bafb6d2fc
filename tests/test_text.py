"""Branches of the normalisers, edge rows included."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T


def one(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select("i", fn(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_ages(spark):
    cases = {"54": "54Y", "54 years": "54Y", "12y 6mo": "12Y6MO", "12 years 6 months": "12Y6MO", "2y 0mo": "2Y", "6 months": "6MO", "3 wks": "3WK", "10 d": "10D", "34-year old": "34Y",
             "aged 7 yo": "7Y", "aged 7 y/o": "7Y", "male 40 years old": "40Y", "adult": "unknown", "": "unknown", "N/A": "unknown", None: "unknown", "71.5 yr": "71.5Y"}
    assert one(spark, T.normal_age, list(cases)) == list(cases.values())


def test_sex_and_cell_type(spark):
    assert one(spark, T.normal_sex, ["Male", "f; M", "woman|x", "", None, "n/a"]) == ["male", "female; male", "female; unknown", "unknown", "unknown", "unknown"]
    assert one(spark, T.normal_cell_type, ["T cells", "b-lymphocyte, T-cell", "NK  Cell!", "", None, "none"]) == ["t-cell", "b-cell; t-cell", "nk cell", "unknown", "unknown", "unknown"]


def test_durations(spark):
    assert one(spark, T.duration_days, ["24 h", "2 weeks", "a fortnight", "6 months", "1 year", "90 min", "x", None]) == [1.0, 14.0, 14.0, 180.0, 365.0, 0.0625, None, None]


def test_durations_in_words(spark):
    cases = {"two weeks": 14.0, "three days": 3.0, "deux semaines": 14.0, "une quinzaine": 14.0, "dix-sept jours": 17.0, "quelques heures": 0.125, "a couple of months": 60.0, "1,5 jours": 1.5, "someone days": None, "long term": None}
    assert one(spark, T.duration_days, list(cases)) == list(cases.values())
    assert one(spark, T.duration_text, ["36 h", "two weeks", "five weeks", "1 year", " overnight ", None]) == ["36 hours", "14 days", "5 weeks", "12 months", "overnight", None]


def test_terms_of_any_length_are_found(spark):
    from millrace.operators.resolve import dictionary_matches

    terms = spark.createDataFrame([("diffuse large B-cell lymphoma",), ("Lymphoma",), ("large",), ("",), (None,)], "term string")
    docs = spark.createDataFrame([(1, "a case of Diffuse large B cell lymphoma, late"), (2, "lymphomas"), (3, ""), (4, None), (5, "large lymphoma large")], "k int, text string")
    got = {r.k: r.candidates for r in dictionary_matches(docs, "k", "text", terms).collect()}
    assert got == {1: ["diffuse large B-cell lymphoma", "large", "Lymphoma"], 5: ["large", "Lymphoma"]}


def test_missing_policies(spark):
    values = ["unknown", "Not Applicable", " ", "x", None, "nan"]
    assert one(spark, lambda c: T.is_missing(c, "normalisation"), values) == [True, False, True, False, True, False]
    assert one(spark, lambda c: T.is_missing(c, "extraction"), values) == [True, True, True, False, True, False]
    assert one(spark, lambda c: T.is_missing(c, "profiling"), values) == [True, True, True, False, True, True]


def test_age_evidence(spark):
    df = spark.createDataFrame([("40Y", "40 years old", True), ("40Y", "age: 40", True), ("40Y", "41 y/o", False), ("12Y6MO", "12 years 6 months", True), ("12Y6MO", "12 years", False), ("odd", "", True), ("6MO", "6 weeks", False)], "a string, t string, e boolean")
    assert df.where(T.age_confirmed(F.col("a"), F.col("t")) != F.col("e")).count() == 0


def test_keys_fold_spaces_and_case(spark):
    assert one(spark, T.fold, [" SKIN ", "É"]) == ["skin", "é"]


@pytest.mark.parametrize("value,want", [("ab", False), ("a1", True), ("lymph node", False), ("melanoma", True), ("", False), (None, False), ("7", False)])
def test_valid_synonym(spark, value, want):
    assert one(spark, T.valid_synonym, [value]) == [want]
