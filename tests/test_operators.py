"""Invariants of operators that random choice or models keep from an exact oracle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import curate, metrics, resolve, sample, synth, vector, vocab
from millrace.sources import delimited, records, sinks


def test_merge_layers_precedence(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "unknown", "b"), (3, None, "")], "k int, db_x string, llm_x string")
    got = {r.k: (r.x, r.x_source) for r in curate.merge_layers(df, ["x"], ["db", "llm"]).collect()}
    assert got == {1: ("a", "db"), 2: ("b", "llm"), 3: (None, None)}


def test_key_table_name_beats_synonym(spark):
    v = spark.createDataFrame([(0, "1", "Lung", "pulmo"), (1, "2", "Pulmo", ""), (2, "3", "Liver", "hepar"), (3, "4", "Other", "hepar")], "ord int, code string, name string, synonym string")
    keys = {r.key: r.canonical for r in vocab.key_table(v, "ord").collect()}
    assert keys["pulmo"] == "Pulmo" and keys["hepar"] == "Other"


def test_lookup_values_keeps_positions(spark):
    v = spark.createDataFrame([("1", "Lung", "pulmo"), ("2", "Skin", "")], "code string, name string, synonym string")
    df = spark.createDataFrame([(1, "x; Pulmo,skin"), (2, ""), (3, None)], "k int, v string")
    got = {r.k: (r.terms, r.codes) for r in resolve.lookup_values(df, "k", "v", vocab.key_table(v)).collect()}
    assert got == {1: ("x; lung; skin", "unknown; 1; 2"), 2: ("unknown", "unknown"), 3: ("unknown", "unknown")}


def test_numbered_is_gapless_and_ordered(spark):
    rows = sample.numbered(spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v")), ["v"]).collect()
    assert sorted((r.v, r.rn) for r in rows) == [(i, i + 1) for i in range(1000)]


def test_caps_hold(spark):
    df = spark.range(2000).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 11).alias("b"))
    rows = sample.multi_capped(df, "id", {"a": 5, "b": 4}).collect()
    for c, cap in (("a", 5), ("b", 4)):
        n = {}
        for r in rows:
            n[r[c]] = n.get(r[c], 0) + 1
        assert max(n.values()) <= cap
    assert len(rows) >= 30


def test_quota_sums(spark):
    c = spark.createDataFrame([("a", 50), ("b", 30), ("c", 5)], "l string, count bigint")
    assert sum(r.quota for r in sample.quotas(c, 17, "l").collect()) == 17


def test_splits_are_disjoint(spark):
    df = sample.sequential_split(spark.range(100).withColumnRenamed("id", "k"), "k", [("a", 30), ("b", 20)])
    n = {r.part: r["count"] for r in df.groupBy("part").count().collect()}
    assert n == {"a": 30, "b": 20, None: 50}
    with pytest.raises(ValueError):
        sample.sequential_split(spark.range(10).withColumnRenamed("id", "k"), "k", [("a", 30)])


def test_weighted_sample_has_its_size(spark):
    df = spark.range(50).select("id", (F.col("id") % 5 + 1).cast("double").alias("w"))
    assert abs(sample.weighted_with_replacement(df, "id", "w", 500).count() - 500) <= 1


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "k bigint, v array<float>")
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    got = {}
    for r in vector.neighbours(df, df, "k", "v", 3).collect():
        got.setdefault(r.id, set()).add(r.other)
    assert got == {i: set(np.argsort(-s[i])[:3].tolist()) for i in range(60)}


def test_records_are_coherent(spark):
    edges = [("d", "m", "o", "skin"), ("d", "c", "o", "lung")]
    rows = synth.generate(spark, 40, {"d": ["m", "c"], "o": ["skin", "lung"]}, edges, ["a {d} b"]).collect()
    assert len(rows) == 40 and all((r.d, r.o) in {("m", "skin"), ("c", "lung")} for r in rows)
    assert all(r.d.lower() in r.phrase.lower() and r.o.lower() in r.phrase.lower() for r in rows)


def test_lcs():
    assert metrics.lcs_length("a b c d".split(), "b x d".split()) == 2
    assert metrics.lcs_length([], ["a"]) == 0


def test_first_object(spark):
    df = spark.createDataFrame([('x {"a": "}"} y',), ("{",), (None,)], "t string")
    assert [r[0] for r in df.select(synth.first_object(F.col("t"))).collect()] == ['{"a": "}"}', None, None]


def test_resume_and_first_writer(spark, tmp_path):
    p = str(tmp_path / "out")
    d = spark.range(10).withColumnRenamed("id", "k")
    for part in (d.where("k < 4"), d, d):
        sinks.resume_append(spark, part, p, "k", lambda x: x)
    assert sorted(r[0] for r in spark.read.parquet(p).collect()) == list(range(10))


def test_obo_file(spark, tmp_path):
    f = tmp_path / "x.obo"
    f.write_text('format\n\n[Term]\nid: A:1\nname: one\nsynonym: "uno" EXACT []\nsynonym: "eins" EXACT []\n\n[Term]\nid: A:2\nname: two\nis_obsolete: true\n\n[Typedef]\nid: part_of\nname: part\n')
    rows = records.read_obo(spark, str(f), "A:").collect()
    assert [tuple(r) for r in rows] == [("A:1", "one", "uno;eins")]


def test_flat_file(spark, tmp_path):
    f = tmp_path / "c.txt"
    f.write_text("ID   X1\nAC   C1\nSY   X-1; X 1\nSX   Male\nAG   30Y\nOX   NCBI_TaxID=9606; ! Homo sapiens\n//\nID   Y\nOX   NCBI_TaxID=10090; ! Mus\n//\n")
    rows = records.read_flat(spark, str(f)).collect()
    assert [(r.id, r.name, r.synonym, r.sex, r.age) for r in rows] == [("C1", "X1", "X-1;X 1", "male", "30Y")]


def test_split_last(spark):
    df = spark.createDataFrame([("a,b,c",), ("none",), ("",)], "value string")
    assert [tuple(r) for r in delimited.split_last(df).collect()] == [("a,b", "c"), ("none", ""), ("", "")]


def test_fetch_retries_and_marks_errors(spark):
    from millrace.sources import fetch

    calls = []

    def get(k):
        calls.append(k)
        if len(calls) < 3:
            raise OSError
        return "<a/>"
    assert fetch.with_retry(get, "k", fetch.well_formed, sleep=lambda s: None) == "<a/>" and len(calls) == 3
    assert fetch.with_retry(lambda k: "<a", "k", fetch.well_formed, tries=2, sleep=lambda s: None) == "error"
    keys = spark.createDataFrame([("1",), ("2",)], "run_accession string")
    assert {tuple(r) for r in fetch.fetch(keys, lambda k: f"<r>{k}</r>").collect()} == {("1", "<r>1</r>"), ("2", "<r>2</r>")}


def test_windowed_tags_are_shifted(spark):
    from millrace.operators.spans import tag_windows

    class Finder:
        def complete(self, prompts):
            return [(f"{p.find('skin')} {p.find('skin') + 4} ORGAN" if "skin" in p else "nothing", [0.0]) for p in prompts]
    df = spark.createDataFrame([(1, "x" * 25 + "skin" + "y" * 30), (2, "")], "k long, t string")
    got = {r.k: [tuple(s) for s in r.spans] for r in tag_windows(df, "k", "t", Finder(), 20, 10).collect()}
    assert got == {1: [(25, 29, "ORGAN")], 2: []}


SF = "/root/testdata/sf0.001"


def _whole(spark, cells):
    """doc_id and the text that the query is to work on, without its helpers."""
    return {r.doc_id: "\n".join(x for x in (r.text, None if r.doc_id is None else cells[r.doc_id % len(cells)]) if x is not None) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def tables():
    from pathlib import Path

    if not Path(SF).exists():
        pytest.skip("no test tables")
    from millrace.plans import model_queries, registry

    return model_queries, lambda spark, name: {r[0]: r[1] for r in registry.queries()[name](spark, SF).collect()}


def test_span_queries_read_whole_documents(spark, tables):
    import re

    from millrace.operators import spans

    queries, run = tables
    texts = _whole(spark, queries._NOTES)
    tags = {k: sorted(((m.start(), m.end(), c) for c, p in spans.RULES for m in re.finditer(p, t)), key=lambda s: (s[0], -s[1], s[2])) for k, t in texts.items()}
    shown = lambda ss: " ".join(f"{a}:{b}:{c}" for a, b, c in ss)
    assert run(spark, "spn1_rule_tags") == {k: shown(s) for k, s in tags.items()}
    cues = {k: [m.end() for m in re.finditer(spans.NEGATIONS, t)] for k, t in texts.items()}
    assert run(spark, "spn4_negation_filter") == {k: shown(s for s in ss if not any(0 <= s[0] - e <= 40 for e in cues[k])) for k, ss in tags.items()}

    def guarded(ss, t):
        seen = set()
        return [s for s in ss if not ((x := (s[2], t[s[0]: s[1]].upper())) in seen or seen.add(x))]
    assert run(spark, "spn5_acronym_guard") == {k: shown(guarded(ss, texts[k])) for k, ss in tags.items()}
    quiet = {}
    for k, t in texts.items():
        weight, at, quiet[k] = 0.8, 0, []
        for line in t.split("\n"):
            weight = spans.SECTION_WEIGHTS.get(line.strip().rstrip(":").lower(), weight)
            quiet[k] += [weight < 0.5] * (len(line) + 1)
    assert run(spark, "spn3_section_filter") == {k: shown(s for s in ss if not quiet[k][s[0]]) for k, ss in tags.items()}
    codes = {k: [m.span() for m in re.finditer(r"\b[A-Za-z]+-?\d+\b|\b\d+ [a-z]\b", t)] for k, t in texts.items()}
    assert run(spark, "spn7_enrich_codes") == {k: shown(ss + [(a, b, "CHUNK") for a, b in codes[k] if not any(s[0] < b and a < s[1] for s in ss)]) for k, ss in tags.items()}

    def masked(ss):
        kept = []
        for s in ss:
            if not kept or kept[-1][1] <= s[0]:
                kept.append(s)
        return " ".join(f"[{i + 1}] {s[2]}" for i, s in enumerate(kept))
    assert run(spark, "spn8_masked_text") == {k: masked(ss) for k, ss in tags.items()}
    from millrace.plans import registry

    ends = {}
    for r in registry.queries()["str49_sections"](spark, SF).collect():
        ends[r.doc_id] = max(ends.get(r.doc_id, 0), r.end)
    assert ends == {k: len(t) + 1 for k, t in texts.items() if t}


def test_rewriting_queries_read_whole_documents(spark, tables):
    import re

    queries, run = tables
    texts = _whole(spark, queries._MASKED)
    both = {"skin lesions": "DISEASE", "melanoma": "DISEASE", "skin": "ORGAN"}

    def markers(t):
        left = [1]

        def sub(m):
            c = both[m.group(0).lower()]
            if c == "ORGAN":
                left[0] -= 1
                return m.group(0) if left[0] < 0 else "__ORGAN__"
            return f"__{c}__"
        return re.sub(r"(?i)(?<!\w)(?:skin lesions|melanoma|skin)(?!\w)", sub, t)
    assert run(spark, "str37_39_term_markers") == {k: markers(t) for k, t in texts.items()}
    collapsed = {k: re.sub(r"(__[A-Z_]+?__)(?:[ :=,]+[\w.+-]*\d[\w.+-]*){1,4}", r"\1", t) for k, t in texts.items()}
    assert run(spark, "str40_value_collapse") == collapsed

    def scrubbed(t):
        words = t.split(" ")
        marked = [i for i, w in enumerate(words) if "__age__" in w.lower()]
        return " ".join(w for i, w in enumerate(words) if not (re.fullmatch(r"\W*\d+(?:\.\d+)?\W*", w) and any(0 < abs(i - j) <= 4 for j in marked)))
    assert run(spark, "str45_win8_number_scrub") == {k: scrubbed(t) for k, t in texts.items()}

    def added(t):
        parts = re.split(r"(?<=[.!?])\s+", t)
        for i, c in enumerate(c for c in ("AGE", "ORGAN") if f"__{c}__" not in t):
            parts[i % len(parts)] += f" __{c}__"
        return " ".join(parts)
    assert run(spark, "str42_insert_missing") == {k: added(t) for k, t in texts.items()}
    clean = lambda t: re.sub(r" {2,}", " ", t).strip()
    assert run(spark, "str46_phrase_sanitiser") == {k: clean(re.sub(r"(?i)(?<!\w)(?:melanoma|lung)(?!\w)", "", t)) for k, t in texts.items()}

    def limited(t):
        marks = {}
        for m in re.finditer(r"__([A-Z_]+?)__", t):
            marks.setdefault(m.group(1), []).append(m.span())
        gone = {i for s in marks.values() for a, b in sorted(s, key=lambda s: (abs(sum(s) / 2 - len(t) / 2), s))[1:] for i in range(a, b)}
        return clean("".join(c for i, c in enumerate(t) if i not in gone))
    assert run(spark, "str41_mention_limit") == {k: limited(t) for k, t in texts.items()}
    rewritten = run(spark, "str44_guarded_rewrite")
    assert rewritten.keys() == texts.keys() and all(v in (texts[k], collapsed[k]) for k, v in rewritten.items())


def test_nearest_label_judges_every_vector(spark, tables):
    _, run = tables
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    u = np.array([r.embedding for r in rows], np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    labels = np.array([int(r.label) for r in rows])
    known = sorted(set(labels.tolist()))
    c = np.array([u[labels == k].mean(axis=0) for k in known])
    s = u @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
    assert run(spark, "vec21_nearest_label") == {r.vec_id: known[i] for r, i in zip(rows, s.argmax(axis=1).tolist())}


def test_chrf_of_equals_counted_grams():
    from collections import Counter

    def plain(a, b):
        a, b, total = "".join(a.split()), "".join(b.split()), 0.0
        for n in range(2, 7):
            x, y = (Counter(t[i: i + n] for i in range(len(t) - n + 1)) for t in (a, b))
            same = sum((x & y).values())
            if same:
                p, r = same / sum(y.values()), same / sum(x.values())
                total += 5 * p * r / (4 * p + r)
        return total / 5

    from millrace.operators.metrics import chrf_of

    for a, b in [("", ""), ("ab", ""), ("a b a b a b", "babab"), ("ñandú 𝒳𝒴 été", "été ñandú 𝒳𝒴"), ("x" * 500, "x" * 90), ("one two three", "two one three four")]:
        assert abs(chrf_of(a, b) - plain(a, b)) < 1e-12
    assert chrf_of(None, "abc") == 0.0


def test_vector_sum_of_odd_vectors(spark):
    from millrace.operators.vector import vector_sum

    rows = [("a", [1.0, 2.0]), ("a", [3.0]), ("a", None), ("a", []), (None, [5.0, None]), ("b", None)]
    df = spark.createDataFrame(rows, "label string, v array<double>").repartition(3)
    assert {r["label"]: (r["n"], r["total"]) for r in vector_sum(df, "v", "label").collect()} == {"a": (2, [4.0, 2.0]), None: (1, [5.0, 0.0])}
    assert [(r["n"], r["total"]) for r in vector_sum(df, "v").collect()] == [(3, [9.0, 2.0])]
    assert vector_sum(df.limit(0), "v", "label").count() == 0


def test_score_densities_sum_to_one(spark):
    from millrace.operators.vector import score_densities

    a = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(20)], "id int, v array<double>")
    b = spark.createDataFrame([(i, [i / 10, 1.0]) for i in range(20)], "id int, v array<double>")
    sums = score_densities(a, b, "v", 10).groupBy("side").sum("density").collect()
    assert {r[0]: round(r[1], 6) for r in sums} == {"train": 1.0, "other": 1.0}


def test_generated_records_do_not_depend_on_partitions(spark):
    from collections import Counter

    from millrace.operators.synth import BALANCED_ROWS, generate

    args = ({"organ": ["skin", "lung"], "sex": ["male", "female", "unknown sex"]}, [("organ", "lung", "sex", "male"), ("organ", "skin", "sex", "female"), ("organ", "skin", "sex", "male")], ["{organ} of a {sex}"])
    n, before = BALANCED_ROWS + 100, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    rows = []
    try:
        for parts in ("1", "5"):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", parts)
            rows.append(sorted(map(tuple, generate(spark, n, *args).collect())))
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism") if before is None else spark.conf.set("spark.sql.leafNodeDefaultParallelism", before)
    assert rows[0] == rows[1] and len(rows[0]) == n
    assert Counter(r[1] for r in rows[0]) == {"skin": n // 2, "lung": n // 2}
    assert {(r[1], r[2]) for r in rows[0]} == {("lung", "male"), ("skin", "female"), ("skin", "male")}


def test_weak_labels_take_attributes_first(spark):
    from millrace.functions.labels import weak_labels

    df = spark.createDataFrame([("female lung, 10x", "", None, "kidney"), (None, "M", "1.5", "  "), ("mesh of fems; colonial", None, "2", None)], "t string, sex string, lat string, tissue string")
    given = {"sex": F.col("sex"), "latitude": F.col("lat"), "longitude": F.col("lat"), "tissue": F.col("tissue")}
    rows = df.select(*[c.alias(n) for n, c in weak_labels(F.col("t"), given).items()]).collect()
    assert len(rows[0]) == 15
    assert [(r["sex"], r["organ"], r["sequencing_source"], r["biopsy_site"], r["localization"]) for r in rows] == [
        ("female", "lung", "single_cell", "kidney", None), ("m", None, None, None, "1.5,1.5"), (None, None, None, None, "2,2")]


def test_every_style_holds_the_statement_and_clean_notes():
    import csv
    import json
    import random

    from millrace.operators.styles import LAYOUTS, notes_for, rendered

    said = 'drug "X", 5 {mg}; it\'s | <daily>'
    assert len(LAYOUTS) == 21
    for style, layout in LAYOUTS.items():
        notes = notes_for(random.Random(1), ("VITAL signs",))
        assert notes and not any("vital signs" in n for n in notes)
        text = rendered(said, style, notes, random.Random(7))
        assert layout.escape(said) in text and text == rendered(said, style, notes, random.Random(7))
        assert rendered("", style, [], random.Random(7)) is not None
    record = json.loads(rendered(said, "json", ["a", "b", "c"], random.Random(1)))
    assert record["action"] == said and set(record) == {"action", "check", "note", "extra"}
    rows = list(csv.reader(rendered(said, "csv", notes, random.Random(1)).splitlines()))
    assert rows[:2] == [["field", "value"], ["action", said]] and all(len(r) == 2 for r in rows)


def test_styles_of_null_texts_and_keys(spark):
    from millrace.operators.styles import styles

    df = spark.createDataFrame([("x", 1), (None, 2), ("y", None), ("z", 25)], "t string, k long")
    out = [r[0] for r in df.coalesce(1).select(styles()(F.col("t"), F.col("k"))).collect()]
    assert out[1] is None and out[2] is None and out[0].startswith("1) x") and out[3].startswith('action: "z"')
