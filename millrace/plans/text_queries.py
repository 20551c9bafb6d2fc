"""Queries of the scalar text functions (ids as in the survey's inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.labels import weak_labels

from . import samples as S
from .registry import query, table


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _over(values, name="v"):
    """documents with a sample cell in column name."""
    return lambda spark, sf: _docs(spark, sf).select("doc_id", S.pick(F.col("doc_id"), values).alias(name))


def _from(values, name="v"):
    return f"(SELECT doc_id, {S.pick_sql('doc_id', values)} AS {name} FROM documents) t"


def _missing(c, policy="normalisation"):
    return f"({c} IS NULL OR lower(trim({c})) IN {S.in_sql(T.POLICIES[policy])})"


def _plain(c):
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def _compact(c):
    return f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


def _classes(c, classes):
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{n}'" for n, p in classes) + " ELSE '' END"


# --- cleaning -------------------------------------------------------------------------------------------------------

@query("prj1_sanitise", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS clean_md5, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM documents")
def prj1(spark, sf):
    c = T.sanitise(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.md5(c).alias("clean_md5"), F.length(c).cast("bigint").alias("n"))


_SCRUB = "regexp_replace(html, '[!-/:-@\\[-`{-~]+', ' ', 'g')"
for _w in T.SCRUB_WORDS:
    _SCRUB = f"replace({_SCRUB}, '{_w}', ' ')"
_SCRUB = f"regexp_replace({_SCRUB}, '[0-9]{{4}} [0-9]{{2}} [0-9]{{2}}', ' ', 'g')"
for _w in T.SCRUB_WORDS_AFTER_DATE:
    _SCRUB = f"replace({_SCRUB}, '{_w}', ' ')"


@query("prj2_scrub", f"SELECT page_id, md5(CASE WHEN regexp_matches(x, '^ *$') THEN '' ELSE x END) AS scrubbed_md5 FROM (SELECT page_id, regexp_replace({_SCRUB}, ' +', ' ', 'g') AS x FROM pages) t")
def prj2(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.scrub(F.col("html"))).alias("scrubbed_md5"))


@query("prj3_row_context", """
SELECT doc_id, trim(regexp_replace(array_to_string(list_filter([lang, source, extra, file], lambda x: NOT regexp_matches(lower(x), '(run|study|experiment|sample) accession')), ' '), '\\S+?\\.fastq\\.gz', '', 'g')) AS context
FROM (SELECT doc_id, lang, source, CASE WHEN doc_id % 3 = 0 THEN 'Run Accession ' || doc_id ELSE 'tissue ' || doc_id END AS extra, 'reads_' || doc_id || '.fastq.gz end' AS file FROM documents) t""")
def prj3(spark, sf):
    i = F.col("doc_id").cast("string")
    d = _docs(spark, sf).select("doc_id", "lang", "source", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Run Accession "), i)).otherwise(F.concat(F.lit("tissue "), i)).alias("extra"), F.concat(F.lit("reads_"), i, F.lit(".fastq.gz end")).alias("file"))
    return d.select("doc_id", T.row_context([F.col(c) for c in ("lang", "source", "extra", "file")]).alias("context"))


@query("prj4_disease_with_status", "SELECT doc_id, coalesce(nullif(d, ''), 'NA') || CASE WHEN h IN ('', 'unknown') THEN '' ELSE ',' || h END AS disease FROM (SELECT doc_id, "
       + S.pick_sql("doc_id", S.SYNONYMS) + " AS d, " + S.pick_sql("doc_id", S.SEXES) + " AS h FROM documents) t")
def prj4(spark, sf):
    d, h = S.pick(F.col("doc_id"), S.SYNONYMS), S.pick(F.col("doc_id"), S.SEXES)
    return _docs(spark, sf).select("doc_id", F.concat(F.coalesce(F.nullif(d, F.lit("")), F.lit("NA")), F.when(h.isin("", "unknown"), "").otherwise(F.concat(F.lit(","), h))).alias("disease"))


@query("prj5_drop_accessions", """
SELECT doc_id, array_to_string(list_filter(string_split('sample (SRR' || doc_id || '), of PRJNA12 srp9 kept ERRx ' || source, ' '), lambda w: NOT regexp_matches(upper(regexp_replace(w, '^[.,;:()\\[\\]{}<>]+', '')), '^([SDE]RR|[SDE]RP[0-9]|PRJ[A-Z]{2}[0-9])')), ' ') AS kept
FROM documents""")
def prj5(spark, sf):
    t = F.concat(F.lit("sample (SRR"), F.col("doc_id").cast("string"), F.lit("), of PRJNA12 srp9 kept ERRx "), F.col("source"))
    return _docs(spark, sf).select("doc_id", T.drop_accessions(t).alias("kept"))


@query("prj6_line_filter", "SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?i)the[ -]*and')")
def prj6(spark, sf):
    return _docs(spark, sf).where(~F.col("text").rlike("(?i)the[ -]*and")).select("doc_id")


@query("prj7_membership", "SELECT d.doc_id FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND d.lang NOT IN ('de') AND trim(d.text) <> ''")
def prj7(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1")
    return _docs(spark, sf).where((F.trim("text") != "") & ~F.col("lang").isin("de")).join(good, "doc_id", "left_semi").select("doc_id")


@query("prj8_two_line_outputs", "SELECT count(*) AS n FROM conversations WHERE len(string_split(text, chr(10))) = 2 AND role = 'user'")
def prj8(spark, sf):
    return table(spark, sf, "conversations").where((F.size(F.split("text", "\n")) == 2) & (F.col("role") == "user")).agg(F.count("*").alias("n"))


@query("prj9_fill_rate", f"""SELECT * FROM (SELECT 'age' AS field, CAST(count(*) FILTER (WHERE NOT {_missing('a')}) AS BIGINT) AS filled FROM {_from(S.AGES, 'a')}
UNION ALL SELECT 'sex', CAST(count(*) FILTER (WHERE NOT {_missing('b')}) AS BIGINT) FROM {_from(S.SEXES, 'b')}) u""")
def prj9(spark, sf):
    d = _docs(spark, sf).select(S.pick(F.col("doc_id"), S.AGES).alias("age"), S.pick(F.col("doc_id"), S.SEXES).alias("sex"))
    one = d.agg(*[F.count_if(~T.is_missing(F.col(c))).alias(c) for c in d.columns])
    return one.select(F.expr("stack(2, 'age', age, 'sex', sex) as (field, filled)"))


@query("prj10_bare_nan", "SELECT doc_id, regexp_replace('{\"a\": nan, \"b\": ' || doc_id || '}', ':\\s*nan\\s*([,}])', ': \"unknown\"\\1', 'g') AS fixed FROM documents")
def prj10(spark, sf):
    t = F.concat(F.lit('{"a": nan, "b": '), F.col("doc_id").cast("string"), F.lit("}"))
    return _docs(spark, sf).select("doc_id", F.regexp_replace(t, r":\s*nan\s*([,}])", ': "unknown"$1').alias("fixed"))


@query("prj11_code_format", f"""SELECT doc_id, replace(translate(v, '_+', ':;'), 'UBERON:unknown', 'unknown') AS formatted,
CASE WHEN NOT {_missing('v', 'vocabulary')} THEN regexp_replace(regexp_replace(trim(v), '(?i)uberon[_:]', 'UBERON:', 'g'), '\\s+', '', 'g') END AS prefixed FROM {_from(S.CODES)}""")
def prj11(spark, sf):
    return _over(S.CODES)(spark, sf).select("doc_id", T.code_format(F.col("v")).alias("formatted"), T.code_prefix(F.col("v")).alias("prefixed"))


@query("prj12_sentinels", f"""SELECT doc_id, CASE WHEN s IN ('None', 'not applicable') THEN 'unknown' ELSE s END AS sex, CASE WHEN s = 'None' THEN 'unknown' ELSE s END AS age
FROM (SELECT doc_id, {S.pick_sql('doc_id', ['None', 'not applicable', 'male', ''])} AS s FROM documents) t""")
def prj12(spark, sf):
    s = S.pick(F.col("doc_id"), ["None", "not applicable", "male", ""])
    from millrace.operators.curate import render_sentinels

    return render_sentinels(_docs(spark, sf).select("doc_id", s.alias("sex"), s.alias("age")), ["sex", "age"], keep_na=["age"])


@query("prj13_lower_fields", "SELECT doc_id, lower(source) AS source, lower(lang) AS lang FROM documents")
def prj13(spark, sf):
    return _docs(spark, sf).select("doc_id", *[F.lower(c).alias(c) for c in ("source", "lang")])


# --- extraction and classes -----------------------------------------------------------------------------------------

_XML = "'<TAG>cell type</TAG> <VALUE>' || source || ' </VALUE><TAG>sex</TAG><VALUE>' || lang || '</VALUE> sample_title=\"' || doc_id || ' t\"'"


def _xml():
    return F.concat(F.lit("<TAG>cell type</TAG> <VALUE>"), F.col("source"), F.lit(" </VALUE><TAG>sex</TAG><VALUE>"), F.col("lang"), F.lit('</VALUE> sample_title="'), F.col("doc_id").cast("string"), F.lit(' t"'))


@query("str1_tag_value", f"SELECT doc_id, trim(regexp_extract(x, '(?i)<TAG>cell[_ ]type</TAG>\\s*<VALUE>([^<]+)</VALUE>', 1)) AS cell_type, trim(regexp_extract(x, '(?i)<TAG>sex</TAG>\\s*<VALUE>([^<]+)</VALUE>', 1)) AS sex FROM (SELECT doc_id, {_XML} AS x FROM documents) t")
def str1(spark, sf):
    return _docs(spark, sf).select("doc_id", T.tag_value(_xml(), "cell_type").alias("cell_type"), T.tag_value(_xml(), "sex").alias("sex"))


@query("str2_attribute", "SELECT page_id, trim(regexp_extract(html, '(?i)lang=\"([^\"]+)\"', 1)) AS lang, trim(regexp_extract(html, '(?i)charset=\"([^\"]+)\"', 1)) AS charset FROM pages")
def str2(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.attribute(F.col("html"), "lang").alias("lang"), T.attribute(F.col("html"), "charset").alias("charset"))


@query("str3_attribute_bag_text", f"SELECT doc_id, array_to_string(list_transform(list_zip(regexp_extract_all(x, '<TAG>([^<]+)</TAG>', 1), regexp_extract_all(x, '<VALUE>([^<]*)</VALUE>', 1)), lambda p: trim(p[1]) || ': ' || trim(p[2])), '; ') AS bag FROM (SELECT doc_id, {_XML} AS x FROM documents) t")
def str3(spark, sf):
    from millrace.sources.records import attribute_text

    return _docs(spark, sf).select("doc_id", attribute_text(_xml()).alias("bag"))


@query("str4_accession_finder", """SELECT doc_id, coalesce(nullif(regexp_extract(x, '<DB>biosample</DB><ID>(SAMN[0-9]+)</ID>', 1), ''), nullif(regexp_extract(x, 'namespace="BioSample">(SAMN[0-9]+)<', 1), ''), nullif(regexp_extract(x, '(SAMN[0-9]+)', 1), '')) AS accession
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '<DB>biosample</DB><ID>SAMN' || doc_id || '</ID>' WHEN 1 THEN 'namespace="BioSample">SAMN' || doc_id || '<' WHEN 2 THEN 'see SAMN' || doc_id || ' here' ELSE 'none' END AS x FROM documents) t""")
def str4(spark, sf):
    from millrace.sources.records import sample_accession

    i, m = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    x = F.when(m == 0, F.concat(F.lit("<DB>biosample</DB><ID>SAMN"), i, F.lit("</ID>"))).when(m == 1, F.concat(F.lit('namespace="BioSample">SAMN'), i, F.lit("<"))).when(m == 2, F.concat(F.lit("see SAMN"), i, F.lit(" here"))).otherwise("none")
    return _docs(spark, sf).select("doc_id", sample_accession(x).alias("accession"))


_JOINED = "replace(replace(replace(lower(v), ' ', ''), '-', ''), '.', '')"


def _any(*words: str) -> str:
    return "(" + " OR ".join(f"contains(s, '{w}')" for w in words) + ")"


@query("str5_library_class", f"SELECT doc_id, CASE WHEN {_any('polya', 'oligodt', 'truseqmrna', 'smartermrna')} THEN 'polyA' WHEN {_any('ribominus', 'ribodep', 'ribozero', 'depleteribosom', 'rrnadeple', 'rrnaminus', 'rrnaremoval')} THEN 'inverse rRNA' WHEN {_any('hybridselection', 'exoncapture', 'exomecapture', 'rnaexome', 'bait', 'capturebased', 'targetedtranscriptome', 'sureselect')} THEN 'hybrid selection' WHEN {_any('truseqsmall', 'sizefraction', 'smallrna', 'mirna', 'microrna')} THEN 'small RNA' ELSE '' END AS library_selection FROM (SELECT doc_id, {_JOINED} AS s FROM {_from(S.TITLES)}) t")
def str5(spark, sf):
    return _over(S.TITLES)(spark, sf).select("doc_id", T.first_class(F.col("v"), T.LIBRARY_CLASSES).alias("library_selection"))


@query("str6_source_class", f"SELECT doc_id, CASE WHEN {_any('visium', 'geomx', 'merfish', 'hdst', 'slideseq', 'nanostring')} OR regexp_matches(lower(v), 'spatial.{{0,10}}(transcriptomic|sequencing|st-seq)') THEN 'spatial' WHEN {_any('singlecell', 'singlenucleus', 'scrna', '10x', 'dropseq', 'smartseq', 'fluidigm', 'indrop', 'seqwell', 'c1platform', 'microwell')} THEN 'single cell' WHEN {_any('bulk', 'wholetranscriptome', 'wta', 'rnaseq')} THEN 'bulk' ELSE '' END AS sequencing_source FROM (SELECT doc_id, v, {_JOINED} AS s FROM {_from(S.SOURCES + ['spatial ST-seq of skin'])}) t")
def str6(spark, sf):
    return _over(S.SOURCES + ["spatial ST-seq of skin"])(spark, sf).select("doc_id", T.first_class(F.col("v"), T.SOURCE_CLASSES).alias("sequencing_source"))


_BIOPSY = (("metastasis", " metasta(sis|ses|tic) "), ("blood", " (blood|plasma|venous) "))


@query("str7_biopsy_fallback", f"SELECT doc_id, {_classes('g', _BIOPSY)} AS biopsy_type FROM (SELECT doc_id, ' ' || regexp_replace(lower(v), '[^a-z0-9]+', '  ', 'g') || ' ' AS g FROM {_from(S.SOURCES)}) u")
def str7(spark, sf):
    return _over(S.SOURCES)(spark, sf).select("doc_id", T.first_class(T.spaced(F.col("v")), _BIOPSY).alias("biopsy_type"))


_TOLD = ["", "Small-RNA of pbmc, untreated", "Truseq stranded mRNA; visium of bone marrow", "10x of Lung carcinoma, treated with x for 3 days", "healthy male donor aged 45 years", "total RNA, partial response", "48 hours treatment, NR", "deplete the ribosomal; F, mets", "colorectal lipoma, progression", "snRNA of DMSO wells, 12 h"]
_STATED = ["", "Benign tumour", "Melanoma", "asthma", " ", "Non-cancer, once carcinoma", "Glioma"]
_ORIGIN = ["", "Han Chinese", "Paris", "West African", "handmade"]


def _say(of: str, *classes: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({of}, '{p}') THEN '{n}'" for n, p in classes) + " END"


def _word(*classes: tuple[str, str]) -> str:
    return _say("g", *((n, f"(^|[^a-z0-9])({p})([^a-z0-9]|$)") for n, p in classes))


_ILL = "(carcinoma|cancer|leukemia|lymphoma|myeloma|melanoma|sarcoma|glioblastoma|tumou?r|neoplasm)|oma([^a-z]|$)"


@query("str8_weak_labels", f"""SELECT doc_id,
coalesce({_say("t", ("polyA", r"poly[.\s-]?a|oligo[.\s-]?dt|(truseq|standard|smarter|stranded)[.\s-]?mrna"), ("inverse rRNA", r"ribo[.\s-]?(mi|dep|zero)|riboerase|ribogone|ribocop|deplet.{0,10}ribosom|remove ribosom|(truseq|smarter|stranded)[.\s-]?total|total rna"), ("hybrid selection", r"hybrid[.\s-]?selection|exo(n|me)[.\s-]?capture|rna[.\s-]?exome|geomx|hybrid capture|capture rna|bait"), ("small RNA", r"truseq[.\s-]?small|small[.\s-]?rna|size[.\s-]?fraction|mirna|pi[.\s-]?rna"))}, CASE WHEN doc_id % 3 = 0 THEN 'other' END) AS library_selection,
coalesce({_say("t", ("single_cell", r"scrna|snrna|(smart|cite|drop)[.\s-]?seq|single[.\s-]?(cell|nucleus)|10x|cell[.\s-]?ranger"), ("spatial", r"spatial|visium|(slide|stereo)[.\s-]?seq|merfish|seqfish|cosmx|xenium|geomx"))}, CASE WHEN doc_id % 3 = 1 THEN 'bulk' END) AS sequencing_source,
{_word(("metastasis", "metastasis|metastatic|mets?"), ("blood", "pbmc|blood|plasma|serum"), ("primary", "primary"))} AS biopsy_type,
{_word(("lung", "lung"), ("liver", "liver"), ("breast", "breast"), ("prostate", "prostate"), ("colon", "colon|colorectal"), ("kidney", "kidney|renal"), ("brain", "brain|glioblastoma|cortex|cerebellum"), ("pancreas", "pancreas|pancreatic"), ("ovary", "ovary|ovarian"), ("stomach", "stomach|gastric"), ("skin", "skin|dermal|melanoma"), ("heart", "heart|cardiac"), ("muscle", "muscle|myocard"), ("spleen", "spleen"), ("thyroid", "thyroid"), ("esophagus", "esophag(us|eal)"), ("uterus", "uterus|endometri(um|al)"), ("cervix", "cervix|cervical"), ("bladder", "bladder|urothelial"), ("bone_marrow", "bone marrow"), ("blood", "blood"))} AS organ,
coalesce(s, {_word(("control", "healthy|normal|control|wild ?type"))}, {_say("t", ("cancer", _ILL))}) AS disease,
CASE WHEN s IS NOT NULL THEN CASE WHEN regexp_matches(s, '{_ILL}') AND NOT regexp_matches(s, 'benign|non[ -]?cancer') THEN 'true' ELSE 'false' END ELSE coalesce({_say("t", ("true", _ILL))}, {_word(("false", "healthy|normal|control|wild ?type"))}) END AS is_cancer,
coalesce({_word(("control", "untreated|vehicle|control|dmso"))}, {_say("t", ("treated", f"treated with|treatment with|administered|exposure to|received|[0-9]+ *(day|hour|week|month|mo|d|h|w)s?[^a-z]+treat"))}) AS treatment,
{_word(("stable_disease", "stable disease|sd"), ("partial_response", "partial response|pr"), ("complete_response", "complete response|cr"), ("progressive_disease", "progression|progressive disease|pd"), ("non_responder", "non ?responder|nr"), ("responder", "responder"))} AS response,
nullif(regexp_extract(t, '([0-9]+ *(?:day|hour|week|month|mo|d|h|w)s?)(?:[^a-z]|$)', 1), '') AS treatment_time,
nullif(regexp_extract(t, '((?:age[^0-9]{{0,6}})?[0-9]{{1,2}} *(?:years?|yrs?|yo|y|ans))(?:[^a-z]|$)', 1), '') AS age,
{_word(("female", "female|f"), ("male", "male|m"))} AS sex,
CASE WHEN o IN ('han chinese', 'west african') THEN o END AS ethnicity, nullif(o, '') AS localization
FROM (SELECT doc_id, t, trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g')) AS g, nullif(trim(lower({S.pick_sql("doc_id", _STATED)})), '') AS s, lower({S.pick_sql("doc_id", _ORIGIN)}) AS o FROM (SELECT doc_id, lower(concat_ws(' | ', text, {S.pick_sql("doc_id", _TOLD)})) AS t FROM documents) a) b""")
def str8(spark, sf):
    i = F.col("doc_id")
    given = {"disease": S.pick(i, _STATED), "origin": S.pick(i, _ORIGIN), "library_selection": F.when(i % 3 == 0, "RANDOM"), "library_strategy": F.when(i % 3 == 1, "RNA")}
    labels = weak_labels(F.concat_ws(" | ", "text", S.pick(i, _TOLD)), given)
    return _docs(spark, sf).select("doc_id", *[c.alias(n) for n, c in labels.items() if n not in ("biopsy_site", "cell_type")])


_LETTERS, _DIGITS = "length(regexp_replace(v, '[^A-Za-z]', '', 'g'))", "length(regexp_replace(v, '[^0-9]', '', 'g'))"


@query("str9_valid_synonym", f"SELECT doc_id, v, NOT lower(trim(v)) IN {S.in_sql(T.POLICIES['vocabulary'])} AND ({_DIGITS} > 0 OR {_LETTERS} >= 3) AND {_LETTERS} + {_DIGITS} >= 2 AND NOT {_plain('v')} IN {S.in_sql(T.GENERIC_SYNONYMS)} AS valid FROM {_from(S.SYNONYMS)}")
def str9(spark, sf):
    return _over(S.SYNONYMS)(spark, sf).select("doc_id", "v", T.valid_synonym(F.col("v")).alias("valid"))


@query("str11_candidate_token", f"SELECT doc_id, v, NOT lower(v) IN {S.in_sql(T.GENERIC_TOKENS)} AND (({_LETTERS} >= 2 AND {_DIGITS} > 0) OR {_LETTERS} >= 6) AS token, {_LETTERS} >= 3 AND {_DIGITS} >= 3 AS code FROM {_from(S.SYNONYMS + ['ABC123', 'cells', 'keratinocyte'])}")
def str11(spark, sf):
    return _over(S.SYNONYMS + ["ABC123", "cells", "keratinocyte"])(spark, sf).select("doc_id", "v", T.candidate_token(F.col("v")).alias("token"), T.code_token(F.col("v")).alias("code"))


_UNPACK = "list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(v), '^[\\[\\](){}]+|[\\[\\](){}]+$', '', 'g'), '[,;|/]'), lambda p: regexp_replace(trim(p), '^[''\"]+|[''\"]+$', '', 'g')), lambda p: p <> '')"


@query("str14_split_candidates", f"SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS candidates FROM (SELECT doc_id, {_UNPACK} AS l FROM {_from(S.CANDIDATES)}) u")
def str14(spark, sf):
    return _over(S.CANDIDATES)(spark, sf).select("doc_id", F.array_join(T.split_candidates(F.col("v")), "|").alias("candidates"))


@query("str15_flexible_match", "SELECT doc_id, CAST(len(regexp_extract_all(v, '(?i)SK[\\s_/-]*MEL[\\s_/-]*28')) AS INTEGER) AS n FROM " + _from(S.CANDIDATES))
def str15(spark, sf):
    return _over(S.CANDIDATES)(spark, sf).select("doc_id", F.regexp_count("v", T.candidate_pattern(F.lit("SK-MEL-28"))).alias("n"))


@query("str16_best_candidate", "SELECT doc_id, arg_max(c, n * 10 - i) AS chosen FROM (SELECT doc_id, c, i, len(regexp_extract_all(lower(text), c)) AS n FROM documents, (VALUES ('the', 1), ('and', 2), ('que', 3), ('der', 4)) k(c, i)) t GROUP BY doc_id")
def str16(spark, sf):
    from millrace.operators.resolve import best_candidate

    return best_candidate(_docs(spark, sf).select("doc_id", F.lower("text").alias("text"), F.array(*map(F.lit, ("the", "and", "que", "der"))).alias("candidates")), "doc_id")


@query("str17_token_budget", "SELECT doc_id, CAST(least(len(w), 200) AS INTEGER) AS n_tokens, md5(array_to_string(w[1:200], ' ')) AS text_md5 FROM (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents) t")
def str17(spark, sf):
    from millrace.operators.context import cut_words

    c = cut_words(F.col("text"), 200)
    return _docs(spark, sf).select("doc_id", F.size(F.split(c, " ")).alias("n_tokens"), F.md5(c).alias("text_md5"))


@query("str18_append_note", "SELECT doc_id, CASE WHEN len(string_split(source || ' ' || lang || ' ' || note, ' ')) <= 4 THEN source || ' ' || lang || ' ' || note ELSE source || ' ' || note END AS summary FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'a b' ELSE 'a b c' END AS note FROM documents) t")
def str18(spark, sf):
    from millrace.operators.context import append_note

    note = F.when(F.col("doc_id") % 2 == 0, "a b").otherwise("a b c")
    return _docs(spark, sf).select("doc_id", append_note(F.concat_ws(" ", "source", "lang"), F.col("source"), note, 4).alias("summary"))


@query("str19_time_negation", "SELECT doc_id, CAST(CASE WHEN regexp_matches(g, ' [0-9]+ *(h|hr|hrs|hour|hours|d|day|days|week|weeks) ') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(g, ' (hpi|dpi|wpi) ') THEN 1 ELSE 0 END AS INTEGER) AS time_score, CAST(len(regexp_extract_all(g, ' (no|not|without|none|never|nor) ')) AS INTEGER) AS neg_score FROM (SELECT doc_id, ' ' || regexp_replace(lower(v), '[^a-z0-9]+', '  ', 'g') || ' ' AS g FROM " + _from(S.TREATMENTS + S.DURATIONS) + ") u")
def str19(spark, sf):
    g = T.spaced(F.col("v"))
    one = lambda p: g.rlike(p).cast("int")
    return _over(S.TREATMENTS + S.DURATIONS)(spark, sf).select("doc_id", (one(" [0-9]+ *(h|hr|hrs|hour|hours|d|day|days|week|weeks) ") + one(" (hpi|dpi|wpi) ")).alias("time_score"), F.regexp_count(g, F.lit(" (no|not|without|none|never|nor) ")).alias("neg_score"))


@query("str20_treatment_split", "SELECT doc_id, array_to_string(regexp_extract_all(lower(v), '[0-9]+ *(?:hours?|hrs?|h|days?|d)\\b'), '; ') AS treatment_time, trim(regexp_replace(regexp_replace(lower(v), '[0-9]+ *(?:hours?|hrs?|h|days?|d)\\b|\\b(?:for|to|and|in|with|via|on|of|the)\\b', '', 'g'), '\\s+', ' ', 'g')) AS treatment FROM " + _from(S.TREATMENTS))
def str20(spark, sf):
    from millrace.operators.curate import split_treatment

    t, w = split_treatment(F.col("v"))
    return _over(S.TREATMENTS)(spark, sf).select("doc_id", w.alias("treatment_time"), t.alias("treatment"))


_AGE_S = "trim(regexp_replace(regexp_replace(lower(trim(v)), '[‐-―-]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_AGE_CASE = "CASE WHEN " + _missing("v") + " THEN 'unknown' " + " ".join(
    (f"WHEN regexp_matches(s, '{p}') AND regexp_extract(s, '{p}', 2) <> '' AND NOT regexp_matches(regexp_extract(s, '{p}', 2), '^0+(\\.0+)?$') THEN regexp_extract(s, '{p}', 1) || 'Y' || regexp_extract(s, '{p}', 2) || 'MO' " if k == 0 else "")
    + f"WHEN regexp_matches(s, '{p}') THEN regexp_extract(s, '{p}', 1) || '{u}'" for k, (p, u) in enumerate(T.AGE_RULES)) + " ELSE 'unknown' END"


@query("str21_age_normalise", f"SELECT doc_id, v, {_AGE_CASE} AS age FROM (SELECT doc_id, v, {_AGE_S} AS s FROM {_from(S.AGES)}) u")
def str21(spark, sf):
    return _over(S.AGES)(spark, sf).select("doc_id", "v", T.normal_age(F.col("v")).alias("age"))


@query("str22_age_confirmed", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN false ELSE true END AS confirmed FROM documents")
def str22(spark, sf):
    k = F.col("doc_id") % 3
    age = F.when(k == 0, "12Y6MO").when(k == 1, "40Y").otherwise("unreadable")
    text = F.when(k == 0, "a 12 years 6 months old child").when(k == 1, "a 41 year old, 40 days after").otherwise("")
    return _docs(spark, sf).select("doc_id", T.age_confirmed(age, text).alias("confirmed"))


def _multi_sql(one, values):
    return f"SELECT doc_id, v, CASE WHEN trim(v) = '' OR len(list_filter(p, lambda x: x <> 'unknown')) = 0 THEN 'unknown' ELSE array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), '; ') END AS norm FROM (SELECT doc_id, v, list_transform(regexp_split_to_array(v, '[;,/|]'), lambda y: {one}) AS p FROM {_from(values)}) u"


@query("str23_sex_normalise", _multi_sql("CASE WHEN lower(trim(y)) IN ('m', 'male', 'man') THEN 'male' WHEN lower(trim(y)) IN ('f', 'female', 'woman') THEN 'female' ELSE 'unknown' END", S.SEXES))
def str23(spark, sf):
    return _over(S.SEXES)(spark, sf).select("doc_id", "v", T.normal_sex(F.col("v")).alias("norm"))


@query("str24_cell_type_normalise", _multi_sql(f"CASE WHEN lower(trim(y)) IN {S.in_sql(T.POLICIES['normalisation'])} THEN 'unknown' WHEN regexp_matches({_plain('y')}, '^t ?(cells?|lymphocytes?)$') THEN 't-cell' WHEN regexp_matches({_plain('y')}, '^b ?(cells?|lymphocytes?)$') THEN 'b-cell' ELSE {_plain('y')} END", S.CELLS))
def str24(spark, sf):
    return _over(S.CELLS)(spark, sf).select("doc_id", "v", T.normal_cell_type(F.col("v")).alias("norm"))


@query("str25_assay_like", f"SELECT doc_id, v, NOT {_missing('v')} AND (" + " OR ".join(f"contains({_plain('v')}, '{p}') OR contains({_compact('v')}, '{p.replace(' ', '')}')" for p in T.ASSAY_PHRASES) + f") AS assay FROM {_from(S.TREATMENTS)}")
def str25(spark, sf):
    return _over(S.TREATMENTS)(spark, sf).select("doc_id", "v", T.assay_like(F.col("v")).alias("assay"))


@query("str26_clean_answer", f"SELECT doc_id, CASE WHEN s = '' THEN 'unknown' ELSE s END AS answer FROM (SELECT doc_id, trim(regexp_replace(trim(split_part(trim(regexp_replace(v, '\\s+', ' ', 'g')), '\"', 1)), '[,;}}\\]]$', '')) AS s FROM {_from(S.ANSWERS)}) u")
def str26(spark, sf):
    return _over(S.ANSWERS)(spark, sf).select("doc_id", T.clean_answer(F.col("v")).alias("answer"))


@query("str27_prompt", "SELECT conv_id, turn, 'Record: ' || conv_id || chr(10) || 'Summary: ' || text || chr(10) || 'Field: sex (reported sex)' || chr(10) || 'Answer: \"' AS prompt FROM conversations WHERE role = 'user'")
def str27(spark, sf):
    from millrace.operators.infer import build_prompt

    c = table(spark, sf, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", build_prompt(F.col("conv_id"), F.col("text"), "sex", "reported sex").alias("prompt"))


@query("str28_prompt_parts", "SELECT conv_id, turn, CAST(conv_id AS VARCHAR) AS run, md5(text) AS summary_md5 FROM conversations WHERE role = 'user'")
def str28(spark, sf):
    from millrace.operators.infer import build_prompt, prompt_run, prompt_summary

    c = table(spark, sf, "conversations").where("role = 'user'").withColumn("p", build_prompt(F.col("conv_id"), F.col("text"), "sex", "reported sex"))
    return c.select("conv_id", "turn", prompt_run(F.col("p")).alias("run"), F.md5(prompt_summary(F.col("p"))).alias("summary_md5"))


@query("str29_canonical_text", "SELECT doc_id, md5(trim(regexp_replace(replace(text, chr(65279), ''), '\\s+', ' ', 'g'))) AS text_md5 FROM documents")
def str29(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.canonical_text(F.col("text"))).alias("text_md5"))


_CLOSED = ["polya", "inverse rrna", "hybrid selection", "small rna", "other"]
_ALIAS = {"poly a selected": "polya", "ribo": "inverse rrna"}
_CLOSED_SQL = "CASE " + " ".join(f"WHEN s = '{a}' THEN '{n}'" for a, n in reversed(_ALIAS.items())) + " " + " ".join(
    f"WHEN {h} = '{n}' THEN '{n}'" for h in ("s", "array_to_string(string_split(s, ' ')[1:2], ' ')", "split_part(s, ' ', 1)") for n in reversed(_CLOSED)) + " " + " ".join(
    f"WHEN contains(s, '{n}') THEN '{n}'" for n in sorted(_CLOSED, key=lambda n: (len(n), n), reverse=True)) + " END"


@query("str30_closed_value", f"SELECT doc_id, v, {_CLOSED_SQL} AS closed FROM (SELECT doc_id, v, {_plain('v')} AS s FROM {_from(S.VALUES)}) u")
def str30(spark, sf):
    return _over(S.VALUES)(spark, sf).select("doc_id", "v", T.closed_value(F.col("v"), _CLOSED, _ALIAS).alias("closed"))


_CANON = {"source": T.SOURCE_CLASSES, "response": (("responder", "(?i)respon|complete|partial"), ("resistant", "(?i)resist|progress")), "is_cancer": (("true", "(?i)^(true|yes|1)$|cancer|melanoma"), ("false", "(?i)^(false|no|0)$"))}


@query("str31_category_canon", "SELECT doc_id, " + ", ".join(f"{_classes('v', c)} AS {k}" for k, c in _CANON.items()) + f" FROM {_from(S.SOURCES + ['yes', 'no', 'partial response', 'Resistant', 'melanoma'])}")
def str31(spark, sf):
    return _over(S.SOURCES + ["yes", "no", "partial response", "Resistant", "melanoma"])(spark, sf).select("doc_id", *[T.first_class(F.col("v"), c).alias(k) for k, c in _CANON.items()])


_SPOKEN = ["two weeks", "three days", "deux semaines", "une quinzaine", "dix-sept jours", "quelques heures", "a couple of months", "1,5 heures", "½ day", "treated for twelve hours", "someone days", "long term"]


@query("str32_duration_days", f"""SELECT doc_id, v, round(d, 6) AS days, CASE WHEN d IS NULL THEN trim(v) WHEN d < 2 THEN CAST(round_even(d * 24, 0) AS BIGINT) || ' hours' WHEN d < 21 THEN CAST(round_even(d, 0) AS BIGINT) || ' days' WHEN d < 90 THEN CAST(round_even(d / 7, 0) AS BIGINT) || ' weeks' ELSE CAST(round_even(d / 30, 0) AS BIGINT) || ' months' END AS canonical
FROM (SELECT doc_id, v, CASE WHEN regexp_matches(lower(v), 'fortnight|quinzaine') THEN 14.0 WHEN u LIKE 'h%' THEN n / 24 WHEN u LIKE 'd%' OR u LIKE 'j%' THEN n WHEN u LIKE 'w%' OR u LIKE 's%' THEN n * 7 WHEN u LIKE 'mi%' THEN n / 1440 WHEN u LIKE 'm%' THEN n * 30 WHEN u LIKE 'y%' THEN n * 365 END AS d
FROM (SELECT doc_id, v, g[2] AS u, coalesce(TRY_CAST(replace(g[1], ',', '.') AS DOUBLE), CASE g[1] WHEN 'few' THEN 3 WHEN 'quelques' THEN 3 WHEN 'couple' THEN 2 WHEN 'une' THEN 1 END, nullif(list_position(['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen', 'twenty'], g[1]), 0), nullif(list_position(['un', 'deux', 'trois', 'quatre', 'cinq', 'six', 'sept', 'huit', 'neuf', 'dix', 'onze', 'douze', 'treize', 'quatorze', 'quinze', 'seize', 'dix-sept', 'dix-huit', 'dix-neuf', 'vingt'], g[1]), 0)) AS n
FROM (SELECT doc_id, v, [trim(regexp_extract(t, p, 1)), regexp_extract(t, p, 2)] AS g FROM (SELECT doc_id, v, replace(lower(v), '½', '0.5') AS t, '(?:^|[ (])([0-9.,]+ ?|dix-[a-z]+ |[a-z]+ )(?:of )?(min|mins|minutes?|h|hrs?|hours?|heures?|d|days?|jours?|w|wks?|weeks?|semaines?|m|mo|mos|months?|mois|y|yrs?|years?)([^a-z]|$)' AS p FROM {_from(S.DURATIONS + _SPOKEN)}) a) b) c) w""")
def str32(spark, sf):
    return _over(S.DURATIONS + _SPOKEN)(spark, sf).select("doc_id", "v", F.round(T.duration_days(F.col("v")), 6).alias("days"), T.duration_text(F.col("v")).alias("canonical"))


@query("str33_loose_equal", f"SELECT doc_id, regexp_replace(a, '[^A-Za-z0-9]+', '', 'g') = regexp_replace(b, '[^A-Za-z0-9]+', '', 'g') AS same FROM (SELECT doc_id, {S.pick_sql('doc_id', S.SYNONYMS)} AS a, {S.pick_sql('doc_id', ['lymph-node', 'ab', 'A1', 'Skin.', 'none'])} AS b FROM documents) t")
def str33(spark, sf):
    a, b = S.pick(F.col("doc_id"), S.SYNONYMS), S.pick(F.col("doc_id"), ["lymph-node", "ab", "A1", "Skin.", "none"])
    return _docs(spark, sf).select("doc_id", (T.loose_key(a) == T.loose_key(b)).alias("same"))


@query("str34_cell_line_noise", "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(v), '\\b(cells?|lines?|cultures?)\\b', '', 'g'), '[\\s,;:.-]+$', '')) AS name, regexp_matches(lower(v), '(with|and|of|for|,|-)\\s*$') AS incomplete FROM " + _from(S.CELLS + ["A375 cell line", "treated with", "SK-MEL,"]))
def str34(spark, sf):
    from millrace.operators.resolve import incomplete_phrase, trim_cell_line

    return _over(S.CELLS + ["A375 cell line", "treated with", "SK-MEL,"])(spark, sf).select("doc_id", trim_cell_line(F.col("v")).alias("name"), incomplete_phrase(F.col("v")).alias("incomplete"))


@query("str35_json_wrap", "SELECT doc_id, '{\"v\": \"' || replace(replace(v, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\"}' AS wrapped FROM " + _from(S.ANSWERS))
def str35(spark, sf):
    return _over(S.ANSWERS)(spark, sf).select("doc_id", F.concat(F.lit('{"v": "'), T.json_escape(F.col("v")), F.lit('"}')).alias("wrapped"))


@query("str36_surface_variants", "SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS variants FROM (SELECT doc_id, [v, lower(v), upper(v), replace(v, ' ', '-'), replace(v, '-', ' '), replace(v, ' ', '_'), replace(v, 'carcinoma', 'cancer'), replace(v, 'therapy', 'tx')] AS l FROM " + _from(["basal carcinoma", "gene therapy", "SK-MEL-2", "skin"]) + ") u")
def str36(spark, sf):
    from millrace.operators.synth import surface_variants

    return _over(["basal carcinoma", "gene therapy", "SK-MEL-2", "skin"])(spark, sf).select("doc_id", F.array_join(surface_variants(F.col("v")), "|").alias("variants"))


@query("str47_slug", "SELECT doc_id, CASE WHEN s = '' THEN 'unnamed' WHEN length(s) <= 80 THEN s ELSE s[1:71] || '_' || md5(s)[1:8] END AS slug FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_-]+', '_', 'g'), '_{2,}', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM documents) t")
def str47(spark, sf):
    return _docs(spark, sf).select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("str48_file_key", "SELECT doc_id, source || '_' || doc_id AS key FROM documents")
def str48(spark, sf):
    from millrace.sources.records import file_key

    path = F.concat(F.lit("s3a://b/x.y/"), F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit("_metadata.xml"))
    return _docs(spark, sf).select("doc_id", file_key(path, "_metadata.xml").alias("key"))


@query("str50_acronyms", "SELECT doc_id, array_to_string(list_transform(list_zip(regexp_extract_all(x, '([A-Za-z]+(?: [a-z]+)*) \\(([A-Z]{2,})\\)', 2), regexp_extract_all(x, '([A-Za-z]+(?: [a-z]+)*) \\(([A-Z]{2,})\\)', 1)), lambda p: p[1] || '=' || p[2]), ';') AS acronyms FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Human papilloma virus (HPV) and tumour mutation load (TML).' ELSE 'none' END AS x FROM documents) t")
def str50(spark, sf):
    from millrace.operators.spans import acronyms

    x = F.when(F.col("doc_id") % 2 == 0, "Human papilloma virus (HPV) and tumour mutation load (TML).").otherwise("none")
    return _docs(spark, sf).select("doc_id", F.array_join(F.transform(acronyms(x), lambda p: F.concat(p["short"], F.lit("="), p["long"])), ";").alias("acronyms"))


# --- numbers --------------------------------------------------------------------------------------------------------

@query("mth1_safe_double", f"SELECT doc_id, v, CASE WHEN NOT {_missing('v', 'profiling')} THEN coalesce(TRY_CAST(trim(v) AS DOUBLE), TRY_CAST(regexp_extract(v, '-?[0-9]+(?:\\.[0-9]+)?', 0) AS DOUBLE)) END AS num FROM {_from(S.NUMBERS)}")
def mth1(spark, sf):
    return _over(S.NUMBERS)(spark, sf).select("doc_id", "v", T.safe_double(F.col("v")).alias("num"))


@query("mth2_metric_or_na", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'not applicable' ELSE printf('%.6f', value) END AS metric FROM events")
def mth2(spark, sf):
    v = F.when(F.col("event_id") % 5 != 0, F.col("value")).when(F.col("event_id") % 10 == 0, F.lit(float("inf")))
    return table(spark, sf, "events").select("event_id", T.metric_or_na(v).alias("metric"))


@query("mth3_perplexity", "SELECT user_id, round(-avg(-value / 10), 6) AS nll, round(exp(avg(value / 10)), 4) AS ppl FROM events GROUP BY user_id")
def mth3(spark, sf):
    from millrace.operators.infer import perplexity

    return perplexity(table(spark, sf, "events").select("user_id", (-F.col("value") / 10).alias("logprob")), "user_id").select("user_id", F.round("nll", 6).alias("nll"), F.round("ppl", 4).alias("ppl"))


@query("mth4_entropy", "SELECT user_id, round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT user_id, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY user_id, event_type) t GROUP BY user_id")
def mth4(spark, sf):
    from millrace.operators.infer import entropy_of_counts

    return entropy_of_counts(table(spark, sf, "events"), "user_id", "event_type").select("user_id", F.round("entropy", 6).alias("entropy"))


@query("mth5_tolerant_equal", "SELECT o_orderkey, abs(o_totalprice - round(o_totalprice, 0)) < 0.000001 AS whole FROM orders")
def mth5(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (F.abs(F.col("o_totalprice") - F.round("o_totalprice", 0)) < 1e-6).alias("whole"))
