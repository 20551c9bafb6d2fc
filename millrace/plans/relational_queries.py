"""Queries of sources, joins, aggregates, windows, sorts, sets, JSON and the provenance merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import curate as C
from millrace.operators import profile as P
from millrace.operators import resolve as R
from millrace.operators import vocab as V
from millrace.sources import delimited as D
from millrace.sources import records as X
from millrace.sources import sinks as K

from . import samples as S
from .registry import FLAGSHIP, query, table

# --- vocabulary stand-ins -------------------------------------------------------------------------------------------

_VOCAB = [("N1", "Melanoma", "skin cancer;malignant melanoma;MM1"), ("N2", "Skin", "cutis;dermal tissue"), ("N3", "Lung", "pulmo;pulmonary organ"), ("N4", "SK-MEL-2", "SKMEL2;SK Mel 2"), ("N5", "A375", "A-375;A 375"), ("N6", "Pulmo", "lung organ")]
_CELLS = ["melanoma", "Skin cancer; cutis", "Lung,  PULMO", "unknown tissue", "", "SK-MEL-2", "a375 cells", "grown A-375 line", "dermal tissue"]


def _vocab(spark):
    return spark.createDataFrame([(i, *v) for i, v in enumerate(_VOCAB)], "ord int, code string, name string, synonym string")


_VSQL = "(VALUES " + ", ".join(f"({i}, '{c}', '{n}', '{s}')" for i, (c, n, s) in enumerate(_VOCAB)) + ") v(ord, code, name, synonym)"
_KEYS = f"""(SELECT key, arg_max(name, p * 100 + ord) AS canonical, arg_max(code, p * 100 + ord) AS code FROM (
SELECT lower(trim(name)) AS key, name, code, ord, 1 AS p FROM {_VSQL} UNION ALL
SELECT lower(trim(unnest(string_split(synonym, ';')))) AS key, name, code, ord, 0 AS p FROM {_VSQL}) k GROUP BY key)"""


def _cells(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.pick(F.col("doc_id"), _CELLS).alias("v"))


_CELLSQL = f"(SELECT doc_id, {S.pick_sql('doc_id', _CELLS)} AS v FROM documents)"


def _keys(spark):
    return V.key_table(_vocab(spark), "ord")


# --- flagship -------------------------------------------------------------------------------------------------------

_SRC_SQL = "CASE WHEN contains(lower(text), 'the') THEN 'english prose' WHEN contains(lower(text), 'que') THEN 'romance prose' ELSE '' END"


@query(FLAGSHIP, f"""
WITH base AS (SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'curated' END AS db_class, nullif({_SRC_SQL}, '') AS llm_class,
 {S.pick_sql('d.doc_id', _CELLS)} AS v FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
resolved AS (SELECT b.*, coalesce(k.canonical, trim(b.v)) AS organ FROM base b LEFT JOIN {_KEYS} k ON lower(trim(b.v)) = k.key)
SELECT coalesce(db_class, llm_class, 'unknown') AS value, CASE WHEN db_class IS NOT NULL THEN 'db' WHEN llm_class IS NOT NULL THEN 'llm' ELSE 'none' END AS source,
 CASE WHEN organ = '' THEN 'unknown' ELSE organ END AS organ, count(*) AS n FROM resolved GROUP BY 1, 2, 3 ORDER BY n DESC, value, source, organ LIMIT 50""")
def flagship(spark, sf):
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "curated").alias("db_class"))
    cls = T.first_class(F.lower("text"), (("english prose", "the"), ("romance prose", "que")))
    base = docs.select("doc_id", cls.alias("llm_class"), S.pick(F.col("doc_id"), _CELLS).alias("v")).join(labels, "doc_id", "left")
    merged = C.merge_layers(R.lookup(base, "v", _keys(spark), "organ"), ["class"], ["db", "llm"])
    rows = merged.select(F.coalesce("class", F.lit("unknown")).alias("value"), F.coalesce("class_source", F.lit("none")).alias("source"), F.when(F.col("organ") == "", "unknown").otherwise(F.col("organ")).alias("organ"))
    return rows.groupBy("value", "source", "organ").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value", "source", "organ").limit(50)


# --- sources --------------------------------------------------------------------------------------------------------

@query("src4_key_text_rows", "SELECT trim(CAST(conv_id AS VARCHAR)) AS run_accession, md5(trim(text)) AS text_md5 FROM conversations WHERE trim(text) <> ''")
def src4(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("run"), "text")
    return D.two_columns(c).select("run_accession", F.md5("text").alias("text_md5"))


@query("src5_last_delimiter", "SELECT doc_id, md5(CASE WHEN contains(l, ',') THEN l[1:length(l) - length(list_last(string_split(l, ','))) - 1] ELSE l END) AS prompt_md5, CASE WHEN contains(l, ',') THEN list_last(string_split(l, ',')) ELSE '' END AS output FROM (SELECT doc_id, replace(text, chr(10), ' ') AS l FROM documents) t")
def src5(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("value"))
    return D.split_last(d, "value", keep=["doc_id"]).select("doc_id", F.md5("prompt").alias("prompt_md5"), "output")


@query("src6_alias_reader", "SELECT coalesce(nullif(k, ''), printf('ROW_%06d', CAST(row_number() OVER (ORDER BY page_id) AS INTEGER))) AS id, md5(trim(url)) AS text_md5 FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) ELSE '' END AS k, url FROM pages) t")
def src6(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string")).otherwise("").alias("run"), F.col("url").alias("text"))
    return D.aliased_table(p, "page_id").select("id", F.md5("text").alias("text_md5"))


@query("src9_xml_sniff", "SELECT page_id, starts_with(ltrim(html), '<') AND (contains(html, '<STUDY') OR contains(html, '<SAMPLE')) AS is_record, starts_with(ltrim(html), '<') AS is_markup FROM pages")
def src9(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", X.looks_like_xml(h).alias("is_record"), F.ltrim(h).startswith("<").alias("is_markup"))


@query("src12_header_projection", "SELECT doc_id, source, CAST(n_chars AS VARCHAR) AS n_chars, '' AS absent FROM documents")
def src12(spark, sf):
    d = table(spark, sf, "documents")
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), "source", F.col("n_chars").cast("string"))
    return d.select("doc_id", *X.header_projection(F.lit("id\tsource\tn_chars"), line, ["source", "n_chars", "absent"]))


_OBO = "[Term]\nid: X:{0}\nname: term {0}\nsynonym: \"alpha {0}\" EXACT []\nsynonym: \"beta\" RELATED []\n"


@query("src13_obo_terms", "SELECT 'X:' || doc_id AS code, 'term ' || doc_id AS name, 'alpha ' || doc_id || ';beta' AS synonym FROM documents WHERE doc_id % 5 <> 0")
def src13(spark, sf):
    i = F.col("doc_id").cast("string")
    body = F.concat(F.lit("Term]\nid: X:"), i, F.lit("\nname: term "), i, F.lit('\nsynonym: "alpha '), i, F.lit('" EXACT []\nsynonym: "beta" RELATED []\n'), F.when(F.col("doc_id") % 5 == 0, "is_obsolete: true\n").otherwise(""))
    return X.obo_terms(table(spark, sf, "documents").select(body.alias("value")))


_ANC = ["African=82.1%; European, North=3%", "East Asian, North=50%; East Asian, South=40%", "European, North=60%; European, South=30%", "South Asian=20%"]


@query("src14_flat_records", f"""SELECT 'CL' || doc_id AS id, 'Line ' || doc_id AS name, 'L' || doc_id || ';L-' || doc_id AS synonym, 'Melanoma' AS disease, '40Y' AS age, 'female' AS sex,
list_extract(['African', 'Asian', 'European', 'Caucasian'], CAST(doc_id % 4 AS INTEGER) + 1) AS ethnicity, CASE WHEN doc_id % 2 = 0 THEN 'metastasis' WHEN doc_id % 3 = 0 THEN 'blood' ELSE 'primary' END AS biopsy_type,
CASE WHEN doc_id % 3 = 0 THEN 'peripheral blood' ELSE 'lymph node' END AS biopsy_site, '000' || (doc_id % 7) AS uberon_code, 'melanocyte' AS cell_type FROM documents WHERE doc_id % 4 <> 9""")
def src14(spark, sf):
    i = F.col("doc_id").cast("string")
    site = F.concat(F.when(F.col("doc_id") % 2 == 0, "Metastatic; ").otherwise("In situ; "), F.when(F.col("doc_id") % 3 == 0, "Peripheral blood; ").otherwise("Lymph node; "), F.lit("UBERON=UBERON_000"), (F.col("doc_id") % 7).cast("string"))
    body = F.concat(F.lit("ID   Line "), i, F.lit("\nAC   CL"), i, F.lit("\nSY   L"), i, F.lit("; L-"), i, F.lit("\nDI   NCIt; C1; Melanoma\nAG   40Y\nSX   Female\nCC   Population: Caucasian.\nCC   Genome ancestry: "), S.pick(F.col("doc_id"), _ANC), F.lit(".\nCC   Derived from site: "), site, F.lit(".\nCC   Cell type: Melanocyte; CL=1.\nOX   NCBI_TaxID=9606; ! Homo sapiens"))
    return X.flat_records(table(spark, sf, "documents").select(body.alias("value")))


@query("src15_ancestry", "SELECT doc_id, list_extract(['African', 'Asian', 'European', 'Caucasian'], CAST(doc_id % 4 AS INTEGER) + 1) AS ethnicity FROM documents")
def src15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.ancestry(S.pick(F.col("doc_id"), _ANC), F.lit("Caucasian")).alias("ethnicity"))


@query("src16_site_disposition", "SELECT doc_id, list_extract(['metastasis', 'blood', 'primary', ''], CAST(doc_id % 4 AS INTEGER) + 1) AS biopsy_type FROM documents")
def src16(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.biopsy_type(S.pick(F.col("doc_id"), ["Metastatic; Lung", "In situ; Peripheral blood", "In situ; Skin", "Other; Skin"])).alias("biopsy_type"))


@query("src17_templates", "SELECT doc_id, 't ' || doc_id AS template, CAST(CASE WHEN doc_id % 3 = 0 THEN 4 WHEN doc_id % 3 = 1 THEN 2 ELSE 1 END AS INTEGER) AS weight FROM documents")
def src17(spark, sf):
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    item = F.when(k == 0, F.concat(F.lit('["t '), i, F.lit('", 4]'))).when(k == 1, F.concat(F.lit('{"text": "t '), i, F.lit('", "count": 2}'))).otherwise(F.concat(F.lit('"t '), i, F.lit('"')))
    t, w = X.template(item)
    return table(spark, sf, "documents").select("doc_id", t.alias("template"), w.alias("weight"))


@query("src18_join_cells", "SELECT doc_id, trim(lang || ' ' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE source || ' ' END || n_chars) AS text FROM documents")
def src18(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, " ").otherwise(F.col("source")).alias("s"), F.col("n_chars").cast("string").alias("n"))
    return D.join_cells(d, ["lang", "s", "n"]).select("doc_id", "text")


_JSON = "CASE event_id % 4 WHEN 0 THEN '{\"' || event_id || '\": {\"sex\": \"male\", \"organ\": [\"skin\",\"lung\"]}, \"nll\": {\"sex\": 0.5}, \"ppl\": {\"sex\": \"not applicable\"}}' WHEN 1 THEN '' WHEN 2 THEN '{\"broken' ELSE '{\"' || event_id || '\": {\"age\": \"\"}}' END"


def _answers(spark, sf):
    i, k = F.col("event_id").cast("string"), F.col("event_id") % 4
    body = F.when(k == 0, F.concat(F.lit('{"'), i, F.lit('": {"sex": "male", "organ": ["skin","lung"]}, "nll": {"sex": 0.5}, "ppl": {"sex": "not applicable"}}'))).when(k == 1, "").when(k == 2, '{"broken').otherwise(F.concat(F.lit('{"'), i, F.lit('": {"age": ""}}')))
    return table(spark, sf, "events").select("event_id", body.alias("body"))


@query("src19_inference_json", """SELECT event_id, 'sex' AS field, 'male' AS value, CAST(0.5 AS DOUBLE) AS nll, CAST(NULL AS DOUBLE) AS ppl FROM events WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 'organ', 'skin; lung', NULL, NULL FROM events WHERE event_id % 4 = 0 UNION ALL SELECT event_id, 'age', 'unknown', NULL, NULL FROM events WHERE event_id % 4 = 3""")
def src19(spark, sf):
    from millrace.operators.infer import parse_answers

    return parse_answers(_answers(spark, sf), "event_id", "body")


@query("src20_embedding_scan", "SELECT vec_id, label, len(embedding) AS dims, round(CAST(embedding[1] AS DOUBLE), 5) AS first_value FROM embeddings")
def src20(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.size("embedding").cast("bigint").alias("dims"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first_value"))


@query("src21_blocks", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title\\b[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM pages WHERE contains(html, '<title')")
def src21(spark, sf):
    return table(spark, sf, "pages").where(F.col("html").contains("<title")).select("page_id", X.block_text(F.col("html"), "title").alias("title"))


@query("src22_column_cut", "SELECT c_custkey, c_mktsegment FROM customer")
def src22(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment")


def _filed(df, name, how):
    """df written by how(writer, path) into the shared folder; returns the path."""
    from millrace.operators.lineage import fresh_path

    path = fresh_path(df.sparkSession, name)
    how(df.write, path)
    return path


@query("src1_key_list", "SELECT DISTINCT source AS run_accession FROM documents")
def src1(spark, sf):
    keys = table(spark, sf, "documents").select("source").distinct().select(F.explode(F.array(F.concat(F.lit(" "), "source", F.lit(" ")), F.lit(""))))
    return D.read_keys(spark, _filed(keys, "keys", lambda w, p: w.text(p)))


@query("src2_delimited_scan", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS source FROM documents")
def src2(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source"))
    return D.read_table(spark, _filed(d, "table", lambda w, p: w.csv(p, header=True, sep="\t")), "\t")


@query("src3_sniffed_scan", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def src3(spark, sf):
    d = table(spark, sf, "nation").select("n_nationkey", "n_name").coalesce(1)
    return D.read_table(spark, _filed(d, "sniffed", lambda w, p: w.csv(p, header=True, sep="\t")))


@query("src7_first_two_columns", "SELECT CAST(c_custkey AS VARCHAR) AS run_accession, c_name AS text FROM customer")
def src7(spark, sf):
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("\ufeffwho"), F.col("c_name").alias("what"), "c_mktsegment")
    return D.two_columns(D.read_table(spark, _filed(d, "flex", lambda w, p: w.csv(p, header=True)), ","))


@query("src8_plain_lines", "SELECT printf('ROW_%06d', CAST(row_number() OVER (ORDER BY n_name) AS INTEGER)) AS id, n_name AS text FROM nation")
def src8(spark, sf):
    path = _filed(table(spark, sf, "nation").select("n_name"), "lines", lambda w, p: w.text(p))
    return D.aliased_table(spark.read.text(path).withColumnRenamed("value", "text"), "text")


@query("snk1_export_round_trip", "SELECT f AS format, count(*) AS n FROM nation, (SELECT unnest(['csv', 'tsv', 'json', 'parquet']) AS f) t GROUP BY f")
def snk1(spark, sf):
    from millrace.operators.lineage import fresh_path

    path = fresh_path(spark, "export")
    failed = K.export(table(spark, sf, "nation"), path)
    read = {"csv": lambda p: spark.read.csv(p, header=True), "tsv": lambda p: spark.read.csv(p, header=True, sep="\t"), "json": spark.read.json, "parquet": spark.read.parquet}
    out = None
    for f in K.FORMATS:
        one = read[f](f"{path}/{f}").agg(F.lit(f).alias("format"), F.count("*").alias("n")) if f not in failed else None
        out = one if out is None else out if one is None else out.union(one)
    return out


@query("snk2_confidence_file", "SELECT CAST(event_id AS VARCHAR) AS run_accession, CASE WHEN event_type = 'click' THEN printf('%.6f', value) ELSE 'not applicable' END AS sex FROM events")
def snk2(spark, sf):
    d = table(spark, sf, "events").select(F.col("event_id").alias("run_accession"), F.col("value").alias("sex"), F.when(F.col("event_type") == "click", "llm").otherwise("db").alias("sex_source"))
    path = _filed(C.mask_confidence(d, {"sex": "sex"}).select("run_accession", "sex"), "confidence", lambda w, p: w.csv(p, header=True))
    return D.read_table(spark, path, ",")


@query("snk5_resumed_append", "SELECT doc_id FROM documents")
def snk5(spark, sf):
    from millrace.operators.lineage import fresh_path

    d, path = table(spark, sf, "documents").select("doc_id"), fresh_path(spark, "resumed")
    for part in (d.where("doc_id % 2 = 0"), d, d):
        K.resume_append(spark, part, path, "doc_id", lambda x: x)
    return spark.read.parquet(path)


@query("snk6_html_rows", "SELECT count(*) AS n_rows FROM nation")
def snk6(spark, sf):
    html = K.html_table(table(spark, sf, "nation"), ["n_nationkey", "n_name"], {})
    return spark.createDataFrame([(html.count("<tr>") - 1,)], "n_rows bigint")


# --- sinks as relations ---------------------------------------------------------------------------------------------

@query("snk3_upsert", "SELECT user_id, arg_max(event_id, event_id) AS event_id FROM events GROUP BY user_id")
def snk3(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id")
    return K.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id")


@query("snk4_resume_rows", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def snk4(spark, sf):
    return K.todo(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("snk7_shards", "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 4 AS INTEGER) AS shard FROM documents")
def snk7(spark, sf):
    return K.shard_of(table(spark, sf, "documents").select("doc_id"), "doc_id", 4)


@query("snk8_first_writer", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS writer FROM documents")
def snk8(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return K.first_writer([d.where("doc_id % 3 = 0").withColumn("writer", F.lit("a")), d.withColumn("writer", F.lit("b"))], "doc_id")


@query("snk9_file_union", "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def snk9(spark, sf):
    return table(spark, sf, "supplier").selectExpr("s_suppkey k", "s_name name").unionByName(table(spark, sf, "customer").selectExpr("c_custkey k", "c_name name"))


# --- joins ----------------------------------------------------------------------------------------------------------

@query("joi1_left_fill", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def joi1(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string")), "doc_id", "left").na.fill("", ["quality"])


@query("joi2_inner_pairs", "SELECT a.conv_id, md5(a.text) AS real_md5, md5(b.text) AS synth_md5 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1")
def joi2(spark, sf):
    c = table(spark, sf, "conversations")
    a, b = (c.where(F.col("turn") == t).select("conv_id", F.md5("text").alias(n)) for t, n in ((0, "real_md5"), (1, "synth_md5")))
    return a.join(b, "conv_id")


@query("joi3_side_lookup", "SELECT d.doc_id, coalesce(s.side, '') AS side FROM documents d LEFT JOIN (SELECT k, arg_max(e, event_id) AS side FROM (SELECT user_id AS k, event_id, event_type || ';' || props AS e FROM events) t GROUP BY k) s ON s.k = d.doc_id")
def joi3(spark, sf):
    side = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), "event_id", "event_type", "props")
    return R.side_lookup(table(spark, sf, "documents").select("doc_id"), "doc_id", side, "event_id", "side")


@query("joi4_lookup_insert", "SELECT c.c_custkey, coalesce(n.n_name, '') AS nation, c.c_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def joi4(spark, sf):
    n = table(spark, sf, "nation")
    return table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("")).alias("nation"), "c_name")


@query("joi5_vocabulary_lookup", f"SELECT t.doc_id, coalesce(k.canonical, trim(t.v)) AS resolved FROM {_CELLSQL} t LEFT JOIN {_KEYS} k ON lower(trim(t.v)) = k.key")
def joi5(spark, sf):
    return R.lookup(_cells(spark, sf), "v", _keys(spark)).select("doc_id", "resolved")


_PARTS = f"(SELECT doc_id, i, trim(list_extract(p, i)) AS part FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(v, '[;,]'), lambda x: trim(x)), lambda x: x <> '') AS p, unnest(generate_series(1, len(list_filter(list_transform(regexp_split_to_array(v, '[;,]'), lambda x: trim(x)), lambda x: x <> '')))) AS i FROM {_CELLSQL} c) q)"


@query("joi6_7_multi_value_codes", f"""SELECT d.doc_id, coalesce(a.terms, 'unknown') AS terms, coalesce(a.codes, 'unknown') AS codes FROM documents d LEFT JOIN (
SELECT p.doc_id, string_agg(coalesce(lower(k.canonical), lower(p.part)), '; ' ORDER BY p.i) AS terms, string_agg(coalesce(k.code, 'unknown'), '; ' ORDER BY p.i) AS codes FROM {_PARTS} p LEFT JOIN {_KEYS} k ON lower(p.part) = k.key GROUP BY p.doc_id) a ON a.doc_id = d.doc_id""")
def joi67(spark, sf):
    return R.lookup_values(_cells(spark, sf), "doc_id", "v", _keys(spark))


_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(lower(v), '\\bcells?\\b', '', 'g'), '[.,\\-_;:()\\[\\]''\"]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("joi8_cascade", f"SELECT t.doc_id, coalesce(a.canonical, b.canonical, c.canonical) AS canonical FROM {_CELLSQL} t LEFT JOIN {_KEYS} a ON lower(trim(v)) = a.key LEFT JOIN {_KEYS} b ON regexp_replace(lower(v), '[^a-z0-9]', '', 'g') = b.key LEFT JOIN {_KEYS} c ON {_CLEAN} = c.key WHERE coalesce(a.canonical, b.canonical, c.canonical) IS NOT NULL")
def joi8(spark, sf):
    return R.cascade(_cells(spark, sf), "doc_id", "v", _keys(spark))


@query("joi9_second_pass", f"""SELECT doc_id, arg_min(canonical, pos) AS canonical FROM (SELECT c.doc_id, k.canonical, CASE WHEN k.key = lower(c.v) THEN 0 ELSE 1 END AS pos FROM
(SELECT doc_id, unnest(list_filter(regexp_extract_all(v, '[A-Za-z0-9][A-Za-z0-9._/''-]*[A-Za-z0-9]'), lambda t: regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[0-9]'))) AS v FROM {_CELLSQL} t) c
JOIN {_KEYS} k ON k.key = lower(c.v) OR k.key = regexp_replace(lower(c.v), '[^a-z0-9]', '', 'g')) z GROUP BY doc_id""")
def joi9(spark, sf):
    return R.second_pass(_cells(spark, sf), "doc_id", "v", _keys(spark))


_ENT = [("Melanoma", "40Y", "female"), ("SK-MEL-2", "60Y", "unknown"), ("A375", "54Y", "male")]
_ENTSQL = "(VALUES " + ", ".join(f"('{n}', '{a}', {'NULL' if s == 'unknown' else repr(s)})" for n, a, s in _ENT) + ") e(name, age, sex)"


def _entity(spark):
    return spark.createDataFrame(_ENT, "name string, age string, sex string")


def _own(spark, sf):
    i = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", S.pick(i, ["Melanoma", "SK-MEL-2", "A375", "none"]).alias("cell_line"), S.pick(i, ["30Y", "", "unknown"]).alias("age"), S.pick(i, ["male", "na", "female", "", "x"]).alias("sex"))


_OWNSQL = f"(SELECT doc_id, {S.pick_sql('doc_id', ['Melanoma', 'SK-MEL-2', 'A375', 'none'])} AS cell_line, nullif(nullif({S.pick_sql('doc_id', ['30Y', '', 'unknown'])}, ''), 'unknown') AS age, nullif(nullif({S.pick_sql('doc_id', ['male', 'na', 'female', '', 'x'])}, ''), 'na') AS sex FROM documents) d"


@query("joi10_propagate_missing", f"SELECT doc_id, cell_line, coalesce(d.age, e.age) AS age, coalesce(d.sex, e.sex) AS sex, CASE WHEN d.age IS NOT NULL THEN 'own' WHEN e.age IS NOT NULL THEN 'entity' END AS age_source FROM {_OWNSQL} LEFT JOIN {_ENTSQL} ON d.cell_line = e.name")
def joi10(spark, sf):
    return R.propagate(_own(spark, sf), "cell_line", _entity(spark), ["age", "sex"]).drop("sex_source")


@query("joi11_propagate_over", f"SELECT doc_id, cell_line, coalesce(e.age, d.age) AS age, coalesce(e.sex, d.sex) AS sex, CASE WHEN e.sex IS NOT NULL THEN 'entity' WHEN d.sex IS NOT NULL THEN 'own' END AS sex_source FROM {_OWNSQL} LEFT JOIN {_ENTSQL} ON d.cell_line = e.name")
def joi11(spark, sf):
    return R.propagate(_own(spark, sf), "cell_line", _entity(spark), ["age", "sex"], overwrite=True).drop("age_source")


@query("joi12_bag_alias", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN lang END AS tissue FROM documents")
def joi12(spark, sf):
    k = F.col("doc_id") % 3
    bag = F.when(k == 0, F.create_map(F.lit("Tissue Type"), "source", F.lit("organ"), F.lit("z"))).when(k == 1, F.create_map(F.lit("Body_Site"), "lang")).otherwise(F.create_map(F.lit("other"), "lang"))
    return table(spark, sf, "documents").select("doc_id", R.bag_lookup(bag, ["tissue_type", "body-site"]).alias("tissue"))


@query("joi13_semi", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def joi13(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("joi14_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def joi14(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("joi15_key_differences", "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'twice' FROM documents GROUP BY doc_id HAVING count(*) > 1")
def joi15(spark, sf):
    return R.key_differences(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("joi16_label_texts", "SELECT d.doc_id, md5(d.text) AS prompt_md5, replace('label:' || l.quality, 'label:', '') AS output FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def joi16(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("label:"), F.col("quality").cast("string")).alias("o"))
    return table(spark, sf, "documents").join(lab, "doc_id").select("doc_id", F.md5("text").alias("prompt_md5"), F.regexp_replace("o", "^label:", "").alias("output"))


@query("joi17_allowed_values", "SELECT n_name AS region_nation, array_to_string(list_sort(array_agg(DISTINCT c_mktsegment)), ',') AS allowed FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def joi17(spark, sf):
    from millrace.operators.synth import allowed

    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    edges = n.join(c, F.col("n_nationkey") == F.col("c_nationkey")).select(F.lit("nation").alias("from_attr"), F.col("n_name").alias("from_val"), F.lit("segment").alias("to_attr"), F.col("c_mktsegment").alias("to_val")).distinct()
    out = allowed(n.select(F.col("n_name").alias("nation")), "nation", "segment", edges)
    return out.select(F.col("nation").alias("region_nation"), F.when(F.size("allowed") > 0, F.array_join("allowed", ",")).alias("allowed"))


@query("joi18_interleave", "SELECT * FROM (SELECT row_number() OVER (ORDER BY doc_id) AS rn, 0 AS side, doc_id FROM documents UNION ALL SELECT row_number() OVER (ORDER BY doc_id), 1, doc_id FROM labels) t")
def joi18(spark, sf):
    d, lab = (table(spark, sf, t).select("doc_id", F.col("doc_id").alias("o")) for t in ("documents", "labels"))
    return R.interleave(d, lab, "doc_id", "o")


# --- aggregates -----------------------------------------------------------------------------------------------------

@query("agg1_value_counts", "SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def agg1(spark, sf):
    return P.value_counts(table(spark, sf, "documents"), ["lang", "source"])


@query("agg2_pair_counts", "SELECT lang || '|' || source AS pair, count(*) AS n FROM documents GROUP BY 1")
def agg2(spark, sf):
    return P.pair_counts(table(spark, sf, "documents"), "lang", "source")


@query("agg3_bucket_counts", "SELECT event_type, CASE WHEN value IS NULL OR value < 0 THEN 'missing' WHEN value <= 3 THEN 'confident' WHEN value <= 6 THEN 'medium' ELSE 'uncertain' END AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def agg3(spark, sf):
    return P.bucket_counts(table(spark, sf, "events"), "event_type", "value", 3, 6)


@query("agg4_metric_stats", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(CASE WHEN rn = floor(0.1 * (c - 1)) + 1 THEN value END) AS p10, min(CASE WHEN rn = floor(0.9 * (c - 1)) + 1 THEN value END) AS p90 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS c FROM events) t GROUP BY event_type")
def agg4(spark, sf):
    r = P.floor_percentiles(table(spark, sf, "events"), "event_type", "value", {"p10": 0.1, "p90": 0.9})
    return r.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "p10", "p90")


@query("agg5_category_profile", "SELECT 'lang' AS field, CAST(sum(n) AS BIGINT) AS filled, count(*) AS distinct_values, string_agg(lang || ' (' || n || ')', '; ' ORDER BY n DESC, lang) AS profile FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) t")
def agg5(spark, sf):
    return P.category_profile(table(spark, sf, "documents"), ["lang"])


@query("agg6_shares", "SELECT o_orderstatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY o_orderstatus")
def agg6(spark, sf):
    return P.shares(table(spark, sf, "orders"), "o_orderstatus").select("o_orderstatus", "n", F.round("share", 6).alias("share"))


@query("agg7_top_counts", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 5")
def agg7(spark, sf):
    return P.top_counts(table(spark, sf, "part"), "p_brand", 5)


@query("agg8_accuracy", "WITH a AS (SELECT lang, avg(CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END) AS accuracy FROM documents GROUP BY lang) SELECT lang, round(accuracy, 6) AS accuracy FROM a UNION ALL SELECT 'MEAN', round(avg(accuracy), 6) FROM a")
def agg8(spark, sf):
    return P.accuracy(table(spark, sf, "documents").select("lang", (F.col("doc_id") % 3 == 0).alias("ok")), "lang", "ok").select("lang", F.round("accuracy", 6).alias("accuracy"))


_PRED = "(SELECT lang AS ref, CASE WHEN doc_id % 4 = 0 THEN 'en' ELSE lang END AS pred FROM documents) t"


def _pred(spark, sf):
    return table(spark, sf, "documents").select(F.col("lang").alias("ref"), F.when(F.col("doc_id") % 4 == 0, "en").otherwise(F.col("lang")).alias("pred"))


@query("agg9_confusion", f"SELECT ref, pred, count(*) AS n FROM {_PRED} GROUP BY ref, pred")
def agg9(spark, sf):
    return P.confusion(_pred(spark, sf), "ref", "pred")


@query("agg10_class_report", f"SELECT label, round(CASE WHEN p > 0 THEN t / p ELSE 0.0 END, 6) AS precision, round(CASE WHEN r > 0 THEN t / r ELSE 0.0 END, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * t / (p + r) ELSE 0.0 END, 6) AS f1 FROM (SELECT l.label, CAST(count(*) FILTER (WHERE ref = label AND pred = label) AS DOUBLE) AS t, CAST(count(*) FILTER (WHERE pred = label) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE ref = label) AS DOUBLE) AS r FROM (SELECT DISTINCT lang AS label FROM documents) l, {_PRED} GROUP BY l.label) z")
def agg10(spark, sf):
    return P.class_report(_pred(spark, sf), "ref", "pred").select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("agg11_class_weights", "SELECT lang, n, round((1.0 / n) / avg(1.0 / n) OVER (), 6) AS weight FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) t")
def agg11(spark, sf):
    return P.class_weights(table(spark, sf, "documents"), "lang").select("lang", "n", F.round("weight", 6).alias("weight"))


@query("agg12_split_summary", "SELECT lang, count(*) FILTER (WHERE doc_id % 3 = 0) AS test, count(*) FILTER (WHERE doc_id % 3 = 1) AS train, count(*) FILTER (WHERE doc_id % 3 = 2) AS val FROM documents GROUP BY lang")
def agg12(spark, sf):
    part = F.element_at(F.array(F.lit("test"), F.lit("train"), F.lit("val")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf, "documents").withColumn("part", part).groupBy("lang").pivot("part", ["test", "train", "val"]).count().na.fill(0)


@query("agg13_accept_rate", "SELECT round(avg(CASE WHEN value >= 1 AND user_id % 2 = 0 AND event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS accept_rate FROM events")
def agg13(spark, sf):
    ok = (F.col("value") >= 1) & (F.col("user_id") % 2 == 0) & (F.col("event_type") != "error")
    return table(spark, sf, "events").agg(F.round(F.avg(ok.cast("double")), 6).alias("accept_rate"))


@query("agg14_histogram", "SELECT CAST(least(floor(value / (100.0 / 60)), 59) AS INTEGER) AS bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER () * (100.0 / 60)), 9) AS density FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1")
def agg14(spark, sf):
    return P.histogram(table(spark, sf, "events"), "value", 0.0, 100.0, 60).select("bin", "n", F.round("density", 9).alias("density"))


@query("agg15_ecdf", "SELECT value, round(max(rn) / (SELECT count(*) FROM events), 9) AS ecdf FROM (SELECT value, row_number() OVER (ORDER BY value) AS rn FROM events) t GROUP BY value")
def agg15(spark, sf):
    return P.ecdf(table(spark, sf, "events"), "value").select("value", F.round("ecdf", 9).alias("ecdf"))


@query("agg16_hints", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 200")
def agg16(spark, sf):
    return P.top_counts(table(spark, sf, "documents"), "source", 200)


@query("agg17_token_counts", "SELECT doc_id, w AS token, count(*) AS n FROM (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ')) AS w FROM documents) t GROUP BY doc_id, w")
def agg17(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(F.split(T.sanitise(F.lower("text")), " ")).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("agg18_dedup", "SELECT text_md5, max(doc_id) AS last_id, min(doc_id) AS first_id FROM (SELECT doc_id, md5(text) AS text_md5 FROM documents) t GROUP BY text_md5")
def agg18(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    return R.keep_last(d, "text_md5", "doc_id").withColumnRenamed("doc_id", "last_id").join(d.groupBy("text_md5").agg(F.min("doc_id").alias("first_id")), "text_md5")


# --- windows, sorts, sets -------------------------------------------------------------------------------------------

@query("win1_keep_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) t WHERE r = 1")
def win1(spark, sf):
    e = table(spark, sf, "events").withColumn("o", F.struct("ts", "event_id"))
    return R.keep_last(e.select("user_id", "event_id", "event_type", "o"), "user_id", "o").select("user_id", "event_id", "event_type")


@query("win2_ordinal_ranks", "SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS rn FROM events")
def win2(spark, sf):
    from millrace.operators.sample import numbered

    return numbered(table(spark, sf, "events").select("event_id", "value"), ["value", "event_id"]).select("event_id", "rn")


@query("win3_tie_auc", "SELECT round((sum(r) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 6) AS auc FROM (SELECT user_id % 3 = 0 AS pos, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM events) t")
def win3(spark, sf):
    return P.auc(table(spark, sf, "events").select("value", (F.col("user_id") % 3 == 0).alias("pos")), "value", "pos").select(F.round("auc", 6).alias("auc"))


@query("win4_label_positions", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS pos FROM documents")
def win4(spark, sf):
    from pyspark.sql import Window as W

    from millrace.operators.sample import hash_order

    return table(spark, sf, "documents").select("doc_id", F.row_number().over(W.partitionBy("source").orderBy(hash_order("doc_id"), "doc_id")).cast("bigint").alias("pos"))


@query("win7_run_limit", "SELECT doc_id, array_to_string(list_filter(l, lambda x, i: NOT (i > 2 AND l[i - 1] = x AND l[i - 2] = x)), ' ') AS kept FROM (SELECT doc_id, string_split(CASE WHEN doc_id % 2 = 0 THEN 'a a a a b b c' ELSE 'x y y y' END, ' ') AS l FROM documents) t")
def win7(spark, sf):
    from millrace.operators.sample import run_limited

    t = F.split(F.when(F.col("doc_id") % 2 == 0, "a a a a b b c").otherwise("x y y y"), " ")
    return table(spark, sf, "documents").select("doc_id", F.array_join(run_limited(t, 2), " ").alias("kept"))


@query("win9_char_windows", "SELECT doc_id, CAST(s AS INTEGER) AS start, md5(text[s + 1:s + 500]) AS piece_md5 FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 400)) AS s FROM documents) t")
def win9(spark, sf):
    from millrace.operators.sample import char_windows

    return char_windows(table(spark, sf, "documents"), "doc_id", "text", 500, 400).select("doc_id", "start", F.md5("piece").alias("piece_md5"))


@query("srt1_top_first_seen", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, min(doc_id) LIMIT 7")
def srt1(spark, sf):
    return P.top_counts(table(spark, sf, "documents"), "source", 7, first="doc_id")


@query("srt2_4_hash_sample", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def srt2(spark, sf):
    from millrace.operators.sample import hash_order

    return table(spark, sf, "documents").select("doc_id").orderBy(hash_order("doc_id"), "doc_id").limit(100)


@query("srt3_longest_first", "SELECT array_to_string(list_transform(list_sort(list_transform(array_agg(DISTINCT p_brand), lambda x: printf('%03d', 100 - CAST(length(x) AS INTEGER)) || x)), lambda x: x[4:]), '|') AS alternatives FROM part")
def srt3(spark, sf):
    b = F.array_agg(F.struct((100 - F.length("p_brand")).alias("k"), "p_brand"))
    return table(spark, sf, "part").select("p_brand").distinct().agg(F.array_join(F.transform(F.array_sort(b), lambda x: x["p_brand"]), "|").alias("alternatives"))


@query("srt5_row_cap", "SELECT event_id FROM events ORDER BY event_id LIMIT 1000")
def srt5(spark, sf):
    return table(spark, sf, "events").select("event_id").orderBy("event_id").limit(1000)


@query("set1_union_tagged", "SELECT text_md5, 'b' AS tag FROM (SELECT md5(text) AS text_md5 FROM benchmark) x UNION ALL SELECT md5(text), 'd' FROM documents")
def set1(spark, sf):
    t = lambda n, tag: table(spark, sf, n).select(F.md5("text").alias("text_md5"), F.lit(tag).alias("tag"))
    return t("benchmark", "b").unionByName(t("documents", "d"))


@query("set2_key_sets", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) a UNION ALL SELECT 'left', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) b")
def set2(spark, sf):
    d, lab = (table(spark, sf, t).select("doc_id") for t in ("documents", "labels"))
    return d.intersect(lab).agg(F.lit("both").alias("kind"), F.count("*").alias("n")).union(d.subtract(lab).agg(F.lit("left"), F.count("*")))


@query("set3_exact_overlap", "SELECT count(*) AS n, round(count(*) / (SELECT CAST(count(DISTINCT text) AS DOUBLE) FROM conversations), 6) AS ratio FROM (SELECT text FROM conversations INTERSECT SELECT text FROM documents) t")
def set3(spark, sf):
    a, b = (table(spark, sf, t).select("text").distinct() for t in ("conversations", "documents"))
    n = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), "text", "left")
    return n.agg(F.count("y").alias("n"), F.round(F.count("y") / F.count("*"), 6).alias("ratio"))


@query("set4_stable_union", "SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS merged FROM (SELECT doc_id, [source, 'src1', lang, 'src1', 'en'] AS l FROM documents) t")
def set4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_distinct(F.concat(F.array("source", F.lit("src1")), F.array("lang", F.lit("src1"), F.lit("en")))), ",").alias("merged"))


@query("set5_merge_edges", "SELECT DISTINCT 'lang' AS from_attr, lang AS from_val, 'source' AS to_attr, source AS to_val FROM documents")
def set5(spark, sf):
    from millrace.operators.synth import merge_edges

    e = lambda d: d.select(F.lit("lang").alias("from_attr"), F.col("lang").alias("from_val"), F.lit("source").alias("to_attr"), F.col("source").alias("to_val"))
    d = table(spark, sf, "documents")
    return merge_edges(e(d.where("doc_id % 2 = 0")), e(d.where("doc_id % 2 = 1")))


@query("set6_excluded_vocabulary", "SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 50 = 1)")
def set6(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_brand").distinct().join(p.where("p_partkey % 50 = 1").select("p_brand"), "p_brand", "left_anti")


# --- JSON and arrays ------------------------------------------------------------------------------------------------

_LENIENT = ["{\"a\": \"x1\"}", "\"{\"\"a\"\": \"\"x2\"\"}\"", "{a: x3, b", "none", ""]


@query("jsn1_lenient_field", f"SELECT doc_id, list_extract(['x1', 'x2', 'x3', NULL, NULL], CAST(doc_id % 5 AS INTEGER) + 1) AS a FROM documents")
def jsn1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.lenient_field(S.pick(F.col("doc_id"), _LENIENT), "a").alias("a"))


@query("jsn3_json_keys", "SELECT DISTINCT unnest(json_keys(props)) AS category FROM events")
def jsn3(spark, sf):
    return table(spark, sf, "events").select(F.explode(F.json_object_keys("props")).alias("category")).distinct()


@query("jsn4_list_values", f"SELECT doc_id, list_extract(['skin; lung', 'plain', 'unknown', 'unknown'], CAST(doc_id % 4 AS INTEGER) + 1) AS value FROM documents")
def jsn4(spark, sf):
    v = S.pick(F.col("doc_id"), ['["skin","lung"]', "plain", "", "[]"])
    text = F.coalesce(F.array_join(F.from_json(v, "array<string>"), "; "), v)
    return table(spark, sf, "documents").select("doc_id", F.when(F.trim(text) == "", "unknown").otherwise(text).alias("value"))


@query("jsn5_build_json", "SELECT doc_id, '{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' AS output FROM documents")
def jsn5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.to_json(F.struct("lang", "source")).alias("output"))


@query("jsn6_key_value_lines", "SELECT doc_id, lang, source FROM documents")
def jsn6(spark, sf):
    m = X.key_value_lines(F.concat(F.lit("lang: "), "lang", F.lit("\nsource: "), "source"))
    return table(spark, sf, "documents").select("doc_id", m["lang"].alias("lang"), m["source"].alias("source"))


@query("arr1_packed_lists", "SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i AND x <> ''), ';') AS packed FROM (SELECT doc_id, list_transform(string_split('b; a ;;' || lang || ';a', ';'), lambda x: trim(x)) AS l FROM documents) t")
def arr1(spark, sf):
    v = F.concat(F.lit("b; a ;;"), F.col("lang"), F.lit(";a"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_distinct(T.split_values(v, ";")), ";").alias("packed"))


@query("arr2_strided", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) t WHERE r % 4 = 1")
def arr2(spark, sf):
    return K.shard_of(table(spark, sf, "documents").select("doc_id"), "doc_id", 4).where("shard = 1").select("doc_id")


@query("str9_key_table", f"SELECT key, canonical, code FROM {_KEYS} k WHERE key NOT IN ('mm')")
def key_table(spark, sf):
    return _keys(spark)


@query("str10_pruned_synonyms", "SELECT * FROM (VALUES ('N1', 'Melanoma', 'MM1'), ('N2', 'Skin', ''), ('N3', 'Lung', ''), ('N4', 'SK-MEL-2', 'SKMEL2;SK Mel 2'), ('N5', 'A375', 'A-375'), ('N6', 'Pulmo', '')) t(code, name, synonym)")
def str10(spark, sf):
    return V.prune_synonyms(_vocab(spark))


@query("str12_dictionary_match", "SELECT doc_id, array_to_string(list_transform(list_sort(array_agg(printf('%06d', CAST(pos AS INTEGER)) || term)), lambda x: x[7:]), ';') AS candidates FROM (SELECT doc_id, term, min(strpos(g, ' ' || term || ' ')) AS pos FROM (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS g FROM documents) d, (VALUES ('the and'), ('of the'), ('que'), ('der')) k(term) WHERE contains(g, ' ' || term || ' ') GROUP BY doc_id, term) t GROUP BY doc_id")
def str12(spark, sf):
    terms = spark.createDataFrame([("the and",), ("of the",), ("que",), ("der",)], "term string")
    return R.dictionary_matches(table(spark, sf, "documents"), "doc_id", "text", terms).select("doc_id", F.array_join("candidates", ";").alias("candidates"))


@query("str13_regex_tokens", "SELECT DISTINCT doc_id, lower(t) AS token FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]{4,}')) AS t FROM documents) d WHERE lower(t) IN ('with', 'that', 'pour', 'nicht')")
def str13(spark, sf):
    known = spark.createDataFrame([("with",), ("that",), ("pour",), ("nicht",)], "token string")
    t = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]{4,}"), 0)).alias("t")).select("doc_id", F.lower("t").alias("token"))
    return t.join(known, "token", "left_semi").distinct()


# --- provenance merge and cross-field rules -------------------------------------------------------------------------

def _layers(spark, sf):
    i = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", S.pick(i, ["male", "", "unknown"]).alias("db_sex"), S.pick(i, ["female", "n/a", "none", "male"]).alias("llm_sex"), S.pick(i, ["", "female", "unknown", "", "male"]).alias("entity_sex"))


_LAYERS = f"(SELECT doc_id, nullif(nullif({S.pick_sql('doc_id', ['male', '', 'unknown'])}, ''), 'unknown') AS a, nullif(nullif({S.pick_sql('doc_id', ['female', 'n/a', 'none', 'male'])}, 'n/a'), 'none') AS b, nullif(nullif({S.pick_sql('doc_id', ['', 'female', 'unknown', '', 'male'])}, ''), 'unknown') AS c FROM documents) t"


@query("cur1_precedence", f"SELECT doc_id, coalesce(a, b, c) AS sex, CASE WHEN a IS NOT NULL THEN 'db' WHEN b IS NOT NULL THEN 'llm' WHEN c IS NOT NULL THEN 'entity' END AS sex_source FROM {_LAYERS}")
def cur1(spark, sf):
    return C.merge_layers(_layers(spark, sf), ["sex"], ["db", "llm", "entity"])


@query("cur2_dependents", f"SELECT doc_id, treatment, CASE WHEN treatment = 'unknown' THEN 'not applicable' ELSE lang END AS response FROM (SELECT doc_id, lang, {S.pick_sql('doc_id', S.TREATMENTS)} AS treatment FROM documents) t")
def cur2(spark, sf):
    return C.dependent_reset(table(spark, sf, "documents").select("doc_id", S.pick(F.col("doc_id"), S.TREATMENTS).alias("treatment"), F.col("lang").alias("response")), "treatment", ["response"])


@query("cur3_codes", f"SELECT doc_id, CASE WHEN lower(trim(v)) IN {S.in_sql(T.POLICIES['normalisation'])} THEN 'unknown' ELSE 'C1' END AS code FROM (SELECT doc_id, {S.pick_sql('doc_id', S.SYNONYMS)} AS v FROM documents) t")
def cur3(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", S.pick(F.col("doc_id"), S.SYNONYMS).alias("v"), F.lit("C1").alias("code"))
    return C.consistent_codes(d, {"code": "v"}).select("doc_id", "code")


@query("cur4_restore", f"SELECT doc_id, coalesce(a, b) AS sex, CASE WHEN a IS NOT NULL THEN 'db' WHEN b IS NOT NULL THEN 'llm' END AS sex_source FROM {_LAYERS}")
def cur4(spark, sf):
    d = _layers(spark, sf)
    return C.restore_database(d.select("doc_id", "db_sex", T.missing_to_null(F.col("llm_sex")).alias("sex"), F.when(~T.is_missing(F.col("llm_sex")), "llm").alias("sex_source")), ["sex"]).drop("db_sex")


@query("cur5_masked_confidence", "SELECT event_id, CASE WHEN event_type = 'click' THEN printf('%.6f', value) ELSE 'not applicable' END AS nll FROM events")
def cur5(spark, sf):
    d = table(spark, sf, "events").select("event_id", F.col("value").alias("nll"), F.when(F.col("event_type") == "click", "llm").otherwise("db").alias("sex_source"))
    return C.mask_confidence(d, {"nll": "sex"}).select("event_id", "nll")


@query("cur6_age_evidence", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '40Y' WHEN doc_id % 4 = 1 THEN 'unknown' ELSE '40Y' END AS age FROM documents")
def cur6(spark, sf):
    k = F.col("doc_id") % 4
    d = table(spark, sf, "documents").select("doc_id", F.lit("40Y").alias("age"), F.when(k == 2, "db").otherwise("llm").alias("age_source"), F.when(k == 1, "a 41 years old man").when(k == 3, "age: 40").otherwise("40 years old").alias("summary"))
    return C.check_ages(d).select("doc_id", "age")


@query("cur7_gates", f"SELECT doc_id, CASE WHEN v IN ('PolyA', 'other') THEN v ELSE '' END AS v FROM (SELECT doc_id, {S.pick_sql('doc_id', S.VALUES)} AS v FROM documents) t")
def cur7(spark, sf):
    return C.gate(table(spark, sf, "documents").select("doc_id", S.pick(F.col("doc_id"), S.VALUES).alias("v")), {"v": ["PolyA", "other"]})


@query("cur8_ambiguity", f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'a;b' ELSE v END AS candidates FROM {_CELLSQL} t WHERE doc_id % 4 = 0 OR lower(trim(v)) NOT IN ({', '.join(repr(n.lower()) for _, n, _ in _VOCAB)})")
def cur8(spark, sf):
    d = _cells(spark, sf).withColumn("cands", F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")))
    return C.ambiguous_rows(d, "doc_id", "v", "cands", _vocab(spark))


@query("cur9_failed_rows", "SELECT doc_id FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0")
def cur9(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "error").otherwise("ok").alias("a"), F.when(F.col("doc_id") % 11 != 0, "ok").alias("b"))
    return C.failed_rows(d, ["a", "b"]).select("doc_id")


@query("cur10_inject_unknown")
def cur10(spark, sf):
    return C.inject_unknown(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id", {"lang": 0.2, "source": 0.1})
